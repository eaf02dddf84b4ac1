"""The logical tables of a storage fleet as projections of the given star-schema tables.

Each adapter is one SQL text for both engines, in integer arithmetic, so that a query and its oracle see equal rows. Times
are timestamps without a zone; `now` is a literal per source and never the clock.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quayside.plans.dialect import Duck, Spark

FILES_NOW = "2001-11-05 00:00:00"
EVENTS_NOW = "2024-01-31 00:00:00"
CHUNK = 8 * 1024 * 1024


def peers(d) -> str:
    return f"""
SELECT id, 'host-' || right(id, 5) || ':8081' AS address, 'host-' || right(id, 5) || ':9081' AS grpc_address, '/mnt/nvme' AS nvme_path,
  CAST((k * 7919) % 1000 AS BIGINT) * 1073741824 AS available_space, CAST((k * 104729) % 1000 AS BIGINT) * 1073741824 AS used_space,
  CASE WHEN k % 7 = 0 THEN 'inactive' ELSE 'active' END AS status,
  CASE WHEN k % 11 = 3 THEN NULL ELSE {d.at(EVENTS_NOW)} - {d.seconds("(k * 13) % 120")} END AS last_heartbeat,
  CAST(CASE WHEN k % 5 = 0 THEN 0 ELSE (k * 31) % 900 + 1 END AS DOUBLE) AS network_speed_mbps,
  CAST(CAST((k * 17) % 40 AS DOUBLE) / 4 AS DOUBLE) AS network_latency_ms,
  CASE WHEN n % 3 = 0 THEN 'gpu' WHEN n % 3 = 1 THEN 'cpu' ELSE 'io' END AS pool, CASE WHEN n % 2 = 0 THEN 'a' ELSE 'b' END AS zone,
  {d.labels(pool="CASE WHEN n % 3 = 0 THEN 'gpu' WHEN n % 3 = 1 THEN 'cpu' ELSE 'io' END", zone="CASE WHEN n % 2 = 0 THEN 'a' ELSE 'b' END")} AS labels
FROM (SELECT 'peer-' || lpad(CAST(s_suppkey AS {d.text}), 5, '0') AS id, s_suppkey AS k, s_nationkey AS n FROM {d.table("supplier")}) s"""


_PART = "CASE WHEN (l_orderkey + l_linenumber) % 10 = 0 THEN l_linenumber ELSE -1 END"


def _located(d, rows: str, seq: str, part: str = _PART, tier: str = "l_linenumber % 3") -> str:
    """Replica rows from rows of lineitem; seq, part and tier are columns or made of them."""
    return f"""
SELECT *, file_size > {CHUNK} AS is_chunked, {d.chunk_list("CASE WHEN file_size > " + str(CHUNK) + " THEN l_linenumber % 4 ELSE 0 END")} AS chunks
FROM (SELECT '/models/m' || CAST(l_partkey % 40 AS {d.text}) || '/f' || CAST(l_partkey AS {d.text}) || '.bin'
    || CASE WHEN {part} >= 0 THEN '_chunk_' || CAST({part} AS {d.text}) ELSE '' END AS file_path,
  'peer-' || lpad(CAST(l_suppkey AS {d.text}), 5, '0') AS peer_id,
  CASE {tier} WHEN 0 THEN 'cloud' WHEN 1 THEN 'nvme' ELSE 'peer' END AS storage_tier,
  '/mnt/' || CAST(l_partkey AS {d.text}) AS storage_path,
  CAST(CASE WHEN l_partkey % 50 = 7 THEN 0 ELSE ((l_partkey * 7919) % 1000) * 131072 + l_linenumber END AS BIGINT) AS file_size,
  l_shipdate AS last_accessed, CAST(CASE WHEN l_partkey % 9 = 0 THEN 0 ELSE {CHUNK} END AS BIGINT) AS chunk_size,
  CAST({seq} AS BIGINT) AS seq, l_linenumber
  FROM {rows}) l"""


def file_locations(d) -> str:
    return _located(d, d.table("lineitem"), "l_orderkey * 10 + l_linenumber")


def replicas(d) -> str:
    """The catalog after all upserts: per (path, peer, tier) the last row, at the place of the first. Rows are grouped by the
    numbers that paths, peers and tiers are made of; only those that stay get their texts."""
    n = "l_orderkey * 10 + l_linenumber"
    return _located(d, d.last_rows(d.table("lineitem"), n, _PART), "first_seq", "part", "tier")


def read_events(d) -> str:
    return f"""
SELECT event_id AS seq, ts, 'peer-' || lpad(CAST(user_id % 10 AS {d.text}), 5, '0') AS node,
  CASE event_id % 3 WHEN 0 THEN 'nvme' WHEN 1 THEN 'peer' ELSE 'cloud' END AS tier,
  'peer-' || lpad(CAST((user_id * 7 + event_id) % 10 AS {d.text}), 5, '0') AS peer_id,
  '/models/m' || CAST(event_id % 40 AS {d.text}) || '/f' || CAST(event_id % 200 AS {d.text}) || '.bin' AS path,
  CAST(event_id % 7 AS BIGINT) AS chunk_index, CAST(CASE WHEN event_id % 53 = 0 THEN 0 ELSE (event_id % 64 + 1) * 131072 END AS BIGINT) AS bytes,
  CAST(CASE WHEN event_id % 97 = 0 THEN -1 ELSE round(value * 100) * 10000 END AS BIGINT) AS nanos,
  CASE event_type WHEN 'error' THEN 'error' WHEN 'signup' THEN 'miss' WHEN 'click' THEN 'busy' ELSE 'ok' END AS outcome
FROM {d.table("events")}"""


def remote_reads(d) -> str:
    return f"""
SELECT event_id AS seq, ts, 'peer-' || lpad(CAST(user_id % 10 AS {d.text}), 5, '0') AS node,
  '/models/m' || CAST(event_id % 40 AS {d.text}) || '/f' || CAST(event_id % 200 AS {d.text}) || '.bin'
    || CASE WHEN event_id % 4 = 0 THEN '_chunk_' || CAST(event_id % 7 AS {d.text}) ELSE '' END AS path,
  '10.0.0.' || CAST(user_id AS {d.text}) || ':' || CAST(40000 + event_id % 1000 AS {d.text}) AS reader
FROM {d.table("events")}"""


def range_reads(d) -> str:
    return f"""
SELECT event_id AS seq, ts, '/models/m0/u' || CAST(user_id % 25 AS {d.text}) || '.bin' AS path,
  CAST({d.div("event_id", "25")} % 50 AS BIGINT) * 1048576 AS offset, CAST(1048576 AS BIGINT) AS size
FROM {d.table("events")}"""


def cache_entries(d) -> str:
    return f"""
SELECT '/orders/o' || CAST(CASE WHEN o_orderkey % 8 = 5 THEN o_orderkey - 3 ELSE o_orderkey END AS {d.text}) || '.bin' || CASE WHEN o_orderkey % 8 = 5 THEN '_chunk_' || CAST(o_orderkey % 3 AS {d.text}) ELSE '' END AS file_path,
  CAST(round(o_totalprice * 100) AS BIGINT) AS size, o_orderdate AS last_accessed,
  CASE o_orderkey % 4 WHEN 0 THEN 'peer' WHEN 1 THEN 'cloud' ELSE 'nvme' END AS tier, o_orderkey % 6 = 2 AS is_chunked,
  CAST(CASE WHEN o_orderkey % 6 = 2 THEN 3 ELSE 0 END AS BIGINT) AS num_chunks, CAST(65536 AS BIGINT) AS chunk_size,
  o_orderstatus = 'F' AS persisted, o_orderpriority AS priority
FROM {d.table("orders")}"""


def objects(d) -> str:
    return f"""SELECT '/docs/' || coalesce(lang, 'none') || '/' || CAST(doc_id AS {d.text}) || '.txt' AS path, text, length(text) AS length FROM {d.table("documents")}"""


def lease_requests(d) -> str:
    return f"""
SELECT event_id AS seq, {d.div(d.micros("ts"), "100")} AS ts_us, 'key-' || CAST(event_id % 25 AS {d.text}) AS key, 'peer-' || CAST(user_id % 4 AS {d.text}) AS peer_id,
  CASE WHEN event_id % 3 = 0 THEN 'release' ELSE 'acquire' END AS op, CAST((event_id % 5) * 30000000 AS BIGINT) AS ttl_ms
FROM {d.table("events")}"""


def sessions(d) -> str:
    return f"""
SELECT event_id AS seq, 'vol-' || CAST(event_id % 25 AS {d.text}) AS volume_id, CASE WHEN (event_id * 7) % 10 < 5 THEN 'delete' ELSE 'create' END AS op,
  '/models/m' || CAST(event_id % 5 AS {d.text}) AS root_path, event_id % 2 = 0 AS pinned
FROM {d.table("events")}"""


def heartbeats(d) -> str:
    return f"""
SELECT event_id AS seq, ts, 'peer-' || lpad(CAST(user_id AS {d.text}), 5, '0') AS peer_id, CASE WHEN event_type = 'error' THEN 'inactive' ELSE 'active' END AS status,
  CAST(event_id * 4096 AS BIGINT) AS available_space, CAST(user_id * 8192 AS BIGINT) AS used_space,
  CAST(CASE WHEN event_id % 3 = 0 THEN 0 ELSE event_id % 900 END AS DOUBLE) AS network_speed_mbps,
  CAST(CASE WHEN event_id % 4 = 0 THEN 0 ELSE event_id % 37 END AS DOUBLE) AS network_latency_ms
FROM {d.table("events")}"""


def metric_lines(d) -> str:
    """Scrapes of a counter per event type, with comments and malformed lines among them."""
    value = f"CAST(sum(CAST(round(value * 100) AS BIGINT)) OVER (PARTITION BY event_type, {d.div('event_id', '5000')} ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS {d.text})"
    left, right, back = "chr(123)", "chr(125)", "chr(92)"
    return f"""
SELECT event_id AS line_no, ts, 'node-' || CAST(event_id % 3 AS {d.text}) AS node,
  CASE WHEN event_id % 31 = 0 THEN '# HELP fleet_reads_total reads' WHEN event_id % 37 = 0 THEN 'broken' || {left} || 'type="x' WHEN event_id % 41 = 0 THEN '   '
    WHEN event_id % 43 = 0 THEN 'fleet_load NaN' WHEN event_id % 47 = 0 THEN 'fleet_limit' || {left} || 'kind="a' || {back} || '"b=c",unit="x,y"' || {right} || ' +Inf 1700000000000'
    WHEN event_id % 5 = 0 THEN 'fleet_used_bytes ' || {value}
    ELSE 'fleet_reads_total' || {left} || 'type="' || event_type || '",tier="t' || CAST(event_id % 2 AS {d.text}) || '"' || {right} || ' ' || {value} END AS line
FROM {d.table("events")}"""


def disks(d) -> str:
    return f"""
SELECT CAST(p_partkey AS BIGINT) AS seq, '/mnt/d' || CAST(p_partkey AS {d.text}) AS mount_point,
  CASE p_partkey % 5 WHEN 0 THEN '/dev/nvme' || CAST(p_partkey % 8 AS {d.text}) || 'n1p2' WHEN 1 THEN '/dev/sda' || CAST(p_partkey % 9 AS {d.text})
    WHEN 2 THEN '/dev/mmcblk0p1' WHEN 3 THEN '/dev/xvdb1' ELSE 'tmpfs' END AS device,
  CASE p_partkey % 6 WHEN 0 THEN 'ext4' WHEN 1 THEN 'xfs' WHEN 2 THEN 'tmpfs' WHEN 3 THEN 'btrfs' WHEN 4 THEN 'overlay' ELSE 'ext4' END AS filesystem_type,
  CASE p_partkey % 4 WHEN 0 THEN 'nvme' WHEN 1 THEN 'ssd' WHEN 2 THEN 'disk' ELSE 'unknown' END AS disk_class,
  CAST(p_size AS BIGINT) * 10737418240 AS total_bytes, CAST((p_size * 37) % 50 AS BIGINT) * 1073741824 AS free_bytes,
  CAST(round(p_retailprice) AS DOUBLE) AS write_mbps, CAST(round(p_retailprice * 2) AS DOUBLE) AS read_mbps
FROM {d.table("part")}"""


def warm_jobs(d) -> str:
    return f"""
SELECT event_id AS seq, 'job-' || CAST({d.div("event_id", "8")} AS {d.text}) AS id, ts AS updated_at,
  CASE WHEN event_id % 8 < 6 THEN 'running' WHEN user_id % 3 = 0 THEN 'failed' ELSE 'done' END AS status,
  CAST(event_id % 8 + 1 AS BIGINT) AS files, CAST(event_id % 8 AS BIGINT) AS done,
  CASE event_type WHEN 'error' THEN 'failed' WHEN 'click' THEN 'already_local' WHEN 'signup' THEN 'skipped' ELSE 'warmed' END AS outcome,
  CAST((event_id % 64 + 1) * 131072 AS BIGINT) AS bytes
FROM {d.table("events")}"""


ADAPTERS: dict[str, tuple[Callable[[object], str], tuple[str, ...]]] = {
    "peers": (peers, ("supplier",)),
    "file_locations": (file_locations, ("lineitem",)),
    "replicas": (replicas, ("lineitem",)),
    "read_events": (read_events, ("events",)),
    "remote_reads": (remote_reads, ("events",)),
    "range_reads": (range_reads, ("events",)),
    "cache_entries": (cache_entries, ("orders",)),
    "objects": (objects, ("documents",)),
    "lease_requests": (lease_requests, ("events",)),
    "sessions": (sessions, ("events",)),
    "heartbeats": (heartbeats, ("events",)),
    "metric_lines": (metric_lines, ("events",)),
    "disks": (disks, ("part",)),
    "warm_jobs": (warm_jobs, ("events",)),
}


def logical(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    make, tables = ADAPTERS[name]
    return spark.sql(make(Spark), **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables})


def oracle(body: str, *names: str) -> str:
    """The oracle's SQL: body, which starts with SELECT or with its own common tables after a comma, over these tables."""
    ctes = ",\n".join(f"{n} AS ({ADAPTERS[n][0](Duck)})" for n in names)
    return f"WITH RECURSIVE {ctes}{body if body.lstrip().startswith(',') else chr(10) + body}"
