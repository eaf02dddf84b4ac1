"""Queries of selection, ranking, ordered computations and decisions (survey 2.E, 2.F, 2.I batch twins, 2.L), with oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quayside.functions import scalars as S
from quayside.operators import catalog as K
from quayside.operators import ordered as O
from quayside.operators import selection as P
from quayside.plans.queries_catalog import at
from quayside.sources.adapters import CHUNK, EVENTS_NOW, FILES_NOW, logical, oracle

c = F.col
QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str, *tables: str):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = oracle(sql, *tables)
        return f

    return add


def same(name: str, as_: str) -> None:
    """Another name of a query."""
    QUERIES[name], ORACLES[name] = QUERIES[as_], ORACLES[as_]


def _fnv(x: str) -> str:
    return f"CAST(list_reduce(list_prepend(CAST(2166136261 AS HUGEINT), list_transform(string_split({x}, ''), lambda q: CAST(ascii(q) AS HUGEINT))), lambda h, b: (xor(h, b) * 16777619) & 4294967295) AS BIGINT)"


@query(
    f""", live AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS i, count(*) OVER () AS n FROM peers WHERE status = 'active' AND (last_heartbeat IS NULL OR last_heartbeat >= TIMESTAMP '{EVENTS_NOW}' - to_seconds(75)) AND pool = 'gpu')
SELECT id FROM live WHERE ((i - {_fnv("'/models/m1'")} % n) % n + n) % n < greatest(1, ceil(n * 34 / 100))""",
    "peers",
)
def f1_warm_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """F1, U2, F6, F7."""
    return P.warm_nodes(logical(spark, sf, "peers"), at(EVENTS_NOW), "/models/m1", 34, {"pool": "gpu"}).select("id")


@query(
    f"SELECT id, s AS score, CAST(row_number() OVER (ORDER BY s DESC, {_fnv("'/a#' || id")}, id) AS INTEGER) AS rank FROM (SELECT id, CASE WHEN network_speed_mbps > 0 THEN network_speed_mbps ELSE 100 END / CASE WHEN network_latency_ms > 0 THEN network_latency_ms ELSE 1 END AS s FROM peers)",
    "peers",
)
def f2_network_rank(spark: SparkSession, sf: str) -> DataFrame:
    """F2, F16, W2."""
    return P.rank_by_network(logical(spark, sf, "peers"), "/a").select("id", "score", "rank")


_PAIRS = """, smp AS (SELECT node, peer_id, ts, seq, nanos / 1e6 AS ms, outcome = 'ok' AS ok FROM read_events WHERE tier = 'peer' AND outcome IN ('ok', 'error')),
pair AS (SELECT node, peer_id, list_reduce(list(ms ORDER BY ts, seq), lambda a, x: 0.3 * x + 0.7 * a) AS latency_ms, list_reduce(list(CAST(ok AS DOUBLE) ORDER BY ts, seq), lambda a, x: 0.3 * x + 0.7 * a) AS success, count(*) AS samples FROM smp GROUP BY node, peer_id)"""


def _samples(spark: SparkSession, sf: str) -> DataFrame:
    t = logical(spark, sf, "read_events").where("outcome <> 'busy'")
    return t.select("node", "tier", "peer_id", "ts", "seq", (c("nanos") / 1e6).alias("ms"), (c("outcome") == "ok").alias("ok"), (c("outcome") == "miss").alias("miss"))


@query(_PAIRS + " SELECT node, peer_id, round(latency_ms, 6) AS latency_ms, round(success, 6) AS success, samples FROM pair", "read_events")
def w2_pair_latency(spark: SparkSession, sf: str) -> DataFrame:
    """W2, C13, G18, I5."""
    t = O.ewma(_samples(spark, sf).where("tier = 'peer' AND NOT miss"), ["node", "peer_id"])
    return t.select("node", "peer_id", F.round("latency_ms", 6).alias("latency_ms"), F.round("success", 6).alias("success"), "samples")


@query(
    _PAIRS + """ SELECT node, p.id, coalesce(samples, 0) AS samples, round(CASE WHEN samples >= 3 THEN success ELSE 1 END / greatest(0.5, CASE WHEN samples >= 3 THEN latency_ms WHEN network_latency_ms > 0 THEN network_latency_ms ELSE 5 END), 6) AS score
FROM peers p LEFT JOIN pair q ON p.id = q.peer_id""",
    "read_events", "peers",
)
def f3_pair_scores(spark: SparkSession, sf: str) -> DataFrame:
    """each node's scores of the peers that it has samples of; peers without any stand with no node."""
    own = O.ewma(_samples(spark, sf).where("tier = 'peer' AND NOT miss"), ["node", "peer_id"])
    t = logical(spark, sf, "peers").join(own.withColumnRenamed("peer_id", "id"), "id", "left")
    return t.select("node", "id", F.coalesce("samples", F.lit(0)).alias("samples"), F.round(P.pair_score(c("latency_ms"), c("success"), c("samples"), c("network_latency_ms")), 6).alias("score"))


@query(
    f""", cand AS (SELECT DISTINCT file_path AS path, peer_id AS id FROM replicas WHERE storage_tier <> 'cloud'),
n AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY id) - 1 AS i, count(*) OVER (PARTITION BY path) AS n, coalesce(TRY_CAST(nullif(regexp_extract(path, '_chunk_([0-9]+)$', 1), '') AS BIGINT), {_fnv("path")}) AS o FROM cand)
SELECT path, id, CAST(((i - o) % n + n) % n AS INTEGER) AS rank FROM n WHERE ((i - o) % n + n) % n < 2""",
    "replicas",
)
def f4_rotation_of_all_paths(spark: SparkSession, sf: str) -> DataFrame:
    """over all paths."""
    t = K.holders(logical(spark, sf, "replicas")).select(c("file_path").alias("path"), c("peer_id").alias("id")).distinct()
    return P.rotate(t, "id", P.rotation_start(c("path"))).where("rank < 2").select("path", "id", "rank")


same("f4_rotation", "f4_rotation_of_all_paths")


@query(
    """SELECT id, available_space / 1073741824 * (CASE WHEN network_speed_mbps > 0 THEN network_speed_mbps ELSE 100 END / CASE WHEN network_latency_ms > 0 THEN network_latency_ms ELSE 1 END) AS score FROM peers WHERE status = 'active'
ORDER BY score DESC, md5('1:' || id) LIMIT 5""",
    "peers",
)
def f5_replication_targets(spark: SparkSession, sf: str) -> DataFrame:
    """F5, A9."""
    return P.replication_targets(logical(spark, sf, "peers"), 5)


_DISK = """, ok AS (SELECT * FROM disks WHERE filesystem_type IN ('ext4', 'ext3', 'ext2', 'xfs', 'btrfs', 'f2fs') AND starts_with(device, '/dev/') AND free_bytes >= 2147483648),
sc AS (SELECT *, CASE disk_class WHEN 'nvme' THEN 1000 WHEN 'ssd' THEN 400 WHEN 'disk' THEN 50 ELSE 100 END + CASE WHEN free_bytes >= 1073741824 THEN 10 * (floor(log2(free_bytes / 1073741824)) + 1) ELSE 0 END + 25.0 AS base FROM ok)"""


@query(_DISK + " SELECT mount_point, round(base + (write_mbps + read_mbps) / 200, 6) AS score, CAST(row_number() OVER (ORDER BY base + (write_mbps + read_mbps) / 200 DESC, free_bytes DESC, mount_point) AS INTEGER) AS rank FROM sc", "disks")
def f8_disk_rank(spark: SparkSession, sf: str) -> DataFrame:
    """F8, G13."""
    return P.rank_disks(P.eligible_mounts(logical(spark, sf, "disks"))).select("mount_point", F.round("score", 6).alias("score"), "rank")


@query(_DISK + ", top AS (SELECT * FROM sc ORDER BY base DESC, free_bytes DESC, mount_point LIMIT 3) SELECT mount_point, CAST(base + (write_mbps + read_mbps) / 200 AS DOUBLE) AS score FROM top ORDER BY 2 DESC, free_bytes DESC, mount_point LIMIT 1", "disks")
def f9_disk_pick(spark: SparkSession, sf: str) -> DataFrame:
    """F9, A29."""
    return P.pick_disk(P.eligible_mounts(logical(spark, sf, "disks"))).select("mount_point", "score")


@query("SELECT arg_min(id, id) AS id, arg_min(address, id) AS address FROM peers WHERE status = 'active' AND address <> ''", "peers")
def f11_probe_target(spark: SparkSession, sf: str) -> DataFrame:
    """F11, A25."""
    t = K.active_peers(logical(spark, sf, "peers")).where("address <> ''")
    return t.agg(F.min("id").alias("id"), F.min_by("address", "id").alias("address"))


@query("SELECT device, arg_min(mount_point, seq) AS mount_point FROM disks GROUP BY device", "disks")
def u8_one_per_device(spark: SparkSession, sf: str) -> DataFrame:
    """U8."""
    return P.one_per_device(logical(spark, sf, "disks"))


@query(
    """, dev AS (SELECT DISTINCT CASE WHEN device LIKE '/dev/nvme%' THEN regexp_replace(device[6:], 'p[0-9]+$', '') WHEN device LIKE '/dev/sda%' THEN 'sda' WHEN device LIKE '/dev/xvd%' THEN 'xvdb' END AS name, seq FROM disks)
SELECT DISTINCT name FROM dev WHERE name IS NOT NULL AND seq % 3 = 0 AND name NOT IN (SELECT name FROM dev WHERE seq % 40 = 1 AND name IS NOT NULL)""",
    "disks",
)
def g14_raw_disks(spark: SparkSession, sf: str) -> DataFrame:
    """G14, H31."""
    t = logical(spark, sf, "disks")
    devices = t.select(S.disk_name(c("device")).alias("name"), F.when(c("seq") % 3 == 0, "").otherwise("ext4").alias("filesystem")).distinct()
    return P.raw_disks(devices, t.where("seq % 40 = 1")).select("name").distinct()


_TIERS = """, smp AS (SELECT node, tier, ts, seq, nanos / 1e6 AS ms, outcome FROM read_events WHERE tier IN ('peer', 'cloud') AND outcome <> 'busy'),
tiers AS (SELECT node, tier, list_reduce(list(ms ORDER BY ts, seq) FILTER (outcome <> 'miss'), lambda a, x: 0.3 * x + 0.7 * a) AS latency_ms, list_reduce(list(CASE WHEN outcome = 'ok' THEN 1.0::DOUBLE ELSE 0 END ORDER BY ts, seq) FILTER (outcome <> 'miss'), lambda a, x: 0.3 * x + 0.7 * a) AS success,
  count(*) FILTER (outcome <> 'miss') AS samples, count(*) FILTER (outcome = 'miss') AS misses, max(ts) FILTER (outcome <> 'miss') AS last_at FROM smp GROUP BY node, tier)"""


def _tiers(spark: SparkSession, sf: str) -> DataFrame:
    return O.ewma(_samples(spark, sf).where("tier IN ('peer', 'cloud')"), ["node", "tier"])


@query(_TIERS + " SELECT node, tier, round(latency_ms, 6) AS latency_ms, round(success, 6) AS success, samples, misses FROM tiers", "read_events")
def w1_tier_ewma(spark: SparkSession, sf: str) -> DataFrame:
    """W1, I5, D21."""
    return _tiers(spark, sf).select("node", "tier", F.round("latency_ms", 6).alias("latency_ms"), F.round("success", 6).alias("success"), "samples", "misses")


@query(
    _TIERS + f""", s AS (SELECT *, CASE WHEN last_at < TIMESTAMP '{EVENTS_NOW}' - to_seconds(30) AND success < 0.7 THEN 0.7 ELSE success END / greatest(latency_ms, 0.5) AS score FROM tiers),
w AS (SELECT p.node, p.score AS ps, q.score AS cs, p.success AS pok, q.success AS cok, coalesce(p.samples, 0) >= 3 AND coalesce(q.samples, 0) >= 3 AS known FROM (SELECT * FROM s WHERE tier = 'peer') p FULL JOIN (SELECT * FROM s WHERE tier = 'cloud') q USING (node))
SELECT node, CASE WHEN known AND cs > ps THEN 'cloud' ELSE 'peer' END AS first_tier, CASE WHEN known THEN (CASE WHEN cs > ps THEN cok ELSE pok END < 0.85) OR (greatest(ps, cs) > 0 AND least(ps, cs) >= greatest(ps, cs) * 0.75) END AS hedge,
  CASE WHEN NOT known THEN 'none' WHEN cs > ps THEN 'cloud' ELSE 'peer' END AS measured FROM w""",
    "read_events",
)
def l1_tier_choice(spark: SparkSession, sf: str) -> DataFrame:
    """L1, L2, D21."""
    return O.tier_choice(_tiers(spark, sf), at(EVENTS_NOW))


_STREAK = """, l AS (SELECT *, lag("offset" + size) OVER (PARTITION BY path ORDER BY seq) AS was FROM range_reads), m AS (SELECT *, coalesce(was > 0 AND abs("offset" - was) <= 1048576, false) AS follows FROM l),
i AS (SELECT *, sum(CASE WHEN follows THEN 0 ELSE 1 END) OVER (PARTITION BY path ORDER BY seq ROWS UNBOUNDED PRECEDING) AS g FROM m), st AS (SELECT path, seq, row_number() OVER (PARTITION BY path, g ORDER BY seq) - 1 AS streak FROM i)"""


@query(_STREAK + " SELECT path, seq, CAST(streak AS INTEGER) AS streak, least(2 * (1 << least(streak, 40)), CASE WHEN streak >= 3 THEN greatest(8, least(8 * 4, 24, 50)) ELSE 8 END) AS ahead FROM st", "range_reads")
def w3_readahead(spark: SparkSession, sf: str) -> DataFrame:
    """W3, W4."""
    t = O.sequential_streaks(logical(spark, sf, "range_reads"), S.MIB)
    return t.select("path", "seq", "streak", O.readahead(c("streak"), 2, 8, F.lit(50).cast("bigint"), 24, long=3).alias("ahead"))


_EVICT = """, e AS (SELECT file_path, size, last_accessed, priority = '1-URGENT' AS pinned, persisted AS safe FROM cache_entries WHERE tier = 'nvme'), u AS (SELECT sum(size) AS used FROM e)"""


@query(
    _EVICT + " SELECT file_path, size, freed_before FROM (SELECT *, CAST(coalesce(sum(size) OVER (ORDER BY last_accessed, file_path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS freed_before FROM e WHERE NOT pinned AND safe), u WHERE freed_before < used - used * 75 // 100",
    "cache_entries",
)
def w5_evict(spark: SparkSession, sf: str) -> DataFrame:
    """Down to 75 % of what is used now."""
    e = logical(spark, sf, "cache_entries").where("tier = 'nvme'").select("file_path", "size", "last_accessed", (c("priority") == "1-URGENT").alias("pinned"), c("persisted").alias("safe"))
    e = e.crossJoin(F.broadcast(e.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("used"))))  # one row
    return O.evict_globally(e, c("used"), F.expr("used * 75 div 100")).select("file_path", "size", "freed_before")


@query(
    """, cloud AS (SELECT file_path AS path, min(size) AS size FROM cache_entries WHERE tier = 'cloud' GROUP BY file_path), own AS (SELECT file_path, size, is_chunked, num_chunks, chunk_size, persisted FROM cache_entries WHERE tier <> 'cloud')
SELECT file_path, size, persisted OR CASE WHEN is_chunked THEN coalesce((SELECT true FROM cloud WHERE path = file_path || '_chunk_0') AND (SELECT size FROM cloud WHERE path = file_path || '_chunk_' || (num_chunks - 1)) = own.size - (num_chunks - 1) * chunk_size, false)
  ELSE coalesce((SELECT size FROM cloud WHERE path = file_path) = own.size, false) END AS safe FROM own""",
    "cache_entries",
)
def g11_evict_safe(spark: SparkSession, sf: str) -> DataFrame:
    """G11, A10."""
    t = logical(spark, sf, "cache_entries")
    objects = t.where("tier = 'cloud'").groupBy("file_path").agg(F.min("size").alias("cloud_size"))
    return evict_safe(t.where("tier <> 'cloud'"), objects).select("file_path", "size", "safe")


def evict_safe(entries: DataFrame, objects: DataFrame) -> DataFrame:
    """A durable copy is known, or the object store has one of the same size; of chunked files the first chunk and a last
    one of the right size."""
    of = lambda name: objects.select(c("file_path").alias(f"{name}_path"), c("cloud_size").alias(name))
    out = entries.join(of("whole"), c("whole_path") == c("file_path"), "left")
    out = out.join(of("first"), c("first_path") == S.chunk_path(c("file_path"), F.lit(0)), "left")
    out = out.join(of("last"), c("last_path") == S.chunk_path(c("file_path"), c("num_chunks") - 1), "left")
    chunked = c("first").isNotNull() & (c("last") == c("size") - (c("num_chunks") - 1) * c("chunk_size"))
    safe = c("persisted") | F.coalesce(F.when(c("is_chunked"), chunked).otherwise(c("whole") == c("size")), F.lit(False))
    return out.withColumn("safe", safe)


@query(
    """, s AS (SELECT node, tier, ts, seq, sum(bytes) OVER (PARTITION BY node, tier, seq // 3000 ORDER BY seq ROWS UNBOUNDED PRECEDING) AS value FROM read_events), d AS (SELECT *, lag(value) OVER (PARTITION BY node, tier ORDER BY ts, seq) AS was FROM s),
r AS (SELECT *, CASE WHEN was IS NULL THEN 0 WHEN value < was THEN value ELSE value - was END AS rise, epoch_us(ts) // 1000000 AS sec FROM d)
SELECT node, tier, seq, sum(rise) OVER (PARTITION BY node, tier ORDER BY sec RANGE BETWEEN 3599 PRECEDING AND CURRENT ROW) / 3600 AS rate FROM r""",
    "read_events",
)
def w6_counter_rate(spark: SparkSession, sf: str) -> DataFrame:
    """An hour's rate of counters that start anew."""
    from pyspark.sql import Window

    w = Window.partitionBy("node", "tier", F.expr("seq div 3000")).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    t = logical(spark, sf, "read_events").select("node", "tier", "ts", "seq", c("seq").alias("line_no"), F.sum("bytes").over(w).cast("double").alias("value"))
    return O.counter_rate(t, ["node", "tier"], 3600).select("node", "tier", "seq", "rate")


@query(
    """, f AS (SELECT path, chunk_index, min(seq) AS seq, arg_max(bytes, seq) AS bytes FROM read_events GROUP BY ALL), n AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY seq DESC) AS n, sum(bytes) OVER (PARTITION BY path ORDER BY seq DESC ROWS UNBOUNDED PRECEDING) AS b FROM f)
SELECT path, chunk_index, seq, bytes FROM n WHERE n <= 4 AND b <= 16777216""",
    "read_events",
)
def w7_fifo_kept(spark: SparkSession, sf: str) -> DataFrame:
    """W7, D20."""
    return O.fifo_kept(logical(spark, sf, "read_events"), 4, 16 * S.MIB)


@query(
    """, f AS (SELECT path, CAST(sum(bytes) AS BIGINT) AS bytes, max(ts) AS last_access FROM read_events GROUP BY path), h AS (SELECT *, sum(bytes) OVER (ORDER BY path <> '/models/m3/f3.bin', last_access DESC, path ROWS UNBOUNDED PRECEDING) AS held FROM f)
SELECT path, bytes, CAST(held AS BIGINT) AS held FROM h WHERE held <= 4294967296 OR path = '/models/m3/f3.bin'""",
    "read_events",
)
def w8_lru_files(spark: SparkSession, sf: str) -> DataFrame:
    """W8, H28."""
    t = logical(spark, sf, "read_events").groupBy("path").agg(F.sum("bytes").alias("bytes"), F.max("ts").alias("last_access"))
    return O.lru_files_kept(t, 4 * S.GIB, "/models/m3/f3.bin").select("path", "bytes", "held")


@query(
    f""", h AS (SELECT file_path, count(DISTINCT peer_id) AS holders, max(last_accessed) AS last_accessed, max(file_size) AS size FROM replicas WHERE storage_tier <> 'cloud' AND NOT regexp_matches(file_path, '_chunk_[0-9]+$') GROUP BY file_path HAVING max(last_accessed) >= TIMESTAMP '{FILES_NOW}' - to_days(200) AND max(file_size) BETWEEN 1 AND 67108864),
r AS (SELECT path AS file_path, count(DISTINCT split_part(reader, ':', 1)) AS readers FROM (SELECT regexp_replace(path, '_chunk_[0-9]+$', '') AS path, reader, ts FROM remote_reads) WHERE ts > TIMESTAMP '{EVENTS_NOW}' - to_days(20) AND ts <= TIMESTAMP '{EVENTS_NOW}' GROUP BY path),
d AS (SELECT file_path, last_accessed, greatest(0, least(25 + coalesce(readers, 0) // 2, 40) - holders) AS deficit FROM h LEFT JOIN r USING (file_path)), s AS (SELECT *, coalesce(sum(deficit) OVER (ORDER BY last_accessed DESC, file_path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent FROM d WHERE deficit > 0)
SELECT file_path, deficit, CAST(greatest(0, least(deficit, 60 - spent)) AS BIGINT) AS copies FROM s WHERE spent < 60""",
    "replicas", "remote_reads",
)
def l8_reconcile(spark: SparkSession, sf: str) -> DataFrame:
    """Hot files with fewer holders than their readers call for, within a run's budget."""
    t = K.holders(logical(spark, sf, "replicas")).where(S.parent_path(c("file_path")).isNull())
    hot = t.groupBy("file_path").agg(F.countDistinct("peer_id").alias("holders"), F.max("last_accessed").alias("last_accessed"), F.max("file_size").alias("size"))
    hot = hot.where(K.is_hot(at(FILES_NOW), 200 * 1440, "size"))
    readers = O.recent_readers(logical(spark, sf, "remote_reads"), at(EVENTS_NOW), 20 * 1440).withColumnRenamed("path", "file_path")
    want = S.heat_target(F.lit(25).cast("bigint"), F.coalesce("readers", F.lit(0)), most=40)
    need = hot.join(readers, "file_path", "left").withColumn("deficit", F.greatest(F.lit(0).cast("bigint"), want - c("holders")))
    return O.reconcile(need, 60).select("file_path", "deficit", "copies")


@query(f"SELECT regexp_replace(path, '_chunk_[0-9]+$', '') AS path, count(DISTINCT split_part(reader, ':', 1)) AS readers FROM remote_reads WHERE ts > TIMESTAMP '{EVENTS_NOW}' - to_days(3) AND ts <= TIMESTAMP '{EVENTS_NOW}' GROUP BY 1", "remote_reads")
def d8_recent_readers(spark: SparkSession, sf: str) -> DataFrame:
    """The exact batch twin of the sliding window."""
    return O.recent_readers(logical(spark, sf, "remote_reads"), at(EVENTS_NOW), 3 * 1440)


@query(
    """, r AS (SELECT path, seq, epoch_us(ts) AS t, row_number() OVER (PARTITION BY path ORDER BY ts, seq) AS i FROM read_events),
f AS (SELECT path, i, seq, t AS last, true AS ok FROM r WHERE i = 1 UNION ALL SELECT r.path, r.i, r.seq, CASE WHEN r.t - f.last >= 129600000000 THEN r.t ELSE f.last END, r.t - f.last >= 129600000000 FROM f JOIN r ON r.path = f.path AND r.i = f.i + 1)
SELECT path, seq FROM f WHERE ok""",
    "read_events",
)
def w10_admitted(spark: SparkSession, sf: str) -> DataFrame:
    """At most one in 36 hours of each file."""
    t = logical(spark, sf, "read_events").select("path", "seq", F.timestamp_diff("MICROSECOND", at("1970-01-01 00:00:00"), c("ts")).alias("ts_us"))
    return O.admitted(t, ["path"], 129_600_000_000)


@query(
    """, a AS (SELECT path, max(chunk_index) % 5 AS e FROM read_events GROUP BY path), c AS (SELECT DISTINCT path, chunk_index * 3 AS chunk_index FROM read_events WHERE outcome = 'ok'),
n AS (SELECT path, unnest(range(e + 1, least(e + 6, 15) + 1)) AS chunk_index FROM a), m AS (SELECT * FROM n ANTI JOIN c USING (path, chunk_index))
SELECT path, chunk_index, reserved FROM (SELECT *, CAST(row_number() OVER (PARTITION BY path ORDER BY chunk_index) AS BIGINT) * 8388608 AS reserved FROM m) WHERE reserved <= 25165824""",
    "read_events",
)
def w12_prefetch(spark: SparkSession, sf: str) -> DataFrame:
    """W12."""
    t = logical(spark, sf, "read_events")
    asks = t.groupBy("path").agg((F.max("chunk_index") % 5).alias("end_chunk")).select("path", "end_chunk", F.lit(16).cast("bigint").alias("num_chunks"), F.lit(CHUNK).cast("bigint").alias("chunk_size"), F.lit(6).cast("bigint").alias("want"))
    cached = t.where("outcome = 'ok'").select("path", (c("chunk_index") * 3).alias("chunk_index")).distinct()
    return O.prefetch_reservation(asks, cached, 3 * CHUNK).select("path", "chunk_index", "reserved")


@query(
    """, k AS (SELECT path, chunk_index, seq, CASE outcome WHEN 'busy' THEN 'prefetch' WHEN 'error' THEN 'evict' ELSE 'read' END AS kind FROM read_events), n AS (SELECT *, lead(kind) OVER (PARTITION BY path, chunk_index ORDER BY seq) AS nx FROM k)
SELECT path, count(*) AS issued, count(*) FILTER (nx = 'read') AS hits, count(*) FILTER (nx = 'evict') AS wasted FROM n WHERE kind = 'prefetch' GROUP BY path""",
    "read_events",
)
def w13_prefetch_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    """W13, D20."""
    kind = F.when(c("outcome") == "busy", "prefetch").when(c("outcome") == "error", "evict").otherwise("read")
    return O.prefetch_outcomes(logical(spark, sf, "read_events").select("path", "chunk_index", "seq", kind.alias("kind")))


@query(
    """, r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq) AS i, CASE WHEN ttl_ms <= 0 THEN 10000 ELSE least(ttl_ms, 60000) END * 1000 AS ttl FROM lease_requests),
f(key, i, seq, holder, until, granted) AS (
  SELECT key, i, seq, CASE WHEN op = 'acquire' THEN peer_id END, CASE WHEN op = 'acquire' THEN ts_us + ttl ELSE 0 END, op = 'acquire' FROM r WHERE i = 1
  UNION ALL SELECT r.key, r.i, r.seq, CASE WHEN g THEN r.peer_id WHEN d THEN NULL ELSE h END, CASE WHEN g THEN ts_us + ttl WHEN d THEN 0 ELSE u END, g OR d
  FROM (SELECT r.*, f.holder AS h, f.until AS u, r.op = 'acquire' AND (f.holder IS NULL OR r.ts_us >= f.until OR f.holder = r.peer_id) AS g, r.op = 'release' AND coalesce(f.holder = r.peer_id, false) AS d FROM f JOIN r ON r.key = f.key AND r.i = f.i + 1) r)
SELECT key, seq, granted FROM f""",
    "lease_requests",
)
def i7_leases(spark: SparkSession, sf: str) -> DataFrame:
    """I7, H32, A13."""
    return O.leases(logical(spark, sf, "lease_requests"))


@query(
    """, r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq) AS i, CASE WHEN ttl_ms <= 0 THEN 10000 ELSE least(ttl_ms, 60000) END * 1000 AS ttl FROM lease_requests),
f(key, i, op, seq, holder, until, granted) AS (
  SELECT key, i, op, seq, CASE WHEN op = 'acquire' THEN peer_id END, CASE WHEN op = 'acquire' THEN ts_us + ttl ELSE 0 END, op = 'acquire' FROM r WHERE i = 1
  UNION ALL SELECT r.key, r.i, r.op, r.seq, CASE WHEN g THEN r.peer_id WHEN d THEN NULL ELSE h END, CASE WHEN g THEN ts_us + ttl WHEN d THEN 0 ELSE u END, g OR d
  FROM (SELECT r.*, f.holder AS h, f.until AS u, r.op = 'acquire' AND (f.holder IS NULL OR r.ts_us >= f.until OR f.holder = r.peer_id) AS g, r.op = 'release' AND coalesce(f.holder = r.peer_id, false) AS d FROM f JOIN r ON r.key = f.key AND r.i = f.i + 1) r)
SELECT role, count(*) AS n FROM (SELECT CASE WHEN granted THEN 'leader' WHEN outcome = 'ok' THEN 'follower-peer-hit' WHEN outcome = 'miss' THEN 'follower-cloud-fallback' ELSE 'error' END AS role FROM f JOIN read_events USING (seq) WHERE op = 'acquire') GROUP BY role""",
    "lease_requests", "read_events",
)
def i8_lease_roles(spark: SparkSession, sf: str) -> DataFrame:
    """What became of those who asked for a lease."""
    asked = logical(spark, sf, "lease_requests").where("op = 'acquire'").select("seq")
    t = O.leases(logical(spark, sf, "lease_requests")).join(asked, "seq").join(logical(spark, sf, "read_events").select("seq", "outcome"), "seq")
    role = F.when(c("granted"), "leader").when(c("outcome") == "ok", "follower-peer-hit").when(c("outcome") == "miss", "follower-cloud-fallback").otherwise("error")
    return t.groupBy(role.alias("role")).agg(F.count("*").alias("n"))


@query(
    """, d AS (SELECT node, seq, CASE WHEN seq % 5 < 3 THEN 1 ELSE -1 END AS delta, row_number() OVER (PARTITION BY node ORDER BY seq) AS i FROM read_events),
f(node, i, now, acc, rej, peak) AS (SELECT node, 0::BIGINT, 0, 0::BIGINT, 0::BIGINT, 0 FROM (SELECT DISTINCT node FROM d)
  UNION ALL SELECT d.node, d.i, CASE WHEN delta < 0 THEN greatest(now - 1, 0) WHEN now < 8 THEN now + 1 ELSE now END, acc + CASE WHEN delta > 0 AND now < 8 THEN 1 ELSE 0 END, rej + CASE WHEN delta > 0 AND now >= 8 THEN 1 ELSE 0 END,
    greatest(peak, CASE WHEN delta > 0 AND now < 8 THEN now + 1 ELSE 0 END) FROM f JOIN d ON d.node = f.node AND d.i = f.i + 1)
SELECT node, CAST(arg_max(now, i) AS BIGINT) AS inflight, max(acc) AS accepted, max(rej) AS rejected, CAST(max(peak) AS BIGINT) AS peak FROM f GROUP BY node""",
    "read_events",
)
def i13_admission_gate(spark: SparkSession, sf: str) -> DataFrame:
    """I13, D22."""
    t = logical(spark, sf, "read_events").select("node", "seq", F.when(c("seq") % 5 < 3, 1).otherwise(-1).alias("delta"))
    return O.gate(t, ["node"], 8)


@query(
    """, r AS (SELECT *, row_number() OVER (PARTITION BY volume_id ORDER BY seq) AS i FROM sessions),
f(volume_id, i, refs, warm) AS (SELECT volume_id, 0::BIGINT, 0, 0::BIGINT FROM (SELECT DISTINCT volume_id FROM r) UNION ALL
  SELECT r.volume_id, r.i, CASE WHEN op = 'create' THEN refs + 1 ELSE greatest(refs - 1, 0) END, warm + CASE WHEN op = 'create' AND refs = 0 THEN 1 ELSE 0 END FROM f JOIN r ON r.volume_id = f.volume_id AND r.i = f.i + 1)
SELECT volume_id, CAST(arg_max(refs, i) AS BIGINT) AS refs, max(warm) AS warm_starts FROM f GROUP BY volume_id""",
    "sessions",
)
def i15_session_counts(spark: SparkSession, sf: str) -> DataFrame:
    """I15, G18, G19."""
    return O.session_counts(logical(spark, sf, "sessions"))


@query(
    """, g AS (SELECT path, ts, seq, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY path ORDER BY ts, seq) < 51840000000 THEN 0 ELSE 1 END AS b FROM read_events),
i AS (SELECT *, sum(b) OVER (PARTITION BY path ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS i FROM g) SELECT path, min(ts) AS begins, max(ts) AS ends, count(*) AS reads FROM i GROUP BY path, i""",
    "read_events",
)
def i6_idle_gaps(spark: SparkSession, sf: str) -> DataFrame:
    """Sessions with gaps under 14.4 hours."""
    return O.idle_gaps(logical(spark, sf, "read_events"), "path", 51_840)


@query(
    """, e AS (SELECT seq, path AS key, epoch_us(ts) AS ts_us, outcome, bytes FROM read_events)
SELECT r.key, r.seq, CASE WHEN r.ts_us - v.ts_us < 86400000000 THEN v.bytes END AS value FROM (SELECT * FROM e WHERE outcome <> 'ok') r ASOF LEFT JOIN (SELECT key, ts_us, bytes FROM e WHERE outcome = 'ok') v ON r.key = v.key AND r.ts_us >= v.ts_us""",
    "read_events",
)
def i11_cached_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """An as-of join with a time to live."""
    e = logical(spark, sf, "read_events").select("seq", c("path").alias("key"), F.timestamp_diff("MICROSECOND", at("1970-01-01 00:00:00"), c("ts")).alias("ts_us"), "outcome", c("bytes").alias("value"))
    return O.cached_lookup(e.where("outcome <> 'ok'"), e.where("outcome = 'ok'"), 86_400_000_000, "key")


@query(
    """, e AS (SELECT seq, path AS key, epoch_us(ts) AS t FROM read_events), m AS (SELECT *, max(t + 64800000000) OVER (PARTITION BY key ORDER BY t, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS e FROM e)
SELECT key, count(*) FILTER (e IS NULL OR t >= e) AS leaders, count(*) FILTER (t < e) AS followers FROM m GROUP BY key""",
    "read_events",
)
def i9_single_flight(spark: SparkSession, sf: str) -> DataFrame:
    """I9."""
    e = logical(spark, sf, "read_events").select("seq", c("path").alias("key"), F.timestamp_diff("MICROSECOND", at("1970-01-01 00:00:00"), c("ts")).alias("ts_us"), F.lit(64_800_000_000).alias("wait_us"))
    return O.single_flight(e).groupBy("key").agg(F.count(F.when(c("leader"), 1)).alias("leaders"), F.count(F.when(~c("leader"), 1)).alias("followers"))


@query(
    """, t AS (SELECT node, sum(CASE WHEN bytes > 0 THEN bytes END) AS b, sum(CASE WHEN bytes > 0 THEN greatest(nanos, 0) END) AS n, count(*) FILTER (bytes > 0) AS ops FROM read_events WHERE tier = 'peer' AND outcome = 'ok' GROUP BY node)
SELECT node, CAST(CASE WHEN ops >= 8 AND b > 0 AND n > 0 THEN greatest(floor(least(CAST(b AS DOUBLE) / (CAST(n AS DOUBLE) / 1e9) * 4 * 0.25, 67108864) / 65536), 8) ELSE 8 END AS BIGINT) AS max_chunks FROM t""",
    "read_events",
)
def w15_derived_window(spark: SparkSession, sf: str) -> DataFrame:
    """W15, L5."""
    t = logical(spark, sf, "read_events").where("tier = 'peer' AND outcome = 'ok' AND bytes > 0")
    t = t.groupBy("node").agg(F.sum("bytes").alias("b"), F.sum(F.greatest("nanos", F.lit(0))).alias("n"), F.count("*").alias("ops"))
    return t.select("node", O.derived_window(c("b"), c("n"), c("ops"), 4, 8, 65536, 64 * S.MIB).alias("max_chunks"))


@query(
    """, f AS (SELECT file_path, max(file_size) * 20 AS size, count(DISTINCT peer_id) FILTER (storage_tier <> 'cloud' AND peer_id < 'peer-00009') AS n, bool_or(storage_tier = 'cloud') AS cloud FROM replicas GROUP BY file_path)
SELECT file_path, size > 0 AND n > 0 AND (size >= 536870912 OR (cloud AND size > greatest(n, 1) * 209715200)) AS hybrid, CASE WHEN size >= 1073741824 THEN 'cloud' ELSE 'peer' END AS odd_chunk_tier,
  CASE WHEN size <= 8388608 THEN 1 WHEN size <= 268435456 THEN 4 ELSE 16 END AS workers, CASE WHEN size <= 8388608 THEN 0 WHEN size <= 268435456 THEN least(12, CAST(ceil(size / 8388608) AS BIGINT)) ELSE 12 END AS ahead,
  CASE WHEN cloud THEN 60000 ELSE 30000 END AS timeout_ms FROM f""",
    "replicas",
)
def l3_read_policy(spark: SparkSession, sf: str) -> DataFrame:
    """L3, L4, L5, L9."""
    held = F.countDistinct(F.when((c("storage_tier") != "cloud") & (c("peer_id") < "peer-00009"), c("peer_id")))
    f = logical(spark, sf, "replicas").groupBy("file_path").agg((F.max("file_size") * 20).alias("size"), held.alias("n"), F.bool_or(c("storage_tier") == "cloud").alias("cloud"))
    workers, ahead = O.read_profile(c("size"), F.lit(CHUNK).cast("bigint"), 4, F.lit(12).cast("bigint"), F.lit(16).cast("bigint"))
    hybrid = O.hybrid_read(c("size"), c("n"), c("cloud"), F.lit(None).cast("boolean"))
    tier = O.striped_tier(F.lit(1), c("size"), F.lit("peer"), F.lit("cloud"))
    return f.select("file_path", hybrid.alias("hybrid"), tier.alias("odd_chunk_tier"), workers.alias("workers"), ahead.alias("ahead"), O.read_timeout_ms(c("cloud"), F.lit(False)).alias("timeout_ms"))


@query(
    """, t AS (SELECT path, chunk_index, tier, CASE WHEN tier = 'nvme' THEN 0 ELSE 1 END AS rank, epoch_us(ts) + nanos // 1000 AS finish FROM read_events WHERE outcome = 'ok' AND nanos >= 0)
SELECT path, chunk_index, arg_min(tier, (rank, finish, tier)) AS served_by, arg_min(finish, (rank, finish, tier)) AS finish FROM t GROUP BY path, chunk_index""",
    "read_events",
)
def l6_tiered_fallback(spark: SparkSession, sf: str) -> DataFrame:
    """L6, A8, J2, K7."""
    t = logical(spark, sf, "read_events").where("nanos >= 0")
    finish = F.timestamp_diff("MICROSECOND", at("1970-01-01 00:00:00"), c("ts")) + F.expr("nanos div 1000")
    rows = t.select("path", "chunk_index", "tier", "outcome", F.when(c("tier") == "nvme", 0).otherwise(1).alias("rank"), finish.alias("finish"))
    return O.first_answer(rows, ["path", "chunk_index"])


@query(
    "SELECT source, bandwidth, tiers, files, workers FROM (VALUES ('', '', 'peer,cloud', 2, 4), ('cloud-first', 'max', 'cloud,peer', 4, 16), ('cloud-only', '', 'cloud', 2, 4), ('peer-only', 'background', 'peer', 2, 4)) v(source, bandwidth, tiers, files, workers), (SELECT count(*) FROM peers)", "peers"
)
def l7_warm_plans(spark: SparkSession, sf: str) -> DataFrame:
    """L7, G23."""
    plans = [(s, b, *P.warm_plan(s, b)) for s, b in (("", ""), ("cloud-first", "max"), ("cloud-only", ""), ("peer-only", "background"))]
    rows = ", ".join(f"('{s}', '{b}', '{','.join(t)}', {n}, {w})" for s, b, t, n, w in plans)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS v(source, bandwidth, tiers, files, workers)")
