"""Queries of telemetry and byte operators (survey 2.A A16-A18, 2.D, 2.K), with oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quayside.functions import scalars as S
from quayside.operators import byteops as B
from quayside.operators import catalog as K
from quayside.operators import telemetry as T
from quayside.sources.adapters import logical, oracle

c = F.col
QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str, *tables: str):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = oracle(sql, *tables)
        return f

    return add


_PARSED = r""", l AS (SELECT *, trim(line) AS t FROM metric_lines WHERE trim(line) <> '' AND NOT starts_with(trim(line), '#')),
p AS (SELECT line_no, ts, node, CASE WHEN contains(t, '{') THEN regexp_extract(t, '^([^{]*)\{(.*)\}([^}]*)$', 1) ELSE split_part(t, ' ', 1) END AS name,
  CASE WHEN contains(t, '{') THEN trim(regexp_extract(t, '^([^{]*)\{(.*)\}([^}]*)$', 3)) ELSE split_part(t, ' ', 2) END AS rest, regexp_extract(t, '\{(.*)\}', 1) AS inside FROM l),
samples AS (SELECT line_no, ts, node, name, inside, CASE split_part(rest, ' ', 1) WHEN '+Inf' THEN CAST('inf' AS DOUBLE) WHEN 'NaN' THEN CAST('nan' AS DOUBLE) ELSE TRY_CAST(split_part(rest, ' ', 1) AS DOUBLE) END AS value FROM p WHERE name <> '' AND rest <> '')"""
_TYPE = "nullif(regexp_extract(inside, 'type=\"([^\"]*)\"', 1), '')"


def _samples(spark: SparkSession, sf: str) -> DataFrame:
    return T.parse_metrics(logical(spark, sf, "metric_lines"))


@query(
    _PARSED + rf""" SELECT line_no, node, name, CASE WHEN name = 'fleet_reads_total' THEN 'tier=' || regexp_extract(inside, 'tier="([^"]*)"', 1) || ', type=' || {_TYPE} WHEN name = 'fleet_limit' THEN 'kind=a"b=c, unit=x,y' ELSE '' END AS labels,
  CASE WHEN isnan(value) THEN 'NaN' WHEN isinf(value) THEN 'Inf' ELSE CAST(CAST(value AS BIGINT) AS VARCHAR) END AS value FROM samples""",
    "metric_lines",
)
def a18_parse_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """A18, H10, H35, A22."""
    value = F.when(F.isnan("value"), "NaN").when(c("value") == float("inf"), "Inf").otherwise(c("value").cast("bigint").cast("string"))
    return _samples(spark, sf).select("line_no", "node", "name", S.label_string(c("labels")).alias("labels"), value.alias("value"))


@query(
    _PARSED + r""" SELECT name || CASE WHEN name = 'fleet_reads_total' THEN '{tier="' || regexp_extract(inside, 'tier="([^"]*)"', 1) || '",type="' || regexp_extract(inside, 'type="([^"]*)"', 1) || '"}' WHEN name = 'fleet_limit' THEN '{kind="a\"b=c",unit="x,y"}' ELSE '' END
  || ' ' || CASE WHEN isnan(value) THEN 'NaN' WHEN isinf(value) THEN '+Inf' ELSE CAST(CAST(value AS BIGINT) AS VARCHAR) END AS line FROM samples""",
    "metric_lines",
)
def a17_emit_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """A17, H25."""
    return T.emit_metrics(_samples(spark, sf))


@query(_PARSED + " SELECT node, name, arg_min(value, line_no) AS value FROM samples WHERE inside = '' AND NOT isnan(value) GROUP BY node, name", "metric_lines")
def d29_unlabelled(spark: SparkSession, sf: str) -> DataFrame:
    """First wins."""
    return T.unlabelled(_samples(spark, sf).where(~F.isnan("value")), ["node"])


@query(_PARSED + f" SELECT node, {_TYPE} AS label, arg_max(value, line_no) AS value FROM samples WHERE name = 'fleet_reads_total' GROUP BY 1, 2", "metric_lines")
def d29_by_label(spark: SparkSession, sf: str) -> DataFrame:
    """Last wins."""
    return T.by_label(_samples(spark, sf), "fleet_reads_total", "type", ["node"])


@query(_PARSED + " SELECT name, min(line_no) AS first_line FROM samples GROUP BY name", "metric_lines")
def d29_names(spark: SparkSession, sf: str) -> DataFrame:
    """D29, G16."""
    return T.names_seen(_samples(spark, sf))


@query(
    _PARSED + f""", f AS (SELECT coalesce({_TYPE}, name) AS name, value, line_no FROM samples WHERE NOT isnan(value) AND NOT isinf(value)), h AS (SELECT (min(line_no) + max(line_no)) // 2 AS half FROM metric_lines),
b AS (SELECT name, arg_max(value, line_no) AS v FROM f, h WHERE line_no <= half GROUP BY name), a AS (SELECT name, arg_max(value, line_no) AS v FROM f, h WHERE line_no > half GROUP BY name)
SELECT name, coalesce(a.v, 0) - coalesce(b.v, 0) AS delta FROM b FULL JOIN a USING (name)""",
    "metric_lines",
)
def c12_scrape_delta_of_halves(spark: SparkSession, sf: str) -> DataFrame:
    """The second half of all lines against the first."""
    t = _samples(spark, sf).where("NOT isnan(value) AND abs(value) < double('infinity')").withColumn("name", F.coalesce(F.element_at("labels", F.lit("type")), c("name")))
    half = logical(spark, sf, "metric_lines").agg(F.expr("(min(line_no) + max(line_no)) div 2").alias("half"))
    t = t.join(F.broadcast(half))  # one row
    last = lambda x: x.groupBy("name").agg(F.max_by("value", "line_no").alias("value"))
    return T.delta(last(t.where("line_no <= half")), last(t.where("line_no > half")))


QUERIES["c12_scrape_delta"], ORACLES["c12_scrape_delta"] = c12_scrape_delta_of_halves, ORACLES["c12_scrape_delta_of_halves"]


@query(_PARSED + f" SELECT {_TYPE} AS key, sum(value) AS total, max(value) AS top, sum(value) / greatest(count(*), 1) AS per_sample FROM samples WHERE name = 'fleet_reads_total' GROUP BY 1", "metric_lines")
def d27_panels(spark: SparkSession, sf: str) -> DataFrame:
    """D27."""
    return T.histogram_panel(_samples(spark, sf), "fleet_reads_total", F.element_at("labels", F.lit("type")))


_HITS = ", h AS (SELECT node, tier, count(*) FILTER (outcome = 'ok') AS hits, count(*) FILTER (outcome = 'miss') AS misses FROM read_events GROUP BY node, tier)"


@query(_HITS + " SELECT CAST(sum(hits) * 100.0 AS DOUBLE) / CAST(sum(hits) + sum(misses) AS DOUBLE) AS hit_rate FROM h", "read_events")
def d9_cluster_hit_rate(spark: SparkSession, sf: str) -> DataFrame:
    """D9, D16."""
    return T.cluster_hit_rate(T.hit_counts(logical(spark, sf, "read_events"), ["node"]))


@query(
    _HITS + " SELECT node, tier, hits, misses, round(CASE WHEN hits + misses > 0 THEN CAST(hits AS DOUBLE) * 100 / (hits + misses) END, 1) AS hit_rate, CASE WHEN sum(hits) OVER (PARTITION BY node) > 0 THEN CAST(hits AS DOUBLE) * 100 / CAST(sum(hits) OVER (PARTITION BY node) AS DOUBLE) END AS share FROM h", "read_events"
)
def d10_tier_shares(spark: SparkSession, sf: str) -> DataFrame:
    """D10, D16."""
    return T.tier_shares(T.hit_counts(logical(spark, sf, "read_events"), ["node"]))


@query(
    "SELECT CAST(sum(available_space + used_space) AS BIGINT) AS capacity, CAST(sum(used_space) AS BIGINT) AS used, p AS used_pct, CASE WHEN p >= 90 THEN 'critical' WHEN p >= 75 THEN 'warning' ELSE 'ok' END AS level FROM peers, (SELECT CAST(sum(used_space) AS DOUBLE) * 100 / CAST(sum(available_space + used_space) AS DOUBLE) AS p FROM peers) GROUP BY p", "peers"
)
def d11_capacity_use(spark: SparkSession, sf: str) -> DataFrame:
    """D11."""
    return T.capacity_use(logical(spark, sf, "peers"))


@query(
    "SELECT node, tier, bytes, nanos, ops, round(CASE WHEN nanos > 0 THEN CAST(bytes AS DOUBLE) / 1048576 / (CAST(nanos AS DOUBLE) / 1e9) ELSE 0 END, 6) AS mbps FROM (SELECT node, tier, CAST(sum(bytes) AS BIGINT) AS bytes, CAST(sum(greatest(nanos, 0)) AS BIGINT) AS nanos, count(*) AS ops FROM read_events WHERE bytes > 0 AND outcome = 'ok' GROUP BY node, tier)", "read_events"
)
def d17_tier_reads(spark: SparkSession, sf: str) -> DataFrame:
    """D17, D19."""
    return T.tier_reads(logical(spark, sf, "read_events"), ["node"]).withColumn("mbps", F.round("mbps", 6))


@query(
    """, w AS (SELECT bytes * 2 AS total, CASE WHEN seq % 2 = 0 THEN bytes * 3 ELSE -5 END AS n, CASE WHEN seq % 5 = 0 THEN bytes ELSE 0 END AS p, CASE WHEN seq % 3 = 0 THEN bytes // 3 ELSE 0 END AS c FROM read_events), m AS (SELECT total, greatest(n, 0) AS n, p, c FROM w WHERE total > 0),
s AS (SELECT total, CASE WHEN n + p + c > total THEN CAST(floor(n * (total / (n + p + c))) AS BIGINT) ELSE n END AS nvme, CASE WHEN n + p + c > total THEN CAST(floor(p * (total / (n + p + c))) AS BIGINT) ELSE p END AS peer, CASE WHEN n + p + c > total THEN CAST(floor(c * (total / (n + p + c))) AS BIGINT) ELSE c END AS cloud FROM m)
SELECT count(*) AS ops, CAST(sum(total) AS BIGINT) AS total, CAST(sum(nvme) AS BIGINT) AS nvme, CAST(sum(peer) AS BIGINT) AS peer, CAST(sum(cloud) AS BIGINT) AS cloud, CAST(sum(total - nvme - peer - cloud) AS BIGINT) AS other FROM s""",
    "read_events",
)
def d18_read_wall(spark: SparkSession, sf: str) -> DataFrame:
    """D18."""
    b, s = c("bytes"), c("seq")
    t = logical(spark, sf, "read_events").select((b * 2).alias("total"), F.when(s % 2 == 0, b * 3).otherwise(-5).alias("nvme"), F.when(s % 5 == 0, b).otherwise(0).alias("peer"), F.when(s % 3 == 0, S.idiv(b, 3)).otherwise(0).alias("cloud"))
    return T.read_wall(t)


@query("SELECT count(DISTINCT path) AS files, count(*) AS chunks, CAST(sum(bytes) AS BIGINT) AS bytes FROM (SELECT path, chunk_index, max(bytes) AS bytes FROM read_events WHERE outcome = 'ok' GROUP BY path, chunk_index)", "read_events")
def d20_range_cache(spark: SparkSession, sf: str) -> DataFrame:
    """D20."""
    return T.range_cache(logical(spark, sf, "read_events").where("outcome = 'ok'").groupBy("path", "chunk_index").agg(F.max("bytes").alias("bytes")))


@query(
    "SELECT id, count(*) AS files, count(*) FILTER (outcome = 'warmed') AS warmed, count(*) FILTER (outcome = 'already_local') AS already_local, count(*) FILTER (outcome = 'skipped') AS skipped, count(*) FILTER (outcome = 'failed') AS failed, CAST(coalesce(sum(bytes) FILTER (outcome = 'warmed'), 0) AS BIGINT) AS bytes FROM warm_jobs GROUP BY id", "warm_jobs"
)
def d23_warm_results(spark: SparkSession, sf: str) -> DataFrame:
    """D23, D25."""
    return T.warm_results(logical(spark, sf, "warm_jobs"))


@query(
    "SELECT id, seq, count(*) OVER w AS done_so_far, CAST(sum(CASE WHEN outcome = 'warmed' THEN 1 ELSE 0 END) OVER w AS BIGINT) AS warmed, CAST(sum(CASE WHEN outcome = 'failed' THEN 1 ELSE 0 END) OVER w AS BIGINT) AS failed FROM warm_jobs WINDOW w AS (PARTITION BY id ORDER BY seq ROWS UNBOUNDED PRECEDING)", "warm_jobs"
)
def d24_warm_progress(spark: SparkSession, sf: str) -> DataFrame:
    """D24."""
    return T.warm_progress(logical(spark, sf, "warm_jobs"))


@query(
    """, r AS (SELECT seq // 100 AS run, CAST(sum(CASE WHEN tier = 'nvme' THEN bytes ELSE 0 END) AS DOUBLE) AS nvme, CAST(sum(CASE WHEN tier = 'peer' THEN bytes ELSE 0 END) AS DOUBLE) AS peer, CAST(sum(CASE WHEN tier = 'cloud' THEN bytes ELSE 0 END) AS DOUBLE) AS cloud, CAST(sum(nanos) AS DOUBLE) / 1e9 AS seconds FROM read_events GROUP BY 1)
SELECT run, coalesce(round(CASE WHEN seconds > 0 THEN (nvme + peer + cloud) / 1048576 / seconds END, 1), 0) AS read_mbps, round(nvme * 100 / (nvme + peer + cloud), 1) AS nvme_share_pct, round(peer * 100 / (nvme + peer + cloud), 1) AS peer_share_pct, round(cloud * 100 / (nvme + peer + cloud), 1) AS cloud_share_pct FROM r""",
    "read_events",
)
def d28_benchmark_shares(spark: SparkSession, sf: str) -> DataFrame:
    """D28, A19."""
    of = lambda t: F.sum(F.when(c("tier") == t, c("bytes")).otherwise(0)).cast("double").alias(t)
    runs = logical(spark, sf, "read_events").groupBy(S.idiv(c("seq"), 100).alias("run")).agg(of("nvme"), of("peer"), of("cloud"), (F.sum("nanos").cast("double") / 1e9).alias("seconds"))
    return T.benchmark_shares(runs)


@query(
    """, d AS (SELECT node, seq, CASE outcome WHEN 'ok' THEN bytes WHEN 'error' THEN -bytes * 2 ELSE 0 END AS delta FROM read_events), s AS (SELECT *, sum(delta) OVER w AS t FROM d WINDOW w AS (PARTITION BY node ORDER BY seq ROWS UNBOUNDED PRECEDING))
SELECT node, seq, CAST(t - least(0, min(t) OVER (PARTITION BY node ORDER BY seq ROWS UNBOUNDED PRECEDING)) AS BIGINT) AS used FROM s""",
    "read_events",
)
def d30_usage(spark: SparkSession, sf: str) -> DataFrame:
    """D30, G21, G22."""
    delta = F.when(c("outcome") == "ok", c("bytes")).when(c("outcome") == "error", -c("bytes") * 2).otherwise(0)
    return T.usage_after(logical(spark, sf, "read_events").select("node", "seq", delta.alias("delta"))).select("node", "seq", "used")


@query("SELECT CASE WHEN seq % 3 = 0 THEN 'write' WHEN seq % 3 = 1 THEN 'sync' ELSE 'put' END AS phase, count(*) AS calls, CAST(sum(bytes) AS BIGINT) AS bytes, round(sum(CAST(greatest(nanos, 0) AS DOUBLE) / 1e9), 4) AS seconds FROM read_events GROUP BY 1", "read_events")
def d26_write_phases(spark: SparkSession, sf: str) -> DataFrame:
    """D26."""
    phase = F.when(c("seq") % 3 == 0, "write").when(c("seq") % 3 == 1, "sync").otherwise("put")
    return T.write_phases(logical(spark, sf, "read_events").withColumn("phase", phase)).withColumn("seconds", F.round("seconds", 4))


# --- bytes -------------------------------------------------------------------------------------------------------------


def _objects(spark: SparkSession, sf: str) -> DataFrame:
    return logical(spark, sf, "objects").select("path", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("data"))


_OBJ = ", o AS (SELECT path, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM objects)"


@query(
    _OBJ + ", k AS (SELECT path, h, unnest(range(CAST(ceil(n / 1024) AS BIGINT))) AS chunk_index FROM o) SELECT path, chunk_index, CAST(length(substr(h, chunk_index * 2048 + 1, 2048)) // 2 AS INTEGER) AS size, sha256(unhex(substr(h, chunk_index * 2048 + 1, 2048))) AS sum FROM k", "objects"
)
def k1_split(spark: SparkSession, sf: str) -> DataFrame:
    """K1, K4, A24, H13."""
    return B.split_objects(_objects(spark, sf), 1024).select("path", "chunk_index", F.octet_length("data").alias("size"), S.checksum(c("data")).alias("sum"))


@query(_OBJ + " SELECT path, sha256(unhex(h)) AS sum, CAST(n AS INTEGER) AS size FROM o WHERE n > 0", "objects")
def k2_assemble(spark: SparkSession, sf: str) -> DataFrame:
    """K2, K7: split and put together again."""
    return B.assemble(B.split_objects(_objects(spark, sf), 1024)).select("path", S.checksum(c("data")).alias("sum"), F.octet_length("data").alias("size"))


@query(
    _OBJ + ", r AS (SELECT doc_id AS seq, '/docs/' || coalesce(lang, 'none') || '/' || doc_id || '.txt' AS path, (doc_id * 37) % 3000 AS off, (doc_id * 91) % 5000 AS size FROM documents) SELECT seq, substr(h, off * 2 + 1, size * 2) AS data FROM r JOIN o USING (path) WHERE size > 0 AND off < n", "objects"
)
def k3_read_ranges(spark: SparkSession, sf: str) -> DataFrame:
    """K3, C8, A6, A23."""
    o = _objects(spark, sf)
    ids = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    path = F.concat(F.lit("/docs/"), F.coalesce("lang", F.lit("none")), F.lit("/"), c("doc_id").cast("string"), F.lit(".txt"))
    ranges = ids.select(c("doc_id").alias("seq"), path.alias("path"), (c("doc_id") * 37 % 3000).alias("offset"), (c("doc_id") * 91 % 5000).alias("size"))
    sizes = o.select("path", F.octet_length("data").cast("bigint").alias("length"))
    return B.read_ranges(ranges, B.split_objects(o, 1024), sizes, 1024).select("seq", F.hex("data").alias("data"))


@query(
    _OBJ + """, f AS (SELECT path, n, CAST(ceil(n / 1024) AS BIGINT) AS k FROM o WHERE n > 0), e AS (SELECT path, n, k, unnest(range(k)) AS i FROM f), m AS (SELECT path, n, i, k, i % 3 = 1 AS gone, i = 7 AND n % 2 = 0 AS lost FROM e)
SELECT path, n AS size, count(*) FILTER (gone) AS fetched FROM m GROUP BY path, n HAVING NOT bool_or(gone AND lost)""",
    "objects",
)
def k5_complete(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks that are not local come from afar, but not all are there."""
    o = _objects(spark, sf)
    chunks = B.split_objects(o, 1024)
    n = F.octet_length("data").cast("bigint")
    files = o.select("path", n.alias("size"), S.chunk_count(n, F.lit(1024).cast("bigint")).alias("chunk_count"))
    odd = files.where("size % 2 = 0").select("path", F.lit(7).cast("bigint").alias("chunk_index"))
    return B.complete(files, chunks.where("chunk_index % 3 <> 1"), chunks.join(odd, ["path", "chunk_index"], "left_anti"))


@query(_OBJ + " SELECT path FROM o WHERE n % 5 = 0 AND n > 0", "objects")
def k6_corrupt(spark: SparkSession, sf: str) -> DataFrame:
    """K6, H13."""
    o = _objects(spark, sf)
    n = F.octet_length("data")
    sums = o.select("path", S.checksum(F.when(n % 5 == 0, F.concat(c("data"), F.lit(b"x"))).otherwise(c("data"))).alias("checksum"))
    return B.corrupt(o.where(n > 0), sums)


@query(
    """, f AS (SELECT file_path, max(file_size) AS size, bool_or(storage_tier = 'nvme') AS fast, count(*) AS n FROM replicas WHERE starts_with(file_path, '/models/m1') AND NOT regexp_matches(file_path, '_chunk_[0-9]+$') GROUP BY file_path),
s AS (SELECT *, fast AND n % 2 = 0 AS there, sum(CASE WHEN fast AND n % 2 = 0 THEN 0 ELSE size END) OVER (ORDER BY file_path ROWS UNBOUNDED PRECEDING) AS need FROM f)
SELECT file_path, size, CASE WHEN there THEN 'already_local' WHEN need + 1000 > 8589934592 THEN 'skipped' WHEN n % 3 <> 0 THEN 'warmed' ELSE 'failed' END AS outcome FROM s""",
    "replicas",
)
def k8_warm_prefix(spark: SparkSession, sf: str) -> DataFrame:
    """K8, D23, G10, G22, J8."""
    t = K.under_prefix(logical(spark, sf, "replicas"), "/models/m1").where(S.parent_path(c("file_path")).isNull())
    f = t.groupBy("file_path").agg(F.max("file_size").alias("size"), F.bool_or(c("storage_tier") == "nvme").alias("fast"), F.count("*").alias("n"))
    return B.warm_prefix(f.select("file_path", "size"), f.where("fast AND n % 2 = 0").select("file_path", "size"), f.where("n % 3 <> 0").select("file_path"), 1000, 8 * S.GIB)


@query(
    "SELECT path AS file_path, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS size, base64(encode(coalesce(text, ''))) AS content_b64 FROM objects WHERE starts_with(path, '/docs/en/1') ORDER BY path LIMIT 20", "objects"
)
def a16_fs_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    """A16, F12, H14."""
    from quayside.sources.snapshots import fs_snapshot

    return fs_snapshot(_objects(spark, sf), "/docs/en/1", 20)
