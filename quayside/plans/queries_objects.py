"""Queries of whole objects over tiers and of a fleet's views and requests (survey 2.A, 2.B, 2.C, 2.F, 2.I-2.K), with oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quayside.functions import scalars as S
from quayside.operators import catalog as K
from quayside.operators import byteops as B
from quayside.operators import objects as J
from quayside.operators import ordered as O
from quayside.plans.queries_catalog import HOT_DAYS, at
from quayside.sources.adapters import EVENTS_NOW, FILES_NOW, logical, oracle

c = F.col
QUERIES: dict = {}
ORACLES: dict = {}
_OWNER = "regexp_replace({}, '_chunk_[0-9]+$', '')"


def query(sql: str, *tables: str):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = oracle(sql, *tables)
        return f

    return add


def _us(x: str = "ts"):  # noqa: ANN202
    return F.timestamp_diff("MICROSECOND", at("1970-01-01 00:00:00"), c(x))


# --- tiers of peers (2.A) ----------------------------------------------------------------------------------------------


@query(
    """, t AS (SELECT path, chunk_index, seq AS rank, peer_id, 0 AS attempt, outcome FROM read_events UNION ALL SELECT path, chunk_index, seq, peer_id, 1, CASE WHEN seq % 2 = 0 THEN 'ok' ELSE 'busy' END FROM read_events WHERE outcome = 'busy'),
f AS (SELECT path, chunk_index, min((attempt, rank)) FILTER (outcome = 'ok') AS f FROM t GROUP BY ALL)
SELECT path, chunk_index, arg_min(peer_id, (attempt, rank)) FILTER (outcome = 'ok') AS served_by, count(*) FILTER (f IS NULL OR (attempt, rank) <= f) AS tries, count(*) FILTER (outcome = 'busy' AND (f IS NULL OR (attempt, rank) <= f)) AS busy
FROM t JOIN f USING (path, chunk_index) GROUP BY path, chunk_index""",
    "read_events",
)
def a8_served_after_retry(spark: SparkSession, sf: str) -> DataFrame:
    """Holders of a chunk in order, busy ones asked again after all others."""
    t = logical(spark, sf, "read_events").select("path", "chunk_index", c("seq").alias("rank"), "peer_id", "outcome", F.lit(0).alias("attempt"))
    again = t.where("outcome = 'busy'").withColumn("attempt", F.lit(1)).withColumn("outcome", F.when(c("rank") % 2 == 0, "ok").otherwise("busy"))
    return J.served(t.unionByName(again), ["path", "chunk_index"])


@query(
    """, held AS (SELECT DISTINCT file_path, peer_id AS id FROM replicas WHERE storage_tier <> 'cloud'), act AS (SELECT id, available_space FROM peers WHERE status = 'active'),
n AS (SELECT p.file_path, a.id, row_number() OVER (PARTITION BY p.file_path ORDER BY available_space DESC, a.id) AS copy FROM (SELECT DISTINCT file_path FROM held) p CROSS JOIN act a ANTI JOIN held h ON h.file_path = p.file_path AND h.id = a.id)
SELECT file_path, CAST(copy AS INTEGER) AS copy, id AS peer_id FROM n WHERE copy <= 2""",
    "replicas", "peers",
)
def a9_placements(spark: SparkSession, sf: str) -> DataFrame:
    """Two more copies of each path."""
    return J.placements(logical(spark, sf, "peers"), logical(spark, sf, "replicas"), 2)


@query(
    """, a AS (SELECT file_path, seq, CASE WHEN peer_id IN (SELECT id FROM peers WHERE status = 'active') AND file_size > 0 THEN file_size END AS own FROM replicas)
SELECT file_path, bool_or(own IS NOT NULL) AS there, arg_min(own, seq) FILTER (own IS NOT NULL) AS size FROM a GROUP BY file_path""",
    "replicas", "peers",
)
def a10_on_any_peer(spark: SparkSession, sf: str) -> DataFrame:
    """A10."""
    return J.on_any_peer(logical(spark, sf, "peers"), logical(spark, sf, "replicas"))


@query(
    """, asked AS (SELECT '/docs/en/' || i || '.txt' AS path, i FROM (SELECT unnest(range(0, 400)) AS i)), big AS (SELECT i, i % 50 = 7 AS put FROM asked)
SELECT path, CAST(CASE WHEN put THEN 413 WHEN length IS NULL THEN 404 ELSE 200 END AS INTEGER) AS status, CASE WHEN NOT put THEN CAST(length AS BIGINT) END AS size FROM asked JOIN big USING (i) LEFT JOIN objects USING (path)""",
    "objects",
)
def a23_object_requests(spark: SparkSession, sf: str) -> DataFrame:
    """What HEAD gives for 400 paths, one in fifty a PUT over the cap of 2 GiB."""
    asked = spark.range(400).select(F.concat(F.lit("/docs/en/"), "id", F.lit(".txt")).alias("path"), F.when(c("id") % 50 == 7, F.lit(3 * S.GIB)).otherwise(F.lit(0)).alias("upload"))
    t = asked.join(logical(spark, sf, "objects").select("path", c("length").cast("bigint").alias("length")), "path", "left")
    over = c("upload") > 2 * S.GIB
    return t.select("path", F.when(over, 413).when(c("length").isNull(), 404).otherwise(200).alias("status"), F.when(~over, c("length")).alias("size"))


@query(
    "SELECT seq, CAST(least(greatest(CASE WHEN bytes = 0 THEN 1048576 ELSE bytes END * (seq % 9), 4096), 33554432) AS BIGINT) AS payload, CASE WHEN nanos > 0 THEN round(least(greatest(CASE WHEN bytes = 0 THEN 1048576 ELSE bytes END * (seq % 9), 4096), 33554432) / 1048576.0 / (nanos / 1e9), 6) ELSE 0 END AS mib_s FROM read_events",
    "read_events",
)
def a25_network_probes(spark: SparkSession, sf: str) -> DataFrame:
    """Payloads of 1 MiB where none is asked for, clamped, and their rates."""
    size = F.when(c("bytes") == 0, F.lit(S.MIB)).otherwise(c("bytes")) * (c("seq") % 9)
    t = logical(spark, sf, "read_events").withColumn("payload", F.least(F.greatest(size, F.lit(4096)), F.lit(32 * S.MIB)).cast("bigint"))
    return t.select("seq", "payload", F.round(S.mib_per_second(c("payload"), c("nanos")), 6).alias("mib_s"))


@query(
    "SELECT peer_id, CASE outcome WHEN 'ok' THEN 'ReadFile' WHEN 'miss' THEN 'FileExists' WHEN 'busy' THEN 'FileSize' ELSE 'DeleteFile' END AS call, count(*) AS calls, CAST(coalesce(sum(bytes) FILTER (outcome = 'ok'), 0) AS BIGINT) AS bytes, count(DISTINCT node) AS callers FROM read_events WHERE tier = 'peer' GROUP BY ALL",
    "read_events",
)
def a26_peer_calls(spark: SparkSession, sf: str) -> DataFrame:
    """Calls that each peer serves, by kind."""
    call = F.when(c("outcome") == "ok", "ReadFile").when(c("outcome") == "miss", "FileExists").when(c("outcome") == "busy", "FileSize").otherwise("DeleteFile")
    t = logical(spark, sf, "read_events").where("tier = 'peer'").groupBy("peer_id", call.alias("call"))
    return t.agg(F.count("*").alias("calls"), F.coalesce(F.sum(F.when(c("outcome") == "ok", c("bytes"))), F.lit(0)).alias("bytes"), F.countDistinct("node").alias("callers"))


@query(
    """, h AS (SELECT peer_id AS id, arg_max(status, seq) AS seen_as, max(ts) AS seen_at FROM heartbeats GROUP BY peer_id), l AS (SELECT peer_id AS id, count(*) AS samples FROM read_events WHERE tier = 'peer' AND outcome <> 'miss' GROUP BY peer_id), f AS (SELECT peer_id AS id, count(DISTINCT file_path) AS files FROM replicas GROUP BY peer_id)
SELECT id, address, seen_as, seen_at, coalesce(samples, 0) AS samples, coalesce(files, 0) AS files FROM peers LEFT JOIN h USING (id) LEFT JOIN l USING (id) LEFT JOIN f USING (id)""",
    "peers", "heartbeats", "read_events", "replicas",
)
def a28_node_views(spark: SparkSession, sf: str) -> DataFrame:
    """A node's view of each peer: its address, last heartbeat, latency samples and files listed."""
    beat = K.latest_peers(logical(spark, sf, "heartbeats")).select(c("peer_id").alias("id"), c("status").alias("seen_as"), c("ts").alias("seen_at"))
    pairs = logical(spark, sf, "read_events").where("tier = 'peer' AND outcome <> 'miss'").groupBy(c("peer_id").alias("id")).agg(F.count("*").alias("samples"))
    files = logical(spark, sf, "replicas").groupBy(c("peer_id").alias("id")).agg(F.countDistinct("file_path").alias("files"))
    t = logical(spark, sf, "peers").select("id", "address").join(beat, "id", "left").join(pairs, "id", "left").join(files, "id", "left")
    return t.select("id", "address", "seen_as", "seen_at", F.coalesce("samples", F.lit(0)).alias("samples"), F.coalesce("files", F.lit(0)).alias("files"))


# --- predicates and projections (2.B), lookups (2.C) --------------------------------------------------------------------


@query(
    f"""SELECT id, last_heartbeat IS NULL OR last_heartbeat < TIMESTAMP '{EVENTS_NOW}' - to_seconds(60) AS stale, files FROM peers
LEFT JOIN (SELECT peer_id AS id, count(DISTINCT file_path) AS files FROM replicas WHERE NOT regexp_matches(file_path, '_chunk_[0-9]+$') GROUP BY peer_id) USING (id)""",
    "peers", "replicas",
)
def g16_dashboard_peers(spark: SparkSession, sf: str) -> DataFrame:
    """Peers not heard of for a minute are stale; chunk rows are hidden from the counts of files."""
    shown = logical(spark, sf, "replicas").where(~c("file_path").rlike("_chunk_[0-9]+$")).groupBy(c("peer_id").alias("id")).agg(F.countDistinct("file_path").alias("files"))
    stale = c("last_heartbeat").isNull() | (c("last_heartbeat") < at(EVENTS_NOW) - F.make_dt_interval(secs=F.lit(60)))
    return logical(spark, sf, "peers").join(shown, "id", "left").select("id", stale.alias("stale"), "files")


@query(
    "SELECT id, status, done || '/' || files AS progress, round(100.0 * done / files, 3) AS percent, status <> 'running' AS finished FROM (SELECT id, arg_max(status, seq) AS status, arg_max(files, seq) AS files, arg_max(done, seq) AS done FROM warm_jobs GROUP BY id)", "warm_jobs"
)
def g18_public_jobs(spark: SparkSession, sf: str) -> DataFrame:
    """The public view of a warm job."""
    t = K.latest_jobs(logical(spark, sf, "warm_jobs"))
    return t.select("id", "status", F.concat(c("done"), F.lit("/"), c("files")).alias("progress"), F.round(100.0 * c("done") / c("files"), 3).alias("percent"), (c("status") != "running").alias("finished"))


@query(
    "SELECT seq, CASE WHEN seq % 5 = 0 THEN '/' ELSE root_path END AS root_path, CASE WHEN seq % 3 = 0 THEN 'peer-first' ELSE 'cloud-only' END AS source, CASE WHEN seq % 7 = 0 THEN 'vol-' || seq ELSE volume_id END AS name FROM sessions", "sessions"
)
def g19_volume_defaults(spark: SparkSession, sf: str) -> DataFrame:
    """Attributes of a volume that are empty or absent take their defaults, an empty root is /."""
    given = F.create_map(
        F.lit("root"), F.when(c("seq") % 5 == 0, "").otherwise(c("root_path")), F.lit("source"), F.when(c("seq") % 3 == 0, F.lit(None)).otherwise("cloud-only"), F.lit("name"), F.when(c("seq") % 7 == 0, "").otherwise(c("volume_id"))
    )
    default = lambda k, d: F.coalesce(F.nullif(F.element_at("a", F.lit(k)), F.lit("")), d)
    t = logical(spark, sf, "sessions").select("seq", given.alias("a"))
    return t.select("seq", default("root", F.lit("/")).alias("root_path"), default("source", F.lit("peer-first")).alias("source"), default("name", F.concat(F.lit("vol-"), "seq")).alias("name"))


@query(
    "SELECT id, CASE WHEN k % 4 = 0 THEN '/healthz' WHEN k % 4 = 1 THEN '/metrics' ELSE '/objects/' || id END AS url, k % 4 IN (0, 1) OR k % 3 = 1 AS allowed FROM (SELECT id, CAST(right(id, 5) AS INTEGER) AS k FROM peers)", "peers"
)
def g24_access(spark: SparkSession, sf: str) -> DataFrame:
    """Probes and metrics are open, all else needs the key."""
    k = F.right("id", F.lit(5)).cast("int")
    url = F.when(k % 4 == 0, "/healthz").when(k % 4 == 1, "/metrics").otherwise(F.concat(F.lit("/objects/"), c("id")))
    t = logical(spark, sf, "peers").select("id", url.alias("url"), F.when(k % 3 == 1, "secret").when(k % 3 == 2, "wrong").alias("key"))
    return t.select("id", "url", (c("url").isin("/healthz", "/metrics") | F.coalesce(c("key") == "secret", F.lit(False))).alias("allowed"))


@query("SELECT id, coalesce(network_speed_mbps, 0) AS speed FROM (SELECT id FROM peers UNION ALL SELECT 'absent-' || right(id, 2) FROM peers) LEFT JOIN (SELECT id, network_speed_mbps FROM peers WHERE status = 'active') USING (id)", "peers")
def c14_telemetry_by_id(spark: SparkSession, sf: str) -> DataFrame:
    """C14: a peer's speed by its id, 0 for those that are unknown."""
    p = logical(spark, sf, "peers")
    asked = p.select("id").union(p.select(F.concat(F.lit("absent-"), F.right("id", F.lit(2)))))
    return asked.join(p.where("status = 'active'").select("id", "network_speed_mbps"), "id", "left").select("id", F.coalesce("network_speed_mbps", F.lit(0.0)).alias("speed"))


@query(
    """, j AS (SELECT 'peer-' || lpad(CAST(seq % 40 AS VARCHAR), 5, '0') AS peer_id, arg_max(id, seq) AS job FROM warm_jobs WHERE status <> 'failed' GROUP BY 1) SELECT p.id, job, job IS NOT NULL AS accepted FROM peers p LEFT JOIN j ON j.peer_id = p.id WHERE p.status = 'active'""",
    "peers", "warm_jobs",
)
def c15_jobs_by_peer(spark: SparkSession, sf: str) -> DataFrame:
    """The job that each node of a fan-out answered with, null where it did not."""
    answers = logical(spark, sf, "warm_jobs").where("status <> 'failed'").select(F.concat(F.lit("peer-"), F.lpad((c("seq") % 40).cast("string"), 5, "0")).alias("id"), c("id").alias("job"), "seq")
    jobs = answers.groupBy("id").agg(F.max_by("job", "seq").alias("job"))
    return K.active_peers(logical(spark, sf, "peers")).select("id").join(jobs, "id", "left").select("id", "job", c("job").isNotNull().alias("accepted"))


# --- orders (2.F), rollups (2.D) ---------------------------------------------------------------------------------------


@query(
    f""", h AS (SELECT file_path, max(last_accessed) AS last_accessed FROM replicas WHERE last_accessed >= TIMESTAMP '{FILES_NOW}' - to_days({HOT_DAYS}) AND NOT regexp_matches(file_path, '^.+_chunk_[0-9]+$') AND file_size > 0 AND file_size <= 67108864 AND storage_tier <> 'cloud' GROUP BY file_path)
SELECT file_path, last_accessed, row_number() OVER (ORDER BY last_accessed DESC, file_path) AS place FROM h""",
    "replicas",
)
def f10_hot_in_order(spark: SparkSession, sf: str) -> DataFrame:
    """hot files with their place, the most recent first."""
    t = K.holders(logical(spark, sf, "replicas")).where(K.is_hot(at(FILES_NOW), HOT_DAYS * 1440)).groupBy("file_path").agg(F.max("last_accessed").alias("last_accessed"))
    back = lambda unit: -F.unix_micros(F.date_trunc(unit, "last_accessed").cast("timestamp"))
    out = O.running_in_ranges(t, F.lit(1).cast("bigint"), back("DAY"), back("MINUTE"), [c("last_accessed").desc(), c("file_path")])
    return out.select("file_path", "last_accessed", (c("__before") + 1).alias("place"))


@query("""SELECT id, updated_at, row_number() OVER (ORDER BY updated_at DESC, id DESC) AS place FROM (SELECT id, max(updated_at) AS updated_at FROM warm_jobs GROUP BY id) ORDER BY place LIMIT 32""", "warm_jobs")
def f13_newest_jobs(spark: SparkSession, sf: str) -> DataFrame:
    """the newest 32 jobs with their place."""
    from pyspark.sql import Window

    t = logical(spark, sf, "warm_jobs").groupBy("id").agg(F.max("updated_at").alias("updated_at")).orderBy(c("updated_at").desc(), c("id").desc()).limit(32)
    return t.withColumn("place", F.row_number().over(Window.orderBy(c("updated_at").desc(), c("id").desc())).cast("bigint")).orderBy("place")


@query(
    """, w AS (SELECT file_path, count(*) FILTER (storage_tier = 'nvme') AS nvme_replicas FROM replicas GROUP BY file_path) SELECT file_path, nvme_replicas, row_number() OVER (ORDER BY nvme_replicas, file_path) AS place FROM w""", "replicas"
)
def f15_view_in_order(spark: SparkSession, sf: str) -> DataFrame:
    """files by fast replicas, fewest first, then by path, with their place."""
    t = K.world_view(logical(spark, sf, "replicas")).select("file_path", "nvme_replicas")
    out = O.running_in_ranges(t, F.lit(1).cast("bigint"), c("nvme_replicas"), F.struct("nvme_replicas", F.left("file_path", F.lit(14))), [c("file_path")])
    return out.select("file_path", "nvme_replicas", (c("__before") + 1).alias("place"))


@query(
    """, p AS (SELECT node, peer_id, count(*) AS samples FROM read_events WHERE tier = 'peer' AND outcome <> 'miss' GROUP BY ALL) SELECT node, peer_id, samples, row_number() OVER (PARTITION BY node ORDER BY peer_id) AS place, (SELECT string_agg(id, ',' ORDER BY id) FROM peers WHERE status = 'active') AS accepted FROM p""",
    "read_events", "peers",
)
def f16_pairs_in_order(spark: SparkSession, sf: str) -> DataFrame:
    """F16: a node's pairs in order of the peer, and the ids that accepted a warm-up, sorted."""
    from pyspark.sql import Window

    t = logical(spark, sf, "read_events").where("tier = 'peer' AND outcome <> 'miss'").groupBy("node", "peer_id").agg(F.count("*").alias("samples"))
    ids = K.active_peers(logical(spark, sf, "peers")).agg(F.array_join(F.array_sort(F.collect_list("id")), ",").alias("accepted"))  # a fleet's nodes
    return t.withColumn("place", F.row_number().over(Window.partitionBy("node").orderBy("peer_id")).cast("bigint")).crossJoin(F.broadcast(ids))


@query(
    """, f AS (SELECT path, chunk_index, min(seq) AS seq, arg_max(bytes, seq) AS bytes, bool_or(seq % 3 = 0) AS ahead FROM read_events GROUP BY ALL), n AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY seq DESC) AS n, sum(bytes) OVER (PARTITION BY path ORDER BY seq DESC ROWS UNBOUNDED PRECEDING) AS b FROM f)
SELECT count(DISTINCT path) AS files, count(*) AS chunks, CAST(sum(bytes) AS BIGINT) AS bytes, count(*) FILTER (ahead) AS prefetched FROM n WHERE n <= 4 AND b <= 16777216""",
    "read_events",
)
def d20_range_cache(spark: SparkSession, sf: str) -> DataFrame:
    """Files, chunks, bytes and prefetched chunks of the range caches."""
    t = logical(spark, sf, "read_events")
    ahead = t.groupBy("path", "chunk_index").agg(F.bool_or(c("seq") % 3 == 0).alias("ahead"))
    kept = O.fifo_kept(t, 4, 16 * S.MIB).join(ahead, ["path", "chunk_index"])
    return kept.agg(F.countDistinct("path").alias("files"), F.count("*").alias("chunks"), F.sum("bytes").alias("bytes"), F.count(F.when(c("ahead"), 1)).alias("prefetched"))


# --- time (2.E, 2.I) ---------------------------------------------------------------------------------------------------


@query(
    """, r AS (SELECT * FROM read_events WHERE seq % 11 <> 0), g AS (SELECT path, ts, seq, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY path ORDER BY ts, seq) < 7200000000 THEN 0 ELSE 1 END AS b FROM r),
i AS (SELECT *, sum(b) OVER (PARTITION BY path ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS i FROM g), s AS (SELECT path, min(ts) AS begins, max(ts) AS ends, count(*) AS reads FROM i GROUP BY path, i)
SELECT path, begins, ends, reads FROM s WHERE NOT EXISTS (SELECT 1 FROM read_events p WHERE p.seq % 11 = 0 AND p.path = s.path AND p.ts <= s.ends + INTERVAL 2 HOUR AND p.ts > s.ends)""",
    "read_events",
)
def i6_dropped_caches(spark: SparkSession, sf: str) -> DataFrame:
    """Range caches dropped at the end of an idle time of two hours, but where a prefetch was made in it."""
    t = logical(spark, sf, "read_events")
    gaps = O.idle_gaps(t.where("seq % 11 <> 0"), "path", 7200).withColumn("seq", F.monotonically_increasing_id())
    drops = gaps.select("path", (_us("ends") + 7_200_000_000).alias("ts_us"), "seq")
    ahead = t.where("seq % 11 = 0").select("path", _us().alias("ts_us"), c("seq").alias("value"))
    flying = O.cached_lookup(drops, ahead, 7_200_000_000, "path").where("value IS NOT NULL").select("path", "seq")
    return gaps.join(flying, ["path", "seq"], "left_anti").select("path", "begins", "ends", "reads")


@query(
    """, r AS (SELECT node, seq, epoch_us(ts) AS t, row_number() OVER (PARTITION BY node ORDER BY ts, seq) AS i FROM read_events),
f AS (SELECT node, i, t AS last, true AS fresh FROM r WHERE i = 1 UNION ALL SELECT r.node, r.i, CASE WHEN r.t - f.last >= 3600000000 THEN r.t ELSE f.last END, r.t - f.last >= 3600000000 FROM f JOIN r ON r.node = f.node AND r.i = f.i + 1)
SELECT node, count(*) FILTER (fresh) AS fetched, count(*) FILTER (NOT fresh) AS from_cache FROM f GROUP BY node""",
    "read_events",
)
def i16_page_cache(spark: SparkSession, sf: str) -> DataFrame:
    """I16: of a page's refreshes those that fetch, as the response kept for an hour has run out, and those that don't."""
    t = logical(spark, sf, "read_events").select("node", "seq", _us().alias("ts_us"))
    fetched = O.admitted(t, ["node"], 3_600_000_000).groupBy("node").agg(F.count("*").alias("fetched"))
    return t.groupBy("node").agg(F.count("*").alias("n")).join(fetched, "node").select("node", "fetched", (c("n") - c("fetched")).alias("from_cache"))


@query(
    f""", h AS (SELECT file_path, max(last_accessed) AS last_accessed, count(DISTINCT peer_id) AS holders, max(seq) AS s FROM replicas WHERE storage_tier <> 'cloud' GROUP BY file_path), d AS (SELECT *, greatest(0, 30 - holders) AS deficit FROM h),
s AS (SELECT *, coalesce(sum(deficit) OVER w, 0) AS spent, row_number() OVER (ORDER BY last_accessed DESC, file_path) AS place FROM d WHERE deficit > 0 WINDOW w AS (ORDER BY last_accessed DESC, file_path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
p AS (SELECT * FROM s WHERE spent < 90) SELECT file_path, CAST(least(deficit, 90 - spent) AS BIGINT) AS copies FROM p WHERE place < coalesce((SELECT min(place) FROM p WHERE s % 7 = 3), 1000000)""",
    "replicas",
)
def w9_reconciled_until_busy(spark: SparkSession, sf: str) -> DataFrame:
    """The run's copies up to the first that finds its peer busy."""
    from pyspark.sql import Window

    t = K.holders(logical(spark, sf, "replicas")).groupBy("file_path").agg(F.max("last_accessed").alias("last_accessed"), F.countDistinct("peer_id").alias("holders"), F.max("seq").alias("s"))
    plan = O.reconcile(t.withColumn("deficit", F.greatest(F.lit(0).cast("bigint"), 30 - c("holders"))), 90)
    placed = plan.withColumn("place", F.row_number().over(Window.orderBy(c("last_accessed").desc(), "file_path")))  # a run's budget of rows
    return J.until_busy(placed.withColumn("outcome", F.when(c("s") % 7 == 3, "busy").otherwise("ok"))).select("file_path", "copies")


@query(
    """, r AS (SELECT path AS key, seq, epoch_us(ts) AS t, greatest(nanos, 0) // 100 AS wait FROM read_events),
l AS (SELECT key, seq, t FROM (SELECT *, max(t + wait) OVER (PARTITION BY key ORDER BY t, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS busy FROM r) WHERE busy IS NULL OR t >= busy),
n AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY t, seq) AS i FROM l),
f AS (SELECT key, i, seq, t AS last, true AS ok FROM n WHERE i = 1 UNION ALL SELECT n.key, n.i, n.seq, CASE WHEN n.t - f.last >= 86400000000 THEN n.t ELSE f.last END, n.t - f.last >= 86400000000 FROM f JOIN n ON n.key = f.key AND n.i = f.i + 1)
SELECT key, seq FROM f WHERE ok""",
    "read_events",
)
def w11_completions(spark: SparkSession, sf: str) -> DataFrame:
    """Completions that don't follow one in flight, at most one a day of each file."""
    t = logical(spark, sf, "read_events").select(c("path").alias("key"), "seq", _us().alias("ts_us"), S.idiv(F.greatest(c("nanos"), F.lit(0)), 100).alias("wait_us"))
    return J.completions_to_run(t, 86_400_000_000)


# --- whole objects (2.J, 2.K) ------------------------------------------------------------------------------------------

_STRIDE = 512


def _bytes(spark: SparkSession, sf: str) -> DataFrame:
    t = logical(spark, sf, "objects").where("text IS NOT NULL AND text <> ''")
    return t.select("path", F.encode("text", "UTF-8").alias("data"))


@query(
    f""", o AS (SELECT path, octet_length(encode(text)) AS size, md5(text) AS digest, (octet_length(encode(text)) + {_STRIDE - 1}) // {_STRIDE} AS n, CAST(regexp_extract(path, '/([0-9]+)\\.txt$', 1) AS BIGINT) AS k FROM objects WHERE text <> ''),
e AS (SELECT path, unnest(range(n)) AS i, k FROM o), t AS (SELECT path, CASE WHEN (k + i) % 3 = 0 THEN 'nvme' WHEN (k + i) % 3 = 1 AND (k + i) % 4 <> 0 THEN 'peer' WHEN (k + i) % 13 <> 5 THEN 'cloud' END AS tier FROM e)
SELECT path, CAST(any_value(o.size) AS BIGINT) AS size, any_value(o.digest) AS digest, count(*) AS chunks, count(*) FILTER (tier = 'nvme') AS from_nvme, count(*) FILTER (tier = 'peer') AS from_peer, count(*) FILTER (tier = 'cloud') AS from_cloud
FROM t JOIN o USING (path) GROUP BY path HAVING count(*) = count(tier)""",
    "objects",
)
def k7_get_objects(spark: SparkSession, sf: str) -> DataFrame:
    """Objects read chunk by chunk from the fast tier, else a peer that is not busy, else the cloud; lost ones left out."""
    k = F.regexp_extract("path", r"/([0-9]+)\.txt$", 1).cast("bigint") + c("chunk_index")
    chunks = B.split_objects(_bytes(spark, sf), _STRIDE).withColumn("k", k)
    tiers = F.array(
        F.struct(F.lit("nvme").alias("tier"), F.lit(0).alias("rank"), F.when(c("k") % 3 == 0, "ok").otherwise("miss").alias("outcome")),
        F.struct(F.lit("peer").alias("tier"), F.lit(1).alias("rank"), F.when(c("k") % 3 != 1, "miss").when(c("k") % 4 == 0, "busy").otherwise("ok").alias("outcome")),
        F.struct(F.lit("cloud").alias("tier"), F.lit(2).alias("rank"), F.when(c("k") % 13 == 5, "error").otherwise("ok").alias("outcome")),
    )
    out = J.get_objects(chunks.select("path", "chunk_index", "data", F.inline(tiers)))
    return out.select("path", F.octet_length("data").cast("bigint").alias("size"), F.md5("data").alias("digest"), "chunks", "from_nvme", "from_peer", "from_cloud")


@query(
    f""", o AS (SELECT path, octet_length(encode(text)) AS size, (octet_length(encode(text)) + {_STRIDE - 1}) // {_STRIDE} AS n, CAST(regexp_extract(path, '/([0-9]+)\\.txt$', 1) AS BIGINT) AS k FROM objects WHERE text <> ''),
e AS (SELECT path, unnest(range(n)) AS i, k, size, n FROM o), h AS (SELECT *, (k + i) % 2 = 0 AS here, (k + i) % 17 <> 3 AS there FROM e),
d AS (SELECT path, any_value(size) AS size FROM h GROUP BY path HAVING bool_and(here OR there))
SELECT path AS file_path, CAST(size AS BIGINT) AS size FROM d UNION ALL SELECT path || '_chunk_' || i, CAST(least({_STRIDE}, size - i * {_STRIDE}) AS BIGINT) FROM h WHERE here AND path NOT IN (SELECT path FROM d)""",
    "objects",
)
def k5_completed(spark: SparkSession, sf: str) -> DataFrame:
    """K5: files whose missing chunks a peer has become one row, of those that stay short the own chunks are left."""
    k = F.regexp_extract("path", r"/([0-9]+)\.txt$", 1).cast("bigint") + c("chunk_index")
    data = _bytes(spark, sf)
    chunks = B.split_objects(data, _STRIDE)
    local, remote = chunks.where(k % 2 == 0), chunks.where(k % 17 != 3)
    size = F.octet_length("data").cast("bigint")
    files = data.select("path", size.alias("size"), S.chunk_count(size, F.lit(_STRIDE).cast("bigint")).alias("chunk_count"))
    entries = local.select(S.chunk_path(c("path"), c("chunk_index")).alias("file_path"), size.alias("size"))
    return J.swap_completed(entries, B.complete(files, local, remote))


@query(
    f""", p AS (SELECT path, octet_length(encode(text)) AS size, CAST(regexp_extract(path, '/([0-9]+)\\.txt$', 1) AS BIGINT) AS k FROM objects WHERE text <> ''),
r AS (SELECT *, CASE WHEN sum(size) OVER (ORDER BY path ROWS UNBOUNDED PRECEDING) <= 100000 THEN 'nvme' WHEN k % 3 = 0 THEN 'cloud' ELSE 'peer' END AS tier FROM p),
old AS (SELECT '/docs/en/' || i || '.txt' || CASE WHEN i % 2 = 0 THEN '_chunk_1' ELSE '' END AS file_path, '/docs/en/' || i || '.txt' AS owner, CAST(i AS BIGINT) AS size FROM (SELECT unnest(range(300)) AS i))
SELECT path AS file_path, CAST(size AS BIGINT) AS size, tier FROM r UNION ALL SELECT path || '_chunk_' || i, CAST(least(4096, size - i * 4096) AS BIGINT), tier FROM (SELECT *, unnest(range((size + 4095) // 4096)) AS i FROM r WHERE size > 4096)
UNION ALL SELECT file_path, size, 'nvme' FROM old WHERE owner NOT IN (SELECT path FROM r)""",
    "objects",
)
def j2_put_objects(spark: SparkSession, sf: str) -> DataFrame:
    """All objects put over 300 older entries, into a room of 100,000 bytes."""
    k = F.regexp_extract("path", r"/([0-9]+)\.txt$", 1).cast("bigint")
    puts = _bytes(spark, sf).withColumn("peer_ms", F.lit(20)).withColumn("cloud_ms", F.when(k % 3 == 0, 10).otherwise(30))
    name = F.concat(F.lit("/docs/en/"), "id", F.lit(".txt"))
    old = spark.range(300).select(F.when(c("id") % 2 == 0, S.chunk_path(name, F.lit(1))).otherwise(name).alias("file_path"), c("id").alias("size"), F.lit("nvme").alias("tier"))
    out = J.put_objects(old, puts, 4096, 100_000)
    return out.select("file_path", "size", "tier")


@query(
    """, e AS (SELECT file_path, size, last_accessed FROM cache_entries WHERE tier = 'nvme'), a AS (SELECT file_path, sum(size) OVER (ORDER BY last_accessed, file_path ROWS UNBOUNDED PRECEDING) - size AS before FROM (SELECT c.* FROM cache_entries c WHERE tier = 'nvme' AND priority <> '1-URGENT' AND persisted))
SELECT file_path, size FROM e WHERE file_path NOT IN (SELECT file_path FROM a WHERE before < (SELECT sum(size) FROM e) - ((SELECT sum(size) FROM e) * 75) // 100)""",
    "cache_entries",
)
def j7_after_eviction(spark: SparkSession, sf: str) -> DataFrame:
    """The cache that an eviction down to 75 % leaves."""
    e = logical(spark, sf, "cache_entries").where("tier = 'nvme'").select("file_path", "size", "last_accessed", (c("priority") == "1-URGENT").alias("pinned"), c("persisted").alias("safe"))
    used = e.crossJoin(F.broadcast(e.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("used"))))  # one row
    return O.left_after(e, O.evict_globally(used, c("used"), F.expr("used * 75 div 100"))).select("file_path", "size")


_ASKS = ", a AS (SELECT node, seq, CASE WHEN seq % 5 < 3 THEN 'start' ELSE 'end' END AS kind, seq % 7 = 0 AS local, (seq % 10) / 10.0 AS pressure, bytes AS want, CASE WHEN outcome = 'error' THEN 0 ELSE bytes END AS got FROM read_events)"


@query(
    _ASKS + """, d AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY seq) AS i FROM a WHERE kind = 'end' OR NOT (local OR pressure > 0.8)),
f(node, i, seq, kind, now, ok) AS (SELECT node, 0::BIGINT, -1::BIGINT, '', 0, false FROM (SELECT DISTINCT node FROM d)
  UNION ALL SELECT d.node, d.i, d.seq, d.kind, CASE WHEN d.kind = 'end' THEN greatest(now - 1, 0) WHEN now < 2 THEN now + 1 ELSE now END, d.kind = 'start' AND now < 2 FROM f JOIN d ON d.node = f.node AND d.i = f.i + 1)
SELECT a.node, a.seq, CASE WHEN local THEN 'local' WHEN pressure > 0.8 THEN 'pressure' WHEN NOT ok THEN 'busy' WHEN got = want THEN 'committed' ELSE 'short' END AS outcome FROM a LEFT JOIN f USING (node, seq) WHERE a.kind = 'start'""",
    "read_events",
)
def j8_promotions(spark: SparkSession, sf: str) -> DataFrame:
    """Promotions to the fast tier, two at a time on a node."""
    t = logical(spark, sf, "read_events")
    asks = t.select(
        "node", "seq", F.when(c("seq") % 5 < 3, "start").otherwise("end").alias("kind"), (c("seq") % 7 == 0).alias("local"), ((c("seq") % 10) / 10.0).alias("pressure"), c("bytes").alias("want"),
        F.when(c("outcome") == "error", 0).otherwise(c("bytes")).alias("got"),
    )
    return J.promotions(asks)


@query(
    """, a AS (SELECT path, seq, outcome = 'ok' AS ok, row_number() OVER (PARTITION BY path ORDER BY seq) - 1 AS n FROM read_events WHERE outcome <> 'ok' OR seq % 3 = 0), t AS (SELECT path, coalesce(min(n) FILTER (ok), max(n)) + 1 AS attempts, bool_or(ok) AS persisted FROM a WHERE n < 5 GROUP BY path)
SELECT path, attempts, CAST(list_sum(list_transform(range(attempts - 1), lambda i: least(100 * pow(2, i), 1000))) AS BIGINT) AS waited_ms, persisted FROM (SELECT path, CAST(attempts AS BIGINT) AS attempts, persisted FROM t) WHERE attempts > 1
UNION ALL SELECT path, CAST(attempts AS BIGINT), 0, persisted FROM t WHERE attempts = 1""",
    "read_events",
)
def j12_persist_retries(spark: SparkSession, sf: str) -> DataFrame:
    """Writes to the cloud with up to five attempts."""
    from pyspark.sql import Window

    t = logical(spark, sf, "read_events").where("outcome <> 'ok' OR seq % 3 = 0")
    n = F.row_number().over(Window.partitionBy("path").orderBy("seq")) - 1
    return J.persist_outcomes(t.select("path", n.alias("attempt"), (c("outcome") == "ok").alias("ok")))


@query(f"SELECT seq, path FROM remote_reads WHERE {_OWNER.format('path')} NOT IN (SELECT {_OWNER.format('file_path')} FROM replicas WHERE storage_tier = 'nvme' AND seq % 50 = 31)", "remote_reads", "replicas")
def j13_invalidated(spark: SparkSession, sf: str) -> DataFrame:
    """Cached ranges that stay when files change, chunks by their files."""
    changed = logical(spark, sf, "replicas").where("storage_tier = 'nvme' AND seq % 50 = 31").select(c("file_path").alias("path"))
    return J.invalidated(logical(spark, sf, "remote_reads").select("seq", "path"), changed)
