"""Queries of the catalog operators (survey 2.A scans, 2.B, 2.C, 2.D, 2.G, 2.J), with their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quayside.functions import scalars as S
from quayside.operators import catalog as K
from quayside.sources.adapters import CHUNK, EVENTS_NOW, FILES_NOW, logical, oracle

c = F.col

def at(literal: str):  # noqa: ANN201
    return F.expr(f"TIMESTAMP_NTZ '{literal}'")

DAY = 1440
HOT_DAYS = 200

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


_PARENT = "regexp_matches(file_path, '^.+_chunk_[0-9]+$')"


@query("SELECT id, address, used_space FROM peers WHERE status = 'active' AND id <> 'peer-00001'", "peers")
def g1_active_peers(spark: SparkSession, sf: str) -> DataFrame:
    """G1, A12."""
    return K.active_peers(logical(spark, sf, "peers"), "peer-00001").select("id", "address", "used_space")


@query("SELECT file_path, peer_id, storage_tier, file_size FROM replicas WHERE starts_with(file_path, '/models/m1')", "replicas")
def g2_prefix_scan(spark: SparkSession, sf: str) -> DataFrame:
    """By plain text, so /models/m1 also finds /models/m10."""
    return K.under_prefix(logical(spark, sf, "replicas"), "/models/m1").select("file_path", "peer_id", "storage_tier", "file_size")


@query("SELECT file_path, peer_id, storage_tier FROM replicas WHERE NOT (starts_with(file_path, '/models/m1/') OR starts_with(file_path, '/models/m2/'))", "replicas")
def g3_unpinned(spark: SparkSession, sf: str) -> DataFrame:
    """Rows under no pinned prefix, by segments."""
    return logical(spark, sf, "replicas").where(~K.is_pinned(c("file_path"), ["/models/m1", "", "/", "/models/m2"])).select("file_path", "peer_id", "storage_tier")


@query("SELECT id FROM peers WHERE (last_heartbeat IS NULL OR last_heartbeat >= TIMESTAMP '2024-01-31 00:00:00' - to_seconds(75)) AND id IN ('peer-00000', 'peer-00001', 'peer-00002', 'peer-00003', 'peer-00004', 'peer-00005', 'peer-00006') AND zone = 'b'", "peers")
def g4_fresh_allowed_labelled(spark: SparkSession, sf: str) -> DataFrame:
    """G4-G6, U2."""
    t = K.allowed(K.fresh_peers(logical(spark, sf, "peers"), at(EVENTS_NOW)), [f"peer-{i:05}" for i in range(7)])
    return t.where(S.has_labels(c("labels"), {"zone": "b", "absent": ""})).select("id")


@query(
    f"SELECT file_path, max(file_size) AS size, max(last_accessed) AS last_accessed FROM replicas WHERE last_accessed >= TIMESTAMP '{FILES_NOW}' - to_days({HOT_DAYS}) AND NOT {_PARENT} AND file_size > 0 AND file_size <= 67108864 AND storage_tier <> 'cloud' AND peer_id <> '' GROUP BY file_path",
    "replicas",
)
def g7_hot_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """G7, G8, F10."""
    t = K.holders(logical(spark, sf, "replicas")).where(K.is_hot(at(FILES_NOW), HOT_DAYS * DAY))
    return t.groupBy("file_path").agg(F.max("file_size").alias("size"), F.max("last_accessed").alias("last_accessed"))


@query(
    "SELECT tier, CASE outcome WHEN 'ok' THEN 'ok' WHEN 'busy' THEN 'busy' WHEN 'miss' THEN 'miss' ELSE 'failure' END AS class, count(*) AS n FROM read_events GROUP BY ALL", "read_events"
)
def g9_outcome_classes(spark: SparkSession, sf: str) -> DataFrame:
    """G9."""
    return logical(spark, sf, "read_events").groupBy("tier", K.outcome_class(c("outcome")).alias("class")).agg(F.count("*").alias("n"))


@query(
    "SELECT class, count(*) AS n, CAST(sum(file_size) AS BIGINT) AS bytes FROM (SELECT file_size, CASE WHEN chunk_size <= 0 OR file_size <= chunk_size THEN 'small' WHEN file_size <= 67108864 THEN 'medium' ELSE 'large' END AS class FROM replicas) GROUP BY class",
    "replicas",
)
def g12_size_classes(spark: SparkSession, sf: str) -> DataFrame:
    """G12."""
    t = logical(spark, sf, "replicas")
    return t.groupBy(K.size_class(c("file_size"), c("chunk_size"), 64 * S.MIB).alias("class")).agg(F.count("*").alias("n"), F.sum("file_size").alias("bytes"))


@query(
    """, held AS (SELECT DISTINCT file_path, peer_id AS id FROM replicas WHERE storage_tier <> 'cloud'), act AS (SELECT id FROM peers WHERE status = 'active'),
known AS (SELECT * FROM held JOIN act USING (id))
SELECT p.file_path, k.id, (SELECT count(*) FROM act) - count(k.id) OVER (PARTITION BY p.file_path) AS fallbacks FROM (SELECT DISTINCT file_path FROM held) p LEFT JOIN known k ON k.file_path = p.file_path""",
    "replicas", "peers",
)
def c1_holder_flags(spark: SparkSession, sf: str) -> DataFrame:
    """Over all paths and peers."""
    return K.holder_flags(logical(spark, sf, "peers"), logical(spark, sf, "replicas"))


same("c1_holder_partition", "c1_holder_flags")


@query(
    "SELECT id FROM peers WHERE status = 'active' AND id <> 'peer-00002' AND id NOT IN (SELECT peer_id FROM replicas WHERE file_path = '/models/m5/f5.bin' AND storage_tier <> 'cloud')", "replicas", "peers"
)
def c2_seed_targets(spark: SparkSession, sf: str) -> DataFrame:
    """C2, C4, U3."""
    return K.seed_targets(logical(spark, sf, "peers"), logical(spark, sf, "replicas"), "/models/m5/f5.bin", "peer-00002").select("id")


@query("SELECT file_path, arg_min(peer_id, (seq, peer_id)) AS source FROM replicas WHERE storage_tier <> 'cloud' AND peer_id IN (SELECT id FROM peers WHERE status = 'active') GROUP BY file_path", "replicas", "peers")
def c3_seed_sources(spark: SparkSession, sf: str) -> DataFrame:
    """C3."""
    return K.seed_sources(logical(spark, sf, "peers"), logical(spark, sf, "replicas"))


def _views(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    t = logical(spark, sf, "cache_entries")
    local = t.where("tier = 'nvme'").groupBy("file_path").agg(F.max("size").alias("size"), F.max("last_accessed").alias("last_accessed"), F.max("tier").alias("tier"))
    remote = t.where("tier <> 'nvme' OR size % 2 = 0").groupBy("file_path").agg(F.min("size").alias("size"), F.min("last_accessed").alias("last_accessed"), F.lit("cloud").alias("tier"))
    return local, remote


_VIEWS = """, l AS (SELECT file_path, max(size) AS size, max(last_accessed) AS last_accessed, max(tier) AS tier FROM cache_entries WHERE tier = 'nvme' GROUP BY file_path),
r AS (SELECT file_path, min(size) AS size, min(last_accessed) AS last_accessed, 'cloud' AS tier FROM cache_entries WHERE tier <> 'nvme' OR size % 2 = 0 GROUP BY file_path)"""


@query(
    _VIEWS + " SELECT file_path, coalesce(l.size, r.size) AS size, coalesce(l.last_accessed, r.last_accessed) AS last_accessed, coalesce(l.tier, r.tier) AS tier, l.tier IS NOT NULL AS is_local FROM l FULL JOIN r USING (file_path)",
    "cache_entries",
)
def c5_merge_views(spark: SparkSession, sf: str) -> DataFrame:
    """C5, U1, A28."""
    return K.merge_views(*_views(spark, sf))


@query(
    "SELECT file_path, size FROM cache_entries WHERE coalesce(nullif(regexp_extract(file_path, '^(.+)_chunk_[0-9]+$', 1), ''), '-') NOT IN (SELECT file_path FROM cache_entries WHERE tier = 'nvme' AND is_chunked)", "cache_entries"
)
def c6_without_cached_parents(spark: SparkSession, sf: str) -> DataFrame:
    """C6."""
    return K.without_cached_parents(logical(spark, sf, "cache_entries")).select("file_path", "size")


@query(
    """, par AS (SELECT DISTINCT path AS file_path, 7 AS n FROM read_events WHERE outcome = 'ok'),
ch AS (SELECT path AS file_path, chunk_index, bool_or(outcome <> 'error') AS persisted FROM read_events GROUP BY ALL)
SELECT file_path, bool_and(coalesce(persisted, false)) AS durable FROM (SELECT file_path, unnest(range(n)) AS chunk_index FROM par) LEFT JOIN ch USING (file_path, chunk_index) GROUP BY file_path""",
    "read_events",
)
def c7_durable_parents(spark: SparkSession, sf: str) -> DataFrame:
    """C7, J10."""
    t = logical(spark, sf, "read_events")
    parents = t.where("outcome = 'ok'").select(c("path").alias("file_path"), F.lit(7).cast("bigint").alias("num_chunks")).distinct()
    return K.durable_parents(parents, t.select(c("path").alias("parent"), "chunk_index", (c("outcome") != "error").alias("persisted")))


@query(
    """, f AS (SELECT file_path, max(CAST(ceil(file_size / 8388608) AS BIGINT)) AS n FROM replicas WHERE is_chunked GROUP BY file_path),
p AS (SELECT DISTINCT file_path, CAST(k['index'] AS BIGINT) AS chunk_index FROM (SELECT file_path, unnest(chunks) AS k FROM replicas))
SELECT file_path, chunk_index FROM (SELECT file_path, unnest(range(n)) AS chunk_index FROM f) ANTI JOIN p USING (file_path, chunk_index)""",
    "replicas",
)
def c10_missing_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """C10, U3, K5."""
    t = logical(spark, sf, "replicas")
    files = t.where("is_chunked").groupBy("file_path").agg(F.max(S.chunk_count(c("file_size"), F.lit(CHUNK).cast("bigint"))).alias("chunk_count"))
    return K.missing_chunks(files, t.select("file_path", F.explode("chunks").alias("k")).select("file_path", c("k.index").cast("bigint").alias("chunk_index")).distinct())


@query(
    """, paths AS (SELECT DISTINCT file_path FROM replicas), a AS (SELECT file_path, max(file_size) AS size FROM replicas WHERE storage_tier = 'nvme' AND l_linenumber = 1 GROUP BY file_path),
b AS (SELECT file_path, max(file_size) AS size FROM replicas WHERE storage_tier = 'peer' AND l_linenumber = 5 GROUP BY file_path),
f AS (SELECT file_path, arg_min(file_size, (seq, peer_id, storage_tier)) AS size, arg_min(chunk_size, (seq, peer_id, storage_tier)) AS stride FROM replicas WHERE is_chunked GROUP BY file_path)
SELECT file_path, coalesce(a.size, b.size, f.size) AS size, CASE WHEN coalesce(stride, 0) > 0 THEN stride ELSE 4194304 END AS stride,
  CASE WHEN a.size IS NOT NULL THEN 'local' WHEN b.size IS NOT NULL THEN 'view' WHEN f.size IS NOT NULL THEN 'replica' ELSE 'none' END AS origin
FROM paths LEFT JOIN a USING (file_path) LEFT JOIN b USING (file_path) LEFT JOIN f USING (file_path)""",
    "replicas",
)
def c11_resolve_chunked(spark: SparkSession, sf: str) -> DataFrame:
    """C11, G20, H20."""
    t = logical(spark, sf, "replicas")
    own = lambda where: t.where(where).groupBy("file_path").agg(F.max("file_size").alias("size"))
    return K.resolve_chunked(t.select("file_path").distinct(), own("storage_tier = 'nvme' AND l_linenumber = 1"), own("storage_tier = 'peer' AND l_linenumber = 5"), t, 4 * S.MIB)


@query(
    "SELECT CASE WHEN starts_with(file_path, '/models/') THEN split_part(file_path, '/', 3) END AS name, true AS is_dir FROM replicas GROUP BY ALL UNION ALL SELECT DISTINCT split_part(file_path, '/', 4), false FROM replicas WHERE starts_with(file_path, '/models/m7/')",
    "replicas",
)
def c16_directory_children(spark: SparkSession, sf: str) -> DataFrame:
    """C16, U4."""
    t = logical(spark, sf, "replicas")
    return K.children(t, "/models").union(K.children(t, "/models/m7/"))


@query(
    """SELECT count(*) FILTER (status = 'active') AS active_peers, count(*) AS total_peers, CAST(sum(available_space) FILTER (status = 'active') AS BIGINT) AS total_space, CAST(sum(used_space) FILTER (status = 'active') AS BIGINT) AS used_space,
  sum(network_speed_mbps) FILTER (status = 'active' AND network_speed_mbps > 0) / count(*) FILTER (status = 'active' AND network_speed_mbps > 0) AS avg_speed_mbps,
  sum(network_latency_ms) FILTER (status = 'active' AND network_latency_ms > 0) / count(*) FILTER (status = 'active' AND network_speed_mbps > 0) AS avg_latency_ms,
  (SELECT count(DISTINCT file_path) FROM replicas) AS file_count, CAST(sum(available_space - used_space) FILTER (status = 'active') AS BIGINT) AS available_space,
  CAST(sum(available_space + used_space) FILTER (status = 'active') AS BIGINT) AS capacity FROM peers""",
    "peers", "replicas",
)
def d1_cluster_stats(spark: SparkSession, sf: str) -> DataFrame:
    """D1, D11, A28."""
    return K.cluster_stats(logical(spark, sf, "peers"), logical(spark, sf, "replicas"))


_VIEW = """, t AS (SELECT file_path, storage_tier, count(*) AS n FROM replicas GROUP BY ALL),
k AS (SELECT file_path, i, count(*) AS n FROM (SELECT file_path, e['index'] AS i FROM (SELECT file_path, unnest(chunks) AS e FROM replicas)) GROUP BY ALL),
world AS (SELECT r.file_path, count(*) AS replica_count, max(file_size) AS size, bool_or(is_chunked) AS is_chunked, max(last_accessed) AS last_accessed, count(*) FILTER (storage_tier = 'nvme') AS nvme_replicas FROM replicas r GROUP BY r.file_path)"""


@query(
    _VIEW + """ SELECT w.*, (SELECT string_agg(storage_tier || ':' || n, ',' ORDER BY storage_tier || ':' || n) FROM t WHERE t.file_path = w.file_path) AS tier_replicas,
  (SELECT string_agg(i || ':' || n, ',' ORDER BY i) FROM k WHERE k.file_path = w.file_path) AS chunk_replicas FROM world w""",
    "replicas",
)
def d2_world_view(spark: SparkSession, sf: str) -> DataFrame:
    """D2, A28."""
    return K.world_view(logical(spark, sf, "replicas"))


@query(_VIEW + " SELECT count(*) AS files, CAST(sum(replica_count) AS BIGINT) AS replicas, CAST((SELECT count(*) FROM peers) AS BIGINT) AS peers FROM world", "replicas", "peers")
def d3_world_summary(spark: SparkSession, sf: str) -> DataFrame:
    """D3."""
    files = K.world_view(logical(spark, sf, "replicas")).agg(F.count("*").alias("files"), F.sum("replica_count").alias("replicas"))
    return files.crossJoin(logical(spark, sf, "peers").agg(F.count("*").alias("peers")))


@query("SELECT file_path, max(file_size) AS size, bool_or(is_chunked) AS is_chunked, CAST(coalesce(max(len(chunks)) FILTER (is_chunked), 0) AS BIGINT) AS chunk_count FROM replicas GROUP BY file_path", "replicas")
def d4_manifest(spark: SparkSession, sf: str) -> DataFrame:
    """D4, A15."""
    return K.manifest(logical(spark, sf, "replicas"))


@query(
    f""", f AS (SELECT file_path, max(file_size) AS size, bool_or(is_chunked) AS is_chunked, coalesce(max(len(chunks)) FILTER (is_chunked), 0) AS listed, coalesce(arg_max(chunk_size, seq) FILTER (chunk_size > 0), 8388608) AS chunk_size
  FROM replicas WHERE starts_with(file_path, '/models/m1') AND NOT {_PARENT} GROUP BY file_path)
SELECT file_path, size, is_chunked, chunk_size, CAST(CASE WHEN NOT is_chunked THEN 0 WHEN listed > 0 THEN listed ELSE ceil(size / chunk_size) END AS BIGINT) AS chunk_count FROM f""",
    "replicas",
)
def d5_warm_targets(spark: SparkSession, sf: str) -> DataFrame:
    """D5, G23, K8."""
    return K.warm_targets(logical(spark, sf, "replicas"), "/models/m1", CHUNK)


@query("SELECT file_path, arg_min(peer_id, (seq, peer_id, storage_tier)) AS peer_id, arg_min(storage_tier, (seq, peer_id, storage_tier)) AS storage_tier, arg_min(file_size, (seq, peer_id, storage_tier)) AS file_size FROM replicas GROUP BY file_path", "replicas")
def d6_first_locations(spark: SparkSession, sf: str) -> DataFrame:
    """D6."""
    return K.first_locations(logical(spark, sf, "replicas"))


@query("SELECT file_path, count(DISTINCT peer_id) + CASE WHEN bool_or(peer_id = 'peer-00004') THEN 0 ELSE 1 END AS holders FROM replicas WHERE storage_tier <> 'cloud' AND peer_id <> '' GROUP BY file_path", "replicas")
def d7_holder_counts(spark: SparkSession, sf: str) -> DataFrame:
    """D7."""
    return K.holder_counts(logical(spark, sf, "replicas"), "peer-00004")


@query(
    _VIEW + f""" SELECT file_path, nvme_replicas, size, date_diff('second', last_accessed, TIMESTAMP '{FILES_NOW}') AS age_s, 12 - nvme_replicas AS missing FROM world
WHERE nvme_replicas < 12 AND last_accessed > TIMESTAMP '{FILES_NOW}' - to_days({HOT_DAYS}) AND NOT {_PARENT} AND size > 0 AND size <= 67108864""",
    "replicas",
)
def g17_hot_under_replicated(spark: SparkSession, sf: str) -> DataFrame:
    """The flagship: a rollup of all replicas and then the hot files that lack fast copies."""
    return K.hot_under_replicated(K.world_view(logical(spark, sf, "replicas")), at(FILES_NOW), HOT_DAYS * DAY, 12)


@query(
    _VIEW + ", h AS (SELECT nvme_replicas AS replicas, count(*) AS files FROM world GROUP BY ALL) SELECT replicas, coalesce(files, 0) AS files FROM (SELECT unnest(range(greatest(max(replicas), 3) + 1)) AS replicas FROM h) LEFT JOIN h USING (replicas)",
    "replicas",
)
def d12_replica_histogram(spark: SparkSession, sf: str) -> DataFrame:
    """D12."""
    return K.replica_histogram(K.world_view(logical(spark, sf, "replicas")))


@query(_VIEW + " SELECT CAST(trunc(median(nvme_replicas)) AS BIGINT) AS median_replicas FROM world", "replicas")
def d13_median_replicas(spark: SparkSession, sf: str) -> DataFrame:
    """D13."""
    return K.world_view(logical(spark, sf, "replicas")).agg(F.median("nvme_replicas").cast("bigint").alias("median_replicas"))


@query(
    "SELECT file_path, string_agg(DISTINCT lower(storage_tier), ', ' ORDER BY lower(storage_tier)) AS tiers, string_agg(DISTINCT peer_id, ', ' ORDER BY peer_id) AS holders, max(last_accessed) AS last_accessed FROM replicas GROUP BY file_path", "replicas"
)
def d14_holder_strings(spark: SparkSession, sf: str) -> DataFrame:
    """D14."""
    return K.holder_strings(logical(spark, sf, "replicas"))


@query("SELECT DISTINCT unnest(['pool', 'zone']) AS label, unnest(['pool=' || pool, 'zone=' || zone]) AS pair FROM peers", "peers")
def d15_label_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """D15."""
    return K.label_pairs(logical(spark, sf, "peers"))


@query("SELECT file_path, peer_id, storage_tier, seq, file_size, last_accessed FROM replicas", "replicas")
def j3_upsert_replicas(spark: SparkSession, sf: str) -> DataFrame:
    """The oracle's replicas come from window functions over all events."""
    return K.upsert_replicas(logical(spark, sf, "file_locations")).select("file_path", "peer_id", "storage_tier", "seq", "file_size", "last_accessed")


@query(
    """SELECT peer_id, arg_max(ts, seq) AS ts, arg_max(status, seq) AS status, arg_max(available_space, seq) AS available_space, arg_max(used_space, seq) AS used_space,
  arg_max(network_speed_mbps, seq) FILTER (network_speed_mbps > 0) AS network_speed_mbps, arg_max(network_latency_ms, seq) FILTER (network_latency_ms > 0) AS network_latency_ms FROM heartbeats GROUP BY peer_id""",
    "heartbeats",
)
def j1_latest_peers(spark: SparkSession, sf: str) -> DataFrame:
    """J1, I1."""
    return K.latest_peers(logical(spark, sf, "heartbeats"))


@query(
    """SELECT id, CASE WHEN last_heartbeat < TIMESTAMP '2024-01-31 00:00:00' - to_seconds(60) THEN 'inactive' ELSE status END AS status, 'marked' AS kind FROM peers
UNION ALL SELECT id, status, 'leased' FROM peers WHERE last_heartbeat IS NULL OR last_heartbeat >= TIMESTAMP '2024-01-31 00:00:00' - to_seconds(90)""",
    "peers",
)
def j4_liveness(spark: SparkSession, sf: str) -> DataFrame:
    """Both kinds of store."""
    p = logical(spark, sf, "peers")
    marked = K.mark_inactive(p, at(EVENTS_NOW)).select("id", "status", F.lit("marked").alias("kind"))
    return marked.union(K.mark_inactive(p, at(EVENTS_NOW), 90, drop=True).select("id", "status", F.lit("leased").alias("kind")))


@query(
    """, doomed AS (SELECT file_path, num_chunks FROM cache_entries WHERE priority = '1-URGENT' AND tier = 'nvme')
SELECT file_path, size FROM cache_entries WHERE file_path NOT IN (SELECT file_path FROM doomed UNION SELECT file_path || '_chunk_' || i FROM (SELECT file_path, unnest(range(num_chunks)) AS i FROM doomed))
  AND coalesce(nullif(regexp_extract(file_path, '^(.+)_chunk_[0-9]+$', 1), ''), '-') NOT IN (SELECT file_path FROM doomed)""",
    "cache_entries",
)
def j5_delete_objects(spark: SparkSession, sf: str) -> DataFrame:
    """J5, U6, J13."""
    t = logical(spark, sf, "cache_entries")
    return K.delete_objects(t, t.where("priority = '1-URGENT' AND tier = 'nvme'").select("file_path", "num_chunks")).select("file_path", "size")


@query("SELECT CASE WHEN file_path = '/orders/o10.bin' OR starts_with(file_path, '/orders/o10.bin_chunk_') THEN replace(file_path, '/orders/o10.bin', '/orders/new.bin') ELSE file_path END AS file_path, size FROM cache_entries WHERE file_path <> '/orders/new.bin'", "cache_entries")
def j6_rename(spark: SparkSession, sf: str) -> DataFrame:
    """J6."""
    return K.rename(logical(spark, sf, "cache_entries"), "/orders/o10.bin", "/orders/new.bin").select("file_path", "size")


@query(
    """, seen AS (SELECT path, ts FROM remote_reads UNION ALL SELECT regexp_extract(path, '^(.+)_chunk_[0-9]+$', 1), ts FROM remote_reads WHERE regexp_matches(path, '_chunk_[0-9]+$')),
f AS (SELECT file_path, arg_min(last_accessed, (seq, last_accessed)) AS last_accessed FROM replicas GROUP BY file_path), l AS (SELECT path AS file_path, max(ts) AS ts FROM seen GROUP BY path)
SELECT file_path, coalesce(greatest(last_accessed, ts), last_accessed) AS last_accessed FROM f LEFT JOIN l USING (file_path)""",
    "replicas", "remote_reads",
)
def j9_touch(spark: SparkSession, sf: str) -> DataFrame:
    """J9."""
    files = logical(spark, sf, "replicas").groupBy("file_path").agg(F.min_by("last_accessed", F.struct("seq", "last_accessed")).alias("last_accessed"))
    return K.touch(files, logical(spark, sf, "remote_reads"))


@query(
    "SELECT id, min(updated_at) AS started_at, arg_max(status, seq) AS status, arg_max(files, seq) AS files, arg_max(done, seq) AS done, arg_max(updated_at, seq) AS updated_at FROM warm_jobs GROUP BY id", "warm_jobs"
)
def i14_latest_jobs(spark: SparkSession, sf: str) -> DataFrame:
    """I14, C15, A23."""
    return K.latest_jobs(logical(spark, sf, "warm_jobs"))


@query(
    """, j AS (SELECT id, arg_max(CASE WHEN seq % 1000 = 375 THEN 'running' ELSE status END, seq) AS status, max(updated_at) AS updated_at FROM warm_jobs GROUP BY id),
r AS (SELECT *, row_number() OVER (ORDER BY updated_at DESC, id DESC) AS rn FROM j WHERE status <> 'running')
SELECT id, status FROM j WHERE status = 'running' UNION ALL SELECT id, status FROM r WHERE rn <= 120 - (SELECT count(*) FROM j WHERE status = 'running')""",
    "warm_jobs",
)
def w14_retained_of_all_jobs(spark: SparkSession, sf: str) -> DataFrame:
    """Over all updates; one job in 125 still runs."""
    t = logical(spark, sf, "warm_jobs").withColumn("status", F.expr("CASE WHEN seq % 1000 = 375 THEN 'running' ELSE status END"))
    return K.retained_jobs(K.latest_jobs(t).select("id", "status", "updated_at"), 120).select("id", "status")


same("w14_retained_jobs", "w14_retained_of_all_jobs")


@query("SELECT seq, CASE seq % 6 WHEN 2 THEN 'peer' WHEN 3 THEN 'cloud' ELSE 'nvme' END AS store, true AS jitter_ok FROM disks", "disks")
def a27_tier_dispatch(spark: SparkSession, sf: str) -> DataFrame:
    """A27, H34."""
    j = S.jittered(F.lit(15.0))
    return logical(spark, sf, "disks").select("seq", S.storage_of(c("seq") % 6).alias("store"), ((j >= 7.5) & (j <= 22.5)).alias("jitter_ok"))


@query("SELECT id, 'pool=' || CASE WHEN zone = 'a' THEN 'node' ELSE pool END || ', zone=' || zone AS labels FROM peers", "peers")
def u5_union_labels(spark: SparkSession, sf: str) -> DataFrame:
    """U5."""
    node = F.when(c("zone") == "a", F.create_map(F.lit("pool"), F.lit("node"))).otherwise(F.create_map().cast("map<string,string>"))
    return logical(spark, sf, "peers").select("id", S.label_string(S.union_labels(c("labels"), node)).alias("labels"))


@query("SELECT id, status, used_space, pool FROM peers", "peers")
def h37_json(spark: SparkSession, sf: str) -> DataFrame:
    """Rows to JSON text and back, by a declared type."""
    from quayside import schema

    t = logical(spark, sf, "peers")
    text = t.select(F.to_json(F.struct(*[x for x in schema.PEERS.names])).alias("j"))
    return text.select(F.from_json("j", schema.PEERS).alias("p")).select("p.id", "p.status", "p.used_space", F.element_at("p.labels", F.lit("pool")).alias("pool"))


@query(
    """, r AS (SELECT *, row_number() OVER (PARTITION BY volume_id ORDER BY seq) AS i FROM sessions),
f(volume_id, i, refs) AS (SELECT volume_id, 0::BIGINT, 0 FROM (SELECT DISTINCT volume_id FROM r) UNION ALL SELECT r.volume_id, r.i, CASE WHEN op = 'create' THEN refs + 1 ELSE greatest(refs - 1, 0) END FROM f JOIN r ON r.volume_id = f.volume_id AND r.i = f.i + 1),
n AS (SELECT volume_id, CAST(arg_max(refs, i) AS BIGINT) AS refs FROM f GROUP BY volume_id), l AS (SELECT volume_id, arg_max(root_path, seq) AS root_path, arg_max(pinned, seq) AS pinned FROM sessions WHERE op = 'create' GROUP BY volume_id)
SELECT volume_id, refs, root_path, pinned FROM n JOIN l USING (volume_id) WHERE refs > 0""",
    "sessions",
)
def d31_live_sessions(spark: SparkSession, sf: str) -> DataFrame:
    """D31."""
    return K.live_sessions(logical(spark, sf, "sessions"))


@query(
    """, s AS (SELECT id, 'saved' AS origin FROM peers WHERE zone = 'a') SELECT 'replace' AS kind, id, origin FROM s UNION ALL SELECT 'merge', id, origin FROM s UNION ALL SELECT 'merge', id, 'now' FROM peers WHERE pool = 'gpu' AND id NOT IN (SELECT id FROM s)""", "peers"
)
def j11_restore(spark: SparkSession, sf: str) -> DataFrame:
    """J11."""
    p = logical(spark, sf, "peers")
    saved, now = p.where("zone = 'a'").select("id", F.lit("saved").alias("origin")), p.where("pool = 'gpu'").select("id", F.lit("now").alias("origin"))
    return K.restore_state(now, saved, ["id"], False).select(F.lit("replace").alias("kind"), "*").union(K.restore_state(now, saved, ["id"], True).select(F.lit("merge").alias("kind"), "*"))


@query(
    """, held AS (SELECT DISTINCT file_path, peer_id AS id FROM replicas WHERE storage_tier <> 'cloud'), act AS (SELECT id FROM peers WHERE status = 'active'),
lack AS (SELECT p.file_path, a.id FROM (SELECT DISTINCT file_path FROM held) p CROSS JOIN act a ANTI JOIN held h ON h.file_path = p.file_path AND h.id = a.id),
n AS (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY id) AS i, count(*) OVER (PARTITION BY file_path) AS n FROM lack),
src AS (SELECT file_path, arg_min(peer_id, (seq, peer_id)) AS source FROM replicas WHERE storage_tier <> 'cloud' AND peer_id IN (SELECT id FROM act) GROUP BY file_path)
SELECT file_path, source, id AS target FROM n JOIN src USING (file_path) WHERE i <= greatest(1, ceil(n * 5 / 100))""",
    "replicas", "peers",
)
def j14_seed_plan_of_all_paths(spark: SparkSession, sf: str) -> DataFrame:
    """Over all paths."""
    return K.seed_plan(logical(spark, sf, "peers"), logical(spark, sf, "replicas"), 5)


same("j14_seed_plan", "j14_seed_plan_of_all_paths")
