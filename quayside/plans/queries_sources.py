"""Queries of sources and sinks (survey 2.A): each writes a table to a run's folder, reads it back, and is held against the
table that it came from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quayside.functions import scalars as S
from quayside.operators import catalog as K
from quayside.operators import selection as P
from quayside.plans.queries_catalog import ORACLES as CATALOG
from quayside.plans.queries_streaming import all_steps, as_stream, folder
from quayside.sources import snapshots as N
from quayside.sources.adapters import logical, oracle
from quayside.streaming import state

c = F.col
QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str, *tables: str):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = oracle(sql, *tables) if tables else sql
        return f

    return add


def _objects(spark: SparkSession, sf: str) -> DataFrame:
    return logical(spark, sf, "objects").where("text IS NOT NULL").select("path", F.encode("text", "UTF-8").alias("data"))


@query("SELECT count(*) AS lines, CAST(sum(octet_length(encode(line)) + 1) AS BIGINT) AS bytes FROM metric_lines", "metric_lines")
def a1_object_bytes(spark: SparkSession, sf: str) -> DataFrame:
    """Files read as objects with their bytes; the scheme of the folder picks the store."""
    base = folder(spark)
    N.write_metrics(logical(spark, sf, "metric_lines"), f"{base}/objects")
    t = N.read_objects(spark, f"{base}/objects", "part-*")
    lines = F.octet_length("data") - F.octet_length(F.encode(F.replace(F.decode("data", "UTF-8"), F.lit("\n")), "UTF-8"))
    return t.agg(F.sum(lines).cast("bigint").alias("lines"), F.sum("length").alias("bytes"))


@query("SELECT path, CAST(octet_length(encode(text)) AS BIGINT) AS size, md5(text) AS digest FROM objects WHERE text IS NOT NULL", "objects")
def a2_committed_objects(spark: SparkSession, sf: str) -> DataFrame:
    """Objects written in two parts and committed; a second write that is given up leaves them as they are."""
    base, t = folder(spark), _objects(spark, sf)
    first = N.StagedWrite(spark, f"{base}/objects")
    first.write(t.where(F.octet_length("data") % 2 == 0))
    first.write(t.where(F.octet_length("data") % 2 == 1))
    first.commit()
    second = N.StagedWrite(spark, f"{base}/objects")
    second.write(t.withColumn("data", F.encode(F.lit("lost"), "UTF-8")))
    second.abort()
    return spark.read.parquet(f"{base}/objects").select("path", F.octet_length("data").cast("bigint").alias("size"), F.md5("data").alias("digest"))


@query(
    """, l AS (SELECT CASE WHEN size % 5 = 0 THEN file_path || '.tmp' WHEN size % 5 = 1 THEN regexp_replace(file_path, '/([^/]*)$', '/.\\1') WHEN size % 5 = 2 THEN file_path || '.tmp.7' ELSE file_path END AS file_path, size, last_accessed, size % 5 < 3 AS own FROM cache_entries)
SELECT file_path, size, last_accessed FROM l WHERE NOT own AND file_path NOT IN (SELECT file_path FROM cache_entries WHERE tier = 'cloud')""",
    "cache_entries",
)
def a3_rehydrated(spark: SparkSession, sf: str) -> DataFrame:
    """A listing's files that the catalog does not know, without the cache's own names."""
    t = logical(spark, sf, "cache_entries")
    name = F.when(c("size") % 5 == 0, F.concat("file_path", F.lit(".tmp"))).when(c("size") % 5 == 1, F.regexp_replace("file_path", r"/([^/]*)$", "/.$1")).when(c("size") % 5 == 2, F.concat("file_path", F.lit(".tmp.7"))).otherwise(c("file_path"))
    listing = t.select(F.concat(F.lit("file:"), name).alias("path"), c("size").alias("length"), c("last_accessed").alias("modificationTime"))
    return N.found_entries(listing, t.where("tier = 'cloud'")).select("file_path", "size", "last_accessed")


@query(
    "SELECT path, CASE WHEN length % 3 = 0 THEN substr(path, 2) WHEN length % 3 = 1 THEN path END AS key, CASE WHEN length % 3 < 2 THEN CAST(length AS BIGINT) END AS size FROM objects WHERE length IS NOT NULL", "objects"
)
def a4_key_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """A4, H7: objects of a store that keeps some keys with a leading slash, some without, and some not at all."""
    t = logical(spark, sf, "objects").where("length IS NOT NULL")
    store = t.where("length % 3 < 2").select(F.when(c("length") % 3 == 0, F.substring("path", 2, 1 << 30)).otherwise(c("path")).alias("key"), c("length").cast("bigint").alias("length"))
    return N.key_candidates(t.select("path"), store).withColumnRenamed("length", "size")


@query("SELECT path FROM objects WHERE false", "objects")
def a11_no_tier(spark: SparkSession, sf: str) -> DataFrame:
    """A tier that holds nothing: no object has a copy there."""
    return logical(spark, sf, "objects").select("path").join(N.no_tier(spark).select("path"), "path")


@query(
    "SELECT 'bad' AS kind, CASE WHEN seq % 50 = 0 THEN 'row ' || seq END AS id, CAST(NULL AS BIGINT) AS used_space FROM warm_jobs WHERE seq % 50 = 0 UNION ALL SELECT 'peer', 'p' || seq, CAST(bytes AS BIGINT) FROM warm_jobs WHERE seq % 50 <> 0",
    "warm_jobs",
)
def a13_rows_with_bad_ones(spark: SparkSession, sf: str) -> DataFrame:
    """JSON rows of a scan; those that are none are set apart, not lost."""
    base = folder(spark)
    row = F.to_json(F.struct(F.concat(F.lit("p"), "seq").alias("id"), c("bytes").alias("used_space")))
    t = logical(spark, sf, "warm_jobs")
    t.select(F.when(c("seq") % 50 == 0, F.concat(F.lit("row "), "seq")).otherwise(row).alias("value")).write.text(f"{base}/peers")
    spark.createDataFrame([], "value string").write.text(f"{base}/files")
    peers, _, bad = N.read_state(spark, base)
    return bad.select(F.lit("bad").alias("kind"), c("_corrupt_record").alias("id"), F.lit(None).cast("bigint").alias("used_space")).union(peers.select(F.lit("peer").alias("kind"), "id", "used_space"))


@query(
    "SELECT 'file' AS kind, file_path || '|' || peer_id || '|' || storage_tier AS id, file_size AS n FROM replicas UNION ALL SELECT 'peer', id || '|' || pool || '|' || zone, used_space FROM peers", "replicas", "peers"
)
def a14_state_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """The coordinator's state saved and restored."""
    base = folder(spark)
    N.write_state(logical(spark, sf, "peers").drop("last_heartbeat", "pool", "zone"), logical(spark, sf, "replicas").drop("last_accessed", "l_linenumber"), base, "gzip")
    peers, files, _ = N.read_state(spark, base)
    rows = files.select(F.lit("file").alias("kind"), F.concat_ws("|", "file_path", "peer_id", "storage_tier").alias("id"), c("file_size").alias("n"))
    return rows.union(peers.select(F.lit("peer").alias("kind"), F.concat_ws("|", "id", c("labels")["pool"], c("labels")["zone"]).alias("id"), c("used_space").alias("n")))


@query(CATALOG["d4_manifest"])
def a15_manifest_restored(spark: SparkSession, sf: str) -> DataFrame:
    """A manifest saved and read back."""
    base = folder(spark)
    N.write_manifest(K.manifest(logical(spark, sf, "replicas")), f"{base}/manifest")
    return N.read_manifest(spark, f"{base}/manifest")


@query(
    """SELECT CAST(seq AS BIGINT) AS run, 'commit "' || id || '", ' || status AS "commit", CAST(bytes AS DOUBLE) / 1048576 AS read_mbps, CAST(seq % 100 AS DOUBLE) AS nvme_share_pct, n AS times FROM warm_jobs, (SELECT unnest([1, 2]) AS n)""", "warm_jobs"
)
def a19_benchmark_csv(spark: SparkSession, sf: str) -> DataFrame:
    """Benchmark rows appended twice to CSV, with quotes and commas in a field."""
    base = folder(spark)
    t = logical(spark, sf, "warm_jobs")
    name = F.concat(F.lit('commit "'), "id", F.lit('", '), "status")
    share = (c("seq") % 100).cast("double")
    runs = t.select(c("seq").alias("run"), name.alias("commit"), (c("bytes").cast("double") / S.MIB).alias("read_mbps"), share.alias("nvme_share_pct"), F.lit(0.0).alias("peer_share_pct"))
    for n in (1.0, 2.0):
        N.append_benchmark(runs.withColumn("cloud_share_pct", F.lit(n)), f"{base}/runs")
    back = N.read_benchmark(spark, f"{base}/runs")
    return back.select("run", "commit", "read_mbps", "nvme_share_pct", c("cloud_share_pct").cast("int").alias("times"))


@query("SELECT device, CASE WHEN seq % 4 = 1 THEN mount_point || ' b' ELSE mount_point END AS mount_point, filesystem_type FROM disks WHERE seq % 9 <> 0", "disks")
def a20_mounts(spark: SparkSession, sf: str) -> DataFrame:
    """A mount table as text, with escaped spaces and lines that are cut short."""
    base = folder(spark)
    mount = F.when(c("seq") % 4 == 1, F.concat("mount_point", F.lit("\\040b"))).otherwise(c("mount_point"))
    line = F.when(c("seq") % 9 == 0, c("device")).otherwise(F.concat_ws(" ", "device", mount, "filesystem_type", F.lit("rw 0 0")))
    logical(spark, sf, "disks").select(line.alias("value")).write.text(f"{base}/mounts")
    return N.read_mounts(spark, f"{base}/mounts")


@query("SELECT id AS name, 'topology=' || zone AS labels FROM peers", "peers")
def a21_node_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Node documents with their labels, those in the spec taken and renamed."""
    base = folder(spark)
    doc = F.struct(F.struct(c("id").alias("name"), "labels").alias("metadata"))
    logical(spark, sf, "peers").select(F.to_json(doc).alias("value")).write.text(f"{base}/nodes")
    return N.read_node_labels(spark, f"{base}/nodes", {"zone": "topology"}).select("name", S.label_string(c("labels")).alias("labels"))


@query(
    "SELECT mount_point || '/cache' AS cache_dir, CAST(free_bytes AS BIGINT) AS cache_bytes, disk_class FROM disks WHERE free_bytes > 0 AND seq % 6 <> 0 AND filesystem_type IN ('ext4', 'xfs', 'btrfs') AND starts_with(device, '/dev/') AND free_bytes >= 2147483648", "disks"
)
def a29_node_configs(spark: SparkSession, sf: str) -> DataFrame:
    """Configs of the eligible disks written and read; one without a folder is none."""
    base = folder(spark)
    t = P.eligible_mounts(logical(spark, sf, "disks"))
    N.write_node_config(t.select(F.when(c("seq") % 6 == 0, "").otherwise(F.concat("mount_point", F.lit("/cache"))).alias("cache_dir"), c("free_bytes").alias("cache_bytes"), "disk_class"), f"{base}/config")
    return N.read_node_config(spark, f"{base}/config")


@query(
    """, o AS (SELECT path, CASE WHEN length % 5 = 0 THEN 'failed' WHEN length % 5 = 1 THEN 'skipped' ELSE 'restored' END AS outcome FROM objects WHERE text IS NOT NULL)
SELECT outcome, count(*) AS files, min(path) AS first_path, max(path) AS last_path FROM o GROUP BY outcome""",
    "objects",
)
def d25_restore_tallies(spark: SparkSession, sf: str) -> DataFrame:
    """A snapshot restored over what is there: how many files were restored, skipped and failed, with the first and
    last of each."""
    t = logical(spark, sf, "objects").where("text IS NOT NULL").select("path", F.encode("text", "UTF-8").alias("data"), "length")
    snapshot = N.fs_snapshot(t.select("path", "data")).join(t.select(c("path").alias("file_path"), "length"), "file_path")
    bad = snapshot.withColumn("content_b64", F.when(c("length") % 5 == 0, "!not base64!").otherwise(c("content_b64")))
    out = N.fs_restore(bad.drop("length"), t.where("length % 5 = 1").select("path"))
    return out.groupBy("outcome").agg(F.count("*").alias("files"), F.min("path").alias("first_path"), F.max("path").alias("last_path"))


@query(CATALOG["d4_manifest"])
def i12_periodic_manifest(spark: SparkSession, sf: str) -> DataFrame:
    """A stream's ticks that each run the batch query and replace its result."""
    base = folder(spark)
    ticks = as_stream(spark, logical(spark, sf, "heartbeats").select("seq", "ts"), base, 2)
    all_steps(ticks.writeStream.foreachBatch(state.periodic(lambda: K.manifest(logical(spark, sf, "replicas")), f"{base}/manifest")), base)
    return spark.read.parquet(f"{base}/manifest")
