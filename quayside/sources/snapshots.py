"""Sources and sinks of a fleet: catalogs, manifests, snapshots, metric text, benchmark tables, mounts and objects (2.A)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quayside import schema
from quayside.functions import scalars as S

c = F.col


def write_state(peers: DataFrame, replicas: DataFrame, path: str, compression: str = "none") -> None:
    """Peers and replicas as JSON rows of two folders, replaced as a whole. Plain text of replicas is large;
    reading knows the compression by the names of files."""
    peers.write.mode("overwrite").json(f"{path}/peers", compression=compression)
    replicas.write.mode("overwrite").json(f"{path}/files", compression=compression)


def read_state(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(peers, replicas, bad rows of both); a row that is no JSON of the schema is set apart, not lost."""
    out, bad = [], []
    for name, kind in (("peers", schema.PEERS), ("files", schema.REPLICAS)):
        raw = spark.read.schema(schema.with_corrupt(kind)).json(f"{path}/{name}", mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt_record").cache()
        bad.append(raw.where(c("_corrupt_record").isNotNull()).select(F.lit(name).alias("kind"), "_corrupt_record"))
        out.append(raw.where(c("_corrupt_record").isNull()).drop("_corrupt_record"))
    return out[0], out[1], bad[0].union(bad[1])


def read_nested_state(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """One document with a map of peers by id and of replica lists by path."""
    doc = spark.read.schema(schema.STATE).json(path, multiLine=True)
    peers = doc.select(F.explode("peers").alias("id", "p")).select("p.*")
    files = doc.select(F.explode("files").alias("file_path", "l")).select("file_path", F.posexplode("l").alias("seq", "r")).select("file_path", c("seq").cast("bigint").alias("seq"), *[c(f"r.{x}") for x in schema.LOCATION.names])
    return peers, files


def write_manifest(manifest: DataFrame, path: str) -> None:
    """A15."""
    manifest.orderBy("file_path").write.mode("overwrite").json(path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schema.MANIFEST).json(path)


def fs_snapshot(objects: DataFrame, prefix: str = "", max_files: int = 0, data: bool = True) -> DataFrame:
    """Objects (path, data) under a prefix in order, at most max_files (0: all), the bytes in base64."""
    t = objects.where(c("path").startswith(prefix)) if prefix else objects
    t = t.orderBy("path").limit(max_files) if max_files > 0 else t
    return t.select(c("path").alias("file_path"), F.octet_length("data").cast("bigint").alias("size"), *([S.to_base64(c("data")).alias("content_b64")] if data else []))


def fs_restore(snapshot: DataFrame, there: DataFrame, overwrite: bool = False) -> DataFrame:
    """Rows (path, data, outcome): restored, skipped as already there, or failed with data null."""
    raw = F.when(c("content_b64").rlike(r"^[A-Za-z0-9+/\r\n]*={0,2}$"), F.try_to_binary("content_b64", F.lit("base64")))
    t = snapshot.join(there.select(c("path").alias("file_path"), F.lit(True).alias("__there")), "file_path", "left").withColumn("data", raw)
    skip = F.lit(not overwrite) & c("__there").isNotNull()
    return t.select(c("file_path").alias("path"), F.when(~skip, c("data")).alias("data"), F.when(skip, "skipped").when(c("data").isNull(), "failed").otherwise("restored").alias("outcome"))


def write_metrics(lines: DataFrame, path: str) -> None:
    """A17."""
    lines.select("line").write.mode("overwrite").text(path)


def read_metrics(spark: SparkSession, path: str, node: str) -> DataFrame:
    """(line, line_no, node) of a text file; line numbers go up in the file's order."""
    return spark.read.text(path).select(c("value").alias("line"), F.monotonically_increasing_id().alias("line_no"), F.lit(node).alias("node"))


def append_benchmark(runs: DataFrame, path: str) -> None:
    """A19, H38."""
    runs.write.mode("append").csv(path, header=True, escape='"')


def read_benchmark(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schema.BENCHMARK).csv(path, header=True, escape='"')


def read_mounts(spark: SparkSession, path: str) -> DataFrame:
    """(device, mount_point, filesystem_type) of a mount table; lines with fewer fields are skipped, \\040 is a space."""
    f = F.split(F.trim(c("value")), r"\s+")
    t = spark.read.text(path).where(F.size(f) >= 3)
    return t.select(f[0].alias("device"), F.replace(f[1], F.lit("\\040"), F.lit(" ")).alias("mount_point"), f[2].alias("filesystem_type"))


def read_node_labels(spark: SparkSession, path: str, spec: dict[str, str]) -> DataFrame:
    """(name, labels): of node documents the labels in spec, renamed."""
    t = spark.read.schema("metadata STRUCT<name: STRING, labels: MAP<STRING, STRING>>").json(path)
    return t.select("metadata.name", S.select_labels(c("metadata.labels"), spec).alias("labels"))


def read_objects(spark: SparkSession, path: str, names: str = "*") -> DataFrame:
    """(path, modified, length, data) of files; the scheme of the path (file, s3a, abfss, gs) picks the store.
    Spark plans no read of a file without bytes, so those are not among them."""
    t = spark.read.format("binaryFile").option("pathGlobFilter", names).option("recursiveFileLookup", "true").load(path)
    return t.select("path", c("modificationTime").alias("modified"), "length", c("content").alias("data"))


def key_candidates(keys: DataFrame, objects: DataFrame) -> DataFrame:
    """A4, H7: objects by a key, with or without its leading /; the cleaned one first."""
    a = objects.select(c("key").alias("a"), c("length").alias("la"))
    b = objects.select(c("key").alias("b"), c("length").alias("lb"))
    clean = S.object_key(c("path"))
    t = keys.join(a, clean == c("a"), "left").join(b, F.concat(F.lit("/"), clean) == c("b"), "left")
    return t.select("path", F.coalesce("a", "b").alias("key"), F.coalesce("la", "lb").alias("length"))


def is_internal_name(path):  # noqa: ANN001, ANN201
    """Files that the cache keeps for itself."""
    base = F.regexp_extract(path, r"([^/]*)$", 1)
    return base.endswith(".tmp") | base.startswith(".") | F.contains(base, F.lit(".tmp."))


def found_entries(listing: DataFrame, known: DataFrame) -> DataFrame:
    """Cache entries of a listing (path, length, modificationTime) that are not known, last accessed when they were
    written; the cache's own files are skipped."""
    rel = F.regexp_extract(c("path"), r"^(?:[a-z0-9]+:)?(?://)?(.*)$", 1)
    t = listing.select(rel.alias("file_path"), c("length").alias("size"), c("modificationTime").alias("last_accessed"), F.lit("nvme").alias("tier"))
    return t.where(~is_internal_name(c("file_path"))).join(known.select("file_path"), "file_path", "left_anti")


def rehydrate(spark: SparkSession, path: str, known: DataFrame) -> DataFrame:
    """A3: found_entries of a folder. Only names and sizes are read."""
    t = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "modificationTime", "length")
    return found_entries(t, known)


class StagedWrite:
    """A2: objects written beside their place and moved there as a whole, or dropped; readers never see a part."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.path, self.staged = path, f"{path}.staged-{uuid.uuid4().hex}"
        self._at = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._at(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def write(self, objects: DataFrame) -> None:
        objects.write.mode("append").parquet(self.staged)

    def commit(self) -> None:
        self._fs.delete(self._at(self.path), True)
        if not self._fs.rename(self._at(self.staged), self._at(self.path)):
            raise OSError(f"{self.staged} can't be moved to {self.path}")

    def abort(self) -> None:
        self._fs.delete(self._at(self.staged), True)


def write_objects(objects: DataFrame, path: str) -> None:
    """Objects (path, data) as Parquet, by Spark's commit protocol: all or nothing."""
    objects.write.mode("overwrite").parquet(path)


def no_tier(spark: SparkSession) -> DataFrame:
    """A tier that holds nothing."""
    return spark.createDataFrame([], "path string, data binary")


def write_node_config(row: DataFrame, path: str) -> None:
    """The chosen cache folder and size of a node."""
    row.coalesce(1).write.mode("overwrite").json(path)


def read_node_config(spark: SparkSession, path: str) -> DataFrame:
    """Only a config with a folder and a size is one."""
    return spark.read.schema("cache_dir STRING, cache_bytes BIGINT, disk_class STRING").json(path).where("cache_dir <> '' AND cache_bytes > 0")
