"""Helpers that the training-data operators share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only where all run on this machine and it is unset
    it is one of our own."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="quayside-")
        sc.setCheckpointDir(found)
    return found


_stashed: dict[int, tuple[SparkSession, str]] = {}


def _drop_stash() -> None:
    for spark, base in list(_stashed.values()):
        try:
            path = spark._jvm.org.apache.hadoop.fs.Path(base)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        except Exception:  # the JVM may be gone at exit; the folder is scratch space
            pass


def stash(df: DataFrame, options: dict[str, str] | None = None) -> DataFrame:
    """Cuts the lineage: writes df to the shared folder as Parquet and reads it again. Survives lost executors. options: the
    writer's."""
    spark = df.sparkSession
    key = id(spark.sparkContext)
    if key not in _stashed:
        if not _stashed:
            atexit.register(_drop_stash)
        _stashed[key] = (spark, f"{shared_dir(spark)}/quayside-{uuid.uuid4().hex}")
    path = f"{_stashed[key][1]}/{uuid.uuid4().hex}"
    df.write.options(**options or {}).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, order: list[Column], sums: dict[str, str]) -> DataFrame:
    """df with __rank (from 0, in the given total order) and, for each name: column of sums, the inclusive running sum.

    Rows are range-partitioned and only one row a partition meets in a single task, so no task holds the whole table.
    """
    parts = stash(df.orderBy(*order).withColumn("__pid", F.spark_partition_id()))
    per = parts.groupBy("__pid").agg(F.count("*").alias("__n"), *[F.sum(c).alias(f"__s_{k}") for k, c in sums.items()])
    before = Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select("__pid", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"__o_{c[2:]}") for c in per.columns if c != "__pid"])
    inside = Window.partitionBy("__pid").orderBy(*order)
    running = inside.rowsBetween(Window.unboundedPreceding, 0)
    out = parts.join(F.broadcast(per), "__pid")  # one row a partition
    return out.select(
        *df.columns,
        (F.row_number().over(inside) - 1 + F.col("__o_n")).alias("__rank"),
        *[(F.sum(c).over(running) + F.col(f"__o_s_{k}")).alias(k) for k, c in sums.items()],
    )


def map_texts(docs: DataFrame, make: Callable[[], Callable[[list], list[tuple]]], kind: str) -> DataFrame:
    """doc_id and, for each row, the columns of kind that a function gives for its text. make() runs once a task, so what
    it keeps is bounded by itself; ids pass by unchanged, nulls included."""
    schema = StructType.fromDDL(f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {kind}")
    arrow = to_arrow_schema(schema)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = make()
        for b in batches:
            cols = list(zip(*run(b.column("text").to_pylist()), strict=True)) or [()] * (len(arrow) - 1)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *[pa.array(c, f.type) for c, f in zip(cols, list(arrow)[1:], strict=True)]], names=arrow.names)

    return docs.select("doc_id", "text").mapInArrow(each, schema)
