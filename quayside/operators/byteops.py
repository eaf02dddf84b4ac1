"""Operators on the bytes of objects: chunks, ranges, reassembly and checksums (survey 2.K)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quayside.functions import scalars as S

c = F.col


def split_objects(objects: DataFrame, stride: int) -> DataFrame:
    """K1: (path, data) to (path, chunk_index, data) of at most stride bytes; an empty object has no chunk."""
    n = S.chunk_count(F.octet_length("data").cast("bigint"), F.lit(stride).cast("bigint"))
    each = objects.where(F.octet_length("data") > 0).withColumn("chunk_index", F.explode(F.sequence(F.lit(0).cast("bigint"), n - 1)))
    return each.select("path", "chunk_index", F.substring(c("data"), (c("chunk_index") * stride + 1).cast("int"), F.lit(stride)).alias("data"))


def assemble(chunks: DataFrame) -> DataFrame:
    """K2: (path, chunk_index, data) to (path, data), in order of index; one object at a time is in memory."""
    rows = chunks.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("chunk_index", "data"))).alias("p"))
    return rows.select("path", F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["data"])).alias("data"))


def size_mismatches(assembled: DataFrame, sizes: DataFrame) -> DataFrame:
    """K2: objects whose length is not the expected one (path, size)."""
    return assembled.join(sizes, "path").where(F.octet_length("data") != c("size")).select("path")


def ranges_to_chunks(ranges: DataFrame, sizes: DataFrame, stride: int) -> DataFrame:
    """Of ranges (seq, path, offset, size) and sizes (path, length): which bytes of which chunk; cut at the end, nothing
    past it. Chunk numbers are generated, so the join to chunks is one of equal keys."""
    end = F.least(c("offset") + c("size"), c("length"))
    t = ranges.join(sizes, "path").withColumn("end", end).where((c("size") > 0) & (c("offset") >= 0) & (c("offset") < c("end")))
    t = t.withColumn("chunk_index", F.explode(F.sequence(S.idiv(c("offset"), stride), S.idiv(c("end") - 1, stride))))
    start = c("chunk_index") * stride
    return t.select("seq", "path", "chunk_index", F.greatest(c("offset") - start, F.lit(0)).alias("from_byte"), F.least(c("end") - start, F.lit(stride).cast("bigint")).alias("to_byte"))


def read_ranges(ranges: DataFrame, chunks: DataFrame, sizes: DataFrame, stride: int) -> DataFrame:
    """K3: (seq, data) of each range that holds something."""
    need = ranges_to_chunks(ranges, sizes, stride).join(chunks, ["path", "chunk_index"])
    part = F.substring(c("data"), (c("from_byte") + 1).cast("int"), (c("to_byte") - c("from_byte")).cast("int"))
    rows = need.select("seq", "chunk_index", part.alias("data")).groupBy("seq").agg(F.sort_array(F.collect_list(F.struct("chunk_index", "data"))).alias("p"))
    return rows.select("seq", F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["data"])).alias("data"))


def chunk_of(data: Column, index: Column, stride: int) -> Column:
    """K4: a chunk cut from its whole parent."""
    return F.substring(data, (index * stride + 1).cast("int"), F.lit(stride))


def complete(files: DataFrame, local: DataFrame, remote: DataFrame) -> DataFrame:
    """K5: of files (path, size, chunk_count): those that local chunks and, for missing ones, remote chunks make whole, with
    how many were fetched; files that stay short or of a wrong size are left out."""
    want = files.where("chunk_count > 0").select("path", "size", F.explode(F.sequence(F.lit(0).cast("bigint"), c("chunk_count") - 1)).alias("chunk_index"))
    have = want.join(local.select("path", "chunk_index", c("data").alias("l")), ["path", "chunk_index"], "left").join(remote.select("path", "chunk_index", c("data").alias("r")), ["path", "chunk_index"], "left")
    size = F.octet_length(F.coalesce("l", "r"))
    out = have.groupBy("path", "size").agg(F.sum(size).alias("got"), F.count(F.when(c("l").isNull() & c("r").isNotNull(), 1)).alias("fetched"), F.count(F.when(F.coalesce("l", "r").isNull(), 1)).alias("lost"))
    return out.where((c("lost") == 0) & (c("got") == c("size"))).select("path", "size", "fetched")


def corrupt(objects: DataFrame, sums: DataFrame) -> DataFrame:
    """K6: objects (path, data) whose checksum (path, checksum) is another; an empty checksum is not checked."""
    return objects.join(sums, "path").where((c("checksum") != "") & (S.checksum(c("data")) != c("checksum"))).select("path")


def warm_prefix(targets: DataFrame, local: DataFrame, reachable: DataFrame, used: int, capacity: int) -> DataFrame:
    """Outcomes of warming targets (file_path, size): already there in full, no room left in order of
    path, fetched, or failed. Room is counted as if all fetches before were kept."""
    from quayside.operators.ordered import running_in_ranges

    here = local.select("file_path", c("size").alias("own"))
    t = targets.join(here, "file_path", "left").join(reachable.select("file_path", F.lit(True).alias("up")), "file_path", "left")
    there = F.coalesce(c("own") == c("size"), F.lit(False))
    need = F.when(there, 0).otherwise(c("size"))
    # the beginning of a path goes up with the path
    t = running_in_ranges(t, need, F.left("file_path", F.lit(12)), F.left("file_path", F.lit(24)), [c("file_path")])
    return t.select("file_path", "size", F.when(there, "already_local").when(c("__before") + need + used > capacity, "skipped").when(c("up"), "warmed").otherwise("failed").alias("outcome"))
