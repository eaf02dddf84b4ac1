"""Whole objects over tiers: tries of holders, reads, puts, promotions, completions and what they leave (survey 2.A, 2.J, 2.K)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quayside.functions import scalars as S
from quayside.operators.byteops import assemble, split_objects
from quayside.operators.catalog import active_peers, holders
from quayside.operators.folds import enter, fold_sorted
from quayside.operators.ordered import admitted, running_in_ranges, single_flight

c = F.col


def served(tries: DataFrame, keys: list[str]) -> DataFrame:
    """Of tries (attempt, rank, outcome, peer_id): who serves: the first in order of rank that is ok; busy ones are asked
    again, in later attempts, after all others; tries is how many were made up to that one."""
    first = tries.groupBy(*keys).agg(F.min(F.when(c("outcome") == "ok", F.struct("attempt", "rank", "peer_id"))).alias("f"))
    until = tries.join(first, keys).where(c("f").isNull() | (F.struct("attempt", "rank", "peer_id") <= c("f")))
    return until.groupBy(*keys).agg(F.max("f.peer_id").alias("served_by"), F.count("*").alias("tries"), F.count(F.when(c("outcome") == "busy", 1)).alias("busy"))


def get_objects(chunks: DataFrame) -> DataFrame:
    """Of chunks (path, chunk_index, tier, rank, outcome, data) in several tiers: the objects of which each chunk is
    had from some tier, each from the first that has it, and the chunks by tier."""
    ok = chunks.withColumn("data", F.when(c("outcome") == "ok", c("data")))
    best = ok.groupBy("path", "chunk_index").agg(F.min_by(F.struct("tier", "data"), F.when(c("data").isNotNull(), c("rank"))).alias("b"))
    have = best.select("path", "chunk_index", c("b.tier").alias("tier"), c("b.data").alias("data"))
    counts = have.groupBy("path").agg(F.count("data").alias("had"), F.count("*").alias("chunks"), *[F.count(F.when(c("tier") == t, 1)).alias(f"from_{t}") for t in ("nvme", "peer", "cloud")])
    whole = counts.where("had = chunks").drop("had")
    return assemble(have.join(whole.select("path"), "path", "left_semi")).join(whole, "path")


def placements(peers: DataFrame, replicas: DataFrame, k: int) -> DataFrame:
    """For each path the k active peers with the most free space that do not hold it. They are among the first k and as
    many as hold it, so only these are listed."""
    live = active_peers(peers).select("id", F.row_number().over(Window.orderBy(c("available_space").desc(), "id")).alias("i"))  # a fleet's nodes
    known = holders(replicas).select("file_path", c("peer_id").alias("id")).distinct().join(live, "id", "left")
    per = known.groupBy("file_path").agg(F.array_sort(F.collect_list("i")).alias("taken")).crossJoin(F.broadcast(live.agg(F.count("*").cast("int").alias("n"))))  # one row
    some = per.where("n > 0").withColumn("free", F.expr(f"slice(array_except(sequence(1, least({k} + size(taken), n)), taken), 1, {k})"))
    placed = some.select("file_path", F.posexplode("free").alias("pos", "i")).join(live, "i")
    return placed.select("file_path", (c("pos") + 1).alias("copy"), c("id").alias("peer_id"))


def on_any_peer(peers: DataFrame, replicas: DataFrame) -> DataFrame:
    """A10: per path whether an active peer has bytes of it, and the size that the first of them gives."""
    live = active_peers(peers).select(c("id").alias("peer_id"), F.lit(True).alias("live"))
    asked = replicas.join(live, "peer_id", "left").withColumn("own", F.when(c("live") & (c("file_size") > 0), c("file_size")))
    return asked.groupBy("file_path").agg(F.bool_or(c("own").isNotNull()).alias("there"), F.min_by("own", F.when(c("own").isNotNull(), c("seq"))).alias("size"))


def put_objects(entries: DataFrame, puts: DataFrame, stride: int, room: int) -> DataFrame:
    """Objects put (path, data, rank by arrival, peer_ms, cloud_ms): what was there under the path goes, chunks as well;
    an object over the stride is kept in chunks; in order of the path those that fit in the room go to the fast tier, the
    others where a write ends first. Rows (file_path, size, checksum, tier) of the new objects and of what is left."""
    new = puts.select("path", "data", F.octet_length("data").cast("bigint").alias("size"), F.when(c("cloud_ms") < c("peer_ms"), "cloud").otherwise("peer").alias("race"))
    placed = running_in_ranges(new, c("size"), F.left("path", F.lit(12)), F.left("path", F.lit(24)), [c("path")])
    placed = placed.withColumn("tier", F.when(c("__before") + c("size") <= room, "nvme").otherwise(c("race")))
    chunked = split_objects(placed.where(c("size") > stride).select("path", "data"), stride).join(placed.select("path", "tier"), "path")
    parts = chunked.select(S.chunk_path(c("path"), c("chunk_index")).alias("file_path"), F.octet_length("data").cast("bigint").alias("size"), S.checksum(c("data")).alias("checksum"), "tier")
    whole = placed.select(c("path").alias("file_path"), "size", S.checksum(c("data")).alias("checksum"), "tier")
    gone = new.select(c("path").alias("owner"))
    left = entries.withColumn("owner", S.owner_path(c("file_path"))).join(gone, "owner", "left_anti")
    return whole.union(parts).union(left.select("file_path", "size", F.lit("").alias("checksum"), "tier"))


def promotions(asks: DataFrame, capacity: int = 2) -> DataFrame:
    """Of events (node, seq, kind start or end, local, pressure, want, got): for each start whether it is skipped as
    local or for want of space (over 80 %), turned away by the gate, or ends up short or committed by its size."""
    able = asks.where("kind = 'end' OR NOT (local OR pressure > 0.8)").withColumn("delta", F.when(c("kind") == "start", 1).otherwise(-1))
    let_in = fold_sorted(able.select("node", "seq", "delta"), ["node"], ["seq"], enter(capacity), (0,), "seq bigint, accepted boolean, enters boolean, inflight bigint")
    starts = asks.where("kind = 'start'").join(let_in.select("seq", "accepted"), "seq", "left")
    outcome = F.when(c("local"), "local").when(c("pressure") > 0.8, "pressure").when(~c("accepted"), "busy").when(c("got") == c("want"), "committed").otherwise("short")
    return starts.select("node", "seq", outcome.alias("outcome"))


def swap_completed(entries: DataFrame, done: DataFrame) -> DataFrame:
    """K5: the rows of chunks of completed files (path, size) give way to one row of the whole file."""
    owned = entries.withColumn("__owner", S.owner_path(c("file_path"))).join(done.select(c("path").alias("__owner")), "__owner", "left_anti")
    return owned.select("file_path", "size").union(done.select(c("path").alias("file_path"), "size"))


def completions_to_run(asks: DataFrame, gap_us: int) -> DataFrame:
    """Of (key, seq, ts_us, wait_us): those that neither follow one in flight nor come within the time after the last
    one that was let through."""
    leaders = single_flight(asks).where("leader").select("key", "seq", "ts_us")
    return admitted(leaders, ["key"], gap_us)


def persist_outcomes(attempts: DataFrame, most: int = 5, base_ms: int = 100, cap_ms: int = 1000) -> DataFrame:
    """Of writes (path, attempt from 0, ok): how many were made up to the first that is ok, the most at most, the waits
    between them, doubled each time up to a cap, and whether it is persisted."""
    tried = attempts.where(c("attempt") < most)
    t = tried.groupBy("path").agg(F.min(F.when(c("ok"), c("attempt"))).alias("f"), F.max("attempt").alias("m"))
    made = (F.coalesce("f", "m") + 1).cast("bigint")
    waits = F.aggregate(F.sequence(F.lit(0), F.greatest(made - 1, F.lit(0)).cast("int")), F.lit(0).cast("bigint"), lambda a, i: a + F.when(i + 1 < made, F.least(F.lit(base_ms) * F.pow(F.lit(2.0), i), F.lit(cap_ms))).otherwise(0).cast("bigint"))
    return t.select("path", made.alias("attempts"), waits.alias("waited_ms"), c("f").isNotNull().alias("persisted"))


def invalidated(rows: DataFrame, changed: DataFrame) -> DataFrame:
    """What is left of cached ranges and hints (path, ...) when files (path) change, their chunks' rows gone as well."""
    return rows.withColumn("__owner", S.owner_path(c("path"))).join(changed.select(S.owner_path(c("path")).alias("__owner")).distinct(), "__owner", "left_anti").drop("__owner")


def until_busy(copies: DataFrame) -> DataFrame:
    """Of a run's planned copies (place, outcome), at most its budget: those made before the first that finds a peer
    busy. A failed one does not end the run."""
    first = copies.agg(F.min(F.when(c("outcome") == "busy", c("place"))).alias("stop"))  # one row
    return copies.crossJoin(F.broadcast(first)).where(c("stop").isNull() | (c("place") < c("stop"))).drop("stop")
