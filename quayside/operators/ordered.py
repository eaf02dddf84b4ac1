"""Computations in order of events: folds, streaks, evictions, budgets and rates (survey 2.E, 2.L)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quayside.functions import scalars as S
from quayside.operators.folds import admit, enter, fold_sorted, grant

c = F.col


def ewma(samples: DataFrame, keys: list[str], alpha: float = 0.3) -> DataFrame:
    """Of (ts, seq, ms, ok, miss): averages that weigh the last sample by alpha, the first as it is; misses are
    counted apart. The weight of the n-th last sample is alpha (1 - alpha)^n, the first's (1 - alpha)^n, so it is a sum
    over a window and needs no array of a hot key."""
    by = [c(k) for k in keys]
    hits = samples.where(~c("miss"))
    back = Window.partitionBy(*by).orderBy(c("ts").desc(), c("seq").desc())
    size = Window.partitionBy(*by)
    n = F.row_number().over(back) - 1
    weight = F.pow(F.lit(1 - alpha), n) * F.when(n + 1 == F.count("*").over(size), 1.0).otherwise(alpha)
    weighed = hits.withColumn("__w", weight)
    stats = weighed.groupBy(*keys).agg(
        F.sum(c("ms") * c("__w")).alias("latency_ms"), F.sum(F.when(c("ok"), c("__w")).otherwise(0.0)).alias("success"), F.count("*").alias("samples"), F.max("ts").alias("last_at")
    )
    misses = samples.groupBy(*keys).agg(F.count(F.when(c("miss"), 1)).alias("misses"))
    return misses.join(stats, keys, "left").select(*keys, "latency_ms", "success", F.coalesce("samples", F.lit(0)).alias("samples"), "misses", "last_at")


def tier_score(latency: Column, success: Column, last_at: Column, now: Column, window_s: int = 30, floor: float = 0.7, least_ms: float = 0.5) -> Column:
    """L1: success over latency; a tier not sampled for a while counts as at least floor."""
    stale = last_at < now - F.make_dt_interval(secs=F.lit(window_s))
    return F.when(stale & (success < floor), floor).otherwise(success) / F.greatest(latency, F.lit(least_ms))


def tier_choice(stats: DataFrame, now: Column, least: int = 3, reliable: float = 0.85, close: float = 0.75) -> DataFrame:
    """Per node (node, tier, ...): the tier to read first, and whether to hedge. Peer first until both tiers have
    samples enough, and on ties; hedged where the first is unreliable or the second close, unknown (null) until then."""
    of = lambda tier, x: F.max(F.when(c("tier") == tier, x))
    score = tier_score(c("latency_ms"), c("success"), c("last_at"), now)
    w = stats.groupBy("node").agg(
        *[of(t, v).alias(f"{t}_{k}") for t in ("peer", "cloud") for k, v in (("score", score), ("ok", c("success")), ("n", c("samples")))],
    )
    known = (F.coalesce("peer_n", F.lit(0)) >= least) & (F.coalesce("cloud_n", F.lit(0)) >= least)
    cloud = known & (c("cloud_score") > c("peer_score"))
    first, second = F.when(cloud, c("cloud_score")).otherwise(c("peer_score")), F.when(cloud, c("peer_score")).otherwise(c("cloud_score"))
    hedge = F.when(known, (F.when(cloud, c("cloud_ok")).otherwise(c("peer_ok")) < reliable) | ((first > 0) & (second >= first * close)))
    return w.select("node", F.when(cloud, "cloud").otherwise("peer").alias("first_tier"), hedge.alias("hedge"), F.when(known, F.when(cloud, "cloud").otherwise("peer")).otherwise("none").alias("measured"))


def sequential_streaks(reads: DataFrame, slack: int) -> DataFrame:
    """Of (path, seq, offset, size): how many reads in a row went on where the last one ended, give or take slack."""
    w = Window.partitionBy("path").orderBy("seq")
    end = F.lag(c("offset") + c("size")).over(w)
    follows = F.coalesce((end > 0) & F.abs(c("offset") - end).between(0, slack), F.lit(False))
    island = F.sum(F.when(follows, 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    numbered = reads.withColumn("__i", island)
    return numbered.withColumn("streak", F.row_number().over(Window.partitionBy("path", "__i").orderBy("seq")) - 1).drop("__i")


def readahead(streak: Column, base: int, most: int, file_chunks: Column, budget_chunks: int, long: int = 32, widen: int = 4) -> Column:
    """Base doubled for each read of the streak up to most; a long streak may go on within the budget and the file."""
    wide = F.greatest(F.lit(most).cast("bigint"), F.least(F.lit(most * widen).cast("bigint"), F.lit(budget_chunks).cast("bigint"), file_chunks))
    cap = F.when(streak >= long, wide).otherwise(F.lit(most).cast("bigint"))
    return F.least(F.lit(base) * F.pow(F.lit(2.0), F.least(streak, F.lit(40))).cast("bigint"), cap)


def running(df: DataFrame, value: Column, keys: list[str], order: list[Column], before: bool = True) -> Column:
    """The sum of value over the rows before (or up to) each in order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return F.coalesce(F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, -1 if before else 0)), F.lit(0))


def evict(entries: DataFrame, used: int, target: int, keys: list[str]) -> DataFrame:
    """Of (file_path, size, last_accessed, pinned, safe): what goes, least recently used first, until no
    more than target is used. Pinned and unsafe rows are left out before the sums."""
    able = entries.where(~c("pinned") & c("safe"))
    gone = running(able, c("size"), keys, [c("last_accessed"), c("file_path")])
    return able.withColumn("freed_before", gone).where(c("freed_before") < used - target)


def running_in_ranges(df: DataFrame, value: Column, coarse: Column, fine: Column, order: list[Column]) -> DataFrame:
    """df with __before, the sum of value over all rows before each in order. coarse and fine go up with the order, so sums
    of ranges of it, and of ranges of those, meet in place of the rows."""
    t = df.withColumn("__c", coarse).withColumn("__f", fine).withColumn("__v", value)
    fines = t.groupBy("__c", "__f").agg(F.sum("__v").alias("__s"))
    wide = fines.groupBy("__c").agg(F.sum("__s").alias("__s"))
    so_far = lambda w: F.coalesce(F.sum("__s").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    wide = wide.select("__c", so_far(Window.orderBy("__c")).alias("__b"))  # a row a coarse range
    base = fines.withColumn("__b2", so_far(Window.partitionBy("__c").orderBy("__f"))).join(wide, "__c").select("__c", "__f", (c("__b") + c("__b2")).alias("__b"))
    inside = Window.partitionBy("__c", "__f").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = t.join(base, ["__c", "__f"]).withColumn("__before", c("__b") + F.coalesce(F.sum("__v").over(inside), F.lit(0)))
    return out.drop("__c", "__f", "__v", "__b")


def evict_globally(entries: DataFrame, used: int | Column, target: int | Column) -> DataFrame:
    """W5 over a whole cache: days and minutes are summed first, so that files are ordered within their minute only. used
    and target are numbers or columns of the entries."""
    able = entries.where(~c("pinned") & c("safe"))
    out = running_in_ranges(able, c("size"), F.to_date("last_accessed"), F.date_trunc("MINUTE", "last_accessed"), [c("last_accessed"), c("file_path")])
    return out.withColumnRenamed("__before", "freed_before").where(c("freed_before") < F.lit(used) - F.lit(target))


def left_after(entries: DataFrame, evicted: DataFrame) -> DataFrame:
    """The cache after an eviction."""
    return entries.join(evicted.select("file_path"), "file_path", "left_anti")


def counter_rate(samples: DataFrame, keys: list[str], seconds: int = 300) -> DataFrame:
    """Of (ts, line_no, value) of counters: the rise over the last seconds by second; a value that falls starts anew.
    Without the extrapolation to the ends of the window that some systems do."""
    w = Window.partitionBy(*keys).orderBy("ts", "line_no")
    was = F.lag("value").over(w)
    rise = samples.withColumn("rise", F.when(was.isNull(), 0.0).when(c("value") < was, c("value")).otherwise(c("value") - was))
    at = F.timestamp_diff("SECOND", F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'"), c("ts"))
    recent = Window.partitionBy(*keys).orderBy("__at").rangeBetween(-seconds + 1, 0)
    return rise.withColumn("__at", at).withColumn("rate", F.sum("rise").over(recent) / seconds).drop("__at")


def fifo_kept(chunks: DataFrame, most_chunks: int, most_bytes: int) -> DataFrame:
    """Of (path, chunk_index, seq, bytes) put into per-file caches: what remains, the oldest first put going first; a
    chunk that is put again keeps its place."""
    first = chunks.groupBy("path", "chunk_index").agg(F.min("seq").alias("seq"), F.max_by("bytes", "seq").alias("bytes"))
    w = Window.partitionBy("path").orderBy(c("seq").desc())
    few = first.withColumn("__n", F.row_number().over(w)).where(c("__n") <= most_chunks)
    total = F.sum("bytes").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return few.withColumn("__b", total).where(c("__b") <= most_bytes).drop("__n", "__b")


def lru_files_kept(files: DataFrame, budget: int, keep: str) -> DataFrame:
    """Of (path, bytes, last_access): files that stay within the budget, most recent first, the one in use before all."""
    back = lambda x: -F.unix_micros(x.cast("timestamp"))  # noqa: E731  # goes up with the order
    first = c("path") == keep
    day, minute = F.when(first, F.lit(-(1 << 62))).otherwise(back(F.date_trunc("DAY", "last_access"))), back(F.date_trunc("MINUTE", "last_access"))
    out = running_in_ranges(files, c("bytes"), day, minute, [c("last_access").desc(), c("path")])
    return out.withColumn("held", c("__before") + c("bytes")).drop("__before").where((c("held") <= budget) | first)


def reconcile(files: DataFrame, budget: int) -> DataFrame:
    """Of (file_path, last_accessed, deficit): copies to make, hottest first, within the budget."""
    need = files.where("deficit > 0").orderBy(c("last_accessed").desc(), "file_path").limit(budget)  # each takes one at least
    spent = F.sum("deficit").over(Window.orderBy(c("last_accessed").desc(), "file_path").rowsBetween(Window.unboundedPreceding, -1))
    out = need.withColumn("copies", F.greatest(F.lit(0), F.least(c("deficit"), F.lit(budget) - F.coalesce(spent, F.lit(0)))).cast("bigint"))
    return out.where("copies > 0")


def admitted(events: DataFrame, keys: list[str], gap_us: int) -> DataFrame:
    """Of (ts_us, seq): those let through, each at least gap_us after the last let through of its key."""
    return fold_sorted(events.select(*keys, "ts_us", "seq"), keys, ["ts_us", "seq"], admit(gap_us), (-1,), "seq bigint")


def prefetch_reservation(asks: DataFrame, cached: DataFrame, budget: int) -> DataFrame:
    """Of asks (path, end_chunk, num_chunks, chunk_size, want): the next chunks, not cached ones, within the budget."""
    ahead = asks.where("end_chunk + 1 < num_chunks AND want > 0").select("path", "chunk_size", F.explode(F.sequence(c("end_chunk") + 1, F.least(c("end_chunk") + c("want"), c("num_chunks") - 1))).alias("chunk_index"))
    new = ahead.join(cached, ["path", "chunk_index"], "left_anti")
    return new.withColumn("reserved", running(new, c("chunk_size"), ["path"], [c("chunk_index")], before=False)).where(c("reserved") <= budget)


def prefetch_outcomes(events: DataFrame) -> DataFrame:
    """Of (path, chunk_index, seq, kind in prefetch, read, evict): prefetches read before they went, and wasted ones."""
    w = Window.partitionBy("path", "chunk_index").orderBy("seq")
    after = events.withColumn("__next", F.lead("kind").over(w)).where("kind = 'prefetch'")
    return after.groupBy("path").agg(F.count("*").alias("issued"), F.count(F.when(c("__next") == "read", 1)).alias("hits"), F.count(F.when(c("__next") == "evict", 1)).alias("wasted"))


def leases(requests: DataFrame) -> DataFrame:
    """Of (key, seq, ts_us, peer_id, op, ttl_ms): for each request whether it is granted. Free or expired keys go to
    who asks, the holder renews, only the holder releases; at the instant of expiry a lease is free."""
    return fold_sorted(requests.select("key", "seq", "ts_us", "peer_id", "op", "ttl_ms"), ["key"], ["seq"], grant, ("", 0), "seq bigint, granted boolean")


def gate(events: DataFrame, keys: list[str], capacity: int) -> DataFrame:
    """Of (seq, delta 1 or -1): starts that a gate of a capacity lets in or turns away. A turned-away start is not in
    flight, so what ends never goes below none."""
    each = fold_sorted(events.select(*keys, "seq", "delta"), keys, ["seq"], enter(capacity), (0,), "seq bigint, accepted boolean, enters boolean, inflight bigint")
    n = lambda ok: F.count(F.when(c("enters") & ok, 1))
    return each.groupBy(*keys).agg(F.max_by("inflight", "seq").alias("inflight"), n(c("accepted")).alias("accepted"), n(~c("accepted")).alias("rejected"), F.max("inflight").alias("peak"))


def session_counts(events: DataFrame) -> DataFrame:
    """Of (volume_id, seq, op): references now, and how often a first reference started a warm-up. A count clipped at 0
    is the running sum less its least value so far."""
    w = Window.partitionBy("volume_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    delta = events.withColumn("__d", F.when(c("op") == "create", 1).otherwise(-1))
    summed = delta.withColumn("__s", F.sum("__d").over(w))
    clipped = summed.withColumn("refs", c("__s") - F.least(F.min("__s").over(w), F.lit(0)))
    return clipped.groupBy("volume_id").agg(F.max_by("refs", "seq").alias("refs"), F.count(F.when((c("op") == "create") & (c("refs") == 1), 1)).alias("warm_starts"))


def idle_gaps(reads: DataFrame, key: str, seconds: int = 30) -> DataFrame:
    """Sessions of reads (ts) with no gap over the time: where each begins and ends, and its reads."""
    w = Window.partitionBy(key).orderBy("ts", "seq")
    gap = F.timestamp_diff("MICROSECOND", F.lag("ts").over(w), c("ts"))
    marked = reads.withColumn("__i", F.sum(F.when(gap.isNull() | (gap >= seconds * 1000000), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(key, "__i").agg(F.min("ts").alias("begins"), F.max("ts").alias("ends"), F.count("*").alias("reads")).drop("__i")


def recent_readers(reads: DataFrame, now: Column, minutes: int = 10) -> DataFrame:
    """Distinct hosts that read a file or its chunks in the last minutes."""
    recent = reads.where((c("ts") > now - F.make_dt_interval(mins=F.lit(minutes))) & (c("ts") <= now))
    return recent.groupBy(S.owner_path(c("path")).alias("path")).agg(F.countDistinct(S.host_part(c("reader"))).alias("readers"))


def cached_lookup(reads: DataFrame, views: DataFrame, ttl_us: int, key: str) -> DataFrame:
    """For each read (ts_us, seq) the newest view (ts_us, value) at or before it and younger than the time to live. Views
    and reads of a key are merged in order and the last view carried on, so no read meets each view."""
    both = reads.select(key, "ts_us", F.lit(1).alias("__k"), "seq", F.lit(None).cast("bigint").alias("value"), F.lit(None).cast("bigint").alias("__at")).unionByName(
        views.select(key, "ts_us", F.lit(0).alias("__k"), F.lit(None).cast("bigint").alias("seq"), "value", c("ts_us").alias("__at"))
    )
    w = Window.partitionBy(key).orderBy("ts_us", "__k", "seq").rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumn("value", F.last("value", ignorenulls=True).over(w)).withColumn("__at", F.last("__at", ignorenulls=True).over(w)).where("__k = 1")
    return seen.select(key, "seq", F.when(c("ts_us") - c("__at") < ttl_us, c("value")).alias("value"))


def single_flight(fetches: DataFrame) -> DataFrame:
    """Of (key, seq, ts_us, wait_us): fetches that overlap one in flight follow it. Those that follow share its end."""
    w = Window.partitionBy("key").orderBy("ts_us", "seq")
    ends = F.max(c("ts_us") + c("wait_us")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return fetches.withColumn("leader", ends.isNull() | (c("ts_us") >= ends))


def derived_window(size: Column, nanos: Column, ops: Column, workers: int, static: int, stride: int, budget: int, least: int = 8, seconds: float = 0.25) -> Column:
    """Chunks that a measured stream moves in a quarter of a second, by workers, within the budget; never under the
    static number, which also holds until there are ops enough."""
    rate = size.cast("double") / (nanos.cast("double") / 1e9)
    derived = F.floor(F.least(rate * workers * seconds, F.lit(float(budget))) / stride).cast("bigint")
    return F.when((ops >= least) & (size > 0) & (nanos > 0), F.greatest(derived, F.lit(static).cast("bigint"))).otherwise(F.lit(static).cast("bigint"))


def hybrid_read(size: Column, replicas: Column, has_cloud: Column, hedge: Column, speed: int = 200 * S.MIB, always: int = 512 * S.MIB) -> Column:
    """L3: read from both tiers at once, where peers hold the file: very large files always; where the cloud has it too, files
    over what the replicas' assumed speed moves in a second, and where the measured tiers call for a hedge."""
    slow = size > F.greatest(replicas, F.lit(1)) * speed
    return (size > 0) & (replicas > 0) & ((size >= always) | (has_cloud & (slow | F.coalesce(hedge, F.lit(False)))))


def striped_tier(index: Column, size: Column, first: Column, second: Column, over: int = S.GIB) -> Column:
    """L4: odd chunks of very large files come from the second tier."""
    return F.when((size >= over) & (F.pmod(index, F.lit(2)) == 1), second).otherwise(first)


def read_profile(size: Column, stride: Column, workers: int, window: Column, derived: Column, most: int = 32) -> tuple[Column, Column]:
    """(workers, readahead) by size class."""
    chunks = S.chunk_count(size, stride)
    small, medium = (stride <= 0) | (size <= stride), size <= 256 * S.MIB
    many = F.least(F.greatest(F.lit(workers).cast("bigint"), derived), F.lit(most).cast("bigint"))
    return (F.when(small, F.lit(1)).when(medium, F.lit(workers)).otherwise(many).cast("bigint"), F.when(small, F.lit(0)).when(medium, F.least(window, chunks)).otherwise(window).cast("bigint"))


def first_answer(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Of tries (rank, outcome, finish): the tier of the least rank that is ok; where two tries race, the
    one of rank 1 that ends first."""
    ok = rows.where("outcome = 'ok'")
    return ok.groupBy(*keys).agg(F.min_by("tier", F.struct("rank", "finish", "tier")).alias("served_by"), F.min_by("finish", F.struct("rank", "finish", "tier")).alias("finish"))


def read_timeout_ms(asks_cloud: Column, hybrid: Column, peer_ms: int = 30_000, cloud_ms: int = 60_000) -> Column:
    """The longest timeout of the tiers that a chunk may be read from."""
    return F.when(asks_cloud | hybrid, F.lit(max(peer_ms, cloud_ms))).otherwise(F.lit(peer_ms)).cast("bigint")
