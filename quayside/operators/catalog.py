"""Operators on the catalog of peers and file replicas: scans, predicates, joins, rollups, sets and upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quayside.functions import scalars as S

c = F.col
HOT_BYTES = 64 * S.MIB


# --- predicates (2.B) --------------------------------------------------------------------------------------------------


def active_peers(peers: DataFrame, but: str | None = None) -> DataFrame:
    """G1."""
    out = peers.where(c("status") == "active")
    return out if but is None else out.where(c("id") != but)


def under_prefix(df: DataFrame, prefix: str, path: str = "file_path", segment: bool = False) -> DataFrame:
    """A plain prefix of the text, which reaches the scan; segment=True stops at path segments."""
    if segment:
        return df.where(is_pinned(c(path), [prefix]))
    return df.where(c(path).startswith(prefix))


def is_pinned(path: Column, prefixes: list[str], root_pins: bool = False) -> Column:
    """The path is a prefix or lies under it, by segments; empty prefixes pin nothing, nor does / unless root_pins."""
    out = F.lit(False)
    for p in filter(None, prefixes):
        out = out | (F.lit(root_pins) if p == "/" else (path == p) | path.startswith(p + "/"))
    return out


def fresh_peers(peers: DataFrame, now: Column, seconds: int = 75) -> DataFrame:
    """Heard of within the time; those never heard of stay."""
    return peers.where(c("last_heartbeat").isNull() | (c("last_heartbeat") >= now - F.make_dt_interval(secs=F.lit(seconds))))


def allowed(peers: DataFrame, ids: list[str]) -> DataFrame:
    """One of the ids; no ids allow all."""
    return peers.where(c("id").isin(*ids)) if ids else peers


def is_hot(now: Column, minutes: float, size: str = "file_size", strict: bool = False) -> Column:
    """G7 (strict=False) and G17's ages: accessed within the time, no chunk, of a size over 0 and up to 64 MiB."""
    cut = now - F.make_dt_interval(mins=F.lit(minutes))
    recent = c("last_accessed") > cut if strict else c("last_accessed") >= cut
    return recent & S.parent_path(c("file_path")).isNull() & (c(size) > 0) & (c(size) <= HOT_BYTES)


def holders(replicas: DataFrame) -> DataFrame:
    """Replicas that a peer holds."""
    return replicas.where((c("storage_tier") != "cloud") & (c("peer_id") != ""))


def outcome_class(outcome: Column) -> Column:
    """What counts as a sample (ok, failure) and what does not (busy, miss)."""
    return F.when(outcome == "ok", "ok").when(outcome == "busy", "busy").when(outcome == "miss", "miss").otherwise("failure")


def size_class(size: Column, stride: Column, medium: int = 256 * S.MIB) -> Column:
    """G12."""
    return F.when((stride <= 0) | (size <= stride), "small").when(size <= medium, "medium").otherwise("large")


# --- joins (2.C) -------------------------------------------------------------------------------------------------------


def holder_flags(peers: DataFrame, replicas: DataFrame) -> DataFrame:
    """(file_path, id, fallbacks), a row for each active holder, or one without an id where no holder
    is active; fallbacks is the number of the other active peers, which are the active peers without the path's rows."""
    held = holders(replicas).select("file_path", c("peer_id").alias("id")).distinct()
    known = held.join(active_peers(peers).select("id").withColumn("live", F.lit(1)), "id", "left")
    per = known.groupBy("file_path").agg(F.count("live").alias("n"))
    rows = per.join(known.where("live = 1").select("file_path", "id"), "file_path", "left")
    return rows.join(F.broadcast(active_peers(peers).agg(F.count("*").alias("all")))).select("file_path", "id", (c("all") - c("n")).alias("fallbacks"))  # one row


def seed_targets(peers: DataFrame, replicas: DataFrame, path: str, source: str) -> DataFrame:
    """Active peers that neither hold the path nor are the source."""
    have = holders(replicas).where(c("file_path") == path).select(c("peer_id").alias("id"))
    return active_peers(peers, source).join(have, "id", "left_anti")


def seed_sources(peers: DataFrame, replicas: DataFrame) -> DataFrame:
    """Per path the active holder that came first."""
    live = active_peers(peers).select(c("id").alias("peer_id"))
    return holders(replicas).join(live, "peer_id").groupBy("file_path").agg(F.min_by("peer_id", F.struct("seq", "peer_id")).alias("source"))


def merge_views(local: DataFrame, remote: DataFrame) -> DataFrame:
    """One row a path of both (file_path, size, last_accessed, tier); local rows win."""
    a = local.select("file_path", *[c(x).alias(f"l_{x}") for x in ("size", "last_accessed", "tier")])
    b = remote.select("file_path", *[c(x).alias(f"r_{x}") for x in ("size", "last_accessed", "tier")])
    out = a.join(b, "file_path", "full_outer")
    own = c("l_tier").isNotNull()
    return out.select("file_path", *[F.when(own, c(f"l_{x}")).otherwise(c(f"r_{x}")).alias(x) for x in ("size", "last_accessed", "tier")], own.alias("is_local"))


def without_cached_parents(entries: DataFrame) -> DataFrame:
    """Entries but chunks whose chunked parent is in the fast tier. Only chunks are joined: rows without a parent, which
    are most, would all go to the task of the null key."""
    parents = entries.where((c("tier") == "nvme") & c("is_chunked")).select(c("file_path").alias("parent")).distinct()
    parent = S.parent_path(c("file_path"))
    chunks = entries.where(parent.isNotNull()).withColumn("parent", parent).join(parents, "parent", "left_anti").select(entries.columns)
    return entries.where(parent.isNull()).unionByName(chunks)


def durable_parents(parents: DataFrame, chunks: DataFrame) -> DataFrame:
    """Of (file_path, num_chunks): whether all chunks 0..n-1 of (parent, chunk_index, persisted) are durable."""
    want = parents.where("num_chunks > 0").select("file_path", F.explode(F.sequence(F.lit(0).cast("bigint"), c("num_chunks") - 1)).alias("chunk_index"))
    have = chunks.groupBy(c("parent").alias("file_path"), "chunk_index").agg(F.bool_or("persisted").alias("persisted"))
    return want.join(have, ["file_path", "chunk_index"], "left").groupBy("file_path").agg(F.bool_and(F.coalesce("persisted", F.lit(False))).alias("durable"))


def missing_chunks(files: DataFrame, present: DataFrame) -> DataFrame:
    """Of files (file_path, chunk_count): the chunks that present (file_path, chunk_index) lacks."""
    want = files.where("chunk_count > 0").select("file_path", F.explode(F.sequence(F.lit(0).cast("bigint"), c("chunk_count") - 1)).alias("chunk_index"))
    return want.join(present, ["file_path", "chunk_index"], "left_anti")


def resolve_chunked(paths: DataFrame, local: DataFrame, remote: DataFrame, replicas: DataFrame, stride: int) -> DataFrame:
    """Size and stride of each path: own entry, else the cached view, else the first chunked replica."""
    first = replicas.where("is_chunked").groupBy("file_path").agg(F.min_by(F.struct("file_size", "chunk_size"), F.struct("seq", "peer_id", "storage_tier")).alias("f"))
    out = paths.join(local.select("file_path", c("size").alias("a")), "file_path", "left").join(remote.select("file_path", c("size").alias("b")), "file_path", "left").join(first, "file_path", "left")
    found = F.coalesce("a", "b", c("f.file_size"))
    origin = F.when(c("a").isNotNull(), "local").when(c("b").isNotNull(), "view").when(c("f").isNotNull(), "replica").otherwise("none")
    return out.select("file_path", found.alias("size"), S.stride_of(F.coalesce(c("f.chunk_size"), F.lit(0)), stride).alias("stride"), origin.alias("origin"))


def children(paths: DataFrame, directory: str) -> DataFrame:
    """The names right under a directory, and whether each is one itself; a directory wins over a file."""
    base = directory.rstrip("/") + "/"
    steps = F.split(F.substring(c("file_path"), len(base) + 1, 1 << 30), "/", 2)
    below = paths.where(c("file_path").startswith(base)).select(steps[0].alias("name"), (F.size(steps) > 1).alias("deeper"))
    return below.groupBy("name").agg(F.max("deeper").alias("is_dir"))


# --- rollups (2.D) -----------------------------------------------------------------------------------------------------


def cluster_stats(peers: DataFrame, replicas: DataFrame) -> DataFrame:
    """One row. Means are over peers with a measured speed, also that of the latency; free space is counted as the
    reference does (available less used), the true capacity stands beside it."""
    live = c("status") == "active"
    probed = live & (c("network_speed_mbps") > 0)
    n = F.count(F.when(probed, 1))
    of = peers.agg(
        F.count(F.when(live, 1)).alias("active_peers"), F.count("*").alias("total_peers"), F.coalesce(F.sum(F.when(live, c("available_space"))), F.lit(0)).alias("total_space"),
        F.coalesce(F.sum(F.when(live, c("used_space"))), F.lit(0)).alias("used_space"),
        F.when(n > 0, F.sum(F.when(probed, c("network_speed_mbps"))) / n).otherwise(0.0).alias("avg_speed_mbps"),
        F.when(n > 0, F.sum(F.when(live & (c("network_latency_ms") > 0), c("network_latency_ms"))) / n).otherwise(0.0).alias("avg_latency_ms"),
    )
    files = replicas.agg(F.countDistinct("file_path").alias("file_count"))
    return of.crossJoin(F.broadcast(files)).withColumn("available_space", c("total_space") - c("used_space")).withColumn("capacity", c("total_space") + c("used_space"))  # one row each


def tier_key(tier: Column) -> Column:
    t = F.lower(F.trim(tier))
    return F.when(F.coalesce(t, F.lit("")) == "", "unknown").otherwise(t)


def world_view(replicas: DataFrame) -> DataFrame:
    """Per path: replicas, replicas by tier and of each chunk (as sorted key:count text), size, chunked or not."""
    tiers = replicas.groupBy("file_path", tier_key(c("storage_tier")).alias("tier")).agg(
        F.count("*").alias("n"), F.max("file_size").alias("size"), F.bool_or("is_chunked").alias("chunked"), F.max("last_accessed").alias("last"), F.count(F.when(c("storage_tier") == "nvme", 1)).alias("fast")
    )
    entry = F.concat(c("tier"), F.lit(":"), c("n").cast("string"))
    files = tiers.groupBy("file_path").agg(
        F.sum("n").alias("replica_count"), F.array_join(F.array_sort(F.collect_list(entry)), ",").alias("tier_replicas"), F.max("size").alias("size"),
        F.bool_or("chunked").alias("is_chunked"), F.max("last").alias("last_accessed"), F.sum("fast").alias("nvme_replicas"),
    )
    pieces = replicas.where(F.size("chunks") > 0).select("file_path", F.explode("chunks").alias("k")).groupBy("file_path", c("k.index").alias("i")).agg(F.count("*").alias("n"))
    pieces = pieces.groupBy("file_path").agg(F.sort_array(F.collect_list(F.struct("i", "n"))).alias("e"))
    text = F.array_join(F.transform("e", lambda x: F.concat(x["i"].cast("string"), F.lit(":"), x["n"].cast("string"))), ",")
    return files.join(pieces.select("file_path", text.alias("chunk_replicas")), "file_path", "left")


def manifest(replicas: DataFrame) -> DataFrame:
    """Per path the largest size, chunked anywhere, and the most chunks listed."""
    listed = F.max(F.when(c("is_chunked"), F.size("chunks")))
    return replicas.groupBy("file_path").agg(F.max("file_size").alias("size"), F.bool_or("is_chunked").alias("is_chunked"), F.coalesce(listed, F.lit(0)).cast("bigint").alias("chunk_count"))


def warm_targets(replicas: DataFrame, prefix: str, default: int) -> DataFrame:
    """Files under a prefix without chunk rows; the last positive chunk size, chunks listed or else counted."""
    if not prefix:
        raise ValueError("a warm-up needs a prefix")
    files = under_prefix(replicas, prefix).where(S.parent_path(c("file_path")).isNull())
    out = files.groupBy("file_path").agg(
        F.max("file_size").alias("size"), F.bool_or("is_chunked").alias("is_chunked"), F.max(F.when(c("is_chunked"), F.size("chunks"))).alias("listed"),
        F.max_by(F.when(c("chunk_size") > 0, c("chunk_size")), F.when(c("chunk_size") > 0, c("seq"))).alias("stride"),
    )
    stride = F.coalesce("stride", F.lit(default)).cast("bigint")
    count = F.when(~c("is_chunked"), F.lit(0)).when(c("listed") > 0, c("listed")).otherwise(S.chunk_count(c("size"), stride)).cast("bigint")
    return out.select("file_path", "size", "is_chunked", stride.alias("chunk_size"), count.alias("chunk_count"))


def first_locations(replicas: DataFrame) -> DataFrame:
    """The first replica of each path; equal places go by peer and tier."""
    return replicas.groupBy("file_path").agg(F.min_by(F.struct("peer_id", "storage_tier", "file_size"), F.struct("seq", "peer_id", "storage_tier")).alias("r")).select("file_path", "r.*")


def holder_counts(replicas: DataFrame, me: str | None = None) -> DataFrame:
    """Distinct peers that hold a path; with me, who counts as one more where absent."""
    n = F.countDistinct("peer_id")
    if me is not None:
        n = n + F.when(F.max(F.when(c("peer_id") == me, 1)).isNull(), 1).otherwise(0)
    return holders(replicas).groupBy("file_path").agg(n.cast("bigint").alias("holders"))


def hot_under_replicated(view: DataFrame, now: Column, minutes: float, target: int = 3) -> DataFrame:
    """Hot files with fewer fast replicas than wanted, fewest first."""
    return view.where((c("nvme_replicas") < target) & is_hot(now, minutes, "size", strict=True)).select(
        "file_path", "nvme_replicas", "size", F.timestamp_diff("SECOND", "last_accessed", now).alias("age_s"), (F.lit(target) - c("nvme_replicas")).alias("missing")
    )


def replica_histogram(view: DataFrame, target: int = 3) -> DataFrame:
    """Files by number of fast replicas, empty bins up to the most or the target included."""
    counts = view.groupBy(c("nvme_replicas").alias("replicas")).agg(F.count("*").alias("files"))
    bins = counts.agg(F.greatest(F.max("replicas"), F.lit(target)).alias("top")).select(F.explode(F.sequence(F.lit(0).cast("bigint"), "top")).alias("replicas"))
    return bins.join(counts, "replicas", "left").select("replicas", F.coalesce("files", F.lit(0)).alias("files"))


def holder_strings(replicas: DataFrame) -> DataFrame:
    """Per file its holders and tiers as text."""
    join = lambda x: F.array_join(F.array_sort(F.collect_set(x)), ", ")
    return replicas.groupBy("file_path").agg(join(F.lower("storage_tier")).alias("tiers"), join("peer_id").alias("holders"), F.max("last_accessed").alias("last_accessed"))


def label_pairs(peers: DataFrame) -> DataFrame:
    """The labels that there are."""
    return peers.select(F.explode(F.map_entries("labels")).alias("e")).select(c("e.key").alias("label"), F.concat(c("e.key"), F.lit("="), c("e.value")).alias("pair")).distinct()


# --- upserts and other changes (2.J) -----------------------------------------------------------------------------------


def upsert_replicas(events: DataFrame) -> DataFrame:
    """Per (path, peer, tier) the last row, at the place of the first; seq is unique among the rows of a key. Each
    column is summed by itself before the shuffle, so columns that nobody asks for cost nothing."""
    keys = ["file_path", "peer_id", "storage_tier"]
    rest = [x for x in events.columns if x not in (*keys, "seq")]
    out = events.groupBy(*keys).agg(F.min("seq").alias("__first"), *[F.max_by(x, "seq").alias(x) for x in rest])
    return out.select(*keys, c("__first").alias("seq"), *rest)


def latest_peers(heartbeats: DataFrame) -> DataFrame:
    """Per peer the last heartbeat; probe values only overwrite where they are positive."""
    known = lambda x: F.max_by(F.when(c(x) > 0, c(x)), F.when(c(x) > 0, c("seq"))).alias(x)
    last = F.max_by(F.struct("ts", "status", "available_space", "used_space"), "seq").alias("r")
    return heartbeats.groupBy("peer_id").agg(last, known("network_speed_mbps"), known("network_latency_ms")).select("peer_id", "r.*", "network_speed_mbps", "network_latency_ms")


def mark_inactive(peers: DataFrame, now: Column, seconds: int = 60, drop: bool = False) -> DataFrame:
    """Peers not heard of are inactive (kept), or with drop gone, as a store with leases has it."""
    late = c("last_heartbeat") < now - F.make_dt_interval(secs=F.lit(seconds))
    if drop:
        return peers.where(~F.coalesce(late, F.lit(False)))
    return peers.withColumn("status", F.when(late, "inactive").otherwise(c("status")))


def footprint(entries: DataFrame, doomed: DataFrame) -> DataFrame:
    """All paths that go with doomed (file_path, num_chunks): themselves, declared chunks, and chunks that are there."""
    each = doomed.where("num_chunks > 0").select("file_path", F.explode(F.sequence(F.lit(0).cast("bigint"), c("num_chunks") - 1)).alias("i"))
    declared = each.select(S.chunk_path(c("file_path"), c("i")).alias("file_path"))
    there = entries.select("file_path", S.parent_path(c("file_path")).alias("parent")).join(doomed.select(c("file_path").alias("parent")), "parent", "left_semi").select("file_path")
    return doomed.select("file_path").union(declared).union(there).distinct()


def delete_objects(entries: DataFrame, doomed: DataFrame) -> DataFrame:
    """What is left."""
    return entries.join(footprint(entries, doomed), "file_path", "left_anti")


def touch(entries: DataFrame, reads: DataFrame) -> DataFrame:
    """Last access of entries after reads (path, ts), which touch a chunk's parent as well."""
    seen = reads.select("path", "ts").union(reads.select(S.parent_path(c("path")), "ts").where(S.parent_path(c("path")).isNotNull()))
    last = seen.groupBy(c("path").alias("file_path")).agg(F.max("ts").alias("read_at"))
    return entries.join(last, "file_path", "left").withColumn("last_accessed", F.greatest("last_accessed", "read_at")).drop("read_at")


def rename(entries: DataFrame, old: str, new: str) -> DataFrame:
    """The path and its chunks under another name; what had that name goes."""
    mine = (c("file_path") == old) | (S.parent_path(c("file_path")).eqNullSafe(F.lit(old)))
    theirs = (c("file_path") == new) | (S.parent_path(c("file_path")).eqNullSafe(F.lit(new)))
    path = F.when(mine, F.concat(F.lit(new), F.substring(c("file_path"), len(old) + 1, 1 << 30))).otherwise(c("file_path"))
    return entries.where(mine | ~theirs).withColumn("file_path", path)


def latest_jobs(updates: DataFrame) -> DataFrame:
    """The last state of each job."""
    last = F.max_by(F.struct("status", "files", "done", "updated_at"), "seq")
    return updates.groupBy("id").agg(last.alias("r"), F.min("updated_at").alias("started_at")).select("id", "started_at", "r.*")


def retained_jobs(jobs: DataFrame, most: int = 32) -> DataFrame:
    """Newest first, running ones always, finished ones up to the total."""
    order = Window.orderBy(c("updated_at").desc(), c("id").desc())
    running = jobs.where("status = 'running'")
    done = jobs.where("status <> 'running'").orderBy(c("updated_at").desc(), c("id").desc()).limit(most)
    n = running.agg(F.count("*").alias("n"))
    ranked = done.withColumn("r", F.row_number().over(order)).join(F.broadcast(n)).where(c("r") <= most - c("n")).drop("r", "n")  # most rows and one row
    return running.unionByName(ranked)


def live_sessions(events: DataFrame) -> DataFrame:
    """Volumes that are in use, with the root and pin of their first reference of now."""
    from quayside.operators.ordered import session_counts

    last = events.where("op = 'create'").groupBy("volume_id").agg(F.max_by(F.struct("root_path", "pinned"), "seq").alias("r"))
    return session_counts(events).where("refs > 0").join(last, "volume_id").select("volume_id", "refs", "r.root_path", "r.pinned")


def pinned_prefixes(sessions: DataFrame) -> DataFrame:
    """Roots that live sessions pin."""
    return sessions.where("pinned AND root_path <> ''").select("root_path").distinct()


def restore_state(now: DataFrame, saved: DataFrame, keys: list[str], merge: bool) -> DataFrame:
    """The saved rows alone, or with merge those and the rows of now under other keys."""
    return saved if not merge else saved.unionByName(now.join(saved.select(*keys), keys, "left_anti"))


def seed_plan(peers: DataFrame, replicas: DataFrame, percent: int) -> DataFrame:
    """Copies (file_path, source, target) that bring files to a percentage of the active peers that lack
    them, lowest ids first. The lowest k lacking peers are the numbers up to some last one but those taken, so a path is one
    row with its gaps until these are listed; what is listed is not shuffled. The rows are paths times a share of the peers."""
    from quayside.operators.selection import share_of

    live = active_peers(peers).select("id", F.row_number().over(Window.orderBy("id")).alias("i"))  # a fleet's nodes
    known = holders(replicas).groupBy("file_path", c("peer_id").alias("id")).agg(F.min("seq").alias("seq")).join(live, "id", "left")
    per = known.where("i IS NOT NULL").groupBy("file_path").agg(F.count("i").alias("held"), F.array_sort(F.collect_list("i")).alias("taken"), F.min_by("id", F.struct("seq", "id")).alias("source"))
    per = per.join(F.broadcast(live.agg(F.count("*").alias("n")))).where("n > held").withColumn("k", share_of(c("n") - c("held"), percent).cast("int"))  # one row
    ends = per.withColumn("last", F.expr("aggregate(taken, k, (b, t) -> IF(t <= b, b + 1, b))")).withColumn("some", F.expr("filter(taken, t -> t <= last)"))
    gaps = F.expr("filter(zip_with(concat(array(0), some), concat(some, array(last + 1)), (a, z) -> struct(a + 1 AS low, z - 1 AS high)), g -> g.low <= g.high)")
    each = ends.select("file_path", "source", F.explode(gaps).alias("g")).select("file_path", "source", F.explode(F.sequence("g.low", "g.high")).alias("i"))
    return each.join(F.broadcast(live), "i").select("file_path", "source", c("id").alias("target"))
