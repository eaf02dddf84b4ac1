"""Telemetry: metric lines to samples and back, hit rates, shares, histograms and panels (survey 2.A A17-A18, 2.D D9-D30)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quayside.functions import scalars as S

c = F.col
TIERS = ("nvme", "peer", "cloud")
_LABEL = r'([^=,\s](?:[^=]*[^=\s])?)\s*="((?:[^"\\]|\\.)*)"'


def parse_metrics(lines: DataFrame) -> DataFrame:
    """Of (line, ...) samples (name, labels, value, ...): comments, lines without a name or a number and unclosed labels
    are skipped, a time after the value is ignored, escapes in labels are undone; NaN and infinities are numbers."""
    own = [x for x in lines.columns if x != "line"]
    line = F.trim(F.translate(c("line"), "\t\r", "  "))
    labelled = F.regexp_replace(line, r"^([^{]*)\{(.*)\}([^}]*)$", "$1\x01$3\x01$2")  # unchanged if a label is not closed
    plain = F.regexp_replace(line, r"^([^ ]+) *(.*)$", "$1\x01$2\x01")
    cut = F.split(F.when(F.contains(line, F.lit("{")), labelled).otherwise(plain), "\x01", 3)
    # a generator's row is made once: selects after it and filters, which move below them, only read it
    t = lines.select(*own, F.explode(F.array(cut)).alias("__p")).where(F.size("__p") == 3)
    name = F.trim(F.get("__p", F.lit(0)))
    value = F.substring_index(F.trim(F.get("__p", F.lit(1))), " ", 1).try_cast("double")  # knows NaN, Inf, +Inf and -Inf
    t = t.where((name != "") & ~name.startswith("#") & value.isNotNull()).select(*own, name.alias("name"), F.get("__p", F.lit(2)).alias("__in"), value.alias("value"))
    found = lambda i: F.regexp_extract_all("__in", F.lit(_LABEL), F.lit(i))
    plain_values = F.transform(found(2), lambda x: F.when(F.contains(x, F.lit("\\")), S.unescape_label(x)).otherwise(x))
    pairs = F.struct(found(1).alias("k"), F.when(F.contains("__in", F.lit("\\")), plain_values).otherwise(found(2)).alias("v"))
    t = t.select(*own, "name", "value", F.explode(F.array(pairs)).alias("__l"))
    k, v = c("__l.k"), c("__l.v")
    last = F.filter(F.arrays_zip(k.alias("k"), v.alias("v")), lambda e, i: ~F.array_contains(F.slice(k, i + 2, F.size(k)), e["k"]))
    again = F.map_from_entries(F.transform(last, lambda e: F.struct(e["k"], e["v"])))
    labels = F.when(F.size(F.array_distinct(k)) == F.size(k), F.map_from_arrays(k, v)).otherwise(again)
    return t.select(*own, "name", labels.alias("labels"), "value")


def format_value(x: Column) -> Column:
    """Whole numbers without a fraction, others in full."""
    return F.when(F.isnan(x), "NaN").when(x == float("inf"), "+Inf").when(x == float("-inf"), "-Inf").when(x == F.floor(x), x.cast("decimal(38,0)").cast("string")).otherwise(x.cast("string"))


def escape_label(x: Column) -> Column:
    return F.replace(F.replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))


def emit_metrics(samples: DataFrame) -> DataFrame:
    """One line a sample: name{label="value",...} number, labels in order."""
    pairs = F.transform(F.array_sort(F.map_entries("labels")), lambda e: F.concat(e["key"], F.lit('="'), escape_label(e["value"]), F.lit('"')))
    text = F.when(F.size("labels") > 0, F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}"))).otherwise("")
    return samples.select(F.concat(c("name"), text, F.lit(" "), format_value(c("value"))).alias("line"))


def unlabelled(samples: DataFrame, keys: list[str]) -> DataFrame:
    """The first unlabelled sample of each name."""
    return samples.where(F.size("labels") == 0).groupBy(*keys, "name").agg(F.min_by("value", "line_no").alias("value"))


def by_label(samples: DataFrame, name: str, label: str, keys: list[str]) -> DataFrame:
    """The last sample of each value of a label."""
    t = samples.where((c("name") == name) & F.map_contains_key("labels", label)).withColumn("label", F.element_at("labels", F.lit(label)))
    return t.groupBy(*keys, "label").agg(F.max_by("value", "line_no").alias("value"))


def names_seen(samples: DataFrame) -> DataFrame:
    """Names in the order they come up."""
    return samples.groupBy("name").agg(F.min("line_no").alias("first_line"))


def delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """By name, a missing side as 0."""
    b, a = before.select("name", c("value").alias("b")), after.select("name", c("value").alias("a"))
    return b.join(a, "name", "full_outer").select("name", (F.coalesce("a", F.lit(0.0)) - F.coalesce("b", F.lit(0.0))).alias("delta"))


def ratio(part: Column, total: Column, scale: float = 100.0) -> Column:
    return F.when(total > 0, part * scale / total)


def hit_counts(events: DataFrame, keys: list[str]) -> DataFrame:
    """Reads that a tier served, and those it did not hold."""
    return events.groupBy(*keys, "tier").agg(F.count(F.when(c("outcome") == "ok", 1)).alias("hits"), F.count(F.when(c("outcome") == "miss", 1)).alias("misses"))


def cluster_hit_rate(hits: DataFrame) -> DataFrame:
    """Hits of all tiers and nodes over hits and misses, in percent; null with none."""
    return hits.agg(ratio(F.sum("hits"), F.sum("hits") + F.sum("misses")).alias("hit_rate"))


def tier_shares(hits: DataFrame) -> DataFrame:
    """Per node and tier its hit rate and its share of the node's hits."""
    from pyspark.sql import Window

    all_ = F.sum("hits").over(Window.partitionBy("node"))
    return hits.select("node", "tier", "hits", "misses", F.round(ratio(c("hits"), c("hits") + c("misses")), 1).alias("hit_rate"), ratio(c("hits"), all_).alias("share"))


def capacity_use(peers: DataFrame) -> DataFrame:
    """Totals, percent used and its level."""
    used, cap = F.sum("used_space"), F.sum(c("used_space") + c("available_space"))
    p = F.coalesce(ratio(used, cap), F.lit(0.0))
    return peers.agg(cap.alias("capacity"), used.alias("used"), p.alias("used_pct"), F.when(p >= 90, "critical").when(p >= 75, "warning").otherwise("ok").alias("level"))


def tier_reads(events: DataFrame, keys: list[str]) -> DataFrame:
    """Bytes, nanos and reads by tier, with MiB/s; reads of nothing don't count, negative times are 0."""
    t = events.where((c("bytes") > 0) & (c("outcome") == "ok"))
    out = t.groupBy(*keys, "tier").agg(F.sum("bytes").alias("bytes"), F.sum(F.greatest("nanos", F.lit(0).cast("bigint"))).alias("nanos"), F.count("*").alias("ops"))
    return out.withColumn("mbps", S.mib_per_second(c("bytes"), c("nanos")))


def read_wall(reads: DataFrame) -> DataFrame:
    """Of (total, nvme, peer, cloud): where the bytes came from. Negative parts are 0; parts that exceed the total are
    scaled down to it, each rounded down; what no part explains is other."""
    parts = reads.where("total > 0").select("*", *[F.greatest(c(t), F.lit(0).cast("bigint")).alias(f"_{t}") for t in TIERS])
    s = c("_nvme") + c("_peer") + c("_cloud")
    scale = c("total").cast("double") / s.cast("double")
    cut = parts.select("total", *[F.when(s > c("total"), F.floor(c(f"_{t}").cast("double") * scale).cast("bigint")).otherwise(c(f"_{t}")).alias(t) for t in TIERS])
    other = c("total") - c("nvme") - c("peer") - c("cloud")
    return cut.agg(F.count("*").alias("ops"), F.sum("total").alias("total"), *[F.sum(t).alias(t) for t in TIERS], F.sum(F.greatest(other, F.lit(0))).alias("other"))


def range_cache(chunks: DataFrame) -> DataFrame:
    """D20."""
    return chunks.agg(F.countDistinct("path").alias("files"), F.count("*").alias("chunks"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))


def warm_results(updates: DataFrame) -> DataFrame:
    """Per job the outcomes, and the bytes of what was warmed."""
    n = lambda x: F.count(F.when(c("outcome") == x, 1)).alias(x)
    return updates.groupBy("id").agg(F.count("*").alias("files"), n("warmed"), n("already_local"), n("skipped"), n("failed"), F.coalesce(F.sum(F.when(c("outcome") == "warmed", c("bytes"))), F.lit(0)).alias("bytes"))


def warm_progress(updates: DataFrame) -> DataFrame:
    """The same counts as they stood after each update."""
    from pyspark.sql import Window

    w = Window.partitionBy("id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    n = lambda x: F.sum(F.when(c("outcome") == x, 1).otherwise(0)).over(w).alias(x)
    return updates.select("id", "seq", F.count("*").over(w).alias("done_so_far"), n("warmed"), n("failed"))


def benchmark_shares(runs: DataFrame) -> DataFrame:
    """MiB/s and shares with one decimal, 0 on an empty denominator."""
    whole = c("nvme") + c("peer") + c("cloud")
    pct = lambda x: F.coalesce(F.round(ratio(c(x), whole), 1), F.lit(0.0)).alias(f"{x}_share_pct")
    return runs.select("run", F.coalesce(F.round(F.when(c("seconds") > 0, whole / S.MIB / c("seconds")), 1), F.lit(0.0)).alias("read_mbps"), *[pct(t) for t in TIERS])


def histogram_panel(samples: DataFrame, name: str, per: Column) -> DataFrame:
    """Sum, max and a ratio with a denominator of at least 1 of a metric by a key."""
    return samples.where(c("name") == name).groupBy(per.alias("key")).agg(F.sum("value").alias("total"), F.max("value").alias("top"), (F.sum("value") / F.greatest(F.count("*"), F.lit(1))).alias("per_sample"))


def usage_after(events: DataFrame) -> DataFrame:
    """Of (node, seq, delta) of puts, deletes and promotions: bytes in use after each, never under 0."""
    from pyspark.sql import Window

    w = Window.partitionBy("node").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    summed = events.withColumn("__s", F.sum("delta").over(w))
    return summed.withColumn("used", c("__s") - F.least(F.min("__s").over(w), F.lit(0))).drop("__s")


def write_phases(events: DataFrame) -> DataFrame:
    """Calls, bytes and seconds of the phases of writes."""
    return events.groupBy("phase").agg(F.count("*").alias("calls"), F.sum("bytes").alias("bytes"), F.sum(S.seconds_of(F.greatest("nanos", F.lit(0)))).alias("seconds"))
