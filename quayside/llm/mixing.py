"""Mixing sources to target weights by Efraimidis-Spirakis sampling. Native: DataFrame functions only.

Every document gets an exponential key, -ln(u) / quality, with u from a hash of its id; a source takes whole epochs of
all its documents first and then, in the order of the keys, as many words as its target still lacks. The running sum
over a source is made of sums of key ranges, of about evenly many rows whatever the documents' weights and more of them
for more rows, so a source with a third of all rows is never in one task.

Edge cases: a null text has size 0; null sources form one source, last in order; an empty table gives an empty result;
a null doc_id is hashed as "null"; rows that repeat are sampled one by one (equal keys are ordered by size); other
columns of the input, whatever their names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quayside.llm.common import numbered, stash

WORD = r"[^\x20\x09-\x0D]+"
U_BITS = 48


def uniform(doc_id: Column, seed: int) -> Column:
    """A number in (0, 1) from the md5 of seed and id, the same in every run and engine."""
    h = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")))), 1, U_BITS // 4), 16, 10)
    return (h.cast("bigint").cast("double") + F.lit(0.5)) / F.lit(float(2**U_BITS))


def quality(size: Column, chars: Column) -> Column:
    """0.1 to 1: how near the mean length of a word is to 6 characters; the weight of a document in the sampling."""
    mean = chars.cast("double") / F.greatest(size, F.lit(1)).cast("double")
    return F.greatest(F.lit(0.1), F.lit(1.0) - F.abs(mean - F.lit(6.0)) / F.lit(10.0))


def targets(sizes: DataFrame, weights: tuple[int, ...], share: float, most: int) -> DataFrame:
    """(__src, source, __total) with the source's target: share of all words by weight, none above most times its size.

    The excess of full sources is shared again by weight: with sources by the level (most * size / weight) at which they
    fill up, the full ones are a prefix, and one level holds for the rest.
    """
    w = F.element_at(F.array(*[F.lit(x).cast("bigint") for x in weights]), (F.col("__rank") % len(weights) + 1).cast("int"))
    ranked = numbered(sizes, [F.col("source").asc_nulls_last()], {})
    ranked = ranked.select("__src", "source", "__total", F.col("__rank").alias("__k"), w.alias("__w"), (F.col("__total") * most).alias("__cap"))
    level = ranked.withColumn("__level", F.col("__cap").cast("double") / F.col("__w"))
    runs = stash(numbered(level, [F.col("__level"), F.col("__k")], {"__caps": "__cap", "__ws": "__w"}))
    words, all_w = runs.agg(F.coalesce(F.sum("__total"), F.lit(0)), F.coalesce(F.sum("__w"), F.lit(0))).first()
    goal = float(words) * share
    left_w = F.lit(all_w) - (F.col("__ws") - F.col("__w"))
    full = F.col("__level") <= (F.lit(goal) - (F.col("__caps") - F.col("__cap")).cast("double")) / left_w
    caps, ws = runs.where(full).agg(F.coalesce(F.max("__caps"), F.lit(0)), F.coalesce(F.max("__ws"), F.lit(0))).first()
    rest = (goal - float(caps)) / (all_w - ws) if all_w > ws else 0.0
    return runs.select("__src", "source", "__total", F.when(F.col("__ws") <= ws, F.col("__cap").cast("double")).otherwise(F.col("__w") * F.lit(rest)).alias("target"))


def range_of(key: Column, parts: int) -> Column:
    """A number that grows with the key. The first half splits keys of weight 1 evenly, the second those of weight 0.1."""
    evenly = lambda x: F.least(F.lit(parts - 1), F.floor((F.lit(1.0) - F.exp(-x)) * parts)).cast("bigint")
    return evenly(key) * parts + evenly(key * F.lit(0.1))


def taken_rows(docs: DataFrame, weights: tuple[int, ...], share: float, most: int, seed: int, rows_a_range: int, keep: bool) -> DataFrame:
    """(doc_id, size, source_size, target, taken), with keep also __doc, all columns of the row."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint")
    own = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__doc")] if keep else []
    rows = docs.select("doc_id", "source", size.alias("size"), F.coalesce(F.length("text"), F.lit(0)).alias("__chars"), *own)
    parts = max(256, -(-docs.count() // rows_a_range))
    rows = rows.withColumn("__key", -F.log(uniform(F.col("doc_id"), seed)) / quality(F.col("size"), F.col("__chars")))
    rows = rows.withColumn("__range", range_of(F.col("__key"), parts))
    rows = stash(rows.withColumn("__src", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))).drop("__chars"))
    sums = rows.groupBy("__src", "source", "__range").agg(F.sum("size").alias("__words"))
    goals = targets(sums.groupBy("__src", "source").agg(F.sum("__words").alias("__total")), weights, share, most)
    whole = F.floor("target").cast("bigint")
    epochs = F.when(F.col("__total") > 0, F.expr("floor(target) div __total")).otherwise(F.lit(0)).cast("bigint")
    goals = goals.select("__src", "__total", "target", epochs.alias("__epochs"), (whole - epochs * F.col("__total")).alias("__rest"))
    before = Window.partitionBy("__src").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("__src", "__range", F.coalesce(F.sum("__words").over(before), F.lit(0)).alias("__before")).join(goals, "__src")
    inside = Window.partitionBy("__src", "__range").orderBy("__key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    out = rows.join(sums, ["__src", "__range"])
    seen = F.col("__before") + F.sum("size").over(inside) - F.col("size")
    extra = F.greatest(F.lit(0), F.least(F.col("size"), F.col("__rest") - seen))
    taken = (F.col("__epochs") * F.col("size") + extra).cast("bigint").alias("taken")
    return out.select("doc_id", "size", F.col("__total").alias("source_size"), "target", taken, *(["__doc"] if keep else []))


def mix(docs: DataFrame, *, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: int = 2, seed: int = 17, rows_a_range: int = 100_000) -> DataFrame:
    """(doc_id, size, source_size, target, taken): the words that the mix takes of each document, repeats counted.

    The document at which a source reaches its target is taken in part, so a source's sum is its target rounded down.
    """
    return taken_rows(docs, weights, share, most, seed, rows_a_range, False)


def apply_mix(docs: DataFrame, *, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: int = 2, seed: int = 17, rows_a_range: int = 100_000) -> DataFrame:
    """The documents of the mix as whole rows: each as often as its own taken words come to, the last part rounded. Rows
    that share a doc_id, null ones too, are taken one by one."""
    out = taken_rows(docs, weights, share, most, seed, rows_a_range, True)
    copies = F.expr("CASE WHEN size > 0 THEN (2 * taken + size) div (2 * size) ELSE 0 END").cast("int")
    out = out.select("__doc", copies.alias("__n")).where("__n > 0")
    return out.select("__doc", F.explode(F.sequence(F.lit(1), "__n"))).select(*[F.col(f"__doc.`{c}`").alias(c) for c in docs.columns])
