"""Line dedup by content-defined chunks of lines.

A rolling hash over the hashes of the last lines ends a chunk where it is 0 modulo a divisor, so an inserted or deleted
line moves only the boundaries next to it. Chunks of several lines are grouped over the whole corpus by hash and then by
their bytes; the first occurrence, by doc_id and place, stays, the others are removed.

Where chunks end depends on what stands before a passage, so by chunks alone most repeats of a few lines stay. With
passages, runs of whole lines that come to passage_words words are grouped as well: all windows that have so many words,
and would not with a line less at one end. Each line of a repeated passage of so many words or more is in such a window
that lies inside the passage, so the passage goes whole, be it one line or many. A window that overlaps the first one of
its document stays. Windows are told apart by a hash of 127 bits over their lines' hashes, not by their bytes.

Chunks are summed before they are shuffled and joined on one row per repeated chunk; where very many documents hold a
chunk, adaptive execution splits their rows.

Edge cases: a null text stays null; an empty one stays empty; blank chunks are never removed; rows of one doc_id count as
one document, so all keep what it keeps; documents with null ids come after all others, by a hash of the text; other
columns pass by unchanged; an empty table stays empty. Two different chunks with one 128-bit hash are both left alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DIVISOR, LEAST, MOST = 3, 2, 16
PASSAGE_WORDS = 50  #: what makes a passage: so many words in whole lines
_MASK, _ODD = 2**64 - 1, 0x9E3779B97F4A7C15
_PRIME, _BASE = 2**127 - 1, 0x2545F4914F6CDD1D9E3779B97F4A7C15


def chunks(lines: list[str], divisor: int = DIVISOR, least: int = LEAST, most: int = MOST) -> list[tuple[int, int]]:
    """(first line, end) of each chunk. The rolling hash is over two lines."""
    out, start, last = [], 0, 0
    for i, line in enumerate(lines):
        now = xxhash.xxh64_intdigest(line.encode("utf-8", "surrogatepass"))
        rolled = (last * _ODD + now) * _ODD & _MASK
        last = now
        size = i + 1 - start
        if size >= most or size >= least and (rolled >> 32) % divisor == 0:
            out.append((start, i + 1))
            start = i + 1
    if start < len(lines):
        out.append((start, len(lines)))
    return out


def removable(lines: list[str], start: int, end: int) -> bool:
    """Several lines, not all of them blank."""
    return end - start > 1 and any(not x.isspace() and x for x in lines[start:end])


def windows(lines: list[str], passage_words: int = PASSAGE_WORDS) -> list[tuple[int, int]]:
    """(first line, end), in order, of the windows that have passage_words words, but not without their last line or not
    without their first one."""
    words = [len(x.split()) for x in lines]
    out, end, held = set(), 0, 0
    for start, own in enumerate(words):
        while end < len(lines) and held < passage_words:
            held += words[end]
            end += 1
        if held < passage_words:
            break
        out.add((start, end))
        held -= own
    start, held = 0, 0
    for i, own in enumerate(words):
        held += own
        while held - words[start] >= passage_words:
            held -= words[start]
            start += 1
        if held >= passage_words:
            out.add((start, i + 1))
    return sorted(out)


def key_of(doc_id: Column, text: Column) -> Column:
    """doc_id, or for null ids a number above all ids from the text."""
    return F.coalesce(doc_id.cast("bigint"), F.lit(1 << 62) + F.pmod(F.xxhash64(text), F.lit(1 << 61)))


def occurrences(docs: DataFrame, with_text: bool) -> DataFrame:
    """(d, t, a, b, and first line, end, again; or the text): the removable chunks of all documents. d and t tell the row,
    a and b are the hash, again is true if the row has the chunk before."""
    more = "chunk string" if with_text else "first int, last int, again boolean"
    rows = docs.select(key_of(F.col("doc_id"), F.col("text")).alias("d"), F.xxhash64("text").alias("t"), "text").where("text IS NOT NULL")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, found = [], []
            for n, text in enumerate(batch.column("text").to_pylist()):
                lines, seen = text.split("\n"), set()
                for start, end in chunks(lines):
                    if not removable(lines, start, end):
                        continue
                    chunk = "\n".join(lines[start:end])
                    h = xxhash.xxh3_128_intdigest(chunk.encode("utf-8", "surrogatepass"))
                    a, b = (h >> 64) - 2**63, (h & _MASK) - 2**63
                    at.append(n)
                    found.append((a, b, chunk) if with_text else (a, b, start, end, h in seen))
                    seen.add(h)
            kinds = [pa.int64(), pa.int64(), *([pa.string()] if with_text else [pa.int32(), pa.int32(), pa.bool_()])]
            cols = list(zip(*found, strict=True)) or [()] * len(kinds)
            own = batch.select(["d", "t"]).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*own.columns, *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], names=names)

    names = ["d", "t", "a", "b", *[x.split()[0] for x in more.split(", ")]]
    return rows.mapInArrow(cut, f"d bigint, t bigint, a bigint, b bigint, {more}")


def repeated(docs: DataFrame) -> DataFrame:
    """(a, b, owner): the chunks that occur more than once, compared by their bytes, and the document that keeps each."""
    texts = occurrences(docs, True).groupBy("a", "b", "chunk").agg(F.count("*").alias("n"), F.min("d").alias("owner"))
    return texts.groupBy("a", "b").agg(F.count("*").alias("texts"), F.max("n").alias("n"), F.min("owner").alias("owner")).where("texts = 1 AND n > 1").select("a", "b", "owner")


def passages(docs: DataFrame) -> DataFrame:
    """(d, t, a, b, first, last, again): the windows of all documents; again is true if the row has the window before,
    and not a line of the first one is in this one. Time is linear in the lines."""
    rows = docs.select(key_of(F.col("doc_id"), F.col("text")).alias("d"), F.xxhash64("text").alias("t"), "text").where("text IS NOT NULL")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds, powers = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_()], [1]
        for batch in batches:
            at, found = [], []
            for n, text in enumerate(batch.column("text").to_pylist()):
                lines, seen, sums = text.split("\n"), {}, [0]
                spans = windows(lines)
                if not spans:
                    continue
                for line in lines:
                    sums.append((sums[-1] * _BASE + xxhash.xxh3_128_intdigest(line.encode("utf-8", "surrogatepass")) + 1) % _PRIME)
                for start, end in spans:
                    while len(powers) <= end - start:
                        powers.append(powers[-1] * _BASE % _PRIME)
                    h = (sums[end] - sums[start] * powers[end - start]) % _PRIME
                    at.append(n)
                    found.append(((h >> 63) - 2**63, h & _MASK >> 1, start, end, seen.setdefault(h, end) <= start))
            cols = list(zip(*found, strict=True)) or [()] * len(kinds)
            own = batch.select(["d", "t"]).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*own.columns, *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], names=["d", "t", "a", "b", "first", "last", "again"])

    return rows.mapInArrow(cut, "d bigint, t bigint, a bigint, b bigint, first int, last int, again boolean")


def merged(spans: DataFrame) -> DataFrame:
    """(d, t, first, last) of the union of each row's spans, so that what is gathered for a row has no line twice."""
    own = Window.partitionBy("d", "t").orderBy("first", "last")
    reach = F.max("last").over(own.rowsBetween(Window.unboundedPreceding, -1))
    cut = spans.withColumn("__new", F.when(F.col("first") <= reach, 0).otherwise(1))
    return cut.withColumn("__n", F.sum("__new").over(own.rowsBetween(Window.unboundedPreceding, 0))).groupBy("d", "t", "__n").agg(F.min("first").alias("first"), F.max("last").alias("last")).drop("__n")


def dedup(docs: DataFrame, whole: bool = False) -> DataFrame:
    """docs with the text that stays, and __lines, __removed (bigint): lines before, lines removed. With whole, repeated
    passages go as well as repeated chunks."""
    gone = occurrences(docs, False).join(repeated(docs), ["a", "b"]).where("again OR d <> owner").select("d", "t", "first", "last")
    if whole:
        twice = passages(docs).groupBy("a", "b").agg(F.count("*").alias("n"), F.min("d").alias("owner")).where("n > 1").drop("n")
        gone = gone.unionByName(passages(docs).join(twice, ["a", "b"]).where("again OR d <> owner").select("d", "t", "first", "last"))
    gone = merged(gone.distinct()).groupBy("d", "t").agg(F.collect_list(F.struct("first", "last")).alias("__gone"))
    gone = gone.withColumnRenamed("d", "__d").withColumnRenamed("t", "__t")
    own = [F.col(f"`{c}`") for c in docs.columns if c.lower() != "text"]
    rows = docs.join(gone, (key_of(docs["doc_id"], docs["text"]) == F.col("__d")) & (F.xxhash64(docs["text"]) == F.col("__t")), "left")
    lines = F.split("text", "\n", -1)
    kept = F.filter(lines, lambda x, i: ~F.exists("__gone", lambda g: (g["first"] <= i) & (i < g["last"])))
    text = F.when(F.col("__gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    removed = F.coalesce(F.aggregate("__gone", F.lit(0).cast("bigint"), lambda s, g: s + g["last"] - g["first"]), F.lit(0))
    count = F.coalesce(F.length("text") - F.length(F.replace(F.col("text"), F.lit("\n"))) + 1, F.lit(0)).cast("bigint")
    return rows.select(*own, text.alias("text"), count.alias("__lines"), removed.cast("bigint").alias("__removed"))


def report(docs: DataFrame, whole: bool = False) -> DataFrame:
    """(doc_id, n_lines, n_removed, text)"""
    return dedup(docs.select("doc_id", "text"), whole).select("doc_id", F.col("__lines").alias("n_lines"), F.col("__removed").alias("n_removed"), "text")


def apply_dedup(docs: DataFrame, whole: bool = False) -> DataFrame:
    """The documents with what stays of their texts; a document of which nothing but white space stays goes."""
    return dedup(docs, whole).where("__removed = 0 OR text RLIKE '[^\\\\s]'").select(*[f"`{c}`" for c in docs.columns])
