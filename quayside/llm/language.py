"""Language ID by rank-order profiles: out-of-place distance of a document's most frequent n-grams to each language's.

A text is lower-cased; words are runs of letters, each with a space on both sides; n-grams of 1 to 3 code points are
counted over the whole text. An n-gram is one integer of three code points, so order and ties are the same everywhere.
A profile holds the most frequent n-grams of a language, learned from a sample of its different labelled texts of a stated
expected size. All languages are learned, however rare. The distance adds up how far each n-gram's rank is from its rank in the profile, and for n-grams that the
profile lacks the profile's size; the score is 1 less the distance's part of the largest possible.

Edge cases: a text that is null or has no letter is und, score 0; equal distances go to the language first by code point;
with nothing to learn from all is und; a null doc_id is not held out and is hashed as an empty text; rows that repeat are
predicted one by one; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quayside.llm.common import map_texts

WORDS = re.compile(r"[^\W\d_]+")
TOP = 300
SAMPLE = 2000  #: expected labelled texts that a language's profile is learned from, at most
LANGUAGES = 20_000  #: profiles that fit in a task; where there are more languages, learning fails rather than leave some out
UNKNOWN = "und"


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of 1 to 3 code points with their counts, most frequent first, ties by code point."""
    words = Counter(WORDS.findall(text.lower()))
    if not words:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    line = np.frombuffer((" " + " ".join(words) + " ").encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
    spaces = np.flatnonzero(line == 32)
    times = np.repeat(np.fromiter(words.values(), np.int64, len(words)), np.diff(spaces))  # of each code point from a space on
    one, two = line[:-1] << 42, line[:-1] << 42 | line[1:] << 21
    inner = line[:-1] != 32
    three = two[:-1] | line[2:]
    whole = line[1:-1] != 32  # a space in the middle would join two words
    codes = np.concatenate([one[inner], two, three[whole]])
    counts = np.concatenate([times[inner], times, times[:-1][whole]])
    order = np.argsort(codes)
    codes, counts = codes[order], counts[order]
    first = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
    codes, counts = codes[first], np.add.reduceat(counts, first)
    order = np.argsort(-counts, kind="stable")
    return codes[order], counts[order]


class Profiles:
    def __init__(self, ranked: dict[str, list[int]]) -> None:
        """ranked: each language's n-grams, most frequent first."""
        self.known = [(lang, np.sort(codes := np.array(g, dtype=np.int64)), np.argsort(codes)) for lang, g in sorted(ranked.items())]

    def predict(self, text: str | None, top: int = TOP) -> tuple[str, float]:
        codes = grams(text)[0][:top] if text else ()
        best = (UNKNOWN, 0.0)
        if len(codes) and self.known:
            ranks, least = np.arange(len(codes)), None
            for lang, own, rank in self.known:
                at = np.minimum(np.searchsorted(own, codes), len(own) - 1)
                away = np.where(own[at] == codes, np.minimum(np.abs(rank[at] - ranks), top), top).sum()
                if least is None or away < least:
                    least, best = away, (lang, float(1 - away / (top * len(codes))))
        return best


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def learn(labelled: DataFrame, *, top: int = TOP, sample: int = SAMPLE, seed: int = 3) -> Profiles:
    """Profiles from (doc_id, text, lang). The driver gets the languages' row counts and top n-grams of each language."""
    rows = labelled.select("text", "lang").where("text IS NOT NULL AND lang IS NOT NULL")
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n"))
    if (n := sizes.count()) > LANGUAGES:
        raise ValueError(f"{n} languages, more than {LANGUAGES}")
    part = F.pmod(F.xxhash64("text", F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    # a row a language, of a checked number; no text is sent to them
    few = rows.join(F.broadcast(sizes), "lang").where(part < F.lit(float(sample)) / F.col("n")).select("lang", "text").distinct()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found: dict[str, Counter] = {}
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True):
                codes, counts = grams(text)
                found.setdefault(lang, Counter()).update(dict(zip(codes.tolist(), counts.tolist(), strict=True)))
            for lang, c in found.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(c), pa.string()), pa.array(c.keys(), pa.int64()), pa.array(c.values(), pa.int64())], names=["lang", "gram", "n"])

    sums = few.mapInArrow(count, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    w = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    ranked: dict[str, list[int]] = {}
    for r in sums.withColumn("r", F.row_number().over(w)).where(F.col("r") <= top).orderBy("lang", "r").select("lang", "gram").collect():
        ranked.setdefault(r["lang"], []).append(r["gram"])
    return Profiles(ranked)


def predict(docs: DataFrame, profiles: Profiles) -> DataFrame:
    """(doc_id, lang_pred, score)"""
    return map_texts(docs, lambda: lambda texts: [profiles.predict(t) for t in texts], "lang_pred string, score double")


def identify(docs: DataFrame, *, top: int = TOP, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, lang_pred, score), learned from the documents that are not held out."""
    profiles = learn(docs.where(~held_out(F.col("doc_id"))), top=top, sample=sample)
    return predict(docs, profiles).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def apply_filter(docs: DataFrame, *, least: float = 0.0) -> DataFrame:
    """The documents whose language is known with a score over least; the others go. All columns are kept."""
    profiles = learn(docs.where(~held_out(F.col("doc_id"))))

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        found = [profiles.predict(t) for t in texts.to_pylist()]
        return pa.array([s if lang != UNKNOWN else -1.0 for lang, s in found], pa.float64())

    return docs.where(score("text") > least)
