"""Document fingerprints by order MinHash, and their likeness to an edited text and to the next document.

Tokens are stretches without spaces, of at most 16 code points; k-mers are runs of k tokens, numbered by occurrence, so
that repeats count. For each of m hash functions the l least numbered k-mers are put in text order and hashed together:
two texts share an entry only if they share k-mers in the same order, which follows the edit distance. Likeness is the
part of entries that are equal.

The next document is that of the next lower doc_id. Documents are dealt to id ranges and sorted; the first document of a
range goes to the range above it as well, so only one id a range meets on the driver, of a bounded number of ranges. Rows
without an id are dealt to ranges of their texts' hashes.

Edge cases: null texts are empty; an empty text's fingerprint equals only that of other texts without a token; texts of
fewer than k tokens have one k-mer; a text with fewer than l k-mers uses all; a null doc_id comes after all others, equal
ids are ordered by text; a document that is alone is its own next; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(r"\S{1,16}")
K, L, M = 3, 2, 32
KEPT = 300_000
RANGES = 65_536  #: of ids, at most; beyond that they hold more rows, which a task streams through
_MIX = np.uint64(0x9E3779B97F4A7C15)  # a fixed odd multiplier
_MAX = np.uint64(2**64 - 1)


class TokenHash(dict):
    def __missing__(self, token: str) -> int:
        if len(self) > KEPT:
            self.clear()
        out = self[token] = xxhash.xxh64_intdigest(token.encode("utf-8", "surrogatepass"))
        return out


class OrderMinHash:
    def __init__(self, k: int = K, l: int = L, m: int = M, seed: int = 5) -> None:  # noqa: E741
        rng = np.random.default_rng(seed)
        self.k, self.l, self.m, self.tokens = k, l, m, TokenHash()
        self.xors, self.odds = (rng.integers(0, 2**64, (m, 1), dtype=np.uint64) for _ in range(2))
        self.odds |= np.uint64(1)

    def least(self, x: np.ndarray, at: np.ndarray) -> np.ndarray:
        """(m, l) positions, of the least l hashes of x by each function."""
        h = (x[None, :] ^ self.xors) * self.odds
        h ^= h >> np.uint64(32)
        h *= _MIX
        picks, rows = [], np.arange(self.m)
        for _ in range(min(self.l, len(x))):
            picks.append(h.argmin(axis=1))
            h[rows, picks[-1]] = _MAX
        return at[np.stack(picks, axis=1)]

    def signature(self, text: str) -> np.ndarray:
        """m hashes of 32 bits."""
        found = TOKEN.findall(text)
        if not found:
            return np.zeros(self.m, dtype=np.uint32)
        t = np.fromiter(map(self.tokens.__getitem__, found), dtype=np.uint64, count=len(found))
        k = min(self.k, len(t))
        mers = t[: len(t) - k + 1].copy()
        for i in range(1, k):
            mers = mers * _MIX + t[i : len(t) - k + 1 + i]
        order = np.argsort(mers, kind="stable")
        s = mers[order]
        where = np.arange(len(s))
        first = np.maximum.accumulate(np.where(np.r_[True, s[1:] != s[:-1]], where, 0))
        nth = np.empty(len(s), dtype=np.uint64)
        nth[order] = where - first
        x, at = mers + (nth + np.uint64(1)) * np.uint64(0xD1B54A32D192ED03), where
        picks = [self.least(x[i : i + 2048], at[i : i + 2048]) for i in range(0, len(x), 2048)]
        if len(picks) > 1:
            pool = np.concatenate(picks, axis=1)  # of each function; the least of the least
            h = (x[pool] ^ self.xors) * self.odds
            h ^= h >> np.uint64(32)
            h *= _MIX
            picks = [np.take_along_axis(pool, np.argsort(h, axis=1, kind="stable")[:, : self.l], axis=1)]
        out = np.full(self.m, 1, dtype=np.uint64)
        for c in np.sort(picks[0], axis=1).T:
            out = (out ^ mers[c]) * _MIX
            out ^= out >> np.uint64(29)
        return (out >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def edited(text: str, following: str) -> str:
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


def ranges_of(docs: DataFrame, rows_a_range: int) -> tuple[list[int], int]:
    """Lower ends of id ranges of about as many rows, all but the lowest, and the number of ranges of rows without an id."""
    counts = docs.agg(F.count("doc_id").alias("ids"), F.count("*").alias("rows")).first()
    n, k = (max(1, min(RANGES, -(-x // rows_a_range))) for x in (counts["ids"], counts["rows"] - counts["ids"]))
    return sorted(set(docs.approxQuantile("doc_id", [i / n for i in range(1, n)], 0.2 / n))) if n > 1 else [], k


def fingerprint(docs: DataFrame, *, rows_a_range: int = 4096) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next)"""
    text = F.coalesce("text", F.lit(""))
    value = F.coalesce(F.col("doc_id").cast("bigint"), F.bitwise_not(F.xxhash64(text)))  # falls from row to row; without an id by hash
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text"), value.alias("value"))
    ends, bare = ranges_of(rows, rows_a_range)
    lows = np.array(ends, dtype=np.int64)

    def range_at(doc_id: int | None, value: int) -> int:
        if doc_id is None:
            return ((value + 2**63) * bare) >> 64
        return bare + int(np.searchsorted(lows, value, side="right"))

    def part_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            part = list(map(range_at, b.column("doc_id").to_pylist(), b.column("value").to_pylist()))
            yield pa.RecordBatch.from_arrays([b.column("value"), pa.array(part, pa.int32())], names=["value", "part"])

    tops = rows.select("doc_id", "value").mapInArrow(part_of, "value bigint, part int").groupBy("part").agg(F.max("value").alias("top")).orderBy("part").collect()
    above = {(at["part"], at["top"]): over["part"] for at, over in zip(tops, [*tops[1:], *tops[:1]], strict=True)}  # a range's first row: the range over it

    @F.arrow_udf("array<struct<part:int,extra:boolean>>")
    def places(ids: pa.Array, values: pa.Array) -> pa.Array:
        out = []
        for x, v in zip(ids.to_pylist(), values.to_pylist(), strict=True):
            own = {"part": range_at(x, v), "extra": False}
            over = above.get((own["part"], v))
            out.append([own] if over is None else [own, {"part": over, "extra": True}])
        return pa.array(out, pa.list_(pa.struct([("part", pa.int32()), ("extra", pa.bool_())])))

    dealt = rows.withColumn("p", F.explode(places("doc_id", "value"))).select("p.part", "p.extra", "doc_id", "value", "text")
    dealt = dealt.repartitionById(len(ends) + 1 + bare, "part").sortWithinPartitions("part", "extra", F.desc("value"), F.xxhash64("text"), "text")
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        omh, last = OrderMinHash(), None  # last: (part, doc_id, text, signature) still without its next
        for b in batches:
            out = []
            for part, extra, doc_id, text in zip(*[b.column(c).to_pylist() for c in ("part", "extra", "doc_id", "text")], strict=True):
                if last is None and extra:
                    continue
                sig = omh.signature(text)
                if last is not None:
                    changed = edited(last[2], text)
                    other = omh.signature(changed)
                    digest = hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest()
                    out.append((last[1], len(last[2]), digest, last[3].astype(">u4").tobytes().hex(), other.astype(">u4").tobytes().hex(), likeness(last[3], other), likeness(last[3], sig)))
                last = None if extra else (part, doc_id, text, sig)
            cols = list(zip(*out, strict=True)) or [()] * 7
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

    return dealt.mapInArrow(run, "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
