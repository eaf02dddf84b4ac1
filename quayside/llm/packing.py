"""Best-fit packing of documents into sequences, by exact-complement hashing.

Only the histogram of piece lengths, at most `capacity` rows whatever the input, is planned on the driver: for each
length, from the longest, single lengths, pairs and triples that exactly fill the gap are taken from an index of their
sums, as often as all are still there; what is left goes by best fit, longest first, into the fullest sequence with room.
A plan is a list of patterns with counts; the rank of a piece among those of its length says which pattern and copy takes
it. Ranks are counted in hashed groups, so a length with a third of all pieces is never in one task.

Edge cases: a null or empty text is one piece of the end token; an empty table gives no rows; rows that repeat are packed
one by one; a null doc_id stays null; only documents longer than the capacity are cut; other columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quayside.llm.common import stash

CAPACITY = 4096
WORDS_KEPT = 300_000  #: of a worker's cache of word ids; it is emptied when it grows beyond


class WordIds(dict):
    """The ids of the tokenizer's words, as little-endian unsigned 32-bit integers, kept once asked for.

    The tokenizer lower-cases a text and cuts it into words by a pattern; merges stay within a word and mark its end, so
    words can be asked for together, apart by spaces, and told apart again. Texts in Latin-1 are cut here; any other, and
    those with a special token, go to the tokenizer as they are.
    """

    #: The rules of the tokenizers whose words are cut here; texts for any other go to the tokenizer as they are.
    NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    #: That pattern for words, with its classes of characters written out for Latin-1.
    SPACE, LETTER, DIGIT = r"\t\n\x0b\x0c\r \x85\xa0", r"a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff", r"0-9\xb2\xb3\xb9\xbc-\xbe"
    WORD = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTER}]+|[{DIGIT}]|[^{SPACE}{LETTER}{DIGIT}]+")

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.before = Tokenizer.from_file(path), {}
        self.cuts = self.known_rules(json.loads(self.tokenizer.to_str()))
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True

    @classmethod
    def known_rules(cls, file: dict) -> bool:
        """Whether a tokenizer lower-cases, cuts and marks words as this class does."""
        before = (file.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        split = before[0].get("pattern") == {"Regex": cls.PATTERN} and (before[0].get("behavior"), before[0].get("invert")) == ("Removed", True)
        ends = file["model"].get("type") == "BPE" and file["model"].get("end_of_word_suffix") == "</w>" and not file["model"].get("dropout")
        return split and ends and [x.get("type") for x in before[1:]] == ["ByteLevel"] and (file.get("normalizer") or {}).get("normalizers") == cls.NORMALIZERS and not file.get("truncation")

    def encode(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")

    def add(self, words: list[str]) -> None:
        if len(self) > WORDS_KEPT:
            self.before = dict(self)
            self.clear()
        old = {w: x for w in words if (x := self.before.get(w)) is not None}
        self.update(old)
        new = [w for w in words if w not in old]
        if not new:
            return
        ids = self.encode(" ".join(new))
        raw = ids.tobytes()
        ends = np.flatnonzero(self.ends[ids]) + 1
        if len(ends) == len(new):
            for w, a, b in zip(new, [0, *(4 * ends[:-1]).tolist()], (4 * ends).tolist(), strict=True):
                self[w] = raw[a:b]
        else:
            for w in new:
                self[w] = self.encode(w).tobytes()

    def words(self, text: str) -> list[str] | None:
        if not self.cuts or "<|" in text:
            return None
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return None
        return self.WORD.findall(text.lower())

    def ids(self, texts: list[str]) -> list[bytes]:
        cut = [self.words(t) for t in texts]
        every: set[str] = set()
        for words in cut:
            every.update(words or ())
        if new := [w for w in every if w not in self]:
            self.add(new)
        out = []
        for text, words in zip(texts, cut, strict=True):
            if words is not None:
                try:
                    out.append(b"".join(map(self.__getitem__, words)))
                    continue
                except KeyError:  # the cache was emptied meanwhile
                    self.add([w for w in set(words) if w not in self])
                    out.append(b"".join([self.get(w) or self.encode(w).tobytes() for w in words]))
                    continue
            out.append(self.encode(text).tobytes())
        return out


def pieces_of(docs: DataFrame, tokenizer: str, *, end: int = 1, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): each document's ids and the end token, cut where over capacity."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, tail = WordIds(tokenizer), np.array([end], dtype="<u4").tobytes()
        for batch in batches:
            rows, texts = [], [t or "" for t in batch.column("text").to_pylist()]
            for first in range(0, len(texts), 128):
                for at, raw in enumerate(words.ids(texts[first : first + 128]), first):
                    raw += tail  # noqa: PLW2901
                    for i, start in enumerate(range(0, len(raw), 4 * capacity)):
                        part = raw[start : start + 4 * capacity]
                        rows.append((at, i, start // 4, len(part) // 4, zlib.crc32(part), part if keep_ids else None))
            at, piece, *cols = zip(*rows, strict=True) if rows else ((),) * 6
            found = [batch.column("doc_id").take(pa.array(at, pa.int64())), pa.array(piece, pa.int32()), *[pa.array(c, pa.int64()) for c in cols[:3]]]
            if keep_ids:
                found.append(pa.array(cols[3], pa.binary()))
            yield pa.RecordBatch.from_arrays(found, names=names)

    kind = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids binary" * keep_ids
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * keep_ids]
    return docs.select("doc_id", "text").mapInArrow(cut, kind)


class Patterns:
    """A histogram being used up, and the patterns that use it: (runs of (length, times), count)."""

    def __init__(self, histogram: dict[int, int], capacity: int) -> None:
        self.capacity, self.left = capacity, np.zeros(capacity + 1, dtype=np.int64)
        for length, n in histogram.items():
            self.left[length] = n
        self.found: list[tuple[tuple[tuple[int, int], ...], int]] = []
        self.pairs: np.ndarray | None = None

    def take(self, lengths: list[int]) -> bool:
        """Uses these lengths together as often as they are all there."""
        runs = {x: lengths.count(x) for x in lengths}
        n = min(int(self.left[x]) // t for x, t in runs.items())
        if not n:
            return False
        for x, t in runs.items():
            self.left[x] -= n * t
            if not self.left[x]:
                self.pairs = None
        self.found.append((tuple(runs.items()), n))
        return True

    def pair_sums(self) -> np.ndarray:
        """By sum: whether two lengths that are still there make it (a single one may count twice here)."""
        if self.pairs is None:
            size = 1 << (2 * self.capacity + 1).bit_length()
            f = np.fft.rfft((self.left > 0).astype(float), size)
            self.pairs = np.fft.irfft(f * f, size)[: self.capacity + 1] > 0.5
        return self.pairs

    def pair(self, anchor: list[int], gap: int) -> bool:
        """Fills the gap by two lengths, the larger as large as can be."""
        if gap < 2:
            return False
        low = np.arange(1, gap // 2 + 1)
        return any(self.take([*anchor, gap - int(a), int(a)]) for a in low[(self.left[low] > 0) & (self.left[gap - low] > 0)])

    def complete(self, length: int) -> bool:
        gap = self.capacity - length
        if not gap:
            return self.take([length])
        if self.left[gap] and self.take([length, gap]):
            return True
        if self.pair_sums()[gap] and self.pair([length], gap):
            return True
        third = np.arange(min(gap - 2, length), 0, -1)
        third = third[(self.left[third] > 0) & self.pair_sums()[gap - third]]
        return any(self.pair([length, int(c)], gap - int(c)) for c in third)

    def best_fit(self) -> None:
        """Longest first, into the fullest sequence with room; equal sequences are handled together."""
        room: dict[int, list[tuple[tuple[tuple[int, int], ...], int]]] = {}
        spaces = np.zeros(self.capacity + 1, dtype=bool)

        def put(r: int, runs: tuple, n: int) -> None:
            if n:
                room.setdefault(r, []).append((runs, n))
                spaces[r] = True

        for length in range(self.capacity, 0, -1):
            n = int(self.left[length])
            while n:
                fits = np.flatnonzero(spaces[length:])
                if len(fits):
                    r = length + int(fits[0])
                    runs, there = room[r].pop()
                    if not room[r]:
                        spaces[r] = False
                else:
                    r, runs, there = self.capacity, (), n
                each = r // length
                full = min(there, n // each)
                put(r - each * length, (*runs, (length, each)), full)
                n -= full * each
                some = n if there > full and 0 < n < each else 0
                if some:
                    put(r - some * length, (*runs, (length, some)), 1)
                    n = 0
                if runs:
                    put(r, runs, there - full - bool(some))
        self.found += [x for groups in room.values() for x in groups]
        self.left[:] = 0


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> dict[str, np.ndarray]:
    """Where the pieces go: arrays sorted by (length, first rank) of the runs of ranks, each with how many sequences it
    spans, the first of them, and the offset of the run's first piece in each."""
    p = Patterns(histogram, capacity)
    for length in range(capacity, 0, -1):
        while p.left[length] and p.complete(length):
            pass
    p.best_fit()
    used, rows, base = np.zeros(capacity + 1, dtype=np.int64), [], 0
    for runs, n in p.found:
        offset = 0
        for length, times in runs:
            rows.append((length, used[length], n, base, offset))
            used[length] += n * times
            offset += length * times
        base += n
    table = np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)
    return dict(zip(("length", "rank", "count", "sequence", "offset"), table.T.copy(), strict=True))


def pack(pieces: DataFrame, *, capacity: int = CAPACITY, group: int = 20_000) -> DataFrame:
    """The pieces with sequence_id and offset: no sequence over capacity, no gap in one."""
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # capacity rows at most
    total = sum(histogram.values())
    at, reach = plan(histogram, capacity), np.int64(total + 1)
    starts = at["length"] * reach + at["rank"]
    order = ["doc_id", "piece", "start", "ids_crc32"]
    rows = pieces.withColumn("__group", F.pmod(F.xxhash64(*order), F.lit(max(8, -(-total // group)))).cast("int"))
    before = Window.partitionBy("length").orderBy("__group").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("length", "__group").agg(F.count("*").alias("__n"))
    sums = sums.select("length", "__group", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    rank = F.col("__before") + F.row_number().over(Window.partitionBy("length", "__group").orderBy(*order)) - 1
    ranked = rows.join(sums, ["length", "__group"]).select(*pieces.columns, rank.cast("bigint").alias("__rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, r = b.column("length").to_numpy(), b.column("__rank").to_numpy()
            i = np.searchsorted(starts, length * reach + r, side="right") - 1
            n = at["count"][i]
            nth = r - at["rank"][i]
            more = [at["sequence"][i] + nth % n, at["offset"][i] + nth // n * length]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *[pa.array(x, pa.int64()) for x in more]], names=[*b.schema.names[:-1], "sequence_id", "offset"])

    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return ranked.mapInArrow(place, f"{kind}, sequence_id bigint, offset bigint")


def pack_documents(docs: DataFrame, tokenizer: str, *, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    return pack(stash(pieces_of(docs, tokenizer, capacity=capacity, keep_ids=keep_ids)), capacity=capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, doc_ids, ids): the sequences themselves, from pieces packed with keep_ids; ids as 32-bit bytes."""
    parts = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "doc_id", "ids"))).alias("p"))
    joined = F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["ids"]))
    return parts.select("sequence_id", F.transform("p", lambda x: x["doc_id"]).alias("doc_ids"), joined.alias("ids"))
