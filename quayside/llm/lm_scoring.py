"""LM scoring by masked pseudo-likelihood: every token is predicted from the tokens on both sides.

A token is a run of letters, digits or underscores, in lower case. A network with a window of three tokens on each side
predicts each token in two steps: its class, then its word in the class. The 4096 most frequent words are in classes of 128
words with like endings, in which the network predicts the word as well. All other words are in classes by a hash of
their last two characters; a word in such a class has the probability of its count in the corpus. The counts of all words
stay a table: the most frequent ones are sent to the tasks, a number of fixed bound, the rest is joined to the tokens that
need it, so no count is cut off, however large the corpus. The score of a text is the sum of the log-probabilities of all
its tokens, each given its neighbours. n_once counts its tokens that occur nowhere else in the corpus.

Texts are cut into tokens once: pieces of the table of a bounded size are kept with the words of each and its tokens as
numbers of those words. Counts come from the pieces' words, and a piece's words, not its tokens, are looked up among all.

The network, in numpy, is trained on every token of the corpus once. Documents are dealt by a hash of id and text to shards
of a bounded number of tokens, and shards to rounds. In a round each shard starts from the same weights, in the order of
the hashes; weights are averaged by the number of tokens, as whole numbers, so the scores don't depend on how the input is
split into tasks, nor on which of them run again (but for the last bits of a float's sum). The number of shards grows with
the corpus; what comes to the driver is one set of weights a round.

Edge cases: a text that is null or has no token has 0 tokens, the sum 0 and a null mean; a corpus without tokens leaves the
first weights; a null doc_id stays null; rows that repeat are scored one by one; other columns are ignored; an empty table
gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quayside.llm.common import stash

TOKEN = re.compile(r"\w+")
WORDLY = np.fromiter((chr(i).isalnum() or chr(i) == "_" for i in range(1 << 16)), dtype=bool, count=1 << 16)  #: \w, by code unit
LOWER = bytes(range(256)).lower()
OTHERS = bytes(i for i in range(128) if not WORDLY[i])
INSIDE = bytes(i > 127 or bool(WORDLY[i]) for i in range(256))  #: which bytes are of words
PIECE = 1 << 20  #: bytes of the texts of a piece, about
CLASSES, EACH, TAILS = 32, 128, 32  #: classes of frequent words, words in each, classes of all other words
KNOWN = (1 << 16) - TAILS  #: most frequent words, whose counts the tasks have; a token's number fits in 16 bits
OWN, OUT = CLASSES * EACH, CLASSES + TAILS
ALONE = 64  #: words that the network sees as themselves; others it sees as their class
EDGE = ALONE + OUT  #: what stands before and after a text
OFFSETS, WIDTH = (-3, -2, -1, 1, 2, 3), 16
MARGIN = 3
BLOCK = 1024  #: rows of a batch that pass through a layer at once
LN2 = float(np.log(2))
HIGH = 80  #: most of a logit whose exponential is taken as it is
UNIT = 1 << 30  #: to a whole number of a logarithm
STEP = 1 << 24  #: to a whole number of a weight
SHARD = 4_000_000  #: tokens of a shard, about
SHAPES = ((len(OFFSETS), EDGE + 1, WIDTH), (WIDTH,), (WIDTH, OUT), (OUT,), (CLASSES, WIDTH, EACH), (CLASSES, EACH))


def tokens(text: str | None) -> list[str]:
    return TOKEN.findall(text.lower()) if text else []


def tail_of(word: str) -> int:
    return zlib.crc32(word[-2:].encode("utf-8", "surrogatepass")) % TAILS


def plain(text: str | None) -> bytes:
    """text as UTF-8 where nothing but ASCII stands between its tokens; only ASCII letters may still be upper case."""
    if not text or text.isascii():
        return text.encode() if text else b""
    text = text.lower()
    units = text.encode("utf-16-le")
    if len(units) > 2 * len(text):
        return " ".join(TOKEN.findall(text)).encode()
    found = np.frombuffer(units, dtype="<u2")
    return np.where(WORDLY[found], found, np.uint16(32)).astype("<u2", copy=False).tobytes().decode("utf-16-le").encode()


def cut(texts: list[str | None]) -> tuple[pa.DictionaryArray, np.ndarray]:
    """All tokens of texts, one after another, and the number of each text's. They are those of tokens()."""
    parts = [plain(t) for t in texts]
    line = b"\n".join([b"", *parts, b""])
    inside = np.frombuffer(line.translate(INSIDE), dtype=bool)
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    starts = edges[::2]
    ends = np.cumsum(edges[1::2] - starts)
    at = np.cumsum([0, *[len(x) + 1 for x in parts]])
    kept = [pa.py_buffer(np.r_[0, ends].astype(np.int64)), pa.py_buffer(line.translate(LOWER, OTHERS))]
    found = pa.Array.from_buffers(pa.large_string(), len(starts), [None, *kept])
    return found.dictionary_encode(), np.diff(np.searchsorted(starts, at))


class Words:
    """The number of a word: its rank if it is known, else KNOWN and its class. By number: classes and log-probabilities."""

    def __init__(self, known: list[tuple[str, int]], tails: dict[int, int]) -> None:
        """known: words and counts, most frequent first; tails: of each class by ending, the count of all its words."""
        self.known = {w: i for i, (w, _) in enumerate(known)}
        n = np.array([c for _, c in known], dtype=np.float64)
        out = np.r_[[tail_of(w) + CLASSES for w, _ in known], np.arange(TAILS) + CLASSES].astype(np.int64)
        own = min(OWN, len(known))
        by_ending = np.argsort(np.array([w[::-1] for w, _ in known[:own]], dtype=object), kind="stable")
        left = np.array([tails.get(t, 0) for t in range(TAILS)], dtype=np.float64)
        np.subtract.at(left, out[:own] - CLASSES, n[:own])
        self.slot, place = np.full(len(out), -1, dtype=np.int16), np.arange(own)
        out[by_ending], self.slot[by_ending] = place * CLASSES // max(own, 1), place - -(-(place * CLASSES // max(own, 1)) * own // CLASSES)
        self.out = out.astype(np.uint8)
        self.seen = np.where(np.arange(len(out)) < min(ALONE, own), np.arange(len(out)), ALONE + out).astype(np.uint8)
        self.inside = np.zeros(len(out))  # in classes by ending: the word's part of the class, for unknown ones without their count
        total = np.maximum(left, 1)[out[own:] - CLASSES]
        self.inside[own:] = np.log(np.r_[n[own:], np.ones(TAILS)] / total)
        counts = np.r_[np.bincount(out[:own], n[:own], CLASSES)[:CLASSES], left] + 1
        self.prior = np.log(counts / counts.sum())
        words = np.full((CLASSES, EACH), -30.0)  # places without a word
        words[out[:own], self.slot[:own]] = np.log(n[:own])
        self.word_prior = words - np.log(np.exp(words).sum(axis=1, keepdims=True))

    def __getitem__(self, word: str) -> int:
        i = self.known.get(word)
        return len(self.known) + tail_of(word) if i is None else i

    def numbers(self, words: pa.Array, names: pa.Array) -> np.ndarray:
        """The numbers of many words; names: those that are known, in order."""
        found = pc.fill_null(pc.index_in(words, value_set=names), -1).to_numpy(zero_copy_only=False)
        ends = pc.utf8_slice_codeunits(words, -2).dictionary_encode()
        tails = np.array([tail_of(x) for x in ends.dictionary.to_pylist()], dtype=np.int64)
        return np.where(found < 0, len(names) + tails[ends.indices.to_numpy()], found).astype("<u2")


class Network:
    def __init__(self, weights: list[np.ndarray]) -> None:
        self.w = [np.array(x, dtype=np.float32) for x in weights]
        self.squares = [np.full(x.shape, 1e-6, dtype=np.float32) for x in self.w]

    @classmethod
    def first(cls, words: Words, seed: int = 7) -> Network:
        rng = np.random.default_rng(seed)
        return cls([rng.normal(0, 0.1, SHAPES[0]), np.zeros(SHAPES[1]), rng.normal(0, 0.1, SHAPES[2]), words.prior, rng.normal(0, 0.1, SHAPES[4]), words.word_prior])

    @classmethod
    def of(cls, flat: np.ndarray) -> Network:
        return cls([x.reshape(s) for x, s in zip(np.split(flat, np.cumsum([np.prod(s) for s in SHAPES])[:-1]), SHAPES, strict=True)])

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in self.w]).astype(np.float64)

    def hidden(self, around: np.ndarray) -> np.ndarray:
        h = np.take(self.w[0][0] + self.w[1], around[:, 0], axis=0)
        more = np.empty_like(h)
        for i in range(1, len(OFFSETS)):
            h += np.take(self.w[0][i], around[:, i], axis=0, out=more, mode="clip")
        return np.tanh(h, out=h)

    def layers(self, out: np.ndarray) -> Iterator[tuple[int | None, slice, Softmax]]:
        """The classes for all rows, then each class of frequent words for its own; out is in order. Rows come in blocks
        that stay in a core's cache."""
        ends = [0, *np.searchsorted(out, np.arange(1, CLASSES + 1)).tolist()]
        space, firsts = np.empty(BLOCK * max(OUT, EACH), dtype=self.w[2].dtype), [np.arange(BLOCK) * n for n in (OUT, EACH)]
        high = np.abs(self.w[4]).sum(axis=1).max(axis=1) + np.abs(self.w[5]).max(axis=1)
        factors = np.exp(np.minimum(self.w[5], HIGH))
        whole = Softmax(self.w[2], self.w[3], np.exp(np.minimum(self.w[3], HIGH)), np.abs(self.w[2]).sum(axis=0).max() + np.abs(self.w[3]).max() > HIGH, space, firsts[0])
        for i in range(0, len(out), BLOCK):
            yield None, slice(i, i + BLOCK), whole
        for k, (a, z) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
            if a < z:
                layer = Softmax(self.w[4][k], self.w[5][k], factors[k], high[k] > HIGH, space, firsts[1])
                for i in range(a, z, BLOCK):
                    yield k, slice(i, min(i + BLOCK, z)), layer

    def score(self, around: np.ndarray, out: np.ndarray, slot: np.ndarray) -> np.ndarray:
        """Log-probabilities of the classes, and of the words in those of frequent words."""
        order, around, out, slot = ordered(around, out, slot)
        h = self.hidden(around)
        p, back = np.zeros(len(out)), np.empty(len(out))
        for k, rows, layer in self.layers(out):
            _, at, sums = layer.exponentials(h[rows], (out if k is None else slot)[rows])
            p[rows] += at - np.log(sums)
        back[order] = p
        return back

    def step(self, around: np.ndarray, out: np.ndarray, slot: np.ndarray, rate: float = 0.1) -> None:
        """One step of Adagrad along the mean gradient of a batch."""
        _, around, out, slot = ordered(around, out, slot)
        h = self.hidden(around)
        gh = np.zeros_like(h)
        g, gw = [np.zeros(x, dtype=np.float32) for x in SHAPES[2:4]], [np.zeros(x, dtype=np.float32) for x in SHAPES[4:]]
        for k, rows, layer in self.layers(out):
            to_w, to_c, to_h = layer.gradient(h[rows], (out if k is None else slot)[rows])
            for x, d in zip(g if k is None else (gw[0][k], gw[1][k]), (to_w, to_c), strict=True):
                x += d
            gh[rows] += to_h
        gh *= 1 - h * h
        ge = np.zeros(SHAPES[0], dtype=np.float32)
        pairs = gh.view(np.result_type(gh.dtype, np.complex64))  # two numbers are added as one
        for i in range(len(OFFSETS)):
            ids = around[:, i]
            order = np.argsort(ids, kind="stable")
            own = ids[order]
            at = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            ge[i][own[at]] = np.add.reduceat(np.take(pairs, order, axis=0), at, axis=0).view(gh.dtype)
        scale = np.float32(1 / len(gh))
        for x, s, d in zip(self.w, self.squares, (ge, gh.sum(axis=0), *g, *gw), strict=True):
            d *= scale
            s += d * d
            d *= np.float32(rate)
            d /= np.sqrt(s)
            x -= d

    def learn(self, rows: tuple[np.ndarray, np.ndarray, np.ndarray], batch: int) -> int:
        """Steps along all rows once, in an order of their own."""
        order = np.random.default_rng(len(rows[1])).permutation(len(rows[1]))
        for i in range(0, len(order), batch):
            some = order[i : i + batch]
            self.step(*taken(some[np.argsort(rows[1][some], kind="stable")], *rows))
        return len(order)


class Softmax:
    """One layer. Its biases are not added to the logits of a block; their exponentials are factors of what is narrow."""

    def __init__(self, w: np.ndarray, c: np.ndarray, factors: np.ndarray, high: bool, space: np.ndarray, firsts: np.ndarray) -> None:
        """factors: exp(c); high: an exponential could leave the floats; space: where blocks of logits are put; firsts: where
        a block's rows begin there."""
        self.w, self.c, self.high, self.space, self.firsts = w, c, high, space, firsts
        self.twos = w * w.dtype.type(1 / LN2)  # for powers of two, which numpy makes in half the time
        self.factors = np.ones_like(factors) if high else factors

    def exponentials(self, h: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The exponentials of the logits without their biases, the logit in each row's own column, and the sum of all
        exponentials; if high, with the biases and less the row's highest logit."""
        n = self.w.shape[1]
        z = np.matmul(h, self.twos, out=self.space[: len(h) * n].reshape(len(h), n))
        if self.high:
            z += self.c * self.c.dtype.type(1 / LN2)
            z -= z.max(axis=1, keepdims=True)
        at = z.reshape(-1)[self.firsts[: len(own)] + own]
        at *= LN2
        if not self.high:
            at += self.c[own]
        np.exp2(z, out=z)
        return z, at, z @ self.factors

    def gradient(self, h: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of minus the log-probabilities: to the weights, the biases and the hidden units. With d as the probabilities less
        1 in the own column they are h.T @ d, its sums and d @ w.T; d itself is not made, as its factors are of rows and
        columns."""
        z, _, sums = self.exponentials(h, own)
        flat, at = z.reshape(-1), self.firsts[: len(own)] + own
        flat[at] -= sums / self.factors[own]
        parts = 1 / sums
        wide = parts[:, None] @ np.ones((1, WIDTH), dtype=z.dtype)
        to_h = z @ np.ascontiguousarray((self.w * self.factors).T)
        to_h *= wide
        wide *= h
        return (wide.T @ z) * self.factors, (parts @ z) * self.factors, to_h


def taken(some: np.ndarray, around: np.ndarray, out: np.ndarray, slot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.array([x[some] for x in around.T]).T, out[some], slot[some]


def ordered(around: np.ndarray, out: np.ndarray, slot: np.ndarray) -> tuple[np.ndarray | slice, np.ndarray, np.ndarray, np.ndarray]:
    """The rows by class, and what order that is."""
    if (out[1:] >= out[:-1]).all():
        return slice(None), around, out, slot
    order = np.argsort(out, kind="stable")
    return order, *taken(order, around, out, slot)


def seen_from(words: Words, ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the tokens of texts that end at ends: what is around each, its class and its place there."""
    n = np.diff(np.r_[0, ends])
    at = np.arange(len(ids)) + MARGIN * (1 + np.repeat(np.arange(len(n)), n))
    line = np.full(len(ids) + MARGIN * (len(n) + 1), EDGE, dtype=np.uint8)
    line[at] = np.take(words.seen, ids)
    around = np.empty((len(OFFSETS), len(ids)), dtype=np.uint8)
    for i, o in enumerate(OFFSETS):
        around[i] = np.take(line, at + o)
    return around.T, np.take(words.out, ids), np.take(words.slot, ids)


def runs(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Rows in a row whose sizes come to about most, from and to."""
    run = (np.cumsum(sizes, dtype=np.int64) - sizes) // most
    cuts = [*np.flatnonzero(np.diff(run, prepend=-1)).tolist(), len(sizes)]
    yield from zip(cuts[:-1], cuts[1:], strict=True)


def pieces(docs: DataFrame) -> DataFrame:
    """(doc_id, place, n, ids, words, sizes, tally): documents of about PIECE bytes in a row, as lists of their ids, of
    hashes of their rows and of their numbers of tokens; ids are the numbers of all their tokens among the piece's words, of
    16 bits each where there are no more words than that, else of 32; the words lie one after another with their sizes in
    bytes and their counts."""
    rows = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("place"), "text")

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = pc.fill_null(pc.binary_length(b.column("text")), 0).to_numpy(zero_copy_only=False)
            for a, z in runs(sizes, PIECE):
                found, n = cut(b.column("text").slice(a, z - a).to_pylist())
                ids, words = found.indices.to_numpy(), found.dictionary
                ends = np.frombuffer(words.buffers()[1], dtype=np.int64, count=len(words) + 1) if len(words) else np.zeros(1, dtype=np.int64)
                kept = words.buffers()[2].to_pybytes()[: ends[-1]] if len(words) else b""
                blobs = [ids.astype("<u2" if len(words) <= 1 << 16 else "<i4").tobytes(), kept, np.diff(ends).astype("<i4").tobytes(), np.bincount(ids, minlength=len(words)).astype("<i4").tobytes()]
                lists = [pa.ListArray.from_arrays(pa.array([0, z - a], pa.int32()), x) for x in (b.column("doc_id").slice(a, z - a), b.column("place").slice(a, z - a), pa.array(n, pa.int64()))]
                yield pa.RecordBatch.from_arrays([*lists, *[pa.array([x], pa.binary()) for x in blobs]], names=["doc_id", "place", "n", "ids", "words", "sizes", "tally"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    options = {"parquet.page.size.row.check.min": "1", "compression": "zstd"}  # rows are large: Parquet looks at its buffers after each
    return stash(rows.mapInArrow(cut_up, f"doc_id array<{kind}>, place array<bigint>, n array<bigint>, ids binary, words binary, sizes binary, tally binary"), options)


def words_in(b: pa.RecordBatch, row: int) -> pa.Array:
    """The words of a piece."""
    ends = np.r_[0, np.cumsum(np.frombuffer(b.column("sizes")[row].as_buffer(), dtype="<i4"))].astype(np.int32)
    return pa.Array.from_buffers(pa.string(), len(ends) - 1, [None, pa.py_buffer(ends), b.column("words")[row].as_buffer()])


def tallied(cuts: DataFrame) -> DataFrame:
    """(word, n): all words of all pieces."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in range(b.num_rows):
                n = np.frombuffer(b.column("tally")[row].as_buffer(), dtype="<i4")
                yield pa.RecordBatch.from_arrays([words_in(b, row), pa.array(n, pa.int64())], names=["word", "n"])

    return stash(cuts.select("words", "sizes", "tally").mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")))


def counted(docs: DataFrame) -> DataFrame:
    """(word, n): all words of all documents."""
    return tallied(pieces(docs))


def words_of(counts: DataFrame) -> Words:
    """The driver gets the most frequent words and a row for each class by ending."""
    known = [(r["word"], r["n"]) for r in counts.orderBy(F.desc("n"), "word").limit(KNOWN).collect()]
    tail = (F.crc32(F.expr("right(word, 2)").cast("binary")) % TAILS).cast("int")
    tails = counts.groupBy(tail.alias("t")).agg(F.sum("n").alias("n")).collect()
    return Words(known, {r["t"]: r["n"] for r in tails})


def numbered(cuts: DataFrame, words: Words) -> DataFrame:
    """(doc_id, place, n, ids, rare) of the documents of all pieces: place is a hash of the row; ids are the numbers of its n
    tokens, of 16 bits each; rare the words that are not known."""

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = pa.array(words.known, pa.string())
        for b in batches:
            for row in range(b.num_rows):
                lists = [b.column(k)[row].values for k in ("doc_id", "place", "n")]
                own = words_in(b, row)
                at = np.frombuffer(b.column("ids")[row].as_buffer(), dtype="<u2" if len(own) <= 1 << 16 else "<i4")
                ids = np.take(words.numbers(own, names), at)
                unknown = np.flatnonzero(ids >= len(names))
                ends = np.r_[0, np.cumsum(lists[2].to_numpy())]
                rare = pa.ListArray.from_arrays(pa.array(np.searchsorted(unknown, ends), pa.int32()), own.take(pa.array(np.take(at, unknown))))
                kept = pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer((ends * 2).astype(np.int32)), pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays([*lists, kept, rare], names=["doc_id", "place", "n", "ids", "rare"])

    kind = cuts.schema["doc_id"].dataType.elementType.simpleString()
    return stash(cuts.mapInArrow(number, f"doc_id {kind}, place bigint, n bigint, ids binary, rare array<string>"), {"compression": "zstd"})


def encoded(docs: DataFrame, words: Words) -> DataFrame:
    """The documents as numbered() has them."""
    return numbered(pieces(docs), words)


def lists_of(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The ids of a batch, and where each row's end."""
    lists = b.column("ids").to_pylist()
    return np.frombuffer(b"".join(lists), dtype="<u2"), np.cumsum([len(x) // 2 for x in lists], dtype=np.int64)


def train(rows: DataFrame, words: Words, *, rounds: int = 2, batch: int = 8192, shard: int = SHARD, chunk: int = 262_144) -> Network:
    """Rounds of training copies of a network on a part of the shards each, and averaging them."""
    now = Network.first(words)
    total = rows.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    shards = max(1, -(-total // shard))
    rounds = min(rounds, shards)
    dealt = rows.where("n > 0").select(F.pmod(F.xxhash64("place"), F.lit(shards)).cast("int").alias("shard"), "place", "ids")
    for turn in range(rounds):
        start = now.flat()

        def learn(batches: Iterator[pa.RecordBatch], start: np.ndarray = start) -> Iterator[pa.RecordBatch]:
            net, at, seen, wait, held = Network.of(start), None, 0, [], 0

            def flush() -> int:
                ids, n = np.concatenate(wait), [len(x) for x in wait]
                return net.learn(seen_from(words, ids, np.cumsum(n)), batch)

            def done() -> pa.RecordBatch:
                values = np.rint(net.flat() * STEP).astype(np.int64)
                return pa.RecordBatch.from_arrays([pa.array(np.arange(len(values)), pa.int32()), pa.array(values), pa.array([seen] * len(values), pa.int64())], names=["i", "x", "n"])

            for b in batches:
                ids, ends = lists_of(b)
                for k, a, z in zip(b.column("shard").to_pylist(), [0, *ends[:-1].tolist()], ends.tolist(), strict=True):
                    if k != at:
                        if at is not None:
                            seen += flush() if wait else 0
                            yield done()
                        net, at, seen, wait, held = Network.of(start), k, 0, [], 0
                    wait.append(ids[a:z])
                    held += z - a
                    if held >= chunk:
                        seen += flush()
                        wait, held = [], 0
            if at is not None:
                seen += flush() if wait else 0
                yield done()

        part = dealt.where(F.col("shard") % rounds == turn)
        part = part.repartitionById(-(-shards // rounds), F.floor(F.col("shard") / rounds).cast("int")).sortWithinPartitions("shard", "place")
        weighted = (F.col("x").cast("decimal(20,0)") * F.col("n").cast("decimal(12,0)")).alias("x")
        sums = part.mapInArrow(learn, "i int, x bigint, n bigint").select("i", weighted, "n").groupBy("i").agg(F.sum("x").alias("x"), F.sum("n").alias("n"))
        means = sums.select("i", (F.col("x") / F.col("n")).cast("double").alias("x")).orderBy("i").collect()
        if means:
            now = Network.of(np.array([r["x"] for r in means]) / STEP)
    return now


def score(rows: DataFrame, words: Words, net: Network, counts: DataFrame, chunk: int = 65_536) -> DataFrame:
    """(doc_id, n_tokens, pll, mean_pll, n_once)"""
    flat = net.flat()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Network.of(flat)
        for b in batches:
            sizes = pc.binary_length(b.column("ids")).to_numpy() // 2
            for start, end in runs(sizes, chunk):
                some = b.slice(start, end - start)
                ids, ends = lists_of(some)
                seen = seen_from(words, ids, ends)
                p = np.zeros(len(ids) + 1)
                for i in range(0, len(ids), chunk):
                    p[i + 1 : i + chunk + 1] = own.score(*[x[i : i + chunk] for x in seen])
                p[1:] += np.take(words.inside, ids)
                p = np.cumsum(p)
                n = sizes[start:end]
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), pa.array(n, pa.int64()), pa.array(p[ends] - p[ends - n], pa.float64()), some.column("rare")], names=["doc_id", "n_tokens", "pll", "rare"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    scored = rows.select("doc_id", "ids", "rare").mapInArrow(each, f"doc_id {kind}, n_tokens bigint, pll double, rare array<string>")
    scored = stash(scored.withColumn("__row", F.monotonically_increasing_id()))
    logs = counts.select("word", F.round(F.log("n") * UNIT).cast("bigint").alias("log"), (F.col("n") == 1).cast("bigint").alias("once"))  # whole numbers: their sums have no order
    more = scored.select("__row", F.explode("rare").alias("word")).join(logs, "word").groupBy("__row").agg(F.sum("log").alias("log"), F.sum("once").alias("once"))
    pll = F.col("pll") + F.coalesce(F.col("log"), F.lit(0)) / UNIT
    joined = scored.drop("rare").join(more, "__row", "left")
    return joined.select("doc_id", "n_tokens", pll.alias("pll"), F.when(F.col("n_tokens") > 0, pll / F.col("n_tokens")).alias("mean_pll"), F.coalesce("once", F.lit(0)).alias("n_once"))


def score_corpus(docs: DataFrame, **options) -> DataFrame:
    """The documents scored by a model of themselves."""
    cuts = pieces(docs)
    counts = tallied(cuts)
    words = words_of(counts)
    rows = numbered(cuts, words)
    return score(rows, words, train(rows, words, **options), counts)
