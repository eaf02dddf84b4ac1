"""N-gram Jaccard join: documents whose sets of word 5-grams have a Jaccard similarity of at least 0.8.

Documents with equal sets are one node. Nodes get MinHash signatures, read as the labels of a forest of prefix tries: a
label is a tree's run of hashes, and nodes that share a prefix of it are a run of the tree's sorted labels. Runs are
matched at full depth first. In a run, nodes whose sketches agree well below the threshold are linked by a spanning forest,
so neither pairs nor unrelated texts that share a prefix by chance are carried on. From the agreement of what was found
the number of pairs that were missed is estimated (each found pair stands for 1 / its chance of being found), and prefixes
are shortened to the depth that would have the target recall; that is measured again, until it is reached.

Groups of nodes linked so are verified exactly, all pairs, from whole texts. Groups are cut into blocks of bounded size
and a task takes one pair of blocks, so links between different texts are counted in full, yet neither pairs nor copies
are ever rows. A run of more nodes than fit in a task is dealt to parts, whose nodes are all linked, without sketches: a
group may become larger for it, but no link is lost. Links go to the least node of each set, the same one in most trees,
so most of them are equal and few are left.

Words are stretches without ASCII white space; a text of fewer than 5 words is one n-gram; one with no word has no link.

Edge cases: a null text has no word; rows of one doc_id are one document, linked where any of its texts is; null ids are
numbered above all others, by a hash of the text; rows that repeat are each a row of the result; other columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quayside.llm.common import stash
from quayside.llm.components import components
from quayside.llm.fingerprints import TokenHash
from quayside.llm.line_dedup import key_of

N, THRESHOLD, TREES, DEPTH, RECALL = 5, 0.8, 24, 12, 0.9999
SKETCH, SLACK = 64, 0.25  #: bytes of a sketch; how far below the threshold their agreement may be (five deviations)
RUN = 8192  #: nodes of a run that a task compares
BLOCK_ROWS, BLOCK_GRAMS = 1500, 1_500_000
LIGHT = 32  #: n-grams of up to so many texts of a block are counted by pairs, others by matrix products
_SPACE = str.maketrans("\t\n\x0b\x0c\r", "     ")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def found_at(depth: int, similarity: np.ndarray | float, trees: int = TREES) -> np.ndarray | float:
    """The chance that a pair shares a prefix of this depth in some tree."""
    return 1 - (1 - similarity**depth) ** trees


def depth_for(agreed: dict[int, int], depth: int, *, trees: int = TREES, threshold: float = THRESHOLD, recall: float = RECALL) -> int:
    """The longest prefix with the target recall, from the pairs found at a depth: their number by sketch bytes agreed."""
    if not agreed:
        return depth
    same, n = (np.array(x, dtype=np.float64) for x in zip(*agreed.items(), strict=True))
    similarity = np.clip((same / SKETCH - 1 / 256) / (1 - 1 / 256), threshold, 1)
    whole = n / found_at(depth, similarity, trees)
    while depth > 1 and (whole * found_at(depth, similarity, trees)).sum() < recall * whole.sum():
        depth -= 1
    return depth


class Grams:
    def __init__(self, n: int = N) -> None:
        self.n, self.words = n, TokenHash()

    def __call__(self, text: str | None) -> np.ndarray:
        """The sorted set of the text's word n-grams, by 64-bit hashes."""
        found = [w for w in (text or "").translate(_SPACE).split(" ") if w]
        if not found:
            return np.empty(0, dtype=np.uint64)
        t = np.fromiter(map(self.words.__getitem__, found), dtype=np.uint64, count=len(found))
        n = min(self.n, len(t))
        out = t[: len(t) - n + 1].copy()
        for i in range(1, n):
            out ^= out >> np.uint64(31)
            out *= _MIX
            out += t[i : len(t) - n + 1 + i]
        return np.unique(out)


class Forest:
    def __init__(self, trees: int, depth: int, seed: int = 11) -> None:
        rng = np.random.default_rng(seed)
        self.trees, self.depth = trees, depth
        self.xors, self.odds = (rng.integers(0, 2**32, (trees * depth, 1), dtype=np.uint32) for _ in range(2))
        self.odds |= np.uint32(1)

    def labels(self, grams: np.ndarray) -> tuple[bytes, bytes]:
        """Of all trees, one after another, 16 bits of each hash; and the sketch."""
        x = ((grams * _MIX) >> np.uint64(32)).astype(np.uint32)
        low = np.full(self.trees * self.depth, 2**32 - 1, dtype=np.uint32)
        for i in range(0, len(x), 2048):
            np.minimum(low, ((x[None, i : i + 2048] ^ self.xors) * self.odds).min(axis=1), out=low)
        low = low * np.uint32(0x9E3779B1)  # the least of many hashes have few bits in their high half
        return (low >> np.uint32(16)).astype(">u2").tobytes(), (low >> np.uint32(8)).astype(np.uint8)[:: len(low) // SKETCH or 1][:SKETCH].tobytes()


def spanning(sketches: np.ndarray, starts: np.ndarray, least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For runs of rows that begin at starts: of each connected set of rows that agree in at least so many bytes, the
    rows, and the bytes in which each agrees with the row that it was found from (the first one's own: all)."""
    ends = np.r_[starts[1:], len(sketches)]
    head = np.repeat(starts, ends - starts)
    with_head = (sketches == sketches[head]).sum(axis=1)
    near = with_head >= least
    lonely = np.add.reduceat(~near, starts)
    for start, end, others in zip(starts.tolist(), ends.tolist(), lonely.tolist(), strict=True):
        if not others:
            yield np.arange(start, end), with_head[start:end]
            continue
        left = np.arange(start, end)
        while len(left):
            rows, same, at = [left[:1]], [np.array([sketches.shape[1]])], 0
            todo, left = left[:1].tolist(), left[1:]
            while at < len(todo) and len(left):
                agree = (sketches[left] == sketches[todo[at]]).sum(axis=1)
                hit = agree >= least
                if hit.any():
                    rows.append(left[hit])
                    same.append(agree[hit])
                    todo += left[hit].tolist()
                    left = left[~hit]
                at += 1
            yield np.concatenate(rows), np.concatenate(same)


def linked(sets: list[np.ndarray], side: np.ndarray, across: bool, threshold: float) -> np.ndarray:
    """Pairs of texts (rows of two indices, first < second) with at least the threshold; across: only of different sides."""
    m, t = len(sets), Fraction(threshold).limit_denominator(10_000)
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    if m == 2:
        both = np.array([[0, len(np.intersect1d(*sets, assume_unique=True))], [0, 0]], dtype=np.int64)
    else:
        owner = np.repeat(np.arange(m), sizes)
        grams = np.concatenate(sets)
        order = np.argsort(grams, kind="stable")
        grams, owner = grams[order], owner[order]
        start = np.flatnonzero(np.r_[True, grams[1:] != grams[:-1]])
        count = np.diff(np.r_[start, len(grams)])
        of = np.repeat(np.arange(len(start)), count)
        both = np.zeros((m, m), dtype=np.int64)
        light = np.repeat(count <= LIGHT, count) & np.repeat(count > 1, count)
        o, k = owner[light], of[light]
        for gap in range(1, min(LIGHT, len(k))):
            same = k[gap:] == k[:-gap]
            if not same.any():
                break
            both += np.bincount(o[:-gap][same] * m + o[gap:][same], minlength=m * m).reshape(m, m)
        heavy = np.flatnonzero(count > LIGHT)
        column = np.full(len(start), -1)
        column[heavy] = np.arange(len(heavy))
        o, k = owner[np.repeat(count > LIGHT, count)], column[of[np.repeat(count > LIGHT, count)]]
        for i in range(0, len(heavy), 2048):
            here = (k >= i) & (k < i + 2048)
            a = np.zeros((m, min(2048, len(heavy) - i)), dtype=np.float32)
            a[o[here], k[here] - i] = 1
            both += np.rint(a @ a.T).astype(np.int64)
    union = sizes[:, None] + sizes[None, :] - both
    ok = np.triu((both * t.denominator >= union * t.numerator) & (both > 0), 1)
    if across:
        ok &= side[:, None] != side[None, :]
    return np.argwhere(ok)


def roots(ids: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """The least id that each is connected to by the pairs."""
    parent = list(range(len(ids)))

    def top(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    for a, b in pairs.tolist():
        a, b = top(a), top(b)  # noqa: PLW2901
        if a != b:
            parent[max(a, b, key=lambda i: ids[i])] = min(a, b, key=lambda i: ids[i])
    return ids[[top(i) for i in range(len(ids))]]


def sets_of(docs: DataFrame, trees: int, depth: int) -> DataFrame:
    """(d, id, a, b, n, labels, sketch) of each row: a hash of its set, the set's size and its signature."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, forest = Grams(), Forest(trees, depth)
        for batch in batches:
            out = []
            for text in batch.column("text").to_pylist():
                g = grams(text)
                h = xxhash.xxh3_128_intdigest(g.tobytes())
                out.append(((h >> 64) - 2**63, (h & 2**64 - 1) - 2**63, len(g), *(forest.labels(g) if len(g) else (None, None))))
            cols = list(zip(*out, strict=True)) or [()] * 5
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([batch.column("d"), batch.column("id"), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], names=["d", "id", "a", "b", "n", "labels", "sketch"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select(key_of(F.col("doc_id"), F.col("text")).alias("d"), F.col("doc_id").alias("id"), "text")
    return rows.mapInArrow(each, f"d bigint, id {kind}, a bigint, b bigint, n bigint, labels binary, sketch binary")


def matches(nodes: DataFrame, level: int, trees: int, depth: int, threshold: float) -> DataFrame:
    """(u, v, same): links that connect the nodes that share a prefix of this depth in a tree and whose sketches agree, u the
    least of them; same is in how many bytes, null where a run was too large to compare."""
    tree = F.explode(F.sequence(F.lit(0), F.lit(trees - 1)))
    prefix = F.expr(f"substring(labels, tree * {2 * depth} + 1, {2 * level})")
    entries = nodes.select("node", "labels", tree.alias("tree")).select("node", F.xxhash64("tree", prefix).alias("key"), F.expr(f"substring(labels, tree * {2 * depth} + {2 * level} + 1, {2 * (depth - level)})").alias("more"))
    shared = entries.groupBy("key").agg(F.min("node").alias("low"), F.count("*").alias("n")).where("n > 1")
    runs = entries.join(shared, "key").join(nodes.select("node", "sketch"), "node")
    part = F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / RUN)).cast("int")
    runs = runs.select("key", part.alias("part"), (F.col("n") > RUN).alias("large"), "low", "node", "sketch", "more")
    runs = runs.repartition("key", "part").sortWithinPartitions("key", "part", "more", "node").drop("more")
    least = int(SKETCH * (threshold - SLACK))

    def link(rows: pa.Table) -> pa.RecordBatch:
        key, part, node = (rows.column(c).to_numpy() for c in ("key", "part", "node"))
        large, low = rows.column("large").to_numpy(zero_copy_only=False), rows.column("low").to_numpy()
        starts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (part[1:] != part[:-1])])
        size = np.diff(np.r_[starts, len(key)])
        u, v, same = [], [], []
        big = np.repeat(large[starts], size)
        if big.any():  # each with the run's least node
            u.append(low[big])
            v.append(node[big])
            same.append(np.full(int(big.sum()), -1))
        if not big.all():
            small = ~large[starts]
            sketches = np.frombuffer(b"".join(rows.column("sketch").filter(pa.array(~big)).to_pylist()), dtype=np.uint8).reshape(-1, SKETCH)
            node = node[~big]
            for members, agreed in spanning(sketches, np.r_[0, size[small].cumsum()[:-1]], least):
                if len(members) > 1:
                    own = node[members]
                    least_one = own.argmin()
                    agreed[0] = agreed[least_one]  # the first row was found from none
                    others = np.delete(np.arange(len(own)), least_one)
                    u.append(np.full(len(others), own[least_one]))
                    v.append(own[others])
                    same.append(agreed[others])
        u, v, same = (np.concatenate(x) if x else np.empty(0, dtype=np.int64) for x in (u, v, same))
        return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64()), pa.array(same, pa.int32(), mask=same < 0)], names=["u", "v", "same"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wait: list[pa.Table] = []
        for b in batches:
            if not b.num_rows:
                continue
            wait.append(pa.Table.from_batches([b]))
            rows = pa.concat_tables(wait)
            last = rows.slice(rows.num_rows - 1)
            rest = int(np.count_nonzero((rows.column("key").to_numpy() == last.column("key")[0].as_py()) & (rows.column("part").to_numpy() == last.column("part")[0].as_py())))
            wait = [rows.slice(rows.num_rows - rest)]  # the last run may go on
            if rest < rows.num_rows:
                yield link(rows.slice(0, rows.num_rows - rest))
        if wait:
            yield link(pa.concat_tables(wait))

    return runs.mapInArrow(each, "u bigint, v bigint, same int")


def forest_links(nodes: DataFrame, *, trees: int, depth: int, threshold: float, recall: float) -> tuple[DataFrame, int]:
    """The links of the forest at the depth to which its prefixes had to be shortened, and that depth. Only counts by
    bytes agreed come to the driver."""
    level = depth
    while True:
        links = stash(matches(nodes, level, trees, depth, threshold).where("u <> v").groupBy("u", "v").agg(F.max("same").alias("same")))
        agreed = links.where(F.col("same") >= int(SKETCH * threshold)).groupBy("same").count().collect()
        to = depth_for({r["same"]: r["count"] for r in agreed}, level, trees=trees, threshold=threshold, recall=recall)
        if to == level:
            return links, level
        level = to


def verified(docs: DataFrame, groups: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """(node, root, links, parts): exact links of each node within its group by each task that holds it."""
    sizes = groups.join(nodes, "node").groupBy("root").agg(F.count("*").alias("m"), F.sum("n").alias("grams"))
    blocks = F.greatest(F.ceil(F.col("m") / BLOCK_ROWS), F.ceil(F.col("grams") / BLOCK_GRAMS)).cast("int")
    placed = groups.join(sizes.select("root", blocks.alias("parts")), "root")
    placed = placed.withColumn("side", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    texts = docs.select(key_of(F.col("doc_id"), F.col("text")).alias("node"), "text").where("text IS NOT NULL")
    rows = texts.join(placed, "node").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = rows.select("root", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "node", "side", "parts", "text")
    rows = rows.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams()

        def every() -> Iterator[tuple]:
            for b in batches:
                yield from zip(*[c.to_pylist() for c in b.columns], strict=True)

        for (_, i, j), group in groupby(every(), key=lambda r: r[:3]):
            found: dict[tuple[int, bytes], tuple[int, np.ndarray]] = {}
            parts = 1
            for _, _, _, node, side, parts, text in group:  # noqa: B007
                g = grams(text)
                found[node, xxhash.xxh3_128_digest(g.tobytes())] = (side, g)  # rows that repeat are one
            ids = np.array([k[0] for k in found], dtype=np.int64)
            sides, sets = np.array([v[0] for v in found.values()]), [v[1] for v in found.values()]
            if len(ids) < 2:
                continue
            pairs = linked(sets, sides, i != j, threshold)
            pairs = pairs[ids[pairs[:, 0]] != ids[pairs[:, 1]]]
            links = np.bincount(pairs.ravel(), minlength=len(ids))
            keep = links > 0
            top = roots(ids, pairs)[keep]
            yield pa.RecordBatch.from_arrays([pa.array(ids[keep]), pa.array(top), pa.array(links[keep].astype(np.int64)), pa.array([parts] * int(keep.sum()), pa.int32())], names=["node", "root", "links", "parts"])

    return rows.mapInArrow(each, "node bigint, root bigint, links bigint, parts int")


def join(docs: DataFrame, *, threshold: float = THRESHOLD, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL) -> DataFrame:
    """(doc_id, class_id, n_links, n_copies): class_id is the least id among the documents connected by links; n_links
    counts the different texts that this one is linked to, n_copies the rows with its own set."""
    rows = classes(docs, threshold, trees, depth, recall)
    return rows.select(F.col("id").alias("doc_id"), "class_id", "n_links", "n_copies")


def classes(docs: DataFrame, threshold: float = THRESHOLD, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL) -> DataFrame:
    """(d, id, a, b, class_id, n_links, n_copies)"""
    docs = docs.select("doc_id", "text")
    sets = stash(sets_of(docs, trees, depth))
    nodes = sets.where("n > 0").groupBy("a", "b").agg(F.min("d").alias("node"), F.count("*").alias("n_copies"), F.first("labels").alias("labels"), F.first("sketch").alias("sketch"), F.first("n").alias("n"))
    nodes = stash(nodes)
    links, _ = forest_links(nodes.select("node", "labels", "sketch"), trees=trees, depth=depth, threshold=threshold, recall=recall)
    groups = components(links.select("u", "v"))
    found = stash(verified(docs, groups, nodes.groupBy("node").agg(F.sum("n").alias("n")), threshold))
    links = found.groupBy("node").agg(F.sum("links").alias("n_links"), F.min("root").alias("root"))
    if not (cut := found.where("parts > 1")).isEmpty():  # what tasks found of one group meets here
        met = components(cut.select(F.col("node").alias("u"), F.col("root").alias("v"))).withColumnRenamed("root", "met")
        links = links.join(met, "node", "left").select("node", "n_links", F.coalesce("met", "root").alias("root"))
    by_set = nodes.select("a", "b", "node", "n_copies").join(links, "node", "left")
    by_set = by_set.select("a", "b", "n_copies", F.coalesce("root", "node").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    out = sets.drop("labels", "sketch", "n").join(by_set, ["a", "b"], "left")
    return out.select("d", "id", "a", "b", F.coalesce("class_id", "d").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), F.coalesce("n_copies", F.lit(1)).cast("bigint").alias("n_copies"))


def apply_join(docs: DataFrame, **options) -> DataFrame:
    """The documents with one of each class left, that of the least id; texts with no word stay. All columns are kept."""
    keep = classes(docs, **options).where("d = class_id").select(F.col("d").alias("__d")).distinct()
    rows = docs.withColumn("__key", key_of(docs["doc_id"], docs["text"])).join(keep, F.col("__key") == F.col("__d"))
    w = Window.partitionBy("__key").orderBy(F.xxhash64("text"), "text")
    return rows.withColumn("__row", F.row_number().over(w)).where("__row = 1").select(*[f"`{c}`" for c in docs.columns])
