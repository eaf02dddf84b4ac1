"""Exact top-k search by inner product: MaxScore over the postings of shards, merged by query.

Terms are the components of a vector; a term's posting list in a shard holds its component of every candidate there. A
term's score q * v is taken relative to its least value in the shard, so that it adds between 0 and a bound. Terms are
split by these bounds: the non-essential ones are those of the smallest bounds that together stay below the threshold,
the k-th best score known so far. The essential lists are walked, and the other terms are probed in turn, the largest
bound first, only for candidates that are still competitive: what they have so far and the most that is left (the
terms' bounds, or the product of the norms of what is left of query and candidate, if that is less) reach the threshold.

A shard is walked in blocks, each with its own bounds, and the threshold rises from block to block. A query's k-th best of
the first shard goes with it to all others, which give only scores that reach it. Queries come in blocks, so a task holds one block and one shard, both of bounded size; blocks are large, as
each shard is copied once a block. Each task gives at most k rows a query, which are merged by query.

Edge cases: a vector that is null, empty, or holds a null or non-finite component takes no part, nor does a row with a
null vec_id; vectors of other lengths are filled up with zeros; rows that repeat a vec_id are each a candidate, and of
queries the least such vector asks; a query's own vec_id is never its candidate; equal scores go to the smaller vec_id,
equal rows in any order; other columns are ignored; empty tables give no rows. Components are exact up to 2^57, scores up
to 2^62.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quayside.llm.common import stash

STRIDE = 8  #: terms that are probed between two looks at who is still competitive


def quantized(vectors: DataFrame, scale: int = 64) -> DataFrame:
    """(vec_id, v): floor(scale * x) of each component x as double, as longs; only rows that take part."""
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("bigint"))
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == F.lit(float("inf"))))
    rows = vectors.select("vec_id", "embedding").where(F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & ~bad)
    return rows.select("vec_id", whole.alias("v"))


def matrix(vectors: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width), dtype=np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def kind_of(a: np.ndarray, b: np.ndarray) -> type:
    """A type in which all sums of a @ b.T are exact: floats where no sum can leave their whole numbers, else int64."""
    reach = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    return np.float32 if reach < 2**22 else np.float64 if reach < 2**51 else np.int64


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Indices of the k highest scores, ties to the smaller id, in order."""
    if len(scores) > k:
        floor = np.partition(scores, len(scores) - k)[len(scores) - k]
        keep = np.flatnonzero(scores >= floor)
        return keep[np.lexsort((ids[keep], -scores[keep]))[:k]]
    return np.lexsort((ids, -scores))


class Postings:
    """The posting lists of a block of candidates, with what bounds them."""

    def __init__(self, v: np.ndarray, ids: np.ndarray, kind: type = np.int64) -> None:
        self.ids, self.lists = ids, np.ascontiguousarray(v.T.astype(kind))
        self.low, self.high = v.min(axis=0), v.max(axis=0)
        self.norms = (v.astype(np.float64) ** 2).sum(axis=1)
        self.walked = self.probed = 0  #: postings read

    def search(self, q: np.ndarray, own: int, theta: int | None) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the candidates that reach theta, all if that is not known."""
        least = np.where(q >= 0, q * self.low, q * self.high)
        bound = np.where(q >= 0, q * self.high, q * self.low) - least
        order = np.argsort(-bound, kind="stable")
        left = bound[order][::-1].cumsum()[::-1]  # the most that the terms from each place on can add
        need = 0 if theta is None else max(theta - int(least.sum()), 0)
        essential = int(np.count_nonzero(left >= need))
        terms = q.astype(self.lists.dtype)
        sums = terms[order[:essential]] @ self.lists[order[:essential]] + least[order[essential:]].sum().astype(self.lists.dtype)
        self.walked += essential * len(sums)
        live = np.flatnonzero(self.ids != own)
        sums = sums[live]
        if essential < len(q):
            walked = self.lists[order[:essential]]
            rest = np.maximum(self.norms - np.einsum("ij,ij->j", walked, walked, dtype=np.float64), 0.0)[live]
            norms = np.sqrt((q[order].astype(np.float64)[::-1] ** 2).cumsum()[::-1])
            ahead = least[order][::-1].cumsum()[::-1]
            for place in range(essential, len(q), STRIDE):
                product = norms[place] * np.sqrt(rest)
                slack = 1 + 1e-9 * (abs(float(theta)) + abs(float(ahead[place])) + product)
                keep = (sums >= theta - left[place]) & (sums - float(ahead[place]) + product + slack >= theta)
                live, sums, rest = live[keep], sums[keep], rest[keep]
                if not len(live):
                    break
                some = order[place : place + STRIDE]
                x = self.lists[some[:, None], live]
                sums = sums + (terms[some] @ x - least[some].sum().astype(terms.dtype))
                rest = np.maximum(rest - np.einsum("ij,ij->j", x, x, dtype=np.float64), 0.0)
                self.probed += x.size
        if theta is not None:
            reach = sums >= theta
            live, sums = live[reach], sums[reach]
        return self.ids[live], sums.astype(np.int64)


class Shard:
    """Blocks of postings. The first one is small, as it is walked without a threshold where none is carried in."""

    def __init__(self, v: np.ndarray, ids: np.ndarray, first: int = 512, size: int = 8192, kind: type = np.int64) -> None:
        ends = [0, *range(min(first, len(v)), len(v), size), len(v)]
        self.blocks = [Postings(v[a:b], ids[a:b], kind) for a, b in zip(ends, ends[1:], strict=False) if a < b]

    def search(self, q: np.ndarray, own: int, k: int, theta: int | None) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the k best for one query, of those that reach theta; it rises from block to block."""
        ids, scores = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        for block in self.blocks:
            more = block.search(q, own, theta)
            ids, scores = np.concatenate([ids, more[0]]), np.concatenate([scores, more[1]])
            top = best(scores, ids, k)
            ids, scores = ids[top], scores[top]
            if len(top) == k:
                theta = int(scores[-1])
        return ids, scores


def rows_of(queries: DataFrame, shards: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, score): the k best of each shard for each query of the blocks that meet it."""

    def search(qs: pd.DataFrame, cs: pd.DataFrame) -> pd.DataFrame:
        got: list[pd.DataFrame] = []
        if len(qs) and len(cs):
            width = max(qs["q"].map(len).max(), cs["v"].map(len).max())
            q, v, carried = matrix(qs["q"], width), matrix(cs["v"], width), qs["theta"].notna().any()
            shard = Shard(v, cs["vec_id"].to_numpy(), len(v) if carried else 512, kind=kind_of(q, v))
            for row, own, theta in zip(q, qs["asked"].tolist(), qs["theta"].tolist(), strict=True):
                ids, scores = shard.search(row, own, k, None if pd.isna(theta) else int(theta))
                got.append(pd.DataFrame({"query_id": own, "vec_id": ids, "score": scores}))
        return pd.concat(got) if got else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")

    return queries.groupBy("b", "s").cogroup(shards.groupBy("b", "s")).applyInPandas(search, "query_id bigint, vec_id bigint, score bigint")


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 20, *, block: int = 8192, shard: int = 8192) -> DataFrame:
    """(query_id, rank, vec_id, score) from (vec_id, v) of both sides."""
    asked = queries.groupBy(F.col("vec_id").alias("asked")).agg(F.min("v").alias("q"))
    n_q, n_c = asked.count(), candidates.count()
    blocks, shards = -(-n_q // block) or 1, -(-n_c // shard) or 1

    def each(first: int, n: int) -> Column:
        return F.explode(F.sequence(F.lit(first), F.lit(n - 1)))

    left = asked.select("asked", "q", F.pmod(F.xxhash64("asked"), F.lit(blocks)).cast("int").alias("b"))
    right = candidates.select("vec_id", "v", F.pmod(F.xxhash64("vec_id", "v"), F.lit(shards)).cast("int").alias("s")).withColumn("b", each(0, blocks))
    found = stash(rows_of(left.withColumn("theta", F.lit(None).cast("string")).withColumn("s", F.lit(0)), right.where("s = 0"), k))
    if shards > 1:
        known = found.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").cast("string").alias("theta")).where(F.col("n") == k)
        carried = left.join(known, F.col("asked") == F.col("query_id"), "left").select("asked", "q", "b", "theta").withColumn("s", each(1, shards))
        found = found.unionByName(rows_of(carried, right.where("s > 0"), k))
    order = [F.col("score").desc(), F.col("vec_id")]
    w = Window.partitionBy("query_id").orderBy(*order)
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
