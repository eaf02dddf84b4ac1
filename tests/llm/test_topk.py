import math
import random

import numpy as np
import pytest

from quayside.llm import topk


def brute(rows, k, every):
    ok = [(i, [math.floor(64 * float(np.float32(x))) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for q, a in ok:
        if q % every == 0:
            s = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in ok if i != q)[:k]
            out |= {(q, n + 1, i, -x) for n, (x, i) in enumerate(s)}
    return out


@pytest.mark.parametrize("block,shard", [(2048, 8192), (3, 40)])
def test_by_brute_force(spark, block, shard):
    rng = random.Random(block)
    rows = [(i, [rng.choice([0.0, 0.5, -0.25, rng.gauss(0, 1)]) for _ in range(6)]) for i in range(150)]
    rows += [(150, None), (160, [1.0, None]), (170, [float("nan")] * 6), (180, [float("inf")] * 6), (190, []), (None, [1.0] * 6), (200, [3.0]), (210, [0.0] * 6)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id bigint, embedding array<float>, rank int, score int")
    v = topk.quantized(df)
    got = topk.top_k(v.where("vec_id % 10 = 0"), v, 7, block=block, shard=shard).collect()
    assert {tuple(r) for r in got} == brute(rows, 7, 10) and len(got) == len(brute(rows, 7, 10))


@pytest.mark.parametrize("first,size", [(512, 2048), (64, 100), (3000, 1)])
@pytest.mark.parametrize("scale", [1, 10**4, 10**7])
def test_maxscore_is_exact(scale, first, size):
    rng = np.random.default_rng(1)
    v, ids = np.floor(8 * rng.normal(0, 1, (3000, 12))).astype(np.int64) * scale, rng.permutation(3000)
    shard = topk.Shard(v, ids, first, size, topk.kind_of(v, v))
    for at in range(30):
        near, scores = shard.search(v[at], ids[at], 20, None)
        s = v @ v[at]
        want = [j for j in np.lexsort((ids, -s)) if j != at][:20]
        assert near.tolist() == ids[want].tolist() and scores.tolist() == s[want].tolist()
        again, _ = shard.search(v[at], ids[at], 20, int(s[want][9]))
        assert again[:10].tolist() == ids[want][:10].tolist()


def test_walks_and_probes_few_postings(spark):
    """On the dense vectors of the table: few lists are walked, and most candidates are given up before their last terms."""
    rows = topk.quantized(spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")).orderBy("vec_id").toPandas()
    v, ids = topk.matrix(rows["v"], 64), rows["vec_id"].to_numpy()
    shard = topk.Shard(v, ids, kind=topk.kind_of(v, v))
    for at in range(0, 2000, 20):
        shard.search(v[at], ids[at], 20, None)
    later = shard.blocks[1:]
    every = 100 * 64 * sum(len(b.ids) for b in later)
    assert sum(b.walked for b in later) < 0.3 * every and sum(b.walked + b.probed for b in later) < 0.6 * every


def test_sql_agrees(spark):
    import duckdb

    from quayside.llm import queries

    got = {tuple(r) for r in queries.op10_exact_top_k(spark, "/root/testdata/sf0.001").select("query_id", "rank", "vec_id", "score").collect()}
    with duckdb.connect() as db:
        db.execute("CREATE VIEW embeddings AS SELECT * FROM '/root/testdata/sf0.001/embeddings.parquet'")
        assert set(db.execute(queries.ORACLE_SQL["op10_exact_top_k"]).fetchall()) == got


def test_edges(spark):
    empty = topk.quantized(spark.createDataFrame([], "vec_id bigint, embedding array<float>"))
    assert topk.top_k(empty, empty, 5).count() == 0
    twice = topk.quantized(spark.createDataFrame([(0, [1.0]), (0, [1.0]), (1, [1.0]), (1, [1.0])], "vec_id bigint, embedding array<float>"))
    assert [tuple(r) for r in topk.top_k(twice.where("vec_id = 0"), twice, 5).collect()] == [(0, 1, 1, 4096), (0, 2, 1, 4096)]
