import hashlib
import math
import random
import re
from collections import Counter

import duckdb
import pytest
from cases import docs, empty, rows
from pyspark.sql import functions as F

from quayside.llm import common, mixing, queries


def brute(texts, weights=(3, 1, 2), share=1.5, most=2, seed=17):
    """[(doc_id, size, source_size, target, taken)] of (doc_id, text, source), by the rule, in memory."""
    size = [len(re.findall("[^\x20\x09-\x0D]+", t or "")) for _, t, _ in texts]
    names = sorted({s for *_, s in texts if s is not None}) + [None] * any(s is None for *_, s in texts)
    total = {s: sum(n for n, (*_, o) in zip(size, texts) if o == s) for s in names}
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, left, goal = {}, set(names), share * sum(total.values())
    while left:
        each = {s: goal * weight[s] / sum(weight[x] for x in left) for s in left}
        full = {s for s in left if each[s] >= most * total[s]}
        if not full:
            target |= each
            break
        target |= {s: float(most * total[s]) for s in full}
        goal -= sum(most * total[s] for s in full)
        left -= full
    out = []
    for s in names:
        own = []
        for n, (i, t, o) in zip(size, texts):
            if o == s:
                u = (int(hashlib.md5(f"{seed}:{'null' if i is None else i}".encode()).hexdigest()[:12], 16) + 0.5) / 2**48
                q = max(0.1, 1 - abs(len(t or "") / max(n, 1) - 6) / 10)
                own.append((-math.log(u) / q, -1 if i is None else i, n))
        rest = math.floor(target[s]) - (epochs := math.floor(target[s]) // total[s] if total[s] else 0) * total[s]
        for _, i, n in sorted(own):
            part = max(0, min(n, rest))
            rest -= part
            out.append((None if i < 0 else i, n, total[s], target[s], epochs * n + part))
    return out


def near(got, want):
    key = lambda r: tuple(-1 if x is None else x for x in r)
    got, want = sorted(map(tuple, got), key=key), sorted(want, key=key)
    assert [(*a[:3], a[4]) for a in got] == [(*b[:3], b[4]) for b in want]
    assert all(a[3] == pytest.approx(b[3], abs=1e-6) for a, b in zip(got, want))


@pytest.mark.parametrize("rows_a_range", [100_000, 1])
def test_by_brute_force(spark, rows_a_range):
    rng = random.Random(1)
    some = [(i, " ".join("x" * rng.randint(1, 30) for _ in range(rng.randint(0, 60))), None, rng.choice(["a", "a", "a", "b", "ä", "\U0001f600", None])) for i in range(300)]
    near(mixing.mix(docs(spark, some), rows_a_range=rows_a_range).collect(), brute([(i, t, s) for i, t, _, s in some]))


def test_edges(spark):
    """Nulls anywhere, repeated rows, very long texts, clashing columns, an empty table."""
    near(mixing.mix(docs(spark)).collect(), brute([(r[0], r[1], r[3]) for r in rows()]))
    assert mixing.mix(empty(spark)).count() == 0 and mixing.apply_mix(empty(spark)).count() == 0
    nothing = docs(spark, [(1, None, None, "a"), (2, " ", None, "b")])
    assert {tuple(r) for r in mixing.mix(nothing).collect()} == {(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)} and mixing.apply_mix(nothing).count() == 0


def test_rows_of_one_id_are_taken_one_by_one(spark):
    some = [(None, f"word{i} " * 10, "en", "a") for i in range(40)] + [(5, "same text here", "en", "b")] * 30
    df = docs(spark, some)
    out = mixing.apply_mix(df)
    assert out.columns == df.columns
    got = Counter(len(r["text"].split()) for r in out.collect())
    taken = Counter()
    for r in mixing.mix(df).collect():
        taken[r["size"]] += r["taken"]
    assert abs(10 * got[10] - taken[10]) <= 5 and abs(3 * got[3] - taken[3]) <= 2
    again = mixing.apply_mix(df)
    assert again.exceptAll(out).isEmpty() and out.exceptAll(again).isEmpty()


def test_hot_ranges(spark):
    """Of one source with documents of every weight no key range holds much more than its share."""
    for q in (0.1, 0.3, 0.6, 1.0):
        keys = spark.range(100_000).select((-F.log(mixing.uniform(F.col("id"), 17)) / F.lit(q)).alias("k"))
        ranges = keys.select("k", mixing.range_of(F.col("k"), 256).alias("r"))
        assert ranges.groupBy("r").count().agg(F.max("count")).first()[0] < 0.02 * 100_000
        spans = ranges.groupBy("r").agg(F.min("k").alias("a"), F.max("k").alias("b")).orderBy("r").collect()
        assert all(x["b"] <= y["a"] for x, y in zip(spans, spans[1:]))  # in the order of the keys


def test_sql_agrees(spark, sf):
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
        want = db.execute(queries.ORACLE_SQL["op9_mix_sources"]).fetchall()
    near([r[:5] for r in queries.op9_mix_sources(spark, sf).select("doc_id", "size", "source_size", "target", "taken").collect()], want)


def test_numbered(spark):
    df = spark.createDataFrame([(i % 7, i) for i in range(100)] + [(None, None)], "k int, n int")
    got = common.numbered(df.repartition(5), [F.col("k").asc_nulls_last(), F.col("n")], {"s": "n"}).orderBy("__rank").collect()
    want = sorted(((i % 7, i) for i in range(100)))
    assert [r["__rank"] for r in got] == list(range(101)) and [(r["k"], r["n"]) for r in got[:-1]] == want and got[-1]["k"] is None
    assert [r["s"] for r in got[:-1]] == [sum(n for _, n in want[: i + 1]) for i in range(100)]


def test_stash(spark):
    df = spark.createDataFrame([(1, None), (None, "x")], "a int, b string")
    back = common.stash(df)
    assert back.schema == df.schema and back.exceptAll(df).isEmpty() and back.count() == 2
