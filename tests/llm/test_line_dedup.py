import random
from collections import Counter

import pytest
import xxhash
from cases import EN, docs, empty, prose, rows

from quayside.llm import line_dedup, queries


def cut(lines):
    """Chunks of lines by the rule itself: 2 to 16 lines, ended where the last two lines' hashes say so."""
    h = [xxhash.xxh64(x.encode()).intdigest() for x in lines]
    out = [[]]
    for i, x in enumerate(lines):
        out[-1].append(x)
        rolled = ((h[i - 1] if i else 0) * 0x9E3779B97F4A7C15 + h[i]) * 0x9E3779B97F4A7C15 % 2**64 // 2**32
        if len(out[-1]) == 16 or len(out[-1]) > 1 and rolled % 3 == 0:
            out.append([])
    return [c for c in out if c]


def in_chunks(texts):
    """{id: lines in repeated chunks, but for the first of each}"""
    every = Counter("\n".join(c) for t in texts.values() for c in cut(t.split("\n")))
    seen, out = set(), {}
    for i in sorted(texts):
        out[i], at = set(), 0
        for c in cut(texts[i].split("\n")):
            chunk = "\n".join(c)
            if len(c) > 1 and chunk.strip() and every[chunk] > 1 and chunk in seen:
                out[i] |= set(range(at, at + len(c)))
            seen.add(chunk)
            at += len(c)
    return out


def in_passages(texts):
    """{id: lines in windows of whole lines with 50 words or more that occur before and don't overlap the first}"""
    first, gone = {}, {i: set() for i in texts}
    for i in sorted(texts):
        lines = texts[i].split("\n")
        for a in range(len(lines)):
            for b in range(a + 1, len(lines) + 1):
                window = tuple(lines[a:b])
                if sum(len(x.split()) for x in window) >= 50:
                    d, end = first.setdefault(window, (i, b))
                    if d != i or end <= a:
                        gone[i].update(range(a, b))
    return gone


def without(texts, *gone):
    return {i: "\n".join(x for n, x in enumerate(t.split("\n")) if not any(n in g[i] for g in gone)) for i, t in texts.items()}


def brute(texts):
    return without(texts, in_chunks(texts), in_passages(texts))


def test_chunks_resist_shifts():
    rng = random.Random(1)
    lines = [prose(rng, EN, 6) for _ in range(400)]
    own = lambda some: {tuple(some[a:b]) for a, b in line_dedup.chunks(some)}
    base = own(lines)
    assert base == {tuple(c) for c in cut(lines)}
    assert sum(map(len, base)) == 400 and len(base & own(["new line", *lines])) > 0.97 * len(base)
    assert len(base & own(lines[:200] + ["in the middle"] + lines[200:])) > 0.95 * len(base)
    assert max(b - a for a, b in line_dedup.chunks(["same"] * 100)) <= line_dedup.MOST
    assert all(b - a > 1 for a, b in line_dedup.chunks([prose(rng, EN, n) for n in (3, 70, 70, 3, 60, 5, 80, 90)])[:-1])  # whatever their length


@pytest.mark.parametrize("seed", [1, 2])
def test_by_brute_force(spark, seed):
    rng = random.Random(seed)
    parts = ["\n".join(prose(rng, EN, rng.choice([3, 8, 60])) for _ in range(rng.randint(1, 9))) for _ in range(12)]
    texts = {i: "\n".join(rng.choice(parts) for _ in range(rng.randint(1, 5))) for i in range(60)}
    got = {r["doc_id"]: r for r in line_dedup.report(docs(spark, list(texts.items()))).collect()}
    want = without(texts, in_chunks(texts))
    assert {i: r["text"] for i, r in got.items()} == want and sum(r["n_removed"] for r in got.values()) > 20
    for i, r in got.items():
        assert r["n_lines"] == len(texts[i].split("\n"))
    kept = {r["doc_id"]: r["text"] for r in line_dedup.apply_dedup(docs(spark, list(texts.items()))).collect()}
    assert kept == {i: t for i, t in want.items() if t.strip()}


@pytest.mark.parametrize("seed", [1, 2])
def test_repeated_passages_go_whole(spark, seed):
    rng = random.Random(seed)
    line = lambda n: " ".join(f"w{rng.randrange(10**9)}" for _ in range(n))
    shared = [[line(20), line(20), line(20)], [line(3), line(70), "", line(2)], [line(26), line(25)], [line(9) for _ in range(12)], [line(1) for _ in range(60)], [line(30), line(30), line(5)], [line(49)], [line(51)]]
    texts = {}
    for i in range(40):
        parts = [[line(rng.randint(1, 15)) for _ in range(rng.randint(0, 4))] + rng.choice(shared) for _ in range(rng.randint(1, 3))]
        texts[i] = "\n".join(x for p in parts for x in [*p, line(4)])
    texts[40] = "\n".join([line(30)] * 7)
    want = brute(texts)
    got = {r["doc_id"]: r for r in line_dedup.report(docs(spark, list(texts.items())), whole=True).collect()}
    assert {i: r["text"] for i, r in got.items()} == want
    assert all(r["n_removed"] == len(texts[i].split("\n")) - (len(want[i].split("\n")) if want[i] else 0) for i, r in got.items())


def test_query_removes_passages(spark, tmp_path):
    rng = random.Random(3)
    line = lambda n: " ".join(f"w{rng.randrange(10**9)}" for _ in range(n))
    passage = [line(20) for _ in range(3)]
    texts = [(i, "\n".join([line(5), line(i + 2), *passage, line(7)])) for i in range(20)]
    docs(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["n_removed"] for r in queries.QUERIES["op6_line_dedup"](spark, str(tmp_path)).collect()}
    assert got == {0: 0} | {i: 3 for i in range(1, 20)}


def test_edges(spark):
    got = line_dedup.report(docs(spark)).collect()
    assert len(got) == len(rows())
    by = {r["doc_id"]: r for r in got}
    assert by[40]["text"] is None and by[40]["n_lines"] == 0 and by[41]["text"] == "" and by[44]["text"] == "\n\n\n"
    assert by[50]["n_removed"] > 0 and by[3]["n_removed"] == 0
    assert line_dedup.report(empty(spark)).count() == 0
    kept = line_dedup.apply_dedup(docs(spark))
    assert kept.columns == docs(spark).columns and kept.where("doc_id = 3").first()["text"] == rows()[3][1]
