import random

import numpy as np
import pytest
from cases import docs, empty, prose, rows

from quayside.llm import components, jaccard_join

VOCABULARY = [f"w{i}" for i in range(800)]


def shingles(text):
    w = text.split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(texts):
    """{id: (class, links, copies)}"""
    sets = {i: frozenset(shingles(t)) for i, t in texts.items()}
    kinds = {s: min(i for i in sets if sets[i] == s) for s in set(sets.values()) if s}
    near = {s: [o for o in kinds if o != s and 5 * len(s & o) >= 4 * len(s | o)] for s in kinds}
    out = {}
    for i, s in sets.items():
        if not s:
            out[i] = (i, 0, 1)
            continue
        seen, todo = {s}, [s]
        while todo:
            for o in near[todo.pop()]:
                if o not in seen:
                    seen.add(o)
                    todo.append(o)
        out[i] = (min(kinds[x] for x in seen), len(near[s]), sum(x == s for x in sets.values()))
    return out


def variants(rng, n, each):
    out = []
    for _ in range(n):
        base = prose(rng, VOCABULARY, rng.randint(3, 300)).split()
        for _ in range(each):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 5])):
                w[rng.randrange(len(w))] = rng.choice(VOCABULARY)
            out.append(" ".join(w))
    rng.shuffle(out)
    return dict(enumerate(out))


@pytest.mark.parametrize("block", [jaccard_join.BLOCK_ROWS, 7])
def test_by_brute_force(spark, block, monkeypatch):
    rng = random.Random(block)
    texts = variants(rng, 30, 5) | {1000 + i: t for i, t in variants(rng, 1, 60).items()} | {2000: "", 2001: " \n", 2002: "one two", 2003: "one  two"}
    monkeypatch.setattr(jaccard_join, "BLOCK_ROWS", block)
    got = {r["doc_id"]: (r["class_id"], r["n_links"], r["n_copies"]) for r in jaccard_join.join(docs(spark, list(texts.items()))).collect()}
    assert got == brute(texts)
    kept = {r["doc_id"] for r in jaccard_join.apply_join(docs(spark, list(texts.items()))).collect()}
    assert kept == {c for c, _, _ in got.values()}


def test_recall_of_the_forest():
    """Of pairs of a similarity of about 0.79, by the depth that pairs of that similarity would lead to."""
    k = jaccard_join.depth_for({51: 1000}, jaccard_join.DEPTH)
    assert jaccard_join.found_at(k, 0.8) >= jaccard_join.RECALL > jaccard_join.found_at(k + 1, 0.8)
    assert jaccard_join.depth_for({64: 1000}, 12) == 12 and jaccard_join.depth_for({}, 12) == 12
    assert k <= jaccard_join.depth_for({51: 1, 60: 1000}, 12) < 12
    rng, hit, near, n = random.Random(3), 0, 0, 300
    forest, grams = jaccard_join.Forest(jaccard_join.TREES, jaccard_join.DEPTH), jaccard_join.Grams()
    for _ in range(n):
        w = prose(rng, VOCABULARY, 400).split()
        o = w[:353] + prose(rng, VOCABULARY, 47).split()
        (a, x), (b, y) = (forest.labels(grams(" ".join(t))) for t in (w, o))
        size = 2 * jaccard_join.DEPTH
        hit += any(a[i : i + 2 * k] == b[i : i + 2 * k] for i in range(0, len(a), size))
        near += sum(p == q for p, q in zip(x, y)) >= jaccard_join.SKETCH * (0.8 - jaccard_join.SLACK)
    assert hit >= 0.99 * n and near == n


def test_prefixes_are_shortened_until_the_target(spark):
    rng = random.Random(9)
    bases = [prose(rng, VOCABULARY, 400).split() for _ in range(150)]
    texts = [" ".join(b) for b in bases] + [" ".join(b[:357] + prose(rng, VOCABULARY, 43).split()) for b in bases]
    sets = jaccard_join.sets_of(docs(spark, list(enumerate(texts))), jaccard_join.TREES, jaccard_join.DEPTH)
    nodes = sets.selectExpr("d AS node", "labels", "sketch").cache()
    links, level = jaccard_join.forest_links(nodes, trees=jaccard_join.TREES, depth=jaccard_join.DEPTH, threshold=0.8, recall=0.9999)
    assert level < jaccard_join.DEPTH
    assert {(r["u"], r["v"]) for r in links.collect()} == {(i, i + 150) for i in range(150)}
    _, easy = jaccard_join.forest_links(nodes, trees=jaccard_join.TREES, depth=jaccard_join.DEPTH, threshold=0.8, recall=0.5)
    assert easy == jaccard_join.DEPTH


def test_unrelated_texts_with_a_prefix_are_not_linked():
    rng = np.random.default_rng(2)
    a, b = rng.integers(0, 256, (2, 64), dtype=np.uint8)
    half = np.where(np.arange(64) < 20, b, a)
    rows = np.stack([a, b, half, a, b, b, a])
    found = [sorted(m.tolist()) for m, _ in jaccard_join.spanning(rows, np.array([0, 5]), 35)]
    assert found == [[0, 2, 3], [1, 4], [5], [6]]


def test_large_runs(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "RUN", 3)
    texts = variants(random.Random(4), 3, 20)
    got = {r["doc_id"]: (r["class_id"], r["n_links"], r["n_copies"]) for r in jaccard_join.join(docs(spark, list(texts.items()))).collect()}
    assert got == brute(texts)


@pytest.mark.parametrize("light", [0, 2, 1000])
def test_linked_by_brute_force(light, monkeypatch):
    monkeypatch.setattr(jaccard_join, "LIGHT", light)
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 300).astype(np.uint64)
    sets = [np.unique(np.where(rng.random(300) < rng.choice([0, 0.05, 0.15]), rng.integers(0, 2**63, 300).astype(np.uint64), base)) for _ in range(40)]
    want = [[i, j] for i in range(40) for j in range(i + 1, 40) if 5 * len(set(sets[i]) & set(sets[j])) >= 4 * len(set(sets[i]) | set(sets[j]))]
    assert jaccard_join.linked(sets, np.zeros(40), False, 0.8).tolist() == want
    side = np.arange(40) % 2
    assert jaccard_join.linked(sets, side, True, 0.8).tolist() == [p for p in want if side[p[0]] != side[p[1]]]


@pytest.mark.parametrize("hub", [components.HUB, 2])
def test_components(spark, hub, monkeypatch):
    monkeypatch.setattr(components, "HUB", hub)
    edges = [(i, i + 1) for i in range(0, 100)] + [(500, 300), (300, 400), (7, 7), (900, 901)] + [(700, 701 + i) for i in range(40)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert got == {**dict.fromkeys(range(101), 0), 500: 300, 300: 300, 400: 300, 900: 900, 901: 900, **dict.fromkeys(range(700, 741), 700)}
    assert components.components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


def test_edges(spark):
    got = jaccard_join.join(docs(spark)).collect()
    assert len(got) == len(rows())
    by = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    assert by[49]["class_id"] == by[50]["class_id"] == 3 and by[40]["class_id"] == 40 and by[3]["n_copies"] == 4
    assert jaccard_join.join(empty(spark)).count() == 0
    kept = jaccard_join.apply_join(docs(spark))
    assert kept.columns == docs(spark).columns and {r["doc_id"] for r in kept.collect()} >= {0, 3, 40, 41, 47, None}
