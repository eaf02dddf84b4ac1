import random
from collections import Counter

import numpy as np
import pytest
from cases import docs, empty, rows

from quayside.llm import lm_scoring as lm


def text_of(rng, n):
    """Words that follow from their neighbours: a, b and c each have one that comes after."""
    after = {"a": "x", "b": "y", "c": "z"}
    return " ".join(f"{w} {after[w]}" for w in (rng.choice("abc") for _ in range(n)))


def words_of(counts):
    known = sorted(counts.items(), key=lambda x: (-x[1], x[0]))[: lm.KNOWN]
    tails = Counter()
    for w, n in counts.items():
        tails[lm.tail_of(w)] += n
    return lm.Words(known, tails)


def test_scores_by_brute_force(spark):
    """Each token from the network's weights, one at a time; words beyond the known ones by their own count."""
    rng = random.Random(1)
    texts = [text_of(rng, 40) + f" rare{i}" for i in range(200)]
    df = docs(spark, list(enumerate(texts)))
    counts = lm.counted(df)
    assert {r["word"]: r["n"] for r in counts.collect()} == Counter(w for t in texts for w in t.split())
    words = lm.words_of(counts)
    coded = lm.encoded(df, words)
    net = lm.train(coded, words, rounds=2, batch=32, shard=4000)
    got = {r["doc_id"]: r for r in lm.score(coded, words, net, counts).collect()}
    e, b, w1, c1, w2, c2 = net.w
    for i in range(5):
        ids = [words[w] for w in texts[i].split()]
        line, total = [lm.EDGE] * 3 + [int(words.seen[x]) for x in ids] + [lm.EDGE] * 3, 0.0
        for j, x in enumerate(ids):
            h = np.tanh(b + sum(e[n][line[j + 3 + o]] for n, o in enumerate(lm.OFFSETS)))
            z = h @ w1 + c1
            total += z[words.out[x]] - np.log(np.exp(z).sum()) + words.inside[x]
            if words.slot[x] >= 0:
                z = h @ w2[words.out[x]] + c2[words.out[x]]
                total += z[words.slot[x]] - np.log(np.exp(z).sum())
        assert got[i]["n_tokens"] == len(ids) and abs(got[i]["pll"] - total) < 1e-2 and abs(got[i]["mean_pll"] * len(ids) - got[i]["pll"]) < 1e-6 and got[i]["n_once"] == 0
    n = sum(map(len, (t.split() for t in texts)))
    unigram = np.mean([np.log(c / n) for t in texts[:20] for c in [Counter(w for t in texts for w in t.split())[w] for w in t.split()]])
    assert np.mean([r["mean_pll"] for r in got.values()]) > unigram + 0.5  # it learns from both sides


def test_beats_unigrams_on_the_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    counts = {r["word"]: r["n"] for r in lm.counted(df).collect()}
    total = sum(counts.values())
    unigram = sum(n * np.log(n / total) for n in counts.values()) / total
    got = lm.score_corpus(df).selectExpr("sum(pll) / sum(n_tokens) AS mean").first()["mean"]
    assert got > unigram + 0.2


def test_same_scores_for_any_split(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    one, many = ({r["doc_id"]: r["pll"] for r in lm.score_corpus(df.repartition(n), shard=20_000).collect()} for n in (1, 8))
    assert one.keys() == many.keys() and all(abs(one[i] - many[i]) <= 1e-5 * abs(one[i]) for i in one)


def test_trains_on_every_token(spark):
    """One shard: the same steps as by hand, over all tokens; many shards: their mean."""
    rng = random.Random(2)
    texts = [text_of(rng, 40) for _ in range(20)]
    df = docs(spark, list(enumerate(texts)))
    words = words_of(Counter(w for t in texts for w in t.split()))
    coded = lm.encoded(df, words)
    placed = [np.frombuffer(r["ids"], dtype="<u2") for r in sorted(coded.collect(), key=lambda r: r["place"])]
    want = lm.Network.first(words)
    assert want.learn(lm.seen_from(words, np.concatenate(placed), np.cumsum([len(x) for x in placed])), 1024) == 20 * 80
    assert lm.train(coded, words, batch=1024).flat() == pytest.approx(want.flat(), abs=1e-5)
    parts = {r["place"]: r["s"] for r in coded.selectExpr("place", "pmod(xxhash64(place), 2) AS s").collect()}
    means, seen = 0, 0
    for s in (0, 1):
        own = [np.frombuffer(r["ids"], dtype="<u2") for r in sorted(coded.collect(), key=lambda r: r["place"]) if parts[r["place"]] == s]
        net = lm.Network.first(words)
        n = net.learn(lm.seen_from(words, np.concatenate(own), np.cumsum([len(x) for x in own])), 1024)
        means, seen = means + n * net.flat(), seen + n
    assert seen == 20 * 80 and lm.train(coded, words, rounds=1, batch=1024, shard=800).flat() == pytest.approx(means / seen, abs=1e-5)


def test_gradient():
    """Against differences of the loss."""
    rng = np.random.default_rng(1)
    words = words_of({f"w{i}": 1 + i % 7 for i in range(5000)})
    net = lm.Network.first(words)
    net.w = [x.astype(np.float64) for x in net.w]
    net.squares = [np.full(x.shape, 1.0) for x in net.w]
    rows = rng.integers(0, 5000, 60)
    around, out, slot = lm.seen_from(words, rows, np.array([20, 60]))
    loss = lambda: -net.score(around, out, slot).mean()
    before, rate = [x.copy() for x in net.w], 1e-3
    for which, at in [(0, (2, int(around[0, 2]), 3)), (1, (4,)), (2, (3, int(out[5]))), (3, (int(out[5]),)), (4, (int(out[slot >= 0][0]), 2, int(slot[slot >= 0][0]))), (5, (int(out[slot >= 0][0]), int(slot[slot >= 0][0])))]:
        base = [x.copy() for x in before]
        net.w = base
        net.w[which][at] += 1e-4
        up = loss()
        net.w[which][at] -= 2e-4
        slope = (up - loss()) / 2e-4
        net.w, net.squares = [x.copy() for x in before], [np.full(x.shape, 1.0) for x in before]
        net.step(around, out, slot, rate)
        moved = (before[which] - net.w[which])[at] / rate
        assert moved == pytest.approx(slope, rel=2e-2, abs=1e-5)


def test_word_probabilities():
    """In each class the words' probabilities come to 1, those of unknown words by their counts."""
    counts = {f"w{i}x{i % 900}": 1 + 70_000 // (i + 1) for i in range(lm.KNOWN + 3000)}
    words = words_of(counts)
    unknown = [w for w in counts if w not in words.known]
    sums = np.zeros(lm.OUT)
    for w, i in words.known.items():
        sums[words.out[i]] += np.exp(words.inside[i]) if words.slot[i] < 0 else np.exp(words.word_prior[words.out[i], words.slot[i]])
        assert (words.slot[i] >= 0) == (i < lm.OWN) == (words.out[i] < lm.CLASSES)
    for w in unknown:
        sums[words.out[words[w]]] += counts[w] * np.exp(words.inside[words[w]])
    assert len(unknown) == 3000 and sums[sums > 0] == pytest.approx(1, abs=1e-6) and (sums[: lm.CLASSES] > 0).all()
    assert len({(int(words.out[i]), int(words.slot[i])) for i in range(lm.OWN)}) == lm.OWN


def test_all_words_keep_their_counts(spark, monkeypatch):
    monkeypatch.setattr(lm, "KNOWN", 50)
    monkeypatch.setattr(lm, "OWN", 40)
    often = [f"k{i}" for i in range(50)] * 5
    rare = [f"r{i}aa" for i in range(9)]
    texts = [" ".join(often), *rare, rare[0], rare[0], rare[1], rare[0] + " " + rare[2], None]
    got = {r["doc_id"]: r for r in lm.score_corpus(docs(spark, list(enumerate(texts)))).collect()}
    assert len(got) == len(texts) and got[len(texts) - 1]["pll"] == 0
    for i in range(9):
        n = {0: 4, 1: 2, 2: 2}.get(i, 1)
        assert abs(got[i + 1]["pll"] - got[9]["pll"] - np.log(n)) < 1e-6 and got[i + 1]["n_once"] == (n == 1)
    assert got[0]["n_once"] == 0 and got[9]["pll"] == got[9]["mean_pll"]


def test_edges(spark):
    got = lm.score_corpus(docs(spark)).collect()
    assert len(got) == len(rows())
    by = {r["doc_id"]: r for r in got}
    assert all((by[i]["n_tokens"], by[i]["pll"], by[i]["mean_pll"]) == (0, 0.0, None) for i in (40, 41, 42, 44)) and by[48]["n_tokens"] == 1
    assert lm.score_corpus(empty(spark)).count() == 0
    assert lm.score_corpus(docs(spark, [(1, None)])).collect()[0]["n_tokens"] == 0


def test_texts_are_read_and_cut_once(spark):
    """Counts and numbers come from one pass over the texts."""
    seen = spark.sparkContext.accumulator(0)

    def look(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    df = docs(spark, [(i, f"a b{i} c") for i in range(30)]).select("doc_id", "text")
    assert lm.score_corpus(df.mapInArrow(look, df.schema)).count() == 30 and seen.value == 30


def test_cut_finds_the_same_tokens():
    """Those of the pattern over the lower-case text, for every character in the midst and at the ends of words."""
    every = [chr(i) for i in range(0x30000) if not 0xD800 <= i < 0xE000]
    texts = ["".join(every[i : i + 97]) for i in range(0, len(every), 97)] + [f"Ab{c}Σ {c}" for c in every[:0x3000]]
    texts += [None, "", " ", "\n", "a\nb", "İΣ ΑΣ. ΑΣΑ", "x" * 5000, "A_1\x00b", "été", "\U0001d400b ½①"]
    found, n = lm.cut(texts)
    assert found.to_pylist() == [w for t in texts for w in lm.tokens(t)] and n.tolist() == [len(lm.tokens(t)) for t in texts]
    assert lm.cut([])[1].tolist() == [] and len(lm.cut([None, "--"])[0]) == 0


def test_same_scores_for_any_pieces(spark, monkeypatch):
    texts = ["one two Three", None, "four", "", "two " * 50, *[f"w{i} x y" for i in range(40)]]
    df = docs(spark, [*enumerate(texts), (None, "one")]).repartition(1)
    whole = {r["doc_id"]: r for r in lm.score_corpus(df).collect()}
    monkeypatch.setattr(lm, "PIECE", 20)
    got = {r["doc_id"]: r for r in lm.score_corpus(df).collect()}
    assert lm.pieces(df).count() > 5 and got.keys() == whole.keys() and len(got) == len(texts) + 1
    assert all(got[i]["n_tokens"] == whole[i]["n_tokens"] and got[i]["n_once"] == whole[i]["n_once"] and got[i]["pll"] == pytest.approx(whole[i]["pll"], rel=1e-5) for i in got)


def test_piece_of_many_words(spark):
    """More words in a piece than 16 bits can number."""
    n = 70_000
    df = docs(spark, [(1, " ".join(f"{i:x}" for i in range(n))), (2, "0 11170 1116f")]).repartition(1)
    assert {r["word"]: r["n"] for r in lm.counted(df).collect()} == Counter([f"{i:x}" for i in range(n)] + ["0", "11170", "1116f"])
    words = words_of({f"{i:x}": 1 for i in range(n)})
    got = {r["doc_id"]: (np.frombuffer(r["ids"], dtype="<u2").tolist(), r["rare"]) for r in lm.encoded(df, words).collect()}
    for i, text in ((1, [f"{i:x}" for i in range(n)]), (2, ["0", "11170", "1116f"])):
        assert got[i] == ([words[w] for w in text], [w for w in text if w not in words.known])


@pytest.mark.parametrize("scale", [0.5, 30])
def test_layer(scale):
    """Logits, sums and gradients as with plain sums, also where an exponential would leave the floats."""
    rng = np.random.default_rng(3)
    words = words_of({f"w{i}": 1 + i % 7 for i in range(5000)})
    net = lm.Network.first(words)
    for i in (2, 3, 4, 5):
        net.w[i] += rng.normal(0, scale, net.w[i].shape).astype(np.float32)
    h = np.tanh(rng.normal(0, 1, (3000, lm.WIDTH))).astype(np.float32)
    out = np.sort(rng.integers(0, lm.OUT, 3000))
    rows = np.zeros(3000)
    for k, some, layer in net.layers(out):
        w, c = (x.astype(np.float64) for x in ((net.w[2], net.w[3]) if k is None else (net.w[4][k], net.w[5][k])))
        own = out[some] if k is None else out[some] * 0 + 5
        z = h[some] @ w + c
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        _, at, sums = layer.exponentials(h[some], own)
        assert at - np.log(sums) == pytest.approx(z[np.arange(len(own)), own] - np.log(np.exp(z - z.max(axis=1, keepdims=True)).sum(axis=1)) - z.max(axis=1), abs=1e-3)
        p[np.arange(len(own)), own] -= 1
        for x, want in zip(layer.gradient(h[some], own), (h[some].T @ p, p.sum(axis=0), p @ w.T), strict=True):
            assert x == pytest.approx(want, abs=2e-3 * max(1, scale))
        rows[some] += 1
    assert rows.tolist() == (1 + (out < lm.CLASSES)).tolist()
