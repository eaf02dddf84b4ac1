import random
import zlib
from collections import Counter

import numpy as np
import pytest
from cases import DE, EN, docs, empty, prose, rows

from quayside.llm import language


def brute(text):
    """Counts of n-grams of 1 to 3 code points of each word with a space on both sides (a lone space is none)."""
    c = Counter()
    for w in language.WORDS.findall(text.lower()):
        w = f" {w} "
        for n in (1, 2, 3):
            c.update(g for i in range(len(w) - n + 1) if (g := w[i : i + n]) != " ")
    return c


def code(g):
    return sum(ord(x) << s for x, s in zip(g, (42, 21, 0)))


def test_grams_by_brute_force():
    for text in ["", "a", "ab ab c", "Él niño, 日本 x1y", prose(random.Random(1), EN, 300)]:
        codes, counts = language.grams(text)
        want = sorted(((-n, code(g)) for g, n in brute(text).items()))
        assert list(zip((-counts).tolist(), codes.tolist())) == want


def test_distance_by_brute_force():
    """Ranking and out-of-place distance from the counts of brute()."""
    rng = random.Random(3)
    top = 40
    ranked = lambda text: [code(g) for _, g in sorted((-n, g) for g, n in brute(text).items())][:top]
    profiles = {k: ranked(prose(rng, w, 60)) for k, w in (("en", EN), ("de", DE), ("xx", EN[:6] + DE[:6]))}
    for _ in range(30):
        text = prose(rng, rng.choice([EN, DE, EN[:6] + DE[:6]]), rng.randint(1, 30))
        own = ranked(text)
        away = {k: sum(abs(i - p.index(g)) if g in p else top for i, g in enumerate(own)) for k, p in profiles.items()}
        best = min(sorted(away), key=away.get)
        lang, score = language.Profiles(profiles).predict(text, top)
        assert lang == best and abs(score - (1 - away[best] / (top * len(own)))) < 1e-12


def test_learns_each_language_by_brute_force(spark, monkeypatch):
    """Counts over all texts of a language, whatever the number of languages; copies count once."""
    rng = random.Random(4)
    some = [(i, prose(rng, EN if i % 2 else DE, 8), "en" if i % 2 else "de") for i in range(30)] + [(100 + i, prose(rng, EN, 3), f"l{i}") for i in range(50)]
    learned = language.learn(docs(spark, some + some), top=25, sample=1000)
    assert [k for k, _, _ in learned.known] == sorted({x[2] for x in some})
    for lang, codes, rank in learned.known:
        c = Counter()
        for t in {x[1] for x in some if x[2] == lang}:
            c.update(brute(t))
        want = [code(g) for _, g in sorted((-n, g) for g, n in c.items())][:25]
        assert codes[np.argsort(rank)].tolist() == want
    monkeypatch.setattr(language, "LANGUAGES", 51)
    with pytest.raises(ValueError):
        language.learn(docs(spark, some))


def test_distance():
    p = language.Profiles({"x": [code("a"), code("b")], "y": [code("b"), code("a")]})
    assert p.predict("!!!") == p.predict(None) == p.predict("") == ("und", 0.0)
    assert language.Profiles({}).predict("abc") == ("und", 0.0)


def test_held_out_accuracy_and_edges(spark):
    rng = random.Random(9)
    some = [(i, prose(rng, EN if i % 2 else DE, 12), "en" if i % 2 else "de") for i in range(200)]
    got = language.identify(docs(spark, some)).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    out = [r for r in got if r["held_out"]]
    assert sum(r["lang_pred"] == ("en" if r["doc_id"] % 2 else "de") for r in out) > 0.97 * len(out)
    got = language.identify(docs(spark)).collect()
    assert len(got) == len(rows()) and all(0 <= r["score"] <= 1 for r in got)
    assert {r["lang_pred"] for r in got if r["doc_id"] in (40, 41, 42, 44, 48)} == {"und"}
    assert language.identify(empty(spark)).count() == 0
    kept = language.apply_filter(docs(spark))
    assert kept.columns == docs(spark).columns and {r["doc_id"] for r in kept.collect()} >= set(range(40))


def test_real_documents(spark, sf):
    docs_ = spark.read.parquet(f"{sf}/documents.parquet")
    got = language.identify(docs_).join(docs_.select("doc_id", "lang"), "doc_id").where("held_out AND lang IS NOT NULL").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) >= 0.95 * len(got)
