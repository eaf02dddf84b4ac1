import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import xxhash
from cases import EN, docs, empty, prose, rows

from quayside.llm import fingerprints
from quayside.llm.fingerprints import OrderMinHash, likeness


def brute(omh, text):
    """The signature from its definition, one hash function and k-mer at a time."""
    tokens = [xxhash.xxh64_intdigest(t.encode()) for t in fingerprints.TOKEN.findall(text)]
    if not tokens:
        return [0] * omh.m
    full, mix = 2**64 - 1, int(fingerprints._MIX)
    k, mers, seen = min(omh.k, len(tokens)), [], Counter()
    for i in range(len(tokens) - k + 1):
        h = tokens[i]
        for t in tokens[i + 1 : i + k]:
            h = (h * mix + t) & full
        mers.append((h, seen[h]))
        seen[h] += 1
    out = []
    for i in range(omh.m):
        x, o = int(omh.xors[i, 0]), int(omh.odds[i, 0])

        def key(mer):
            h = (((mer[0] + (mer[1] + 1) * 0xD1B54A32D192ED03) & full) ^ x) * o & full  # noqa: B023
            return (h ^ h >> 32) * mix & full

        best = sorted(sorted(range(len(mers)), key=lambda j: key(mers[j]))[: omh.l])
        h = 1
        for j in best:
            h = (h ^ mers[j][0]) * mix & full
            h ^= h >> 29
        out.append(h >> 32 | 1)
    return out


def test_signature_by_brute_force():
    omh, rng = OrderMinHash(), random.Random(4)
    for n in (0, 1, 2, 3, 4, 50, 5000):
        text = prose(rng, EN, n)
        assert omh.signature(text).tolist() == brute(omh, text)


def test_order_matters():
    omh, rng = OrderMinHash(m=256), random.Random(5)
    words = [f"w{i}" for i in range(600)]
    text, swapped = " ".join(words), " ".join(words[300:] + words[:300])
    near = " ".join(w if rng.random() > 0.02 else "zz" for w in words)
    assert likeness(omh.signature(text), omh.signature(near)) > 0.6 > likeness(omh.signature(text), omh.signature(swapped))


@pytest.mark.parametrize("size", [1000, 7])
def test_all_documents(spark, size):
    got = fingerprints.fingerprint(docs(spark), rows_a_range=size).collect()
    have = sorted(rows(), key=lambda r: (r[0] is None, -(r[0] or 0)))
    have[-2:] = sorted(have[-2:], key=lambda r: r[1] or "", reverse=True)
    assert len(got) == len(have)
    omh, by = OrderMinHash(), {r["doc_id"]: r for r in got}
    for r, following in zip(have, [*have[1:], have[0]]):
        if r[0] is None or following[0] is None:
            continue  # equal ids go by a hash of the text
        text, nxt = r[1] or "", following[1] or ""
        n = len(text) // 3
        want = text[: len(text) - n] + nxt[:n]
        if r[0] == 49 == following[0]:
            continue
        assert by[r[0]]["edited_sha256"] == hashlib.sha256(want.encode()).hexdigest()
        a, b, c = omh.signature(text), omh.signature(want), omh.signature(nxt)
        assert (by[r[0]]["near_edited"], by[r[0]]["near_next"]) == (np.mean(a == b), np.mean(a == c))
        assert by[r[0]]["n_chars"] == len(text)
    assert by[3]["fingerprint"] == by[50]["fingerprint"] == by[49]["fingerprint"]
    assert by[40]["fingerprint"] == by[41]["fingerprint"]


def test_edges(spark):
    assert fingerprints.fingerprint(empty(spark)).count() == 0
    one = fingerprints.fingerprint(docs(spark, [(5, "abcdef")])).collect()
    assert one[0]["near_next"] == 1.0 and one[0]["edited_sha256"] == hashlib.sha256(b"abcdab").hexdigest()


@pytest.mark.parametrize("size", [1000, 5])
def test_rows_without_an_id_are_dealt_to_ranges(spark, size):
    """In the order of their texts' hashes, after all ids, with the first of all as the last one's next."""
    some = [(None if i % 3 else i, f"text {i} " * (1 + i % 4)) for i in range(90)]
    df = docs(spark, some)
    order = [r["text"] for r in df.selectExpr("doc_id", "text", "xxhash64(text) AS h").orderBy("h").collect() if r["doc_id"] is None]
    chain = [t for i, t in sorted((x for x in some if x[0] is not None), reverse=True)] + order
    want = {hashlib.sha256((t[: len(t) - len(t) // 3] + n[: len(t) // 3]).encode()).hexdigest() for t, n in zip(chain, [*chain[1:], chain[0]])}
    got = fingerprints.fingerprint(df, rows_a_range=size).collect()
    assert len(got) == 90 and {r["edited_sha256"] for r in got} == want
    assert fingerprints.ranges_of(df, 5)[1] == 12 and len(fingerprints.ranges_of(df, 5)[0]) == 5
