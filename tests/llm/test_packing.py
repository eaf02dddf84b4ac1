import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from cases import docs, empty, rows
from tokenizers import Tokenizer

from quayside.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def laid_out(pieces, capacity):
    """Checks that no sequence overflows, overlaps or has a gap; gives their number."""
    at = defaultdict(list)
    for p in pieces:
        at[p["sequence_id"]].append((p["offset"], p["length"]))
    for spans in at.values():
        end = 0
        for offset, length in sorted(spans):
            assert offset == end
            end += length
        assert end <= capacity
    return len(at)


def test_ids_are_the_tokenizers(monkeypatch):
    t = Tokenizer.from_file(PATH)
    words = packing.WordIds(PATH)
    odd = ["", "a  b", " x ", "It's we're I'LL\tdon't", "<|endoftext|> a<|startoftext|>b", "é ́x à", "  x\x1cy\x85z", "ΣΑΣ ΟΔΟΣ. İstanbul", "日本 語\n\n\r\nq", "12 345 3.14", "😀‍😀 fi ﬁ Å Å"]
    rng = random.Random(3)
    odd += ["".join(rng.choice("ab Σ'\n\té́ <|>.1日 ") for _ in range(60)) for _ in range(200)]
    texts = odd + [r[1] for r in rows() if r[1]]
    want = [np.array(t.encode(x, add_special_tokens=False).ids, "<u4").tobytes() for x in texts]
    assert words.ids(texts) == want
    monkeypatch.setattr(packing, "WORDS_KEPT", 20)  # the cache is emptied all the time
    small = packing.WordIds(PATH)
    assert [x for i in range(0, len(texts), 9) for x in small.ids(texts[i : i + 9])] == want
    for text in texts:
        assert np.frombuffer(words.ids([text])[0], "<u4").tolist() == t.encode(text, add_special_tokens=False).ids, repr(text)


def test_packs_every_document_once(spark):
    t = Tokenizer.from_file(PATH)
    for capacity in (64, 4096):
        got = packing.pack_documents(docs(spark), PATH, capacity=capacity).collect()
        laid_out(got, capacity)
        want = Counter()
        for r in rows():
            ids = np.array([*t.encode(r[1] or "", add_special_tokens=False).ids, 1], "<u4")
            want.update((r[0], i, s, len(ids[s : s + capacity]), zlib.crc32(ids[s : s + capacity].tobytes())) for i, s in enumerate(range(0, len(ids), capacity)))
        assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want


def test_empty_table(spark):
    assert packing.pack_documents(empty(spark), PATH).count() == 0


def test_sequences_round_trip(spark):
    packed = packing.pack_documents(docs(spark), PATH, capacity=256, keep_ids=True)
    n = {r["sequence_id"]: len(r["ids"]) // 4 for r in packing.sequences(packed).collect()}
    want = Counter()
    for r in packed.collect():
        want[r["sequence_id"]] += r["length"]
    assert n == want


@pytest.mark.parametrize("seed", range(8))
def test_plan_covers_the_histogram(seed):
    rng = random.Random(seed)
    capacity = rng.choice([8, 50, 200])
    pieces = [rng.choice([rng.randint(1, capacity), min(capacity, rng.randint(1, 9))]) for _ in range(rng.choice([0, 1, 7, 500]))]
    at = packing.plan(Counter(pieces), capacity)
    got = []
    for length, rank, n, base, offset in zip(*at.values()):
        later = at["rank"][(at["length"] == length) & (at["rank"] > rank)]
        end = later.min() if len(later) else Counter(pieces)[length]
        got += [{"sequence_id": base + (r - rank) % n, "offset": offset + (r - rank) // n * length, "length": length} for r in range(rank, end)]
    assert Counter(p["length"] for p in got) == Counter(pieces)
    used = laid_out(got, capacity)
    # first fit, longest first, one piece at a time
    rooms: list[int] = []
    for p in sorted(pieces, reverse=True):
        fit = min((r for r in rooms if r >= p), default=None)
        if fit is not None:
            rooms.remove(fit)
        rooms.append((capacity if fit is None else fit) - p)
    assert used <= len(rooms) * 1.05 + 1


def test_exact_complements_fill_all():
    assert max(packing.plan({60: 5, 40: 5, 50: 2, 30: 3, 20: 3, 10: 3, 70: 1, 15: 2}, 100)["sequence"]) < 13
    at = packing.plan({70: 10, 15: 20}, 100)
    assert (at["sequence"] + at["count"]).max() == 10  # a pair fills each
    at = packing.plan({40: 7, 30: 7, 20: 7, 10: 7}, 100)
    assert (at["sequence"] + at["count"]).max() == 7  # a triple does


def test_any_tokenizer_gives_its_own_ids():
    """Of a tokenizer with other rules the texts go to it as they are."""
    import public_tokenizers
    from tokenizers import Tokenizer

    texts = ["The Don't  stop\n\nNOW 123", "", "ÀÉ naïve 日本 x1y", "tabs\t\tand  spaces "]
    for name, cuts in (("word_bpe_49k.json", True), ("byte_bpe_50k.json", False)):
        path = public_tokenizers.path(name)
        words, plain = packing.WordIds(path), Tokenizer.from_file(path)
        assert words.cuts == cuts
        assert [np.frombuffer(x, "<u4").tolist() for x in words.ids(texts)] == [plain.encode(t, add_special_tokens=False).ids for t in texts]
