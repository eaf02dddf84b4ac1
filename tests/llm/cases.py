"""Documents of every awkward kind, for the operators on documents."""

from __future__ import annotations

import random

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, size bigint, piece int, part int, k string, `key` string, rank int, h bigint"
EN = "the house and the garden were there when the people came with other things that they had seen in the town".split()
DE = "der hund und die katze sind nicht auf dem dach sondern unter dem tisch wo sie mit einem ball spielen".split()


def prose(rng: random.Random, words: list[str], n: int) -> str:
    return " ".join(rng.choice(words) for _ in range(n))


def rows(rng: random.Random | None = None) -> list[tuple]:
    rng = rng or random.Random(1)
    out = []
    for i in range(40):
        lang, words = ("en", EN) if i % 2 else ("de", DE)
        out.append((i, "\n".join(prose(rng, words, 30) for _ in range(1 + i % 4)), lang, f"s{i % 3}"))
    out += [
        (40, None, "en", "s0"), (41, "", "en", "s1"), (42, " \t\n ", None, None), (43, "a", None, "s2"), (44, "\n\n\n", "de", None),
        (45, prose(rng, EN, 9000), "en", "s0"), (46, "x" * 30_000, None, "s0"), (47, "日本語のテキスト ñandú 😀 \U0001f9d1", "en", "s1"), (48, "12345 !!! ???", "en", None),
        (None, prose(rng, DE, 25), "de", "s1"), (None, None, None, None), (49, out[3][1], "en", "s0"), (49, out[3][1], "en", "s0"), (50, out[3][1], "en", "s2"),
    ]
    return [(*r, None if r[1] is None else len(r[1]), 7, 8, 9, "k", "key", 3, 5) for r in out]


def docs(spark, some: list[tuple] | None = None):
    return spark.createDataFrame(rows() if some is None else [(*r, *[None] * (12 - len(r))) for r in some], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
