from collections import Counter

import corpus_pipeline
import numpy as np
import public_tokenizers
from test_jaccard_join import brute as near
from cases import docs as made, empty, rows
from test_line_dedup import brute as deduped
from test_packing import laid_out
from tokenizers import Tokenizer


def test_stages_on_real_documents(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept, columns = [docs], docs.columns
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, kept[-1], sf)
        out.write.parquet(f"{tmp_path}/{i}")
        kept.append(spark.read.parquet(f"{tmp_path}/{i}"))
        assert i == 4 or out.columns == columns
    first, second, third, fourth = [[r.asDict() for r in k.collect()] for k in kept[:4]]
    assert {r["doc_id"] for r in second} == {r["doc_id"] for r in first if r["text"] and any(c.isalpha() for c in r["text"])}
    want = {i: t for i, t in deduped({r["doc_id"]: r["text"] for r in second}).items() if t.strip()}
    assert {r["doc_id"]: r["text"] for r in third} == want
    classes = near({r["doc_id"]: r["text"] for r in third})
    assert {r["doc_id"] for r in fourth} == {c for c, _, _ in classes.values()}
    texts = {r["doc_id"]: r["text"] for r in fourth}
    mixed = [r.asDict() for r in kept[4].collect()]
    assert {r["doc_id"]: r["text"] for r in mixed}.items() <= texts.items() and max(Counter(r["doc_id"] for r in mixed).values()) <= 2
    size = {i: len(t.split()) for i, t in texts.items()}
    assert 1.4 < sum(size[r["doc_id"]] for r in mixed) / sum(size.values()) < 1.6
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    n = {i: len(t.encode(x, add_special_tokens=False).ids) + 1 for i, x in texts.items()}
    packed = kept[5].collect()
    assert sum(r["length"] for r in packed) == sum(n[r["doc_id"]] for r in mixed)
    assert laid_out(packed, 4096) <= np.ceil(sum(r["length"] for r in packed) / 4096) + 2


def test_run_gives_the_same(spark, sf):
    a, b = (corpus_pipeline.run(spark, sf) for _ in range(2))
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert a.select(*key).exceptAll(b.select(*key)).isEmpty() and a.count() == b.count() > 0


def stages(spark, docs, base):
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, "")
        assert i == 4 or out.columns == docs.columns
        out.write.parquet(f"{base}/{i}")
        docs = spark.read.parquet(f"{base}/{i}")
    return docs


def test_awkward_documents(spark, tmp_path):
    """Nulls in every column, empty and very long texts, repeated rows, clashing columns."""
    got = stages(spark, made(spark), tmp_path).collect()
    texts = {r[0]: r[1] for r in rows()}
    assert {r["doc_id"] for r in got} <= {r[0] for r in rows() if r[1] and any(x.isalpha() for x in r[1])}
    assert 45 in {r["doc_id"] for r in got} and not {40, 41, 42, 44, 48, 49, 50} & {r["doc_id"] for r in got}
    assert laid_out(got, 4096) > 0 and texts[45]
    between = spark.read.parquet(f"{tmp_path}/3")
    assert between.columns == made(spark).columns and between.where("doc_id = 45").first()["size"] == 7


def test_empty_table(spark, tmp_path):
    assert stages(spark, empty(spark), tmp_path).count() == 0


def test_run_on_an_empty_table(spark, tmp_path):
    empty(spark).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
