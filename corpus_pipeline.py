"""A corpus pipeline over `documents`: STAGES in order, each written as Parquet and reread as the next one's input.

Language ID drops documents without a known language; line dedup cuts repeated chunks of lines; the n-gram Jaccard join
keeps one document of each class; mixing repeats or drops documents to reach the sources' targets; packing lays the
documents out in sequences. Each stage calls its operator and takes all rows of the stage before.

Edge cases, by stage: a null text or one without a letter has no language and goes; a text of which line dedup leaves
nothing but white space goes, an empty one would stay; of rows with one id and text one stays; a text without a word has
size 0 and is in no mix; null ids stay null; rows of one id with different texts are each a document; columns of other
names pass through unchanged up to the last stage; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quayside.llm import jaccard_join, language, line_dedup, mixing, packing
from quayside.llm.common import stash
from quayside.llm.queries import tokenizer

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents whose language is known."""
    return language.apply_filter(docs)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with what stays of their texts."""
    return line_dedup.apply_dedup(docs, whole=True)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates, that of the least id."""
    return jaccard_join.apply_join(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.apply_mix(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequences and places."""
    return packing.pack_documents(docs, tokenizer())


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_id),
    ("line_dedup", line_dedup_stage),
    ("ngram_jaccard_join", near_duplicates),
    ("mix_sources", mix_sources),
    ("best_fit_packing", best_fit_packing),
]

#: No SQL engine has the tokenizer, the rolling chunks or the profiles; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of the documents table, each stage written and reread."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stash(docs)
    return docs
