"""From raw documents to token ids, in five stages.

Each stage takes all documents that the one before kept, and what it decides takes effect.
Every row is judged by its own text: null and repeated ids, repeated rows, further columns
of any name and an empty table go through all stages, as each one's docstring says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import decontaminate, exact_dedup, language_id, near_dedup, pieces
from tessera.session import stored, table


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, whose language can't be told, go; so do null and empty texts.

    Without any labelled document to learn from, the others stay, as nothing speaks against them.
    """
    return language_id.keep_identified(docs, language_id.fit_on_documents(docs))


def no_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for white space, the smallest id stays; of rows that repeat it with that text, one."""
    return exact_dedup.without_exact_duplicates(docs)


def no_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of similarity 0.8 or more join, the smallest id stays; rows without an id or without words stay too."""
    return near_dedup.without_near_duplicates(docs)


def no_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of ten words of a benchmark item go; an empty benchmark drops none."""
    return decontaminate.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their token ids; no row goes."""
    return pieces.encoded(docs, pieces.load())


STAGES = [
    ("language_id", known_language),
    ("exact_dedup", no_exact_copies),
    ("near_dedup", no_near_copies),
    ("decontaminate", no_benchmark_passages),
    ("sentencepiece", token_ids),
]

#: SQL can't express the language model; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
