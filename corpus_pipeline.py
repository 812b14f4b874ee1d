"""The corpus pipeline: documents through language ID, deduplication, mixing and tokenisation."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from skyloom.llm import byte_bpe, exact_dedup, language_id, mixing, near_dedup
from skyloom.llm.common import written
from skyloom.llm.queries import BPE_FILE

#: Least proportion of its main language that a document needs.
LEAST_PROPORTION = 0.5


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without an identifiable main language."""
    return language_id.identified(docs, LEAST_PROPORTION)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of equal texts."""
    return exact_dedup.deduplicated(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates: five words, similarity 0.8."""
    return near_dedup.deduplicated(docs, words=5, percent=80)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or leaves out documents so that sources meet their target weights."""
    return mixing.mixed_documents(docs, share=1.5, weights=(3, 1, 2))


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, lossless of every document in the mix."""
    return byte_bpe.encoded(docs, public_tokenizers.path(BPE_FILE), public_tokenizers.PATTERN)


STAGES = [("language_id", language_stage), ("exact_dedup", exact_stage), ("near_dedup", near_stage), ("source_mixing", mixing_stage),
    ("byte_bpe", tokens_stage)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over sf_dir's documents; every stage is written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
