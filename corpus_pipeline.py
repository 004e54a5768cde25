"""The corpus pipeline: five stages over ``documents``, each written and read again by the next."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tillmark.llm import byte_bpe, line_chunks, mixing, ngram_join, quality
from tillmark.llm.queries import MIX_POWER, MIX_SEED
from tillmark.session import durable

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality.keep(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Chunks of lines that occurred before go; every document stays."""
    return line_chunks.clean(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of linked documents stays: the one with the smallest doc_id."""
    return ngram_join.one_of_each(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated (or left out) so that sources meet their target shares, in a global shuffle."""
    return mixing.mix(docs, mixing.tempered(docs, MIX_POWER), MIX_SEED)


def byte_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every copy as token ids, checked by what they decode to."""
    return byte_bpe.digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("source_mixing", source_mixing),
    ("byte_encoding", byte_encoding),
]

#: Robust statistics, rolling hashes and byte-pair merges are beyond SQL; tests/llm holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
