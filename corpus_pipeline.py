"""From raw documents to token ids, in five stages; each stage works on all that the one before kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import bpe, exact_dedup, jaccard_join, language_id, mixing
from lodestone.llm.tables import ready, stored


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised."""
    ready(spark)
    return language_id.keep_identified(docs)


def one_copy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every text, that of the largest id."""
    ready(spark)
    return exact_dedup.keep_exact(docs)


def one_version(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near duplicates: five-word shingles, Jaccard 0.8."""
    ready(spark)
    return jaccard_join.keep_distinct(docs, 5, 80)


def weighted_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources, shard by shard; a document appears as often as the mix takes it, always whole."""
    ready(spark)
    return mixing.mix(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document of the mix its ids, and digests of ids and decoded bytes."""
    ready(spark)
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.digests(bpe.round_trip(docs, path, public_tokenizers.PATTERN), "ids")


STAGES = [
    ("language", known_language),
    ("exact", one_copy),
    ("near", one_version),
    ("mix", weighted_sources),
    ("tokens", token_ids),
]

#: Language ID and near duplicates have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each stored before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
