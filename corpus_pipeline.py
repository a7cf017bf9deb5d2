"""Corpus pipeline: five stages from raw documents to sharded training data.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; it is written as Parquet and
read again as the next stage's documents. All stages but the last return the columns of
documents; the last adds ``shard``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wordmill.llm import decontaminate, mixing, sharding, simhash, toxicity
from wordmill.llm.common import written


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go."""
    return toxicity.drop_toxic(docs, _table(spark, sf_dir, "labels"), threshold=0.3)


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group stays: the one with the smallest doc_id."""
    return simhash.keep_one(docs, width=3, limit=3)


def remove_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    return decontaminate.drop_leaks(docs, _table(spark, sf_dir, "benchmark"))


def mix_domains(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated so that expected domain tokens meet their target shares; every
    document stays at least once."""
    return mixing.mix(docs, _table(spark, sf_dir, "labels"), domain="lang", floor=1.0,
                      keep_all=True)


def deal_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows in 16 shards of nearly equal bytes."""
    return sharding.shard_documents(docs, n_shards=16)


STAGES = [
    ("toxicity", remove_toxic),
    ("simhash_near_dedup", remove_near_duplicates),
    ("decontamination", remove_leaks),
    ("mixing", mix_domains),
    ("sharding", deal_shards),
]

#: Stages 1 to 3 train a model, walk an index of bit patterns and search passages: not SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each written and read again."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs, _ = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
