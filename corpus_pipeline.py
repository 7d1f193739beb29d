"""Training-data pipeline: every stage's result is written as Parquet and read again as the next one's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from isohyet.llm.common import documents, store
from isohyet.llm.exact_dedup import drop_exact_duplicates
from isohyet.llm.mixing import take_mix
from isohyet.llm.near_dedup import drop_near_duplicates
from isohyet.llm.packing import pack
from isohyet.llm.quality_rules import keep_quality
from isohyet.llm.queries import vocabulary


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return keep_quality(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the smallest id stays."""
    return drop_exact_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by shingles of five words at 0.8 or more, the smallest id stays."""
    return drop_near_duplicates(docs, words=5, percent=80)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix of sources takes it."""
    return take_mix(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens and their places in sequences."""
    return pack(docs, vocabulary())


STAGES = [
    ("quality rules", quality), ("exact dedup", exact_dedup), ("minhash near dedup", near_dedup), ("mixing sources", mixing), ("best-fit packing", packing),
]

#: The mix is a random draw and the packing needs a tokenizer: neither is SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir), name.replace(" ", "_").replace("-", "_"))
    return docs
