"""The corpus pipeline: quality, near-duplicates, benchmark leaks, source mix, shards.

Each stage takes all documents that the stage before it kept, as rows of a Parquet table in
the shared folder, and applies one operator. SQL can express neither the boosted trees nor
the fingerprints, so there is no ``ORACLE_SQL``; the tests hold ``run`` against the stages
worked out by hand.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from passbook.llm import decontaminate, mixing, quality, sharding, simhash
from passbook.llm.common import documents, table
from passbook.session import stage

ORACLE_SQL = None


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def near_unique(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: the one with the least doc_id."""
    return simhash.keep_one(docs)


def without_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no passage with the benchmark."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sources at their target weights; a document comes once for each time it is taken."""
    return mixing.mixed_documents(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their output shard."""
    return sharding.sharded_documents(docs)


STAGES = [
    ("quality", good_quality),
    ("near_dedup", near_unique),
    ("decontamination", without_leaks),
    ("mixing", source_mix),
    ("sharding", shards),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = documents(spark, sf_dir)
    for name, apply in STAGES:
        docs = stage(apply(spark, docs, sf_dir), f"pipeline_{name}")
    return docs
