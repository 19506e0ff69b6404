"""A corpus pipeline: quality rules, near-duplicates, personal data, mixing, packing.

Each stage takes all that its predecessor kept, written as Parquet and read again. All but the last return the columns
of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import mixing, packing, pii, quality, simhash
from tidemark.llm.common import written


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the quality rules reject goes."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    ratios = quality.fit(docs, labels)
    return quality.keep_good(docs, ratios, quality.threshold(docs, labels, ratios))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near-duplicates the document with the smallest doc_id stays."""
    return simhash.keep_one_of_each_group(docs)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gives way to its kind; every document stays."""
    return pii.redact(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.repeat_by_copies(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences."""
    return packing.pack(docs)


STAGES = [
    ("quality_rules", good_documents),
    ("simhash_near_dedup", one_of_each_group),
    ("pii", without_personal_data),
    ("entropy_mixing", mixed),
    ("packing", packed),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, name)
    return docs
