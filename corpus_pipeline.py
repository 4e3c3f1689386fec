"""Corpus pipeline: quality rules, exact dedup, SimHash near-dedup, PII, packing.

Each stage takes ``(spark, docs, sf_dir)`` and returns a frame, which is written
as Parquet and read again as the next one's ``docs``.  All but the last keep the
columns of ``documents``, whatever further columns there are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stratakit.llm import exact_dedup, packing, pii, quality, queries, simhash
from stratakit.session import write_once


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go; the model learns from ``labels``."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.keep_good(docs, quality.train(docs, labels))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest id stays."""
    return exact_dedup.keep_one_of_equal(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near-duplicate texts the row with the smallest id stays."""
    return simhash.keep_one_of_near(docs, queries.SHINGLE_WORDS, queries.MAX_BITS)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts is replaced."""
    return pii.sanitise(docs, size_col="n_chars")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents as pieces of sequences."""
    return packing.pack(docs, queries.tokenizer_path(), queries.SEQUENCE, with_ids=False)


STAGES = [
    ("quality_rules", good),
    ("exact_dedup", exact),
    ("simhash_near_dedup", near),
    ("pii", private),
    ("packing", packed),
]

#: No SQL expresses the fingerprints, the labelling or the ids.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's result stored."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = write_once(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
