"""A corpus pipeline of four stages: language identification, near-duplicates, secrets, packing.

Each stage takes (spark, docs, sf_dir), works on all documents that the stage before kept, and its rows are written as Parquet in the
shared folder and read again as the next one's documents. All but the last return the columns of ``documents``. SQL cannot express
the stages (trained network, 64-bit XXH hashes, token ids); the tests compare them with brute force.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sessionmill.llm import language_id, packing, secrets, simhash
from sessionmill.llm.common import keep


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the network knows; those without a letter and those it places nowhere go."""
    return language_id.keep_known(docs)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: 0.8 or more of their five-word shingles in common."""
    return simhash.one_of_each(docs)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced by a sign."""
    return secrets.mask_secrets(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece of a document, with its place in a training sequence."""
    return packing.pack_documents(docs, ["doc_id"])


STAGES = [("language_id", known_language), ("simhash_near_dedup", one_of_each_group), ("secret_scans", without_secrets), ("packing", packed)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = keep(stage(spark, docs, sf_dir), name)
    return docs
