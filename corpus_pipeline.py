"""From raw documents to packed training sequences, a stage at a time.

Each stage takes (spark, docs, sf_dir), works on all rows that the one before it kept, and returns a DataFrame that is written as Parquet and read again for the next. All but the last return the columns of documents: documents of no known language go, one document of each near-duplicate group (five-word shingles, similarity 0.8 or more) stays, secrets in texts are blanked, and the rest is packed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spindrift.llm import common, langid, neardup, packing, secrets


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.keep_known(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.keep_first(docs)


def blank_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [("language", language), ("near_dedup", near_dedup), ("secrets", blank_secrets), ("packing", pack)]

#: SQL can't express the language model, the fingerprints or the tokenizer; tests/llm compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.stored(stage(spark, docs, sf_dir))
    return docs
