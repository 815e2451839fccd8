"""From documents to tokens: quality rules, near-dedup, secrets, mixing, BPE.

Every stage takes (spark, docs, sf_dir) and works on all that the one before it kept; all but the last return the columns of
documents. Nulls in any column, empty and very long texts, repeated rows and empty tables pass through each as its operator says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, mixing, quality, secrets, simhash
from tessera.llm.common import cut, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the base rules or the risk-controlled cutoffs of their language reject."""
    return quality.keep(docs, table(spark, sf_dir, "labels"))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the least id, of each group of near copies."""
    return simhash.keep_one(docs)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets replaced by their kind; n_chars follows the text."""
    return secrets.redacted(docs).withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out, so that sources come near their targets."""
    return mixing.repeated(docs)


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, n_tokens, ids, intact): ids of the whole text, and whether they decode to it."""
    return bpe.encoded(docs.select("doc_id", "lang", "source", "text"), ("n_tokens", "ids", "intact"), keep_text=False)


STAGES = [("quality_rules", quality_stage), ("near_dedup", dedup_stage), ("secret_scans", secrets_stage), ("mixing", mixing_stage), ("bpe", tokens_stage)]

#: SQL can't express the fingerprints; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each result written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir))
    return docs
