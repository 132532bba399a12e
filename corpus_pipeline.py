"""The corpus pipeline: language ID, exact dedup, near-dedup, secret scan, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from galewatch.llm import exact_dedup, langid, near_dedup, packing, secrets
from galewatch.llm.common import settled, small_batches
from galewatch.llm.queries import token_pattern, vocabulary


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, and those that no language is clearly above chance for, go.

    Null and empty texts have no letters. Repeated rows go or stay together. An empty table stays empty.
    """
    small_batches(spark)
    return langid.identified(docs)


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest id stays; of rows repeated with it, one. Null and empty texts are equal, null ids the smallest."""
    small_batches(spark)
    return exact_dedup.deduplicated(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of a component of near copies, by five-word shingles and a similarity of 0.8, the document with the least id stays.

    Texts without words, and rows without an id, link with nothing and stay. Rows of one id are one document.
    """
    small_batches(spark)
    return near_dedup.deduplicated(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; all documents stay, and their numbers of characters follow. Null and empty texts stay as they are."""
    small_batches(spark)
    clean = secrets.redact(docs, vocabulary("byte_bpe_50k.tiktoken"), token_pattern())
    return clean.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), "n_chars")) if "n_chars" in docs.columns else clean


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, as sequences of at most 4096 tokens. Null and empty texts are one token; repeated rows are packed each."""
    small_batches(spark)
    return packing.pack_documents(docs, vocabulary("word_bpe_49k.json"))


STAGES = [("language_id", language_id), ("exact_dedup", exact_dedup_stage), ("near_dedup", near_dedup_stage), ("secret_scan", secret_scan), ("packing", pack)]

#: Trained language identification and packing by dynamic programming have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; each but the last is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = settled(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
