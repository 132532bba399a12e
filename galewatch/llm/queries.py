"""The queries of this package, as registered by the entry module."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import centroids, url_filter, warc
from .common import small_batches


def vocabulary(name: str) -> str:
    """A public tokenizer's file; every node has the package."""
    import public_tokenizers

    return public_tokenizers.path(name)


def token_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ann import nearest

    return nearest(_table(spark, sf_dir, "embeddings"))


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lm_score import score_documents

    return score_documents(_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.tiktoken"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pieces import encode_documents

    return encode_documents(_table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    return pack_documents(_table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op5_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .repeats import remove_repeats

    return remove_repeats(_table(spark, sf_dir, "documents"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import derivatives

    return derivatives(_table(spark, sf_dir, "pages"))


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import identify

    return identify(_table(spark, sf_dir, "documents"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import scan

    return scan(_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.tiktoken"), token_pattern())


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dedup import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"), width=3, percent=85)


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import exact_duplicates

    return exact_duplicates(_table(spark, sf_dir, "documents"))


#: Vectors that a Python worker gets at once.
VECTORS = 4096


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark, VECTORS)
    return centroids.with_inertia(centroids.clustered(spark.read.parquet(f"{sf_dir}/embeddings.parquet")))


def op12_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .resample import resampled

    return resampled(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), n=1)


#: Fixed by the query's contract.
URL_RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    out = url_filter.judge(pages, url_filter.outcomes_of(pages, labels), URL_RULES)
    return out.withColumn("bound", F.round("bound", 6) + 0.0)


QUERIES = {
    "op1_ann": op1_ann,
    "op2_lm_score": op2_lm_score,
    "op3_sentencepiece": op3_sentencepiece,
    "op4_packing": op4_packing,
    "op5_repeats": op5_repeats,
    "op6_warc": op6_warc,
    "op7_langid": op7_langid,
    "op8_secrets": op8_secrets,
    "op9_near_dedup": op9_near_dedup,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_centroids": op11_centroids,
    "op12_resample": op12_resample,
    "op13_url_filter": op13_url_filter,
}

ORACLE = {
    "op6_warc": warc.oracle(),
    "op11_centroids": centroids.oracle(),
    "op13_url_filter": url_filter.oracle(URL_RULES),
    "op10_exact_dedup": """
        SELECT doc_id,
               max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
               count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
               doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
               sha256(coalesce(text, '')) AS text_sha256
        FROM documents
    """,
}
