"""Importance resampling of documents towards a target's distribution of hashed word sequences.

A feature is a run of 1 to n words, and falls into a bucket by its hash. A bucket's gain is how much likelier it is in the
target than in the documents; a document's weight is its features' mean gain, and a draw without replacement takes the
highest weights plus Gumbel noise that a hash of the id gives.

Long texts are split at word boundaries into chunks that are dealt to tasks apart. A chunk owns the features that start in
its words, and carries the n - 1 words that follow, so that no feature is lost or counted twice; what chunks give is summed
up by document. Short texts stay where they are.
"""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import settled, shared_numbers

#: Characters of a chunk, about: it goes on to the end of its last word.
CHUNK = 65536
#: A character of a word, and what is between words.
WORD, BETWEEN = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]", "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def _words(text: Column) -> Column:
    return F.filter(F.split(text, BETWEEN), lambda w: w != "")


def chunked(df: DataFrame, keys: list[str], n: int, size: int = CHUNK) -> DataFrame:
    """keys, part, own, carry: df's texts (column _text, in lower case) of more than size characters as rows a chunk, dealt anew; a text without words is one row without."""
    # One pass: so many characters, and the rest of the word that the last of them is in.
    cut = F.filter(F.regexp_extract_all("_text", F.lit(f"(?s).{{1,{size}}}+{WORD}*+"), F.lit(0)), lambda c: F.rlike(c, F.lit(WORD)))
    if n > 1:
        heads = F.transform(F.col("_cut"), lambda c: F.slice(_words(c), 1, n - 1))
        # Every chunk has a word, so the next n - 1 chunks' heads are enough.
        carry = F.transform(F.col("_heads"), lambda _, i: F.slice(F.flatten(F.slice(F.col("_heads"), i + 2, n - 1)), 1, n - 1))
        rows = df.withColumn("_cut", cut).withColumn("_heads", heads).withColumn("_all", F.arrays_zip(F.col("_cut").alias("cut"), carry.alias("carry")))
    else:
        rows = df.withColumn("_all", F.transform(cut, lambda c: F.struct(c.alias("cut"), F.array().cast("array<string>").alias("carry"))))
    rows = rows.select(*keys, F.posexplode_outer("_all").alias("part", "_one")).select(*keys, F.coalesce("part", F.lit(0)).alias("part"), F.col("_one.cut").alias("cut"), F.col("_one.carry").alias("carry"))
    dealt = rows.repartition(*keys, "part")
    return dealt.select(*keys, "part", _words(F.coalesce("cut", F.lit(""))).alias("own"), F.coalesce("carry", F.array().cast("array<string>")).alias("carry"))


def features_of(words: Column, carry: Column, n: int) -> Column:
    """Runs of 1 to n words that start in words; carry follows them."""
    if n == 1:
        return words
    both = F.concat(words, carry)
    starts = F.when(F.size(words) > 0, F.sequence(F.lit(1), F.size(words))).otherwise(F.array().cast("array<int>"))
    run = lambda k: F.transform(F.filter(starts, lambda i: i + (k - 1) <= F.size(both)), lambda i: F.array_join(F.slice(both, i, F.lit(k)), " "))
    return F.flatten(F.array(*(run(k) for k in range(1, n + 1))))


def bucket_of(feature: Column, buckets: int) -> Column:
    """The hash of its UTF-8 bytes, unsigned."""
    return (F.crc32(feature) % buckets).cast("int")


def _lowered(text: str) -> Column:
    return F.translate(F.coalesce(F.col(text).cast("string"), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def bucketed(docs: DataFrame, n: int, buckets: int, size: int = CHUNK, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(short, long): id, words (how many), buckets (an array) of texts in one piece; and id, digest, part besides, of each chunk of long ones."""
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), _lowered(text).alias("_text"))
    is_long = F.length("_text") > size
    none = F.array().cast("array<string>")
    short = rows.filter(~is_long).select("id", _words(F.col("_text")).alias("w")).select("id", F.size("w").cast("long").alias("words"), F.transform(features_of(F.col("w"), none, n), lambda f: bucket_of(f, buckets)).alias("buckets"))
    cut = chunked(rows.filter(is_long).withColumn("digest", F.sha2("_text", 256)), ["id", "digest"], n, size)
    long = cut.select("id", "digest", "part", F.size("own").cast("long").alias("words"), F.transform(features_of(F.col("own"), F.col("carry"), n), lambda f: bucket_of(f, buckets)).alias("buckets"))
    return short, long


def counts(pieces: tuple[DataFrame, DataFrame], buckets: int) -> list[int]:
    """How many features each bucket has: counted in place, then added up; a row a bucket comes to the driver."""
    rows = pieces[0].select("buckets").unionByName(pieces[1].select("buckets")).select(F.explode("buckets").alias("b")).groupBy("b").agg(F.count("*").alias("n"))
    out = [0] * buckets
    for b, n in rows.collect():
        out[b] = n
    return out


def gains(source: list[int], target: list[int]) -> list[int]:
    """A thousand times the logarithm of how much likelier a bucket is in the target, floored; one is added to every count."""
    k, all_source, all_target = len(source), sum(source), sum(target)
    return [math.floor(1000 * math.log(float(t + 1) * float(all_source + k) / (float(s + 1) * float(all_target + k)))) for s, t in zip(source, target, strict=True)]


def _floored(total: str, count: str) -> Column:
    """Whole-number division, down; 0 for none."""
    return F.expr(f"CASE WHEN {count} = 0 THEN 0 ELSE ({total} - pmod({total}, {count})) div {count} END")


def weighted(docs: DataFrame, target: DataFrame, n: int, buckets: int, size: int = CHUNK, doc_id: str = "doc_id", text: str = "text", target_text: str = "text") -> DataFrame:
    """id, words, n_features, weight of every row of docs."""
    pieces = bucketed(docs, n, buckets, size, doc_id, text)
    aims = bucketed(target.select(F.lit(0).alias("id"), F.col(target_text).alias("t")), n, buckets, size, "id", "t")
    table = shared_numbers(gains(counts(pieces, buckets), counts(aims, buckets)))
    total = F.aggregate("buckets", F.lit(0).cast("long"), lambda a, b: a + F.element_at(table, b + 1))
    summed = lambda df: df.withColumns({"n_features": F.size("buckets").cast("long"), "total": total}).drop("buckets")
    # Of repeated rows the chunks meet; each row of them has the same share of the sums.
    per = summed(pieces[1]).groupBy("id", "digest").agg(*(F.sum(c).alias(c) for c in ("words", "n_features", "total")), F.count_if(F.col("part") == 0).alias("rows"))
    per = per.select("id", *(F.expr(f"{c} div rows").alias(c) for c in ("words", "n_features", "total")), F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))).alias("row")).drop("row")
    return summed(pieces[0]).unionByName(per).select("id", "words", "n_features", _floored("total", "n_features").alias("weight"))


def resampled(
    docs: DataFrame, target: DataFrame, n: int = 2, buckets: int = 10_000, percent: int = 10, seed: int = 2024, least: int = 20, size: int = CHUNK, doc_id: str = "doc_id", text: str = "text", target_text: str = "text",
) -> DataFrame:
    """doc_id, n_features, weight, score, rank (from 1; null where it isn't drawn), a row for each of docs.

    percent of the documents with `least` words or more are drawn, rounded down: those with the highest scores, ties to
    smaller ids. Null texts are empty; a text without words has weight 0. Rows without an id have the hash of an empty one
    and come last among ties. Repeated rows are documents each, and tie in any order. An empty table gives no rows; with
    an empty target, gains come from the documents' counts alone. Other columns aren't read. A text of any length is
    split, but a single word never is.
    """
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    rows = weighted(docs, target, n, buckets, size, doc_id, text, target_text)
    rows = settled(rows.select("id", "n_features", "weight", (F.col("weight") + noise).alias("score"), (F.col("words") >= least).alias("able")))
    order = [F.desc("able"), F.desc("score"), F.asc_nulls_last("id")]
    parts = settled(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("range", F.spark_partition_id()))
    drawn = parts.filter("able").count() * percent // 100
    # Sizes of ranges give each one's first rank; a row a range. Only ranges with a drawn row are numbered.
    sizes = parts.groupBy("range").agg(F.count("*").alias("k")).collect()
    before, starts = 0, []
    for r, k in sorted((r["range"], r["k"]) for r in sizes):
        starts.append((r, before))
        before += k
    head = [r for r, b in starts if b < drawn]
    last = max(head, default=-1)
    found = parts.filter(F.col("range") <= last)
    first = docs.sparkSession.createDataFrame([s for s in starts if s[0] <= last], "range int, before long")
    ranked = found.join(F.broadcast(first), "range").withColumn("rank", F.row_number().over(Window.partitionBy("range").orderBy(*order)) + F.col("before"))
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    rest = parts.filter(F.col("range") > last).withColumn("rank", F.lit(None).cast("long"))
    return ranked.drop("before").unionByName(rest).select(F.col("id").alias("doc_id"), "n_features", "weight", "score", F.col("rank").cast("long").alias("rank"))
