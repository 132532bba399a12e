"""Exact duplicates by deterministic block naming.

A text is cut into blocks of fixed size. Blocks with one 64-bit hash are sorted, and a block's name is the hash with
its place among the different blocks of that hash, so that two blocks share a name only if their bytes are equal. Then
adjacent names are paired, and the pairs are named in the same way, level by level, until one name is left for each
document. Names never depend on partitioning.

The bytes are shuffled once, by hash. Blocks that are more than a 1/50,000 of all blocks (at most 50,000 hashes, so at
most 50 MB of bytes) are named apart and joined by broadcast, so no task gets a hot block's copies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import settled, text_of, unused

BLOCK = 1024
#: A hash is hot from this share of all blocks on; fewer than its inverse can be hot.
HOT_SHARE = 50_000
HOT_LEAST = 64


def _place(key: str, *order: str) -> Column:
    return F.dense_rank().over(Window.partitionBy(key).orderBy(*order))


def _named_blocks(rows: DataFrame, block: int) -> DataFrame:
    """rows: rid, doc_id, sha, body (binary) -> rid, n, idx, h, r, doc_id and sha (both with idx 0 only)."""
    n = F.greatest(F.lit(1), F.ceil(F.length("body") / block)).cast("int")
    cut = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.substring(F.col("body"), i * block + 1, F.lit(block)))
    blocks = (
        rows.withColumn("n", n)
        .select("rid", "n", "doc_id", "sha", F.posexplode(cut).alias("idx", "block"))
        .withColumn("h", F.xxhash64("block"))
        .withColumns({c: F.when(F.col("idx") == 0, F.col(c)) for c in ("doc_id", "sha")})
    )
    counts = settled(blocks.groupBy("h").agg(F.count("*").alias("c")).filter(F.col("c") > HOT_LEAST))
    total = rows.select(F.sum(n).alias("c")).first()["c"] or 0
    hot = counts.filter(F.col("c") * HOT_SHARE > total).select("h", F.lit(True).alias("hot"))
    marked = blocks.join(F.broadcast(hot), "h", "left")
    cold = marked.filter(F.col("hot").isNull()).withColumn("r", _place("h", "block"))
    contents = marked.filter("hot").select("h", "block").distinct().withColumn("r", _place("h", "block"))
    warm = marked.filter("hot").join(F.broadcast(contents), ["h", "block"])
    keep = ["rid", "n", "idx", "h", "r", "doc_id", "sha"]
    return cold.select(keep).unionByName(warm.select(keep))


def _named_pairs(names: DataFrame) -> DataFrame:
    """One level up: name each two adjacent names, the last of an odd number alone."""
    pairs = names.groupBy("rid", F.shiftright("idx", 1).alias("idx")).agg(
        *(F.max(F.when(F.col("idx") % 2 == side, F.struct("h", "r"))).alias(f"side{side}") for side in (0, 1))
    )
    pairs = pairs.withColumn("pair", F.struct("side0", "side1")).withColumn("h", F.xxhash64("side0", "side1")).select("rid", "idx", "h", "pair")
    clashes = pairs.groupBy("h").agg(F.min("pair").alias("a"), F.max("pair").alias("b")).filter(F.col("a") != F.col("b")).select("h")
    clashes = settled(clashes)
    if clashes.isEmpty():
        return pairs.select("rid", "idx", "h", F.lit(1).alias("r"))
    ranks = pairs.join(clashes, "h", "left_semi").select("h", "pair").distinct().withColumn("r", _place("h", "pair"))
    return pairs.join(ranks, ["h", "pair"], "left").select("rid", "idx", "h", F.coalesce("r", F.lit(1)).alias("r"))


def identities(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """Per row: rid, doc_id, sha (binary), level, h, r. Rows have the same (level, h, r) if and only if their texts are equal."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(text).alias("t")).select(
        F.monotonically_increasing_id().alias("rid"), "doc_id", F.unhex(F.sha2("t", 256)).alias("sha"), F.encode("t", "UTF-8").alias("body")
    )
    base = settled(_named_blocks(rows, block))
    most = base.agg(F.max("n")).first()[0] or 1
    level, names = 0, base.filter("n > 1").select("rid", "idx", "h", "r")
    found = base.filter("n = 1").select("rid", F.lit(0).alias("level"), "h", "r", "doc_id", "sha")
    if most > 1:
        ends = None
        while most > 1:
            level, most = level + 1, (most + 1) // 2
            names = settled(_named_pairs(names))
            size = names.groupBy("rid").agg(F.max("idx").alias("last"), F.first("h").alias("h"), F.first("r").alias("r"))
            done = size.filter("last = 0").select("rid", F.lit(level).alias("level"), "h", "r")
            ends = done if ends is None else ends.unionByName(done)
            if most > 1:
                names = names.join(size.filter("last > 0").select("rid"), "rid", "left_semi")
        found = found.unionByName(base.filter("n > 1 and idx = 0").select("rid", "doc_id", "sha").join(ends, "rid"))
    return found


def _grouped(docs: DataFrame, doc_id: str, text: str, block: int) -> DataFrame:
    """Per row of docs: doc_id, sha, top (the row that stays: doc_id, rid), group_size, kept.

    Groups of more than a 1/HOT_SHARE of all rows, of which there are fewer than HOT_SHARE, are joined by broadcast, so no
    task gets the copies of one text.
    """
    found = settled(identities(docs, doc_id, text, block))
    key = ["level", "h", "r"]
    groups = settled(found.groupBy(key).agg(F.max(F.struct("doc_id", "rid")).alias("top"), F.count("*").alias("group_size")))
    total = groups.agg(F.sum("group_size")).first()[0] or 0
    hot = groups.filter((F.col("group_size") > HOT_LEAST) & (F.col("group_size") * HOT_SHARE > total))
    one = found.join(F.broadcast(hot), key)
    two = found.join(F.broadcast(hot.select(key)), key, "left_anti").join(groups, key)
    return one.unionByName(two).withColumn("kept", F.col("top.rid") == F.col("rid"))


def exact_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """Per row: doc_id, keep_id, group_size, kept, text_sha256. Of equal texts the row with the largest id stays.

    Null texts count as empty, so all of them and the empty ones are one group. Null ids are smaller than any other, and
    a group of null ids alone keeps a null. Rows repeated with id and text are one group, of which one row stays. A text
    of any length is cut into blocks, so no task names a long one by itself. Other columns are not read, whatever their
    names. An empty table gives no rows.
    """
    return _grouped(docs, doc_id, text, block).select("doc_id", F.col("top.doc_id").alias("keep_id"), "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """The rows that exact_duplicates() keeps, with all their columns, whatever their names.

    Of rows repeated with id and text any one stays; null ids are equal to each other here and smaller than any other, so
    a row without an id stays only where its text has no id at all. Null texts are empty; of them and the empty ones one
    row stays. An empty table stays empty.
    """
    grouped = settled(_grouped(docs, doc_id, text, block))
    i, s, n = unused("kept_id", docs), unused("kept_sha", docs), unused("kept_number", docs)
    keys = grouped.filter("kept").select(F.col("doc_id").alias(i), F.lower(F.hex("sha")).alias(s))
    same = F.col(doc_id).cast("long").eqNullSafe(F.col(i)) & (F.lower(F.sha2(text_of(text), 256)) == F.col(s))
    rows = docs.join(keys, same, "left_semi")
    if not grouped.filter(~F.col("kept") & F.col("doc_id").eqNullSafe(F.col("top.doc_id"))).isEmpty():
        # Rows repeated with their id: their other columns may differ, or may not be comparable, so they are numbered.
        order = Window.partitionBy(F.col(doc_id).cast("long"), F.sha2(text_of(text), 256)).orderBy(F.monotonically_increasing_id())
        rows = rows.withColumn(n, F.row_number().over(order)).filter(F.col(n) == 1).drop(n)
    return rows
