"""Scans over long series, by parts of time.

A series is cut where its time passes a multiple of a width. Tasks work on parts; of each part a summary row (how many
rows, the last value and its place, the open run) goes on to the parts after it, and what a part needs from before or
after it comes back by a join. So one key with all rows is spread over as many tasks as it has parts, and a task holds a
part's rows, or a key's summary rows, never a key's rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, TimestampNTZType, TimestampType

from ..functions.scalars import epoch_seconds

#: A part's width, in seconds of a time or units of a number.
PART = 7 * 86400
#: Windows of a chunk of rows, and the least rows that a chunk has: what precedes a chunk is copied to it.
CHUNK_WINDOWS, CHUNK_LEAST = 16, 1024


def part_of(df: DataFrame, time: str, width: int = PART) -> Column:
    """The part of a row: by whole widths of a time or number. Another type isn't cut."""
    kind = df.schema[time].dataType
    if isinstance(kind, TimestampType | TimestampNTZType):
        return F.floor(epoch_seconds(F.col(time)) / width)
    if isinstance(kind, NumericType):
        return F.floor(F.col(time) / width).cast("long")
    return F.lit(0).cast("long")


def _carried(rows: DataFrame, keys: Sequence[str], summary: DataFrame, names: Sequence[str]) -> DataFrame:
    """rows with the columns of their part's row in summary."""
    two = summary.select(*(F.col(k).alias(f"_is_{k}") for k in (*keys, "_part")), *names)
    met = rows.join(two, [rows[k].eqNullSafe(two[f"_is_{k}"]) for k in (*keys, "_part")])
    return met.drop(*(f"_is_{k}" for k in (*keys, "_part")))


def _in_parts(df: DataFrame, keys: Sequence[str], order: Sequence, width: int) -> tuple[DataFrame, Window, Window]:
    """df with _part and _row (from 1 in its part); a part's rows in order, and a key's summary rows in order."""
    rows = df.withColumn("_part", part_of(df, order[0], width))
    inner = Window.partitionBy(*keys, "_part").orderBy(*order)
    return rows.withColumn("_row", F.row_number().over(inner)), Window.partitionBy(*keys, "_part").orderBy("_row"), Window.partitionBy(*keys).orderBy(F.asc_nulls_first("_part"))


def placed(df: DataFrame, keys: Sequence[str], order: Sequence, width: int = PART, out: str = "_place") -> DataFrame:
    """df with each row's number from 0 within keys, in order (of which the first column cuts it)."""
    rows, _, outer = _in_parts(df, keys, order, width)
    sizes = rows.groupBy(*keys, "_part").agg(F.count("*").alias("_size"))
    before = F.coalesce(F.sum("_size").over(outer.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    met = _carried(rows, keys, sizes.withColumn("_before", before), ["_before"])
    return met.withColumn(out, (F.col("_row") - 1 + F.col("_before")).cast("long")).drop("_row", "_before", "_part")


def filled(df: DataFrame, keys: Sequence[str], order: str, value: str, limit: int | None = 2, width: int = PART) -> DataFrame:
    """value forward- and then backward-filled over at most limit rows (None: any number), within keys.

    A missing row takes the last value at most limit rows before it, else the next one at most limit rows after it: what a
    forward fill reaches always follows a value, so a backward fill after it takes values alone.
    """
    rows, inner, outer = _in_parts(df, keys, [order], width)
    there = F.when(F.col(value).isNotNull(), F.struct(F.col("_row").alias("at"), F.col(value).alias("v")))
    rows = rows.withColumn("_own", there)
    summary = rows.groupBy(*keys, "_part").agg(F.count("*").alias("_size"), F.min("_own.at").alias("_a"), F.max("_own.at").alias("_z"), F.min_by(value, "_own.at").alias("_first"), F.max_by(value, "_own.at").alias("_last"))
    before = F.coalesce(F.sum("_size").over(outer.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    summary = summary.withColumn("_before", before)
    ends = lambda at, v: F.when(F.col(at).isNotNull(), F.struct((F.col(at) + F.col("_before")).alias("at"), F.col(v).alias("v")))
    summary = summary.withColumns({"_a": ends("_a", "_first"), "_z": ends("_z", "_last")})
    summary = summary.withColumns({"_prior": F.last("_z", True).over(outer.rowsBetween(Window.unboundedPreceding, -1)), "_next": F.first("_a", True).over(outer.rowsBetween(1, Window.unboundedFollowing))})
    met = _carried(rows, keys, summary, ["_before", "_prior", "_next"])
    here = lambda c: F.when(c.isNotNull(), F.struct((c["at"] + F.col("_before")).alias("at"), c["v"].alias("v")))
    met = met.withColumns({"_back": F.last("_own", True).over(inner.rowsBetween(Window.unboundedPreceding, 0)), "_ahead": F.first("_own", True).over(inner.rowsBetween(0, Window.unboundedFollowing))})
    back, ahead = F.coalesce(here(F.col("_back")), F.col("_prior")), F.coalesce(here(F.col("_ahead")), F.col("_next"))
    at = F.col("_row") + F.col("_before")
    near = lambda c, far: c["v"] if limit is None else F.when(far <= limit, c["v"])
    return met.withColumn(value, F.coalesce(near(back, at - back["at"]), near(ahead, ahead["at"] - at))).select(*df.columns)


def runs(df: DataFrame, keys: Sequence[str], order: Sequence, flag: Column, width: int | None = PART) -> DataFrame:
    """One row per run of rows with the flag: keys, first (its number from 0), size. A null flag breaks a run.

    The first of order has to be a column's name. With a width of None, for short series alone, keys aren't cut and order may hold expressions.
    """
    on = F.coalesce(flag, F.lit(False))
    if width is None:
        numbered = df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).withColumn("_on", on)
        lit = numbered.filter("_on").withColumn("_run", F.col("_n") - F.row_number().over(Window.partitionBy(*keys).orderBy("_n")))
        return lit.groupBy(*keys, "_run").agg((F.min("_n") - 1).alias("first"), F.count("*").alias("size")).drop("_run")
    rows, inner, outer = _in_parts(df.withColumn("_on", on), keys, order, width)
    lit = rows.filter("_on").withColumn("_run", F.col("_row") - F.row_number().over(inner))
    pieces = lit.groupBy(*keys, "_part", "_run").agg(F.min("_row").alias("_a"), F.max("_row").alias("_z"))
    sizes = rows.groupBy(*keys, "_part").agg(F.count("*").alias("_size"))
    before = F.coalesce(F.sum("_size").over(outer.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    met = _carried(pieces, keys, sizes.withColumn("_before", before), ["_size", "_before"])
    met = met.select(*keys, (F.col("_a") + F.col("_before") - 1).alias("first"), (F.col("_z") + F.col("_before") - 1).alias("_end"), ((F.col("_a") == 1) | (F.col("_z") == F.col("_size"))).alias("_edge"))
    # A part has two runs at its edges at most; those that touch are one.
    w = Window.partitionBy(*keys).orderBy("first")
    edge = met.filter("_edge").withColumn("_new", F.coalesce(F.col("first") != F.lag("_end").over(w) + 1, F.lit(True)).cast("int"))
    edge = edge.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    joined = edge.groupBy(*keys, "_run").agg(F.min("first").alias("first"), F.max("_end").alias("_end")).drop("_run")
    whole = met.filter("not _edge").select(*keys, "first", "_end").unionByName(joined)
    return whole.select(*keys, "first", (F.col("_end") - F.col("first") + 1).alias("size"))


def trailing_mean(df: DataFrame, keys: Sequence[str], order: str, value: str, rows: int, out: str = "smoothed", width: int = PART) -> DataFrame:
    """The mean of the last `rows` rows, fewer at the start; nulls don't count. The rows before a chunk are copied to it."""
    size = max(CHUNK_WINDOWS * rows, CHUNK_LEAST)
    at = placed(df, keys, [order], width)
    chunk = F.floor(F.col("_place") / size)
    both = F.when(F.col("_place") % size > size - rows, F.array(chunk, chunk + 1)).otherwise(F.array(chunk))
    spread = at.withColumn("_chunk", F.explode(both)).withColumn("_own", F.col("_chunk") == F.floor(F.col("_place") / size))
    mean = F.avg(value).over(Window.partitionBy(*keys, "_chunk").orderBy("_place").rowsBetween(-(rows - 1), 0))
    return spread.withColumn(out, mean).filter("_own").select(*(c for c in df.columns if c != out), out)


def steps(df: DataFrame, keys: Sequence[str], place: str, width: int = PART) -> DataFrame:
    """df (a whole number `place` a row, different within keys) with _step: how far the row before it is; null for the first."""
    rows = df.withColumn("_part", F.floor(F.col(place) / width))
    inner = Window.partitionBy(*keys, "_part").orderBy(place)
    outer = Window.partitionBy(*keys).orderBy(F.asc_nulls_first("_part"))
    last = rows.groupBy(*keys, "_part").agg(F.max(place).alias("_last"))
    last = last.withColumn("_prior", F.lag("_last").over(outer))
    met = _carried(rows, keys, last, ["_prior"])
    return met.withColumn("_step", F.col(place) - F.coalesce(F.lag(place).over(inner), "_prior")).drop("_part", "_prior")
