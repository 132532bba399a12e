"""Exact order statistics and row numbers over any number of rows.

Rows are sorted into ranges, written with the number of their range, and counted range by range; a range's first place is
the sum of the sizes before it. No task gets more than a range, even if there is only one group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.files import settled_rows


def _ranges(df: DataFrame, by: Sequence[str], order: Sequence, size: str | Column | None = None) -> tuple[DataFrame, DataFrame]:
    """df in ranges (_part), and by, _part, _before, _all: rows, the sum of size, or an aggregate of a range's rows, before the range and in the group."""
    parts = df.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order).withColumn("_part", F.spark_partition_id())
    parts = settled_rows(parts)
    sizes = parts.groupBy(*by, "_part").agg((F.count("*") if size is None else F.sum(size) if isinstance(size, str) else size).alias("_size"))
    group = Window.partitionBy(*by)
    before = F.sum("_size").over(group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    whole = F.sum("_size").over(group.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return parts, sizes.select(*by, "_part", F.coalesce(before, F.lit(0)).alias("_before"), whole.alias("_all"))


def _same(one: DataFrame, two: DataFrame, names: Sequence[str]) -> DataFrame:
    """one with two's other columns, where names are equal or null on both sides; two is broadcast: it has a row a range and group."""
    two = two.select(*(F.col(n).alias(f"_is_{n}") for n in names), *(c for c in two.columns if c not in names))
    met = one.join(F.broadcast(two), [one[n].eqNullSafe(two[f"_is_{n}"]) for n in names])
    return met.drop(*(f"_is_{n}" for n in names))


def numbered(df: DataFrame, by: Sequence[str], order: Sequence, out: str, ties: bool = False) -> DataFrame:
    """df with a row number from 0 within by, in an order (columns or expressions) that tells rows apart; with ties, equal rows have one number, and order are names of columns without nulls."""
    inner = Window.partitionBy(*by, "_part").orderBy(*order)
    if ties:
        # A range has all rows that are equal in the order.
        parts, before = _ranges(df, by, order, F.count_distinct(*order))
        at = F.dense_rank().over(inner)
    else:
        parts, before = _ranges(df, by, order)
        at = F.row_number().over(inner)
    return _same(parts, before, [*by, "_part"]).withColumn(out, (at - 1 + F.col("_before")).cast("long")).drop("_part", "_before", "_all")


#: Groups of so many values at most are sorted as they are; of larger ones a sketch with this accuracy tells where to look.
SMALL, ACCURACY = 10_000, 10_000
#: Groups of more rows are met by broadcast: there is one of them at most in so many rows.
LARGE = 1_000_000
#: How far beside a wanted share the sketch is asked, which is more than its error.
BESIDE = 4 / ACCURACY


def quantile_arrays(df: DataFrame, by: Sequence[str], value: str, shares: Sequence[float], out: str = "q") -> DataFrame:
    """by, out (the exact interpolated quantiles of value at ascending shares); nulls don't count, NaN is largest, and groups without a value have no row.

    Two scans and no sort of the whole: a mergeable sketch bounds each wanted place, and only values within bounds are told
    apart and sorted; those between bounds are only counted. Were a bound wrong, a place would be found among the counted
    ones, which is an error, not another result.
    """
    shares, by = [float(p) for p in shares], list(by)
    if not shares or sorted(shares) != shares or shares[0] < 0 or shares[-1] > 1:
        raise ValueError("shares must ascend from 0 to 1")
    cells = told_apart(df, by, value, shares)
    end = F.sum(F.col("_c") + F.col("_g")).over(Window.partitionBy(*by).orderBy(F.asc_nulls_first("_v")))
    cells = cells.withColumn("_end", end).withColumn("_start", F.col("_end") - F.col("_c") - F.col("_g"))
    place = lambda i: F.element_at(F.array(*map(F.lit, shares)), F.floor(i / 2).cast("int") + 1) * (F.col("_n") - 1)
    rank = lambda i: F.when(i % 2 == 0, F.floor(place(i))).otherwise(F.ceil(place(i)))
    hits = F.filter(F.sequence(F.lit(0), F.lit(2 * len(shares) - 1)), lambda i: (rank(i) >= F.col("_start")) & (rank(i) < F.col("_end")))
    cells = cells.withColumn("_i", F.explode(hits))
    exact = F.when(rank(F.col("_i")) < F.col("_start") + F.col("_c"), F.col("_v")).otherwise(F.raise_error(F.lit("a sketch's bound was wrong")).cast("double"))
    found = cells.select(*by, "_n", F.struct("_i", exact.alias("v")).alias("_hit")).groupBy(*by, "_n").agg(F.sort_array(F.collect_list("_hit")).alias("_hits"))

    def between(j):
        low, high = (F.element_at("_hits", (2 * j + k).cast("int"))["v"] for k in (1, 2))
        p = F.element_at(F.array(*map(F.lit, shares)), (j + 1).cast("int")) * (F.col("_n") - 1)
        share = p - F.floor(p)
        return F.when((share == 0) | (low == high), low).otherwise(low * (1 - share) + high * share)

    return found.select(*by, F.transform(F.sequence(F.lit(0), F.lit(len(shares) - 1)), between).alias(out))


def told_apart(df: DataFrame, by: Sequence[str], value: str, shares: Sequence[float]) -> DataFrame:
    """by, _n (all values of the group), _v, _c, _g: how often each value within bounds of a wanted place is there, and how many lie between it and the next bound."""
    rows = df.select(*by, F.col(value).cast("double").alias("_x")).filter("_x is not null")
    below, above = ([min(1.0, max(0.0, p + d)) for p in shares] for d in (-BESIDE, BESIDE))
    whole = F.nanvl("_x", F.lit(float("inf")))
    seen = rows.groupBy(*by).agg(
        F.count("*").alias("_n"), F.min("_x").alias("_least"), F.max("_x").alias("_most"), F.percentile_approx(whole, [*below, *above], ACCURACY).alias("_near")
    )
    few, k = F.col("_n") <= SMALL, F.lit(len(shares))
    seen = seen.select(*by, "_n", F.when(few, F.array("_least")).otherwise(F.slice("_near", 1, k)).alias("_low"), F.when(few, F.array("_most")).otherwise(F.transform(F.slice("_near", k + 1, k), lambda h: F.when(h < float("inf"), h).otherwise(F.col("_most")))).alias("_high"))
    met = with_group(rows, seen, by, F.col("_n") > LARGE)
    # Bounds ascend: the last range that begins at or below a value is the one it may be in.
    at = F.size(F.filter("_low", lambda k: k <= F.col("_x")))
    met = met.withColumn("_at", at).withColumn("_top", F.when(F.col("_at") > 0, F.element_at("_high", F.greatest(F.lit(1), F.col("_at")))))
    told = F.coalesce(F.col("_x") <= F.col("_top"), F.lit(False))
    cells = met.select(*by, "_n", F.when(told, F.col("_x")).otherwise(F.col("_top")).alias("_v"), told.alias("_told"))
    return cells.groupBy(*by, "_n", "_v").agg(F.count_if("_told").alias("_c"), F.count_if(~F.col("_told")).alias("_g"))


def with_group(rows: DataFrame, one: DataFrame, by: Sequence[str], large: Column | None = None) -> DataFrame:
    """rows with the columns of their group's row in one; without by there is a single one.

    large: a condition that few of one's rows meet, those of large groups. They are broadcast, so that no task gets all rows of a large group.
    """
    if not by:
        return rows.crossJoin(F.broadcast(one))
    other = one.select(*(F.col(n).alias(f"_of_{n}") for n in by), *(c for c in one.columns if c not in by))
    same, names = [rows[n].eqNullSafe(other[f"_of_{n}"]) for n in by], [f"_of_{n}" for n in by]
    if large is None:
        return rows.join(other, same).drop(*names)
    many = other.filter(large)
    rest = rows.join(F.broadcast(many.select(*names)), same, "left_anti")
    return rows.join(F.broadcast(many), same).drop(*names).unionByName(rest.join(other.filter(~large), same).drop(*names))


def quantiles(df: DataFrame, by: Sequence[str], value: str, wanted: dict[str, float]) -> DataFrame:
    """by, and the exact interpolated quantiles of value by name, as quantile_arrays."""
    shares = sorted(set(wanted.values()))
    found = quantile_arrays(df, by, value, shares, "_q")
    return found.select(*by, *(F.col("_q")[shares.index(q)].alias(name) for name, q in wanted.items()))


def with_quantiles(one: DataFrame, df: DataFrame, by: Sequence[str], value: str, wanted: dict[str, float]) -> DataFrame:
    """one (a row for each of by, or a single row) with quantiles of df's value; null where a group has none."""
    found = quantiles(df, by, value, wanted)
    if not by:
        # A single row on both sides; an aggregate, so that it is there without values too.
        return one.crossJoin(F.broadcast(found.agg(*(F.max(n).alias(n) for n in wanted))))
    found = found.select(*(F.col(n).alias(f"_of_{n}") for n in by), *wanted)
    return one.join(found, [one[n].eqNullSafe(found[f"_of_{n}"]) for n in by], "left").drop(*(f"_of_{n}" for n in by))
