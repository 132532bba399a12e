"""Distribution, label and model shift between sites; power curves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import finite
from .ordered import quantiles, with_quantiles


def summary(df: DataFrame, by: list[str], c: str = "x") -> DataFrame:
    """by, n, mean, std, min, max, median, q01, q99; quantiles are exact and interpolated."""
    one = df.groupBy(*by).agg(F.count(c).alias("n"), F.avg(c).alias("mean"), F.stddev_pop(c).alias("std"), F.min(c).alias("min"), F.max(c).alias("max"))
    return with_quantiles(one, df, by, c, {"median": 0.5, "q01": 0.01, "q99": 0.99})


def compression(std: Column) -> Column:
    """1 / std, infinite for zero."""
    return F.coalesce(F.try_divide(F.lit(1.0), std), F.lit(float("inf")))


def binned_power_curve(df: DataFrame, wind: str, power: str, width: float = 0.5, least: int = 20) -> DataFrame:
    """bin, wind_median, power_median, count of bins with enough rows; only finite rows with wind of zero or more."""
    rows = df.filter(finite(F.col(wind)) & finite(F.col(power)) & (F.col(wind) >= 0)).select(F.floor(F.col(wind) / width).alias("bin"), F.col(wind).alias("w"), F.col(power).alias("p"))
    out = rows.groupBy("bin").agg(F.count("*").alias("count")).filter(F.col("count") >= least)
    # Both medians at once, as two kinds of values.
    long = rows.select("bin", F.inline(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(k).cast("double").alias("x")) for k in ("w", "p")))))
    medians = quantiles(long, ["bin", "kind"], "x", {"m": 0.5}).groupBy("bin").agg(*(F.max(F.when(F.col("kind") == k, F.col("m"))).alias(name) for k, name in (("w", "wind_median"), ("p", "power_median"))))
    out = out.join(medians, "bin")
    return out.select("bin", "wind_median", "power_median", "count")


def power_scale(df: DataFrame, power: str) -> DataFrame:
    """The 99 % quantile of power's size, one row; null without a value."""
    return quantiles(df.select(F.abs(power).alias("x")), [], "x", {"power_scale": 0.99}).agg(F.max("power_scale").alias("power_scale"))


#: Knots of a curve at most: a curve is a table of bins, and is held by every task. Cells of its directory at most.
KNOTS, CELLS = 4096, 65_536


def _directory(xs: list[float]) -> tuple[float, list[int]]:
    """(scale, the cell of each knot): cells of equal width, as many as it takes to part all knots, CELLS at most."""
    gap = min(b - a for a, b in zip(xs, xs[1:], strict=False))
    cells = min(float(CELLS), (xs[-1] - xs[0]) / gap * 1.5 + 1)
    scale = cells / (xs[-1] - xs[0])
    return scale, [int((x - xs[0]) * scale) for x in xs]


def interpolate(df: DataFrame, knots: DataFrame, value: str, x: str, y: str, out: str = "expected") -> DataFrame:
    """df with the piecewise linear lookup of value: constant beyond the knots, NaN for NaN, null for null or without knots.

    All rows stay, and none is moved: the knots are constants of the plan. A directory of cells of equal width tells how
    many knots are before a value's cell, so a row is compared with the knots of its own cell alone: one at most, if the
    closest knots are no nearer than a CELLS-th of the whole. Of knots with one place, the largest counts.
    """
    points = knots.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).filter(f"{finite_sql('x')} and {finite_sql('y')}").groupBy("x").agg(F.max("y").alias("y")).limit(KNOTS + 1).collect()
    if len(points) > KNOTS:
        raise ValueError(f"a curve has {KNOTS} knots at most")
    points = sorted((p["x"], p["y"]) for p in points)
    v = F.col(value).cast("double")
    undefined = v.isNull() | F.isnan(v)
    if len(points) < 2:
        return df.withColumn(out, F.when(undefined, v).otherwise(F.lit(points[0][1])) if points else F.lit(None).cast("double"))
    xs, ys = ([p[i] for p in points] for i in (0, 1))
    scale, cells = _directory(xs)
    before, own = [0] * (cells[-1] + 1), [[] for _ in range(cells[-1] + 1)]
    for k, c in zip(xs, cells, strict=True):
        own[c].append(k)
    for c in range(1, len(own)):
        before[c] = before[c - 1] + len(own[c - 1])
    # The cell of a value is found as the knots' are, in doubles: it never decreases with the value, so knots of lower cells
    # are below it, and those of higher ones above.
    cell = F.greatest(F.lit(0), F.least(F.lit(len(own) - 1), F.floor((F.greatest(F.lit(xs[0]), F.least(F.lit(xs[-1]), v)) - xs[0]) * scale).cast("int"))) + 1
    base = F.element_at(numbers(before, "int"), cell)
    if max(map(len, own)) == 1:
        here = F.element_at(numbers([k[0] if k else float("inf") for k in own]), cell)
        below = base + F.when((here <= v) & (here < float("inf")), 1).otherwise(0)
    else:
        below = base + F.size(F.filter(F.slice(numbers(xs), base + 1, F.element_at(numbers(list(map(len, own)), "int"), cell)), lambda k: k <= v))
    shape = df.withColumn("_below", F.when(undefined, 0).otherwise(below))
    i = F.greatest(F.lit(1), F.least(F.lit(len(xs) - 1), F.col("_below")))
    at = lambda values: F.element_at(numbers(values), i)
    x0, x1, y0, y1 = at(xs[:-1]), at(xs[1:]), at(ys[:-1]), at(ys[1:])
    inside = y0 + (v - x0) / (x1 - x0) * (y1 - y0)
    found = F.when(undefined, v).when(F.col("_below") == 0, ys[0]).when(F.col("_below") == len(xs), ys[-1]).otherwise(inside)
    return shape.withColumn(out, found).drop("_below")


def numbers(values: list, kind: str = "double") -> Column:
    """An array as one constant of the plan."""
    return F.split(F.lit(",".join("Infinity" if v == float("inf") else repr(v) for v in values)), ",").cast(f"array<{kind}>")


def finite_sql(name: str) -> str:
    return f"({name} is not null and not isnan({name}) and abs({name}) < double('infinity'))"


def label_shift(df: DataFrame, by: str = "farm") -> DataFrame:
    """by, rows, positive_rate, fault_events, and mean, median, min and max of positive rows per fault event."""
    rate = df.groupBy(by).agg(F.count("*").alias("rows"), F.avg(F.col("label").cast("double")).alias("positive_rate"))
    per = df.filter("label = 1").groupBy(by, "asset_id", "event_id").agg(F.count("*").alias("d"))
    spans = per.groupBy(by).agg(F.count("*").alias("fault_events"), F.avg("d").alias("mean_duration"), F.min("d").alias("min_duration"), F.max("d").alias("max_duration"))
    spans = with_quantiles(spans, per, [by], "d", {"median_duration": 0.5})
    return rate.join(spans, by, "left").fillna(0, ["fault_events"]).select(by, "rows", "positive_rate", "fault_events", "mean_duration", "median_duration", "min_duration", "max_duration")
