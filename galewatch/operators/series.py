"""Operators over time series: deduplication, windows, gaps, fills, runs, labels."""

from __future__ import annotations

from collections.abc import Sequence
from math import gcd

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import epoch_seconds, from_epoch
from . import scans
from .ordered import numbered
from .scans import filled, runs  # noqa: F401  part of this module's operators

#: Fixed values of the temporal contract, in seconds and rows.
INTERVAL, LOOKBACK, HORIZON_HOURS, STRIDE, LENGTH, COVERAGE, GAP = 600, 86400, 48.0, 3600, 144, 0.95, 1800
DAY = 86400


def first_per_time(df: DataFrame, keys: list[str], time: str, position: str) -> DataFrame:
    """Of readings with one time, the one that comes first in the file. Rows without a time go."""
    order = Window.partitionBy(*keys, time).orderBy(position)
    return df.filter(F.col(time).isNotNull()).withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def candidates(events: DataFrame, stride: int = STRIDE, interval: int = INTERVAL, lookback: int = LOOKBACK) -> DataFrame:
    """(event columns, end_s, start_s): window ends each stride from the event's start (start_s0) to one interval before its end (end_s0)."""
    ends = F.when(F.col("end_s0") - interval >= F.col("start_s0"), F.sequence("start_s0", F.col("end_s0") - interval, F.lit(stride).cast("long")))
    return events.withColumn("end_s", F.explode(ends)).withColumn("start_s", F.col("end_s") - lookback + interval)


def judged_windows(readings: DataFrame, events: DataFrame, key: str, length: int = LENGTH, coverage: float = COVERAGE, gap: int = GAP, interval: int = INTERVAL, stride: int = STRIDE, lookback: int = LOOKBACK) -> DataFrame:
    """(key, end_s, start_s, n_rows, max_gap, n_valid, reason) for each candidate window.

    readings: key, s (seconds), x; events: one row a key. Reasons in order: endpoint (no reading at its end), coverage, gap,
    valid, else keep. Coverage counts all readings in the window, on the grid or not. The stride has to be a multiple of
    the interval.

    Readings are summed up by pieces of time between which no window begins or ends, so that pieces, not readings, are
    copied to the windows they are in, and no task gets all readings of a key.
    """
    if stride % interval:
        raise ValueError("the stride must be a multiple of the interval")
    unit = gcd(stride, lookback)
    wide = candidates(events, stride, interval, lookback)
    near = readings.select(key, "s", "x").join(events.select(key, "start_s0", "end_s0"), key).filter(F.col("s").between(F.col("start_s0") - lookback, F.col("end_s0")))
    # The n-th unit ends n units after the event's start; windows begin one interval after a unit does.
    unit_no = F.ceil((F.col("s") - F.col("start_s0")) / unit)
    near = near.withColumn("n", unit_no).withColumn("late", F.col("s") - F.col("start_s0") - (F.col("n") - 1) * unit >= interval)
    near = near.withColumn("step", F.col("s") - F.lag("s").over(Window.partitionBy(key, "n", "late").orderBy("s")))
    on_grid = F.pmod(F.col("start_s0") - F.col("s"), F.lit(interval)) == 0
    pieces = near.groupBy(key, "start_s0", "n", "late").agg(
        F.count("*").alias("rows"), F.count_if(on_grid & F.col("x").isNotNull()).alias("valid"), F.min("s").alias("first"), F.max("s").alias("last"), F.coalesce(F.max("step"), F.lit(0)).alias("inner")
    )
    pieces = pieces.withColumn("before", F.lag("last").over(Window.partitionBy(key).orderBy("first")))
    final = F.col("n") + (lookback // unit - 2) + F.col("late").cast("int")
    pieces = pieces.withColumn("end", F.explode(F.when(final >= F.col("n"), F.sequence("n", final)))).filter(F.pmod(F.col("end") * unit, F.lit(stride)) == 0)
    pieces = pieces.withColumn("end_s", F.col("start_s0") + F.col("end") * unit)
    across = F.when(F.col("before") >= F.col("end_s") - lookback + interval, F.col("first") - F.col("before"))
    seen = pieces.groupBy(key, "end_s").agg(
        F.sum("rows").alias("n_rows"), F.max(F.greatest("inner", across)).alias("max_gap"), F.sum("valid").alias("n_valid"), F.max((F.col("last") == F.col("end_s")).cast("int")).alias("ends")
    )
    out = wide.select(key, "start_s", "end_s").join(seen, [key, "end_s"], "left").fillna(0, ["n_rows", "max_gap", "n_valid", "ends"])
    reason = F.when(F.col("ends") == 0, "endpoint").when(F.col("n_rows") < coverage * length, "coverage").when(F.col("max_gap") > gap, "gap").when(F.col("n_valid") == 0, "valid").otherwise("keep")
    return out.select(key, "end_s", "start_s", "n_rows", "max_gap", "n_valid", reason.alias("reason"))


def window_features(readings: DataFrame, events: DataFrame, windows: DataFrame, key: str, interval: int = INTERVAL, stride: int = STRIDE, lookback: int = LOOKBACK) -> DataFrame:
    """(key, end_s, n, mean, std, min, max, last, change) of the readings' x in each window that has some.

    readings: key, s, x; events: key, start_s0, end_s0; windows: key, end_s. std is the population's, change is last less
    first; missing values don't count, and of readings at one second the lesser value is first. As in judged_windows,
    readings are summed up by pieces of time, and pieces are merged by window: two for each unit of the lookback at most.
    """
    unit = gcd(stride, lookback)
    near = readings.select(key, "s", F.col("x").cast("double").alias("x")).filter("x is not null and not isnan(x)").join(events.select(key, "start_s0", "end_s0"), key).filter(F.col("s").between(F.col("start_s0") - lookback, F.col("end_s0")))
    near = near.withColumn("n", F.ceil((F.col("s") - F.col("start_s0")) / unit))
    near = near.withColumn("late", F.col("s") - F.col("start_s0") - (F.col("n") - 1) * unit >= interval)
    at = F.struct("s", "x")
    pieces = near.groupBy(key, "start_s0", "n", "late").agg(
        F.struct(F.count("*").cast("double").alias("n"), F.avg("x").alias("mean"), (F.var_pop("x") * F.count("*")).alias("m2"), F.min("x").alias("low"), F.max("x").alias("high"), F.min(at).alias("first"), F.max(at).alias("last")).alias("piece")
    )
    final = F.col("n") + (lookback // unit - 2) + F.col("late").cast("int")
    pieces = pieces.withColumn("end", F.explode(F.when(final >= F.col("n"), F.sequence("n", final)))).filter(F.pmod(F.col("end") * unit, F.lit(stride)) == 0)
    pieces = pieces.select(key, (F.col("start_s0") + F.col("end") * unit).alias("end_s"), "piece")
    merged = pieces.join(windows.select(key, "end_s"), [key, "end_s"], "left_semi").groupBy(key, "end_s").agg(F.sort_array(F.collect_list(F.struct(F.col("piece.first.s").alias("s"), "piece"))).alias("all"))

    def merge(a, row):
        b = row["piece"]
        total, apart = a["n"] + b["n"], b["mean"] - a["mean"]
        return F.struct(
            total.alias("n"), (a["mean"] + apart * b["n"] / total).alias("mean"), (a["m2"] + b["m2"] + apart * apart * a["n"] * b["n"] / total).alias("m2"),
            F.least(a["low"], b["low"]).alias("low"), F.greatest(a["high"], b["high"]).alias("high"), F.least(a["first"], b["first"]).alias("first"), F.greatest(a["last"], b["last"]).alias("last"),
        )

    found = merged.withColumn("f", F.aggregate(F.slice("all", 2, F.size("all")), F.col("all")[0]["piece"], merge))
    f = F.col("f")
    return found.select(key, "end_s", f["n"].cast("long").alias("n"), f["mean"].alias("mean"), F.sqrt(f["m2"] / f["n"]).alias("std"), f["low"].alias("min"), f["high"].alias("max"), f["last"]["x"].alias("last"), (f["last"]["x"] - f["first"]["x"]).alias("change"))


def grid(windows: DataFrame, key: str, readings: DataFrame, interval: int = INTERVAL, keep: Sequence[str] = ()) -> DataFrame:
    """(key, end_s, timestep_idx, s, x, and the windows' columns to keep): each window's dense steps, with readings where there are any.

    A window meets readings by day, with the list of those of its own grid: a row for each second of an interval's multiple,
    more only where several readings are of one second. Steps are made after that, so windows are shuffled and steps never are.
    """
    phase = lambda s: F.pmod(F.col(s), F.lit(interval))
    lists = readings.select(key, "s", "x").groupBy(key, F.floor(F.col("s") / DAY).alias("_day"), phase("s").alias("_phase")).agg(F.collect_list(F.struct("s", "x")).alias("_seen"))
    days = F.sequence(F.floor(F.col("start_s") / DAY), F.floor(F.col("end_s") / DAY))
    pieces = windows.select(key, "end_s", "start_s", *keep, phase("start_s").alias("_phase"), F.explode(days).alias("_day"))
    # Dealt out even where lists are broadcast: each row makes many.
    met = pieces.repartition(key, "_day", "_phase").join(lists, [key, "_day", "_phase"], "left")
    start, step = F.col("start_s"), F.lit(interval)
    first = F.greatest(F.lit(0), F.ceil((F.col("_day") * DAY - start) / step)).cast("int")
    last = F.floor((F.least(F.col("end_s"), (F.col("_day") + 1) * DAY - 1) - start) / step).cast("int")
    met = met.withColumns({"_first": first, "_last": last}).filter("_first <= _last")
    place = lambda s: ((s - start) / step).cast("int")
    met = met.withColumn("_own", F.filter("_seen", lambda r: place(r["s"]).between(F.col("_first"), F.col("_last"))))
    # Steps without a reading by their numbers; readings by theirs, from -1 down.
    steps = F.sequence("_first", "_last")
    rest = F.array_except(steps, F.transform("_own", lambda r: place(r["s"])))
    both = F.concat(rest, F.transform("_own", lambda r, i: -1 - i))
    # A column before it is exploded, so that the explosion is compiled.
    met = met.withColumn("_all", F.when(F.size("_own") > 0, both).otherwise(steps))
    out = met.select(key, "end_s", "start_s", *keep, "_own", F.explode("_all").alias("_at"))
    out = out.withColumn("_read", F.when(F.col("_at") < 0, F.get("_own", -1 - F.col("_at"))))
    number = F.when(F.col("_at") < 0, place(F.col("_read.s"))).otherwise(F.col("_at"))
    out = out.withColumn("timestep_idx", number)
    return out.select(key, "end_s", *keep, "timestep_idx", (start + F.col("timestep_idx") * step).alias("s"), F.col("_read.x").alias("x"))


def trailing_mean(df: DataFrame, keys: list[str], order: str, value: str, horizon_hours: float = 6.0, timestep_hours: float = 1 / 6, out: str = "smoothed") -> DataFrame:
    """The mean of the last round(horizon / timestep) rows, fewer at the start. Rows, not time; causal."""
    return scans.trailing_mean(df, keys, order, value, max(int(round(horizon_hours / timestep_hours)), 1), out)


def horizon_label(anomaly: Column, hours: Column, horizon: float = HORIZON_HOURS) -> Column:
    return F.when(anomaly & (hours > 0) & (hours <= horizon), 1).otherwise(0)


def numbered_windows(windows: DataFrame, key: str, split: Column, event_id: Column) -> DataFrame:
    """key, end_s, start_s, anomaly, end_s0, split, event_id, sequence_idx: windows numbered from 0 in each split, by event and window end.

    windows: candidates() of events with anomaly. Those of one event and end, whatever their key, have one number.
    """
    rows = windows.select(key, "end_s", "start_s", "anomaly", "end_s0", split.alias("split"), event_id.cast("long").alias("event_id"))
    return numbered(rows, ["split"], ["event_id", "end_s"], "sequence_idx", ties=True)


def timestep_metadata(steps: DataFrame, events: DataFrame | None, key: str, farm: Column, split: Column, event_id: Column, mask: Column, horizon: float = HORIZON_HOURS) -> DataFrame:
    """One row a step of every sequence: farm, split, sequence_idx, timestep_idx, asset_id, event_id, window_end, event_end,
    fault_time, hours_to_fault, label, mask.

    steps: key, end_s, timestep_idx, s (grid()), and what mask needs; events: key, anomaly, end_s0. farm, split and
    event_id are expressions over both. The time of a fault, and the hours to it, are null for normal events. Sequences
    are numbered from 0 in each split, by event and window end.

    Without events, steps are those of numbered_windows(), whose columns they kept: nothing is shuffled then.
    """
    rows = steps
    if events is not None:
        rows = steps.join(events.select(key, "anomaly", "end_s0"), key).withColumns({"split": split, "event_id": event_id.cast("long")})
        order = numbered(rows.select("split", "event_id", "end_s").distinct(), ["split"], ["event_id", "end_s"], "sequence_idx")
        rows = rows.join(order, ["split", "event_id", "end_s"])
    rows = rows.withColumns({"farm": F.upper(farm), "mask": mask.cast("int"), "event_end": from_epoch(F.col("end_s0")), "window_end": from_epoch(F.col("s"))})
    hours = F.when(F.col("anomaly"), (F.col("end_s0") - F.col("s")) / 3600.0)
    return rows.select(
        "farm", "split", "sequence_idx", "timestep_idx", F.col(key).alias("asset_id"), "event_id", "window_end", "event_end", F.when(F.col("anomaly"), F.col("event_end")).alias("fault_time"),
        hours.alias("hours_to_fault"), horizon_label(F.col("anomaly"), hours, horizon).alias("label"), "mask",
    )


def time_order(ts: str = "ts") -> Column:
    return epoch_seconds(F.col(ts))


def continuity(df: DataFrame, keys: list[str], time: str, interval: int = INTERVAL) -> DataFrame:
    """Per keys: rows, invalid_times, duplicates (nulls count as one value), gaps over the interval, max_gap in seconds."""
    s = epoch_seconds(F.col(time))
    distinct = df.withColumn("_s", s).groupBy(*keys, "_s").agg(F.count("*").alias("_c"))
    step = F.col("_s") - F.lag("_s").over(Window.partitionBy(*keys).orderBy("_s"))
    stepped = distinct.withColumn("_step", F.when(F.col("_s").isNotNull(), step))
    return stepped.groupBy(*keys).agg(
        F.sum("_c").alias("rows"),
        F.sum(F.when(F.col("_s").isNull(), F.col("_c")).otherwise(0)).alias("invalid_times"),
        (F.sum("_c") - F.count("*")).alias("duplicates"),
        F.count_if(F.col("_step") > interval).alias("gaps"),
        F.coalesce(F.max("_step"), F.lit(0)).alias("max_gap"),
    )
