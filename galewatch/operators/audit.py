"""Audits of raw channels and of event boundaries, and data contracts as counts of violations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import same_word
from .ordered import with_quantiles
from .scans import placed, runs, steps


def melted(df: DataFrame, keys: list[str], channels: list[str]) -> DataFrame:
    """keys, channel, x."""
    return df.unpivot(keys, channels, "channel", "x")


def channel_audit(df: DataFrame, channels: list[str], sample: int | None = None, order: str | None = None) -> DataFrame:
    """Per channel: rows, missing, infinite, zeros, negatives, min, max, constant, median, q01, q99 of finite values (or of a systematic sample of each)."""
    long = melted(df, [order] if order else [], channels)
    x = F.col("x")
    nan, inf = x.isNull() | F.isnan(x), F.abs(x) == float("inf")
    good = F.when(~nan & ~inf, x)
    picked = good
    if sample is not None:
        long = systematic(long.withColumn("x", x), "channel", order, sample)
        picked = F.when(F.col("_picked"), good)
    out = long.groupBy("channel").agg(
        F.count("*").alias("rows"), F.count_if(nan).alias("missing"), F.count_if(~nan & inf).alias("infinite"), F.count_if(good == 0).alias("zeros"), F.count_if(good < 0).alias("negatives"),
        F.min(good).alias("min"), F.max(good).alias("max"), (F.min(good) == F.max(good)).alias("constant"), 
    )
    return with_quantiles(out, long.select("channel", picked.alias("picked")), ["channel"], "picked", {"median": 0.5, "q01": 0.01, "q99": 0.99})


def systematic(df: DataFrame, by: str, order: str, count: int) -> DataFrame:
    """_picked: every step-th finite row of each group in order, up to count, where step is a count-th of the group."""
    fine = F.coalesce(~F.isnan("x") & (F.abs("x") < float("inf")), F.lit(False))
    rows = placed(df.withColumn("_fine", fine), [by, "_fine"], [order], out="_n")
    total = rows.groupBy(F.col(by).alias("_by"), F.col("_fine").alias("_too")).agg(F.count("*").alias("_total"))
    met = rows.join(total, F.col(by).eqNullSafe(F.col("_by")) & (F.col("_fine") == F.col("_too")))
    step = F.greatest(F.lit(1), F.floor(F.col("_total") / count))
    return met.withColumn("_picked", F.col("_fine") & (F.pmod(F.col("_n"), step) == 0) & (F.col("_n") / step < count)).select(*df.columns, "_picked")


def longest_zero_runs(df: DataFrame, by: str, order: str, value: str) -> DataFrame:
    """by, longest: the longest run of zeros; a missing value breaks a run."""
    found = runs(df, [by], [order], F.col(value) == 0).groupBy(by).agg(F.max("size").alias("longest"))
    return df.select(by).distinct().join(found, by, "left").fillna(0, ["longest"])


def missing_share(df: DataFrame, columns: list[str]) -> DataFrame:
    """channel, missing_pct, most missing first; columns of any type."""
    one = df.agg(*((F.avg(F.col(c).isNull().cast("double")) * 100).alias(c) for c in columns))
    return one.unpivot([], columns, "channel", "missing_pct").orderBy(F.desc("missing_pct"), "channel")


def frequency_check(df: DataFrame, c: Column, by: list[str] = [], low: float = 45.0, high: float = 55.0, nominal: float = 50.0, tolerance: float = 0.5) -> DataFrame:  # noqa: B006
    """by, plausible, implausible, median_hz (of plausible values), passed."""
    rows = df.select(*by, c.alias("_hz")).withColumn("_good", F.when(F.col("_hz").between(low, high), F.col("_hz")))
    one = rows.groupBy(*by).agg(F.count("_good").alias("plausible"), F.count_if(~F.col("_hz").between(low, high)).alias("implausible"))
    out = with_quantiles(one, rows, by, "_good", {"median_hz": 0.5})
    return out.withColumn("passed", F.coalesce(F.abs(F.col("median_hz") - nominal) <= tolerance, F.lit(False)))


def validity(df: DataFrame, c: str) -> DataFrame:
    """valid_fraction, and min, median and max of a feature that is null where it isn't valid."""
    one = df.agg(F.avg(F.col(c).isNotNull().cast("double")).alias("valid_fraction"), F.min(c).alias("min"), F.max(c).alias("max"))
    return with_quantiles(one, df, [], c, {"median": 0.5}).select("valid_fraction", "min", "median", "max")


def resolved_boundaries(readings: DataFrame, events: DataFrame) -> DataFrame:
    """events (event_id, start_id, end_id) with start_ts, end_ts and a failure, from readings (event_id, row_pos, ts, train_test).

    Both rows come from one equality join on (event_id, row_pos). Failures in order: id, range, order, time, split.
    """
    ends = events.select("event_id", F.explode(F.array("start_id", "end_id")).alias("row_pos")).distinct()
    at = readings.join(ends, ["event_id", "row_pos"]).select("event_id", "row_pos", "ts", same_word(F.col("train_test"), "prediction").alias("ok"))
    one, two = (at.select("event_id", F.col("row_pos").alias(f"{n}_id"), F.col("ts").alias(f"{n}_ts"), F.col("ok").alias(f"{n}_ok")) for n in ("start", "end"))
    out = events.join(one, ["event_id", "start_id"], "left").join(two, ["event_id", "end_id"], "left")
    failure = (
        F.when(F.col("start_id").isNull() | F.col("end_id").isNull(), "id").when(F.col("start_id") > F.col("end_id"), "order").when(F.col("start_ok").isNull() | F.col("end_ok").isNull(), "range")
        .when(F.col("start_ts").isNull() | F.col("end_ts").isNull() | (F.col("start_ts") > F.col("end_ts")), "time").when(~(F.col("start_ok") & F.col("end_ok")), "split")
    )
    return out.select("event_id", "start_id", "end_id", "start_ts", "end_ts", failure.alias("failure"))


def violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """rule, violations: rows for which a rule isn't true; all rules in one pass."""
    one = df.agg(*(F.count_if(~F.coalesce(ok, F.lit(False))).alias(name) for name, ok in rules.items()))
    return one.unpivot([], list(rules), "rule", "violations")


def single_asset(df: DataFrame, event: str = "event_id", asset: str = "asset_id") -> DataFrame:
    """event, assets, ok: each event has exactly one distinct asset; nulls don't count."""
    return df.groupBy(event).agg(F.count_distinct(asset).alias("assets")).withColumn("ok", F.col("assets") == 1)


def aligned(one: DataFrame, two: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Whether two tables agree row by row: missing on either side, and different values."""
    a, b = one.select(*keys, F.col(value).alias("_a"), F.lit(True).alias("_l")), two.select(*keys, F.col(value).alias("_b"), F.lit(True).alias("_r"))
    return a.join(b, keys, "full_outer").agg(
        F.count("*").alias("rows"), F.count_if(F.col("_l").isNull()).alias("only_right"), F.count_if(F.col("_r").isNull()).alias("only_left"),
        F.count_if(F.col("_l") & F.col("_r") & ~F.col("_a").eqNullSafe(F.col("_b"))).alias("different"),
    )


def stays_apart(df: DataFrame, asset: str = "asset_id", split: str = "split") -> DataFrame:
    """asset, splits of assets that are in more than one split."""
    return df.groupBy(asset).agg(F.count_distinct(split).alias("splits")).filter("splits > 1")


def boundary_audit(resolved: DataFrame, events: DataFrame) -> DataFrame:
    """event_id, failure, mismatch: resolved boundaries against times written in events (event_id, event_start, event_end as text)."""
    written = events.select("event_id", *(F.col(c).try_cast("timestamp_ntz").alias(f"_{c}") for c in ("event_start", "event_end")))
    differ = [F.when(~F.col(f"_{c}").eqNullSafe(F.col(r)), F.lit(c)) for c, r in (("event_start", "start_ts"), ("event_end", "end_ts"))]
    both = resolved.join(written, "event_id", "left")
    return both.select("event_id", "failure", F.when(F.col("failure").isNull(), F.concat_ws(",", *differ)).alias("mismatch"))


def export_ready(missing_files: DataFrame, boundaries: DataFrame, frequency: DataFrame) -> DataFrame:
    """ready: no event lacks its file, no boundary failed, and the frequency audit passed."""
    one = missing_files.agg(F.count("*").alias("missing")).crossJoin(boundaries.agg(F.count("failure").alias("failed"))).crossJoin(frequency.select("passed"))
    return one.select("missing", "failed", "passed", ((F.col("missing") == 0) & (F.col("failed") == 0) & F.col("passed")).alias("ready"))


def calibration_failure(site: Column, uses_curve: Column, has_curve: Column, allowed: Column, curve_site: Column, setting: Column, source: str = "C", needed: str = "train-normal") -> Column:
    """Why an export with a power residual isn't allowed, else null: the zero-shot guard for many exports at once.

    A curve of a target site needs to be allowed explicitly, given or not. One that is given has to be of the export's
    site; the source site's own has to come from its normal training rows.
    """
    target = site != source
    return F.when(~uses_curve, None).when(target & ~allowed, "not allowed").when(~has_curve, None).when(~curve_site.eqNullSafe(site), "other site").when(~target & ~setting.eqNullSafe(F.lit(needed)), "setting")


def input_violations(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, rule, violations: missing, text that is no number, NaN and infinite inputs of a score, and an empty table (one)."""
    found = {}
    for c in columns:
        text = F.trim(F.col(c).cast("string"))
        x = text.try_cast("double")
        found |= {
            (c, "missing"): F.count_if(text.isNull()), (c, "number"): F.count_if(text.isNotNull() & x.isNull()), (c, "nan"): F.count_if(F.coalesce(F.isnan(x), F.lit(False))),
            (c, "infinite"): F.count_if(F.coalesce(F.abs(x) == float("inf"), F.lit(False))), (c, "empty"): (F.count("*") == 0).cast("long"),
        }
    one = df.agg(*(v.alias(f"v{i}") for i, v in enumerate(found.values())))
    each = F.array(*(F.struct(F.lit(c).alias("column"), F.lit(rule).alias("rule"), F.col(f"v{i}").alias("violations")) for i, (c, rule) in enumerate(found)))
    return one.select(F.inline(each))


def require_calibration(uses_target: bool, allowed: bool, provenance: dict | None) -> None:
    """Zero-shot guard: calibration on the target needs an explicit flag and a record of where it comes from."""
    if uses_target and not allowed:
        raise ValueError("calibration on the target site must be allowed explicitly")
    if uses_target and not provenance:
        raise ValueError("calibration on the target site needs its provenance")


def require_dimension(df: DataFrame, features: str, expected: int) -> None:
    """All feature arrays have the model's dimension, or ValueError."""
    bad = df.filter(F.col(features).isNull() | (F.size(features) != expected)).limit(1).count()
    if bad:
        raise ValueError(f"{features} must have {expected} values in every row")
