"""Evaluation of fault probabilities. Predictions have event_id, asset_id, window_end, hours_to_fault, label, probability.

Anything swept over thresholds works on a histogram of scores, so that its cost is that of one pass, not one a threshold.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import with_group, with_quantiles
from .series import HORIZON_HOURS, runs

REQUIRED = ("event_id", "asset_id", "hours_to_fault", "label", "probability")


def thresholds(first: float, last: float, count: int) -> list[float]:
    """Evenly spaced, as first + i * step, the last as given."""
    step = (last - first) / (count - 1)
    return [first + i * step for i in range(count - 1)] + [last]


def prepare(df: DataFrame, model: str | None = None, split: str | None = None) -> DataFrame:
    """Checked and filtered predictions: without masked rows, probabilities within [0, 1], at least one row."""
    if missing := [c for c in REQUIRED if c not in df.columns]:
        raise ValueError(f"predictions lack {missing}")
    for name, value in (("model", model), ("split", split)):
        if value is not None:
            if name not in df.columns:
                raise ValueError(f"{name} was given, but the table has no such column")
            df = df.filter(F.col(name) == value)
    if "mask" in df.columns:
        df = df.filter(F.col("mask") != 0)
    rows, bad = df.agg(F.count("*"), F.count_if(~F.coalesce(F.col("probability").between(0, 1), F.lit(False)))).first()
    if not rows:
        raise ValueError("no rows are left")
    if bad:
        raise ValueError(f"{bad} rows have a probability below 0, above 1 or none")
    return df


def ratio(a: Column, b: Column) -> Column:
    """a / b, zero where b is."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def _f1(tp: Column, fp: Column, fn: Column) -> Column:
    return ratio(2 * tp, 2 * tp + fp + fn)


def confusion(df: DataFrame, threshold: float, strict: bool = True, by: Sequence[str] = ()) -> DataFrame:
    """tn, fp, fn, tp, accuracy, balanced_accuracy, precision, recall, f1, brier; predicted where p > (or >=) threshold."""
    hit = F.col("probability") > threshold if strict else F.col("probability") >= threshold
    yes = F.col("label") == 1
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    counts = df.groupBy(*by).agg(
        F.count_if(~yes & ~hit).alias("tn"), F.count_if(~yes & hit).alias("fp"), F.count_if(yes & ~hit).alias("fn"), F.count_if(yes & hit).alias("tp"),
        F.avg(F.pow(F.col("probability") - F.col("label"), 2)).alias("brier"),
    )
    recall = ratio(tp, tp + fn)
    return counts.select(
        *by, "tn", "fp", "fn", "tp", ratio(tp + tn, tn + fp + fn + tp).alias("accuracy"), ((recall + ratio(tn, tn + fp)) / 2).alias("balanced_accuracy"),
        ratio(tp, tp + fp).alias("precision"), recall.alias("recall"), _f1(tp, fp, fn).alias("f1"), "brier",
    )


def by_score(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """by, probability, pos, neg: how often each score comes with each label."""
    return df.groupBy(*by, "probability").agg(F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") != 1).alias("neg"))


#: Parts that scores are cut into for running sums, and the accuracy of the sketch that tells where.
PARTS, CUT_ACCURACY = 256, 10_000


def running(rows: DataFrame, by: Sequence[str], sums: dict[str, str], descending: bool = False) -> DataFrame:
    """rows (one a score) with running sums (new name -> column) by probability, within by.

    Scores are cut where a mergeable sketch sees equal shares of them, so that parts are alike in rows however scores
    cluster. Sums run within parts, and parts' totals, PARTS + 1 at most for each of by, are summed apart: no task gets
    all scores.
    """
    cuts = rows.groupBy(*by).agg(F.percentile_approx("probability", [i / PARTS for i in range(1, PARTS)], CUT_ACCURACY).alias("_cuts"))
    rows = with_group(rows, cuts, by)
    rows = rows.withColumn("_part", F.size(F.filter("_cuts", lambda c: c <= F.col("probability")))).drop("_cuts")
    way = F.desc if descending else F.asc
    inner = Window.partitionBy(*by, "_part").orderBy(way("probability"))
    outer = (Window.partitionBy(*by) if by else Window).orderBy(way("_part")).rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(*by, "_part").agg(*(F.sum(c).alias(f"_{n}") for n, c in sums.items()))
    before = totals.select(*by, "_part", *(F.coalesce(F.sum(f"_{n}").over(outer), F.lit(0)).alias(f"_{n}") for n in sums))
    out = with_group(rows, before, [*by, "_part"])
    return out.select(*(c for c in rows.columns if c != "_part"), *((F.sum(c).over(inner) + F.col(f"_{n}")).alias(n) for n, c in sums.items()))


def ranking(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """by, n, n_positive, roc_auc (ties count half), pr_auc (average precision); both null with one class."""
    rows = running(by_score(df, by), by, {"upto": "neg"})
    rows = running(rows, by, {"tp": "pos", "fp": "neg"}, True)
    p, n = F.sum("pos"), F.sum("neg")
    return rows.groupBy(*by).agg(
        (p + n).alias("n"),
        p.alias("n_positive"),
        F.when((p > 0) & (n > 0), F.sum(F.col("pos") * (F.col("upto") - F.col("neg") / 2.0)) / (p.cast("double") * n)).alias("roc_auc"),
        F.when((p > 0) & (n > 0), F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp")).cast("double")) / p).alias("pr_auc"),
    )


def swept(df: DataFrame, grid: Sequence[float], strict: bool = True, cost: Column | None = None, by: Sequence[str] = ()) -> DataFrame:
    """by, threshold, n_tp, n_fp, n_fn, n_tn, fp_weight for each threshold of the (sorted) grid.

    A row counts as predicted for the thresholds below its score (or at it), so rows are counted by how many thresholds
    that is, and the counts are summed from above: one pass and a join-free window over the grid's length.
    """
    score = F.col("probability")
    passed = F.size(F.filter(F.array(*(F.lit(float(t)) for t in grid)), lambda t: t < score if strict else t <= score))
    level = df.withColumn("level", passed).groupBy(*by, "level").agg(
        F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") != 1).alias("neg"), F.sum(F.when(F.col("label") != 1, cost if cost is not None else F.lit(1.0)).otherwise(0.0)).alias("weight")
    )
    levels = df.sparkSession.range(len(grid) + 1).select(F.col("id").cast("int").alias("level"))
    keys = df.select(*by).distinct().crossJoin(F.broadcast(levels)) if by else levels
    full = keys.join(level, [*by, "level"], "left").fillna(0, ["pos", "neg", "weight"])
    above = (Window.partitionBy(*by) if by else Window).orderBy(F.desc("level"))
    full = full.withColumns({"n_tp": F.sum("pos").over(above), "n_fp": F.sum("neg").over(above), "fp_weight": F.sum("weight").over(above)})
    whole = (Window.partitionBy(*by) if by else Window.partitionBy()).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    full = full.withColumns({"n_fn": F.sum("pos").over(whole) - F.col("n_tp"), "n_tn": F.sum("neg").over(whole) - F.col("n_fp")})
    at = F.element_at(F.array(*(F.lit(float(t)) for t in grid)), F.col("level"))
    return full.filter("level > 0").select(*by, at.alias("threshold"), "n_tp", "n_fp", "n_fn", "n_tn", "fp_weight")


COST_GRID, F1_GRID = (0.01, 0.99, 99), (0.01, 0.99, 197)


def cost_curve(df: DataFrame, cost_fn: float = 10.0, cost_fp: float = 1.0, grid: Sequence[float] | None = None, fp_cost_by_asset: dict[str, float] | None = None) -> DataFrame:
    """threshold, n_fn, n_fp, n_tp, n_tn, cost_fn_total, cost_fp_total, total_cost; predicted where p > threshold."""
    cost = F.lit(float(cost_fp))
    if fp_cost_by_asset is not None:
        known = F.create_map(*[F.lit(x) for a, c in fp_cost_by_asset.items() for x in (a, float(c))])
        missing = df.select("asset_id").distinct().filter(~F.map_contains_key(known, F.col("asset_id"))).limit(5).collect()
        if missing:
            raise ValueError(f"no false-positive cost for assets: {sorted(r[0] for r in missing)}")
        cost = F.element_at(known, F.col("asset_id"))
    rows = swept(df, grid or thresholds(*COST_GRID), True, cost)
    fn = F.col("n_fn") * float(cost_fn)
    return rows.select("threshold", "n_fn", "n_fp", "n_tp", "n_tn", fn.alias("cost_fn_total"), F.col("fp_weight").alias("cost_fp_total"), (fn + F.col("fp_weight")).alias("total_cost"))


def optimal_threshold(curve: DataFrame) -> DataFrame:
    """The first row of least total_cost."""
    return curve.orderBy("total_cost", "threshold").limit(1)


def f1_sweep(df: DataFrame, grid: Sequence[float] | None = None) -> DataFrame:
    """threshold, f1; predicted where p >= threshold."""
    rows = swept(df, grid or thresholds(*F1_GRID), False)
    return rows.select("threshold", _f1(F.col("n_tp"), F.col("n_fp"), F.col("n_fn")).alias("f1"))


def threshold_of_most_f1(df: DataFrame, grid: Sequence[float] | None = None) -> DataFrame:
    return f1_sweep(df, grid).orderBy(F.desc("f1"), "threshold").limit(1)


def threshold_among_scores(df: DataFrame) -> DataFrame:
    """threshold, f1 of the observed score with most F1, the lowest of ties; 0.5 where there is no positive row."""
    scores = by_score(df)
    rows = running(scores, [], {"tp": "pos", "fp": "neg"}, True).crossJoin(F.broadcast(scores.agg(F.sum("pos").alias("p"))))
    rows = rows.select(F.when(F.col("p") > 0, F.col("probability")).otherwise(0.5).alias("threshold"), F.round(_f1(F.col("tp"), F.col("fp"), F.col("p") - F.col("tp")), 12).alias("f1"))
    return rows.orderBy(F.desc("f1"), "threshold").limit(1)


def policy_costs(df: DataFrame, cost_fn: float = 10.0, cost_fp: float = 1.0) -> DataFrame:
    yes, no = F.count_if(F.col("label") == 1), F.count_if(F.col("label") == 0)
    return df.agg(yes.alias("n_positive_windows"), no.alias("n_negative_windows"), (yes * float(cost_fn)).alias("reactive_only_cost"), (no * float(cost_fp)).alias("always_alarm_cost"))


def cost_ratio_sensitivity(df: DataFrame, ratios: Sequence[float] = (2, 5, 10, 20, 50), grid: Sequence[float] | None = None) -> DataFrame:
    """Per ratio: the best threshold, its cost, both policies' costs, and reductions in percent. The scores are counted once for all ratios."""
    rows = swept(df, grid or thresholds(*COST_GRID)).withColumn("cost_ratio", F.explode(F.array(*(F.lit(float(r)) for r in ratios))))
    rows = rows.withColumns({
        "model_cost": F.col("n_fn") * F.col("cost_ratio") + F.col("n_fp"), "reactive": (F.col("n_fn") + F.col("n_tp")) * F.col("cost_ratio"), "always": (F.col("n_fp") + F.col("n_tn")).cast("double"),
    })
    best = rows.groupBy("cost_ratio").agg(F.min(F.struct("model_cost", "threshold", "n_fn", "n_fp", "reactive", "always")).alias("b"))
    reduced = lambda base: F.try_divide((F.col(f"b.{base}") - F.col("b.model_cost")) * 100.0, F.when(F.col(f"b.{base}") != 0, F.col(f"b.{base}")))
    return best.select(
        "cost_ratio", F.col("b.threshold").alias("model_optimal_threshold"), "b.model_cost", F.col("b.n_fn").alias("model_n_fn"), F.col("b.n_fp").alias("model_n_fp"),
        F.col("b.reactive").alias("reactive_only_cost"), F.col("b.always").alias("always_alarm_cost"),
        reduced("reactive").alias("reduction_vs_reactive_only_pct"), reduced("always").alias("reduction_vs_always_alarm_pct"),
    )


def lead_time(df: DataFrame, threshold: float, min_consecutive: int = 1, search_window_hours: float | None = None, order: Sequence = ("window_end",)) -> DataFrame:
    """One row per fault event that has rows in the search window.

    Rows run from the largest hours_to_fault to the least; the alarm is the start of the first run of min_consecutive
    rows above the threshold. An event without one is a miss, with a null lead time. An empty table gives no rows.
    """
    if min_consecutive < 1:
        raise ValueError("min_consecutive must be at least 1")
    key = ["asset_id", "event_id"]
    rows = df.filter(F.col("hours_to_fault").isNotNull())
    if search_window_hours is not None:
        rows = rows.filter(F.col("hours_to_fault") <= float(search_window_hours))
    by_time = [F.desc("hours_to_fault"), *order]
    above, near = F.col("probability") > threshold, F.col("hours_to_fault") <= HORIZON_HOURS
    numbered = rows.withColumn("_at", F.row_number().over(Window.partitionBy(*key).orderBy(*by_time)) - 1)
    first = runs(rows, key, by_time, above, None).filter(F.col("size") >= min_consecutive).groupBy(*key).agg(F.min("first").alias("alarm"))
    inner = runs(rows.filter(near), key, by_time, above, None).filter(F.col("size") >= min_consecutive).select(*key).distinct().withColumn("inside", F.lit(True))
    per = numbered.groupBy(*key).agg(
        F.count("*").alias("n_windows"), F.max("probability").alias("max_probability"), F.max(F.when(near, F.col("probability"))).alias("max_probability_in_horizon")
    )
    alarmed = numbered.join(first, key).filter("_at = alarm").select(*key, F.col("hours_to_fault").alias("lead_time_hours"))
    out = per.join(alarmed, key, "left").join(inner, key, "left")
    return out.select(
        *key, "n_windows", F.col("lead_time_hours").isNotNull().alias("detected"), "lead_time_hours", F.coalesce(F.col("lead_time_hours") <= HORIZON_HOURS, F.lit(False)).alias("within_label_horizon"),
        F.coalesce("inside", F.lit(False)).alias("alarmed_in_horizon"), "max_probability", "max_probability_in_horizon",
    )


def lead_time_summary(per_event: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row over events (or one for each of by): how many are detected, and how long before their fault."""
    lead = F.col("lead_time_hours")
    one = per_event.groupBy(*by).agg(
        F.count("*").alias("n_fault_events"), F.count_if("detected").alias("n_detected"), F.avg(F.col("detected").cast("double")).alias("detection_rate"), F.avg(lead).alias("mean_lead_time_hours"),
        F.min(lead).alias("min_lead_time_hours"), F.max(lead).alias("max_lead_time_hours"), F.count_if(F.col("detected") & (lead > HORIZON_HOURS)).alias("n_beyond_label_horizon"),
    )
    return with_quantiles(one, per_event, by, "lead_time_hours", {"median_lead_time_hours": 0.5})


def false_alarm_rate(df: DataFrame, threshold: float, min_consecutive: int = 1, hours_per_window: float = 1.0, order: Sequence = ("window_end",)) -> DataFrame:
    """One row over the events without a fault: windows, alarms, episodes (runs of min_consecutive or more), and rates."""
    key = ["asset_id", "event_id"]
    normal = df.filter(F.col("hours_to_fault").isNull())
    above = F.col("probability") > threshold
    per = normal.groupBy(*key).agg(F.count("*").alias("w"), F.count_if(above).alias("a"))
    episodes = runs(normal, key, list(order), above, None).filter(F.col("size") >= min_consecutive).groupBy(*key).agg(F.count("*").alias("e"))
    per = per.join(episodes, key, "left").fillna(0, ["e"])
    windows, alarms, found, alarmed = F.coalesce(F.sum("w"), F.lit(0)), F.coalesce(F.sum("a"), F.lit(0)), F.coalesce(F.sum("e"), F.lit(0)), F.count_if(F.col("e") > 0)
    return per.agg(
        F.count("*").alias("n_normal_events"), windows.alias("n_normal_windows"), alarms.alias("n_alarm_windows"), F.try_divide(alarms.cast("double"), windows).alias("window_alarm_rate"),
        found.alias("n_alarm_episodes"), F.try_divide(found * 1000.0, windows * float(hours_per_window)).alias("episodes_per_1000h"), alarmed.alias("n_events_with_alarm"),
        F.try_divide(alarmed.cast("double"), F.count("*")).alias("event_alarm_rate"),
    )


def operating_points(df: DataFrame, grid: Sequence[float], min_consecutive: int = 1, hours_per_window: float = 1.0) -> DataFrame:
    """Lead time and false alarms at each threshold of the grid, one row each.

    Rows are sorted twice, however many thresholds there are: by time to the fault for events with one, by time for the
    others. A run above a threshold starts where the least of the next min_consecutive scores is above it, so that one
    number a row decides for all thresholds; then rows are aggregated by event and threshold.
    """
    if min_consecutive < 1:
        raise ValueError("min_consecutive must be at least 1")
    key, points = ["asset_id", "event_id"], F.array(*(F.lit(float(t)) for t in grid))
    score = F.coalesce("probability", F.lit(float("-inf")))

    def starts(rows: DataFrame, order: list) -> DataFrame:
        """rows with _least (of the run that could start here), _before (the score before) and _at."""
        w = Window.partitionBy(*key).orderBy(*order)
        ahead = w.rowsBetween(0, min_consecutive - 1)
        full = F.count("*").over(ahead) == min_consecutive
        return rows.withColumn("_p", score).withColumns({"_least": F.when(full, F.min("_p").over(ahead)).otherwise(float("-inf")), "_before": F.lag("_p", 1, float("-inf")).over(w), "_at": F.row_number().over(w)})

    def swept_events(rows: DataFrame) -> DataFrame:
        return rows.withColumn("threshold", F.explode(points))

    hit = F.col("_least") > F.col("threshold")
    faults = swept_events(starts(df.filter(F.col("hours_to_fault").isNotNull()), [F.desc("hours_to_fault"), F.asc("window_end")]))
    lead = faults.groupBy(*key, "threshold").agg(F.min(F.when(hit, F.struct("_at", "hours_to_fault"))).alias("alarm"))
    lead = lead.select("threshold", F.col("alarm").isNotNull().alias("detected"), F.col("alarm.hours_to_fault").alias("lead_time_hours"))
    lead = lead_time_summary(lead, ["threshold"]).select("threshold", "n_fault_events", "detection_rate", "median_lead_time_hours", "mean_lead_time_hours")

    quiet = swept_events(starts(df.filter(F.col("hours_to_fault").isNull()), [F.asc("window_end")]))
    per = quiet.groupBy(*key, "threshold").agg(F.count("*").alias("w"), F.count_if(F.col("_p") > F.col("threshold")).alias("a"), F.count_if(hit & ~(F.col("_before") > F.col("threshold"))).alias("e"))
    alarmed = F.count_if(F.col("e") > 0)
    alarms = per.groupBy("threshold").agg(
        F.try_divide(F.sum("a").cast("double"), F.sum("w")).alias("window_alarm_rate"), F.try_divide(F.sum("e") * 1000.0, F.sum("w") * float(hours_per_window)).alias("episodes_per_1000h"),
        F.try_divide(alarmed.cast("double"), F.count("*")).alias("event_alarm_rate"),
    )
    all_points = df.sparkSession.range(1).select(F.explode(points).alias("threshold"))
    out = all_points.join(lead, "threshold", "left").join(alarms, "threshold", "left").fillna(0, ["n_fault_events"])
    return out.select("threshold", F.lit(min_consecutive).alias("min_consecutive"), "n_fault_events", "detection_rate", "median_lead_time_hours", "mean_lead_time_hours", "window_alarm_rate", "episodes_per_1000h", "event_alarm_rate")


def breakdown(df: DataFrame, threshold: float, by: str = "asset_id") -> DataFrame:
    """Metrics for each value of by, and for all rows as `ALL`; predicted where p > threshold. Null groups are left out but for `ALL`."""
    if by not in df.columns:
        raise ValueError(f"no column {by}")
    both = df.withColumn(by, F.explode(F.array(F.col(by).cast("string"), F.lit("ALL")))).filter(F.col(by).isNotNull())
    scored = confusion(both, threshold, True, [by]).select(by, "precision", "recall", "f1")
    ranked = ranking(both, [by])
    return ranked.join(scored, by).select(by, "n", "n_positive", (F.col("n_positive") / F.col("n")).alias("positive_rate"), "roc_auc", "pr_auc", "precision", "recall", "f1")


def brier_score(df: DataFrame) -> DataFrame:
    return df.agg(F.avg(F.pow(F.col("probability") - F.col("label"), 2)).alias("brier_score"))


def reliability_table(df: DataFrame, n_bins: int = 10) -> DataFrame:
    """bin_lower, bin_upper, count, mean_predicted, observed_rate; empty bins stay. A score's bin is the number of inner edges at most it."""
    edges = [i * (1.0 / n_bins) for i in range(n_bins)] + [1.0]
    inner = F.array(*(F.lit(e) for e in edges[1:-1]))
    rows = df.withColumn("bin", F.size(F.filter(inner, lambda e: e <= F.col("probability")))).groupBy("bin")
    rows = rows.agg(F.count("*").alias("count"), F.avg("probability").alias("mean_predicted"), F.avg(F.col("label").cast("double")).alias("observed_rate"))
    at = lambda shift: F.element_at(F.array(*(F.lit(e) for e in edges)), F.col("bin") + shift)
    bins = df.sparkSession.range(n_bins).select(F.col("id").cast("int").alias("bin"))
    return bins.join(rows, "bin", "left").select(at(1).alias("bin_lower"), at(2).alias("bin_upper"), F.coalesce("count", F.lit(0)).alias("count"), "mean_predicted", "observed_rate")


def calibration_error(table: DataFrame) -> DataFrame:
    gap = F.abs(F.col("mean_predicted") - F.col("observed_rate"))
    return table.agg(F.try_divide(F.sum(F.col("count") * gap), F.sum("count")).alias("ece"), F.count_if(F.col("count") > 0).alias("n_bins_populated"))
