"""Maintenance priority: smoothed risk, degradation slope, access burden and criticality, combined linearly and ranked."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import finite, require_non_negative, require_positive
from .ordered import numbered
from .series import trailing_mean


@dataclass(frozen=True)
class Weights:
    """Of fault risk, degradation, access cost and criticality."""

    w1: float = 1.0
    w2: float = 1.0
    w3: float = 1.0
    w4: float = 1.0

    def __post_init__(self) -> None:
        for name, value in vars(self).items():
            require_non_negative(value, name)


@dataclass(frozen=True)
class Access:
    base: float = 1.0
    transport: float = 0.0
    logistics: float = 0.0
    offshore_premium: float = 1.5
    multiplier: float = 1.0

    def __post_init__(self) -> None:
        for name in ("base", "transport", "logistics"):
            require_non_negative(getattr(self, name), name)
        for name in ("offshore_premium", "multiplier"):
            require_positive(getattr(self, name), name)


@dataclass(frozen=True)
class Criticality:
    capacity_weight: float = 1.0
    output_weight: float = 1.0
    reference_capacity: float = 1.0
    reference_output: float = 1.0

    def __post_init__(self) -> None:
        for name in ("capacity_weight", "output_weight"):
            require_non_negative(getattr(self, name), name)
        for name in ("reference_capacity", "reference_output"):
            require_positive(getattr(self, name), name)


def checked(value: Column, ok: Column, message: str) -> Column:
    """value, or an error where ok isn't true. The check is part of the value, so it can't be pruned."""
    return F.when(F.coalesce(ok, F.lit(False)), value).otherwise(F.raise_error(F.lit(message)).cast("double"))


def access_cost(farm_type: Column, config: Access = Access()) -> Column:  # noqa: B008
    kind = F.lower(F.trim(farm_type))
    cost = (config.base + config.transport + config.logistics) * config.multiplier
    return F.when(kind == "onshore", F.lit(cost)).when(kind == "offshore", F.lit(cost * config.offshore_premium)).otherwise(F.raise_error(F.lit("farm type must be onshore or offshore")).cast("double"))


def criticality(capacity: Column | None = None, output: Column | None = None, config: Criticality = Criticality()) -> Column:  # noqa: B008
    """Weighted shares of reference capacity and output; an absent term is zero, and one is needed."""
    if capacity is None and output is None:
        raise ValueError("capacity or output is needed")
    terms = []
    for value, weight, reference in ((capacity, config.capacity_weight, config.reference_capacity), (output, config.output_weight, config.reference_output)):
        if value is not None:
            terms.append(checked(value, finite(value) & (value >= 0), "capacity and output must be finite and non-negative") * weight / reference)
    return terms[0] if len(terms) == 1 else terms[0] + terms[1]


def priority_score(risk: Column, degradation: Column, access: Column, critical: Column, weights: Weights = Weights(), **override: float) -> Column:  # noqa: B008
    """w1 risk + w2 degradation - w3 access + w4 criticality, from left to right. Values must be finite."""
    w = Weights(**{**vars(weights), **override})
    terms = [checked(c, finite(c), "inputs of the score must be finite numbers") for c in (risk, degradation, access, critical)]
    return w.w1 * terms[0] + w.w2 * terms[1] - w.w3 * terms[2] + w.w4 * terms[3]


def with_priority(df: DataFrame, risk: str = "fault_risk", degradation: str = "degradation_rate", access: str = "access_cost", critical: str = "criticality", out: str = "priority_score", weights: Weights = Weights()) -> DataFrame:  # noqa: B008
    if missing := [c for c in (risk, degradation, access, critical) if c not in df.columns]:
        raise ValueError(f"missing columns: {missing}")
    return df.withColumn(out, priority_score(*map(F.col, (risk, degradation, access, critical)), weights))


def ranked(df: DataFrame, score: str = "priority_score", tie: str = "asset_id", places: int = 6) -> DataFrame:
    """rank by score, largest first, ties by tie; scores are rounded first, so that equal ones are equal.

    Ranks of parts of the scores' range are counted apart, so that the sort is distributed.
    """
    rows = df.withColumn(score, F.round(score, places))
    return numbered(rows, [], [F.desc(score), F.col(tie)], "rank").withColumn("rank", F.col("rank") + 1)


def degradation_rate(value: str, hours: Column) -> Column:
    """The slope of value by hours, by least squares; an aggregate. Null below two points."""
    return F.regr_slope(F.col(value), hours)


def fleet_signals(predictions: DataFrame, key: str = "asset_id", time: str = "ts", value: str = "probability", horizon_hours: float = 6.0, timestep_hours: float = 1 / 6) -> DataFrame:
    """key, n, fault_risk (the last smoothed value), degradation_rate (slope of the smoothed values by row number times the step). Assets with one row are left out."""
    smooth = trailing_mean(predictions, [key], time, value, horizon_hours, timestep_hours)
    row = F.row_number().over(Window.partitionBy(key).orderBy(time)) - 1
    smooth = smooth.withColumn("_h", row * timestep_hours)
    return smooth.groupBy(key).agg(F.count("*").alias("n"), F.max_by("smoothed", time).alias("fault_risk"), degradation_rate("smoothed", F.col("_h")).alias("degradation_rate")).filter("n > 1")
