"""Logistic regression by Newton's method: gradient and Hessian are one aggregate a step.

Missing values take the column's exact median, columns are scaled to mean 0 and deviation 1, classes are balanced by
weights, and all coefficients but the intercept have an L2 penalty. The loss is strictly convex then, so there is one
solution, and steps go on until the gradient has vanished.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import require_positive
from .ordered import quantile_arrays

#: Features at most: the driver solves for as many unknowns.
MOST_FEATURES = 1000


@dataclass
class Logistic:
    """What a row goes through: medians for missing values, means, deviations, coefficients, intercept."""

    columns: list[str]
    medians: list[float]
    means: list[float]
    deviations: list[float]
    coefficients: list[float]
    intercept: float
    steps: int = 0

    def dumps(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def loads(cls, text: str) -> Logistic:
        return cls(**json.loads(text))

    def probability(self) -> Column:
        """Of the columns, by their names."""
        z = F.lit(self.intercept)
        for name, median, mean, deviation, w in zip(self.columns, self.medians, self.means, self.deviations, self.coefficients, strict=True):
            z = z + (known(name, median) - mean) / deviation * w
        return 1 / (1 + F.exp(-z))


def known(name: str, median: float) -> Column:
    """A number, or the median for null and NaN."""
    x = F.col(name).cast("double")
    return F.when(x.isNull() | F.isnan(x), F.lit(float(median))).otherwise(x)


def medians(df: DataFrame, columns: Sequence[str]) -> list[float]:
    """Exact medians of all columns at once; nulls and NaN don't count, and a column of nothing else has 0."""
    pairs = F.inline(F.array(*(F.struct(F.lit(i).alias("i"), F.col(c).cast("double").alias("x")) for i, c in enumerate(columns))))
    long = df.select(pairs).filter("x is not null and not isnan(x)")
    found = {r["i"]: r["q"][0] for r in quantile_arrays(long, ["i"], "x", [0.5]).collect()}
    return [found.get(i, 0.0) for i in range(len(columns))]


def class_weights(df: DataFrame, label: str) -> dict[int, float]:
    """n / (classes * n of the class), for labels 0 and 1; both have to be there."""
    counts = {int(r["label"]): r["n"] for r in df.groupBy(F.col(label).cast("int").alias("label")).agg(F.count("*").alias("n")).limit(3).collect() if r["label"] is not None}
    if set(counts) != {0, 1}:
        raise ValueError("labels must be 0 and 1, and both must be there")
    return {k: sum(counts.values()) / (2 * n) for k, n in counts.items()}


def _moments(beta: np.ndarray, weights: dict[int, float]):
    """Rows (y, x scaled) -> position, value: of loss, gradient and the Hessian's rows, summed up over a task."""
    k = len(beta)

    def run(batches):
        total = np.zeros(1 + k + k * k)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.column_stack([batch.column("x").flatten().to_numpy().reshape(batch.num_rows, -1), np.ones(batch.num_rows)])
            y = batch.column("y").to_numpy()
            s = np.where(y == 1, weights[1], weights[0])
            z = x @ beta
            p = 1 / (1 + np.exp(-z))
            total[0] += (s * (np.logaddexp(0, z) - y * z)).sum()
            total[1 : k + 1] += x.T @ (s * (p - y))
            total[k + 1 :] += ((x * (s * p * (1 - p))[:, None]).T @ x).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["i", "v"])

    return run


def fit(df: DataFrame, columns: Sequence[str], label: str = "label", c: float = 1.0, tolerance: float = 1e-9, most: int = 100) -> Logistic:
    """The balanced, scaled and penalised model: least of |w|^2 / 2 + c * weighted loss.

    Rows without a label don't count. A column that doesn't vary has deviation 1. Each step is one job; a step that
    doesn't lower the objective is halved. An error, if the gradient is above tolerance (for each row) after `most` jobs.
    """
    for name, value in (("c", c), ("tolerance", tolerance), ("most", most)):
        require_positive(value, name)
    columns = list(columns)
    if not 0 < len(columns) <= MOST_FEATURES:
        raise ValueError(f"there may be 1 to {MOST_FEATURES} features")
    df = df.filter(F.col(label).isNotNull())
    weights, middle = class_weights(df, label), medians(df, columns)
    filled = df.select(F.col(label).cast("double").alias("y"), *(known(n, m).alias(f"x{i}") for i, (n, m) in enumerate(zip(columns, middle, strict=True))))
    one = filled.agg(F.count("*").alias("n"), *(f(f"x{i}").alias(f"{k}{i}") for i in range(len(columns)) for k, f in (("m", F.avg), ("s", F.stddev_pop)))).first()
    means, deviations = [one[f"m{i}"] for i in range(len(columns))], [one[f"s{i}"] or 1.0 for i in range(len(columns))]
    rows = filled.select("y", F.array(*((F.col(f"x{i}") - m) / s for i, (m, s) in enumerate(zip(means, deviations, strict=True)))).alias("x"))
    k = len(columns) + 1
    penalty = np.array([1.0] * len(columns) + [0.0])

    def at(beta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        sums = rows.mapInArrow(_moments(beta, weights), "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
        total = np.zeros(1 + k + k * k)
        for r in sums:
            total[r["i"]] = r["v"]
        return c * total[0] + (penalty * beta**2).sum() / 2, c * total[1 : k + 1] + penalty * beta, c * total[k + 1 :].reshape(k, k) + np.diag(penalty)

    beta, jobs = np.zeros(k), 1
    value, gradient, hessian = at(beta)
    while np.abs(gradient).max() > tolerance * c * one["n"]:
        step = np.linalg.solve(hessian, gradient)
        share = 1.0
        while True:
            if jobs == most:
                raise ValueError(f"no solution within {most} jobs")
            new = beta - share * step
            found, jobs = at(new), jobs + 1
            # Near the solution the objective no longer tells steps apart.
            if found[0] <= value + 1e-12 * abs(value):
                break
            share /= 2
        beta, (value, gradient, hessian) = new, found
    return Logistic(columns, middle, means, deviations, beta[:-1].tolist(), float(beta[-1]), jobs)


def solution_sql(rows: str, columns: Sequence[str], label: str = "label", steps: int = 12) -> str:
    """CTEs that give the table `solved` (b0, b1 and the intercept b2, m0, m1, d0, d1) for two features of the table `rows`: Newton's steps, unrolled."""
    a, b = columns
    x, y, s, z = "((x0 - m0) / d0)", "((x1 - m1) / d1)", "s", f"(b0 * ((x0 - m0) / d0) + b1 * ((x1 - m1) / d1) + b2)"
    p = f"(1 / (1 + exp(-{z})))"
    h = f"{s} * {p} * (1 - {p})"
    steps_sql = []
    for r in range(steps):
        steps_sql.append(f"""g{r} AS MATERIALIZED (SELECT b0, b1, b2, sum({s} * ({p} - y) * {x}) + b0 AS u, sum({s} * ({p} - y) * {y}) + b1 AS v, sum({s} * ({p} - y)) AS w,
    sum({h} * {x} * {x}) + 1 AS xx, sum({h} * {x} * {y}) AS xy, sum({h} * {x}) AS x1, sum({h} * {y} * {y}) + 1 AS yy, sum({h} * {y}) AS y1, sum({h}) AS o FROM scaled, n{r} GROUP BY b0, b1, b2)""")
        det = "(xx * (yy * o - y1 * y1) - xy * (xy * o - y1 * x1) + x1 * (xy * y1 - yy * x1))"
        new0 = "(u * (yy * o - y1 * y1) - xy * (v * o - y1 * w) + x1 * (v * y1 - yy * w))"
        new1 = "(xx * (v * o - y1 * w) - u * (xy * o - y1 * x1) + x1 * (xy * w - v * x1))"
        new2 = "(xx * (yy * w - v * y1) - xy * (xy * w - v * x1) + u * (xy * y1 - yy * x1))"
        steps_sql.append(f"n{r + 1} AS MATERIALIZED (SELECT b0 - {new0} / {det} AS b0, b1 - {new1} / {det} AS b1, b2 - {new2} / {det} AS b2 FROM g{r})")
    return f"""med AS (SELECT median({a}) AS q0, median({b}) AS q1, count(*) AS n, count(*) FILTER ({label} = 1) AS yes FROM {rows}),
whole AS (SELECT coalesce({a}, q0) AS x0, coalesce({b}, q1) AS x1, {label}::DOUBLE AS y, CASE WHEN {label} = 1 THEN n / (2.0::DOUBLE * yes) ELSE n / (2.0::DOUBLE * (n - yes)) END AS s FROM {rows}, med),
dev AS (SELECT avg(x0) AS m0, avg(x1) AS m1, stddev_pop(x0) AS d0, stddev_pop(x1) AS d1 FROM whole),
scaled AS MATERIALIZED (SELECT * FROM whole, dev), n0 AS (SELECT 0.0::DOUBLE AS b0, 0.0::DOUBLE AS b1, 0.0::DOUBLE AS b2),
{", ".join(steps_sql)},
solved AS (SELECT b0, b1, b2, m0, m1, d0, d1, q0, q1 FROM n{steps}, dev, med)"""
