"""The logistic solution against a plain solver."""

import numpy as np
import pytest

from galewatch.operators import logistic as L
from galewatch.operators import models


def plain(x, y, c=1.0):
    """Damped Newton steps on all rows at once, with the median, scaling and weights done by NumPy."""
    x = np.array(x, float)
    x = np.where(np.isnan(x), np.nanmedian(x, 0), x)
    d = x.std(0)
    x = np.column_stack([(x - x.mean(0)) / np.where(d == 0, 1, d), np.ones(len(x))])
    s = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    pen, b = np.r_[np.ones(x.shape[1] - 1), 0], np.zeros(x.shape[1])
    for _ in range(200):
        p = 1 / (1 + np.exp(-x @ b))
        b = b - 0.7 * np.linalg.solve((x * (c * s * p * (1 - p))[:, None]).T @ x + np.diag(pen), c * x.T @ (s * (p - y)) + pen * b)
    return b, 1 / (1 + np.exp(-x @ b))


def frame(spark, x, y):
    names = [f"x{i}" for i in range(x.shape[1])]
    rows = [(i, int(b), *(None if np.isnan(v) else float(v) for v in r)) for i, (r, b) in enumerate(zip(x, y, strict=True))]
    return spark.createDataFrame(rows, "i long, label int, " + ", ".join(f"{n} double" for n in names)).repartition(6), names


@pytest.mark.parametrize("c", [1.0, 0.01, 50.0])
def test_equals_a_plain_solver(spark, c):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(500, 4)) * [1, 10, 0.1, 3] + [0, 50, 0, 1]
    y = (x[:, 0] - 0.2 * (x[:, 1] - 50) + rng.logistic(size=500) > 1.5).astype(int)
    x[rng.random((500, 4)) < 0.1] = np.nan
    x[:, 3] = 2.0  # doesn't vary
    df, names = frame(spark, x, y)
    model = L.fit(df, names, c=c)
    b, p = plain(x, y, c)
    assert model.coefficients == pytest.approx(b[:-1], abs=1e-8) and model.intercept == pytest.approx(b[-1], abs=1e-8)
    got = {r.i: r.probability for r in models.scored(model, df).collect()}
    assert [got[i] for i in range(500)] == pytest.approx(p.tolist(), abs=1e-8)
    assert model.steps < 15


def test_separable_classes_have_a_solution(spark):
    x = np.r_[np.linspace(-2, -1, 30), np.linspace(1, 2, 10)][:, None]
    df, names = frame(spark, x, np.r_[np.zeros(30, int), np.ones(10, int)])
    model = L.fit(df, names)
    assert model.coefficients == pytest.approx(plain(x, np.r_[np.zeros(30), np.ones(10)])[0][:-1], abs=1e-8)
    assert models.scored(model, df, 0.5).filter("prediction <> label").count() == 0
    assert L.Logistic.loads(model.dumps()) == model


def test_odd_tables(spark):
    df = spark.createDataFrame([(1, None, 1.0), (0, None, float("nan")), (None, 2.0, 3.0), (1, None, 5.0), (0, None, -4.0)], "label int, a double, b double")
    model = L.fit(df, ["a", "b"])
    assert model.medians == [0.0, 1.0] and models.scored(model, df, 0.5).filter("prediction is null").count() == 0
    for bad in (df.filter("label = 1"), df.limit(0), df.withColumn("label", df.label + 1)):
        with pytest.raises(ValueError, match="labels"):
            L.fit(bad, ["a", "b"])
    with pytest.raises(ValueError, match="features"):
        L.fit(df, [])
