"""Priority scores, costs, slopes and ranks against hand-computed values."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from galewatch.operators import priority as P


def score(spark, values=(0.7, 0.25, 0.4, 1.1), weights=P.Weights(), **override):  # noqa: B008
    df = spark.createDataFrame([values], "a double, b double, c double, d double")
    return df.select(P.priority_score(*map(F.col, "abcd"), weights, **override)).first()[0]


def test_scores(spark):
    assert score(spark) == pytest.approx(1.65)
    w = P.Weights(2, 1.5, 0.5, 3)
    assert score(spark, weights=w) == pytest.approx(4.875) and score(spark, weights=w, w1=1) == pytest.approx(4.175)
    with pytest.raises(PySparkException):
        score(spark, (0.7, None, 0.4, 1.1))
    with pytest.raises(PySparkException):
        score(spark, (0.7, float("nan"), 0.4, 1.1))


@pytest.mark.parametrize("bad", [-1, float("nan"), float("inf"), None, True])
def test_weights_are_checked(bad):
    with pytest.raises(ValueError):
        P.Weights(w2=bad)


def test_access_cost(spark):
    df = spark.createDataFrame([("onshore",), ("offshore",), (" OFFSHORE ",)], "t string")
    assert [r[0] for r in df.select(P.access_cost(F.col("t"))).collect()] == [1, 1.5, 1.5]
    config = P.Access(1.5, 0.75, 0.25, 1.2, 4)
    assert [r[0] for r in df.select(P.access_cost(F.col("t"), config)).collect()] == [10, 12, 12]
    with pytest.raises(PySparkException):
        spark.createDataFrame([("sea",)], "t string").select(P.access_cost(F.col("t"))).collect()


def test_criticality(spark):
    df = spark.createDataFrame([(1.75, 0.5, 4.0, -1.0)], "cap double, out double, big double, bad double")
    assert df.select(P.criticality(F.col("cap"), F.col("out"))).first()[0] == 2.25
    assert df.select(P.criticality(F.col("cap"), F.col("big"), P.Criticality(3, 0.5))).first()[0] == 7.25
    assert df.select(P.criticality(output=F.col("out"))).first()[0] == 0.5
    with pytest.raises(ValueError):
        P.criticality()
    with pytest.raises(PySparkException):
        df.select(P.criticality(F.col("bad"))).collect()


def slope(spark, ys, hours):
    df = spark.createDataFrame(list(zip(ys, map(float, hours), strict=True)), "y double, h double")
    return df.agg(P.degradation_rate("y", F.col("h"))).first()[0]


def test_slopes(spark):
    assert slope(spark, [0.3, 0.6, 0.9], [1, 5, 9]) == pytest.approx(0.075)
    assert slope(spark, [0.2, 0.5, 0.8], [0, 1 / 6, 2 / 6]) == pytest.approx(1.8)
    assert slope(spark, [0.1, 0.5, 0.6], [2, 3, 7]) == pytest.approx(1.1 / 14)
    assert slope(spark, [0.2], [1]) is None


def test_signals_are_of_the_smoothed_series(spark):
    rows = [("a", t, p) for t, p in enumerate([0.1, 0.2, 0.3, 0.4, 0.5, 0.6])] + [("b", 0, 0.5)]
    (r,) = P.fleet_signals(spark.createDataFrame(rows, "asset_id string, ts long, probability double"), horizon_hours=3, timestep_hours=1).collect()
    assert r.asset_id == "a" and r.fault_risk == pytest.approx(0.5)
    xs, ys = range(6), [0.1, 0.15, 0.2, 0.3, 0.4, 0.5]
    mean = sum(ys) / 6
    assert r.degradation_rate == pytest.approx(sum((x - 2.5) * (y - mean) for x, y in zip(xs, ys, strict=True)) / 17.5)


def test_ranks(spark):
    rows = [("north", 0.3), ("west", 2.4), ("south", 0.1 + 0.6), ("east", 0.7), ("inner", 0.9)]
    got = P.ranked(spark.createDataFrame(rows, "asset_id string, priority_score double")).orderBy("rank").collect()
    assert [(r["rank"], r.asset_id) for r in got] == [(1, "west"), (2, "inner"), (3, "east"), (4, "south"), (5, "north")]
    many = spark.range(500).selectExpr("cast(id as string) asset_id", "cast(id * 7 % 50 as double) priority_score")
    got = P.ranked(many).orderBy("rank").collect()
    want = sorted(((-(i * 7 % 50), str(i)) for i in range(500)))
    assert [r["rank"] for r in got] == list(range(1, 501)) and [r.asset_id for r in got] == [a for _, a in want]


def test_missing_columns(spark):
    with pytest.raises(ValueError):
        P.with_priority(spark.range(1))
