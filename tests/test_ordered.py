"""Order statistics and row numbers against NumPy, with the rows in many ranges."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from galewatch.operators import audit, metrics, models, priority, shift
from galewatch.operators.ordered import numbered, quantile_arrays, quantiles, told_apart, with_quantiles


@pytest.fixture(scope="module")
def values():
    rng = np.random.default_rng(8)
    return [("a", float(x)) for x in np.round(rng.normal(50, 20, 3000), 1)] + [("b", 7.0)] * 500 + [("c", -1.5)] + [("d", None)] * 4 + [(None, 1.0), (None, 2.0)]


def test_quantiles_equal_numpys(spark, values):
    df = spark.createDataFrame(values, "g string, x double").repartition(9)
    wanted = {"low": 0.01, "third": 1 / 3, "median": 0.5, "most": 1.0}
    got = {r.g: r for r in quantiles(df, ["g"], "x", wanted).collect()}
    assert got.keys() == {"a", "b", "c", None}
    for g, r in got.items():
        own = [x for k, x in values if k == g]
        for name, q in wanted.items():
            assert r[name] == pytest.approx(np.quantile(own, q), abs=1e-9)
    one = quantiles(df, [], "x", wanted).first()
    assert one.median == pytest.approx(np.median([x for _, x in values if x is not None]))


def test_quantiles_beside_other_columns(spark, values):
    df = spark.createDataFrame(values, "g string, x double")
    out = {r.g: r for r in with_quantiles(df.groupBy("g").agg(F.count("*").alias("n")), df, ["g"], "x", {"median": 0.5}).collect()}
    assert out["d"].median is None and out["d"].n == 4 and out[None].median == 1.5
    none = df.filter("g = 'd'")
    assert with_quantiles(none.agg(F.count("*").alias("n")), none, [], "x", {"median": 0.5}).first().asDict() == {"n": 4, "median": None}
    empty = df.filter("false")
    assert quantiles(empty, ["g"], "x", {"median": 0.5}).collect() == []


def test_only_values_near_a_place_are_told_apart(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(size=60_000), [np.nan] * 3, [np.inf] * 40, [0.25] * 9_000])
    df = spark.createDataFrame([("a", float(v)) for v in x] + [("b", float(i)) for i in range(50)], "g string, x double").repartition(7)
    shares = [0.0, 0.01, 0.3, 0.5, 0.99, 1.0]
    cells = told_apart(df, ["g"], "x", shares).filter("g = 'a'").agg(F.count("*"), F.sum(F.col("_c") + F.col("_g"))).first()
    assert cells[0] < 1000 and cells[1] == len(x)
    got = {r.g: r.q for r in quantile_arrays(df, ["g"], "x", shares).collect()}
    ordered = np.sort(x)  # NaN last
    want = [np.interp(p * (len(x) - 1), np.arange(len(x)), ordered) for p in shares[:-1]]
    assert got["a"][:-1] == pytest.approx(want, rel=1e-12) and np.isnan(got["a"][-1])
    assert got["b"] == pytest.approx(np.quantile(np.arange(50.0), shares))


def test_many_shares_of_a_hot_value_and_of_one_value(spark):
    x = [1.0] * 20_000 + [float(i % 700) for i in range(9_000)]
    df = spark.createDataFrame([(v,) for v in x], "x double")
    shares = np.linspace(0, 1, 101).tolist()
    assert quantile_arrays(df, [], "x", shares).first().q == pytest.approx(np.quantile(x, shares))
    assert quantile_arrays(df.limit(1), [], "x", shares).first().q == [1.0] * 101
    assert quantile_arrays(df.filter("false"), [], "x", shares).collect() == []


def test_row_numbers(spark):
    rows = [(i % 3, (i * 7919) % 1009) for i in range(900)]
    df = spark.createDataFrame([(s, v, v) for s, v in rows], "split int, v long, tie long").repartition(13)
    got = sorted((r.split, r.n, r.v) for r in numbered(df, ["split"], ["v"], "n").collect())
    want = sorted((s, n, v) for s in range(3) for n, v in enumerate(sorted(v for k, v in rows if k == s)))
    assert got == want
    ranks = [(r["rank"], r.v) for r in priority.ranked(df, "v", "tie").orderBy("rank").collect()]
    assert ranks == list(enumerate(sorted((v for _, v in rows), reverse=True), 1))
    assert numbered(df.filter("false"), [], ["v"], "n").collect() == []


def test_interpolation_keeps_every_row(spark):
    knots = [(2.0, 10.0), (4.0, 30.0), (10.0, 0.0)]
    x = [None, float("nan"), float("inf"), float("-inf"), 1.0, 2.0, 3.0, 4.0, 7.0, 10.0, 11.0, 3.0]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x)], "i int, w double")
    curve = spark.createDataFrame([*knots, (None, 3.0)], "x double, y double")
    got = [r.e for r in shift.interpolate(df, curve, "w", "x", "y", "e").orderBy("i").collect()]
    want = [None if v is None else np.interp(v, *zip(*knots, strict=True)) for v in x]
    assert got[0] is None and np.isnan(got[1]) and got[2:] == pytest.approx(want[2:])
    assert [r.e for r in shift.interpolate(df, curve.filter("false"), "w", "x", "y", "e").collect()] == [None] * len(x)
    plan = shift.interpolate(df, curve, "w", "x", "y")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


def test_operating_points_equal_single_thresholds(spark):
    rng = np.random.default_rng(5)
    rows = [(e, f"a{e % 4}", t, None if e % 3 else float(90 - t), int(e % 3 == 0 and 0 < 90 - t <= 48), float(rng.random())) for e in range(20) for t in range(60)]
    df = spark.createDataFrame(rows, "event_id long, asset_id string, window_end long, hours_to_fault double, label int, probability double")
    for least in (1, 3):
        got = {round(r.threshold, 6): r for r in metrics.operating_points(df, [0.2, 0.7, 0.99, 1.5], least).collect()}
        for tau, r in got.items():
            lead = metrics.lead_time_summary(metrics.lead_time(df, tau, least)).first()
            alarms = metrics.false_alarm_rate(df, tau, least).first()
            for name in ("n_fault_events", "detection_rate", "median_lead_time_hours", "mean_lead_time_hours"):
                assert r[name] == pytest.approx(lead[name]), (tau, least, name)
            for name in ("window_alarm_rate", "episodes_per_1000h", "event_alarm_rate"):
                assert r[name] == pytest.approx(alarms[name]), (tau, least, name)
    plan = metrics.operating_points(df, [0.1 * i for i in range(9)])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window") <= 6
    empty = metrics.operating_points(df.filter("false"), [0.5]).first()
    assert (empty.n_fault_events, empty.detection_rate, empty.window_alarm_rate) == (0, None, None)


def test_median_of_a_missing_column(spark):
    df = spark.createDataFrame([(1, None), (2, None)], "i int, a double")
    assert [r.a for r in models.median_imputed(df, ["a"]).collect()] == [None, None]
    assert audit.validity(df, "a").first().asDict() == {"valid_fraction": 0.0, "min": None, "median": None, "max": None}


@pytest.mark.parametrize("knots", [[(0.0, 1.0), (1e-9, 5.0), (1e6, 2.0), (2e6, 2.5)], [(float(i) + (i * 7 % 10) / 11, (i * 31 % 17) / 3) for i in range(400)], [(3.0, 1.0), (3.0, 4.0)], [(-5.5, 2.0), (8.25, -1.0)]])
def test_lookup_by_cells_equals_numpy(spark, knots):
    rng = np.random.default_rng(6)
    xs, ys = zip(*sorted({x: max(b for a, b in knots if a == x) for x, _ in knots}.items()), strict=True)
    v = [*rng.uniform(xs[0] - 2, xs[-1] + 2, 500).tolist(), *xs, *np.nextafter(xs, np.inf).tolist(), *np.nextafter(xs, -np.inf).tolist(), 1e-10, np.inf, -np.inf]
    table = spark.createDataFrame([*knots, (None, 1.0), (1.0, None), (float("nan"), 3.0)], "x double, y double")
    out = shift.interpolate(spark.createDataFrame([(float(a),) for a in v], "v double"), table, "v", "x", "y").collect()
    assert [r.expected for r in out] == pytest.approx(np.interp([r.v for r in out], xs, ys).tolist(), rel=1e-12)
