"""Windows, fills, runs and labels, at their boundaries."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from galewatch.operators import audit, scaling, series


def frame(spark, xs, **more):
    return spark.createDataFrame([("a", i, x) for i, x in enumerate(xs)], "k string, t long, x double")


def column(df, name="x", order="t"):
    return [r[name] for r in df.orderBy(order).collect()]


def test_bounded_fill(spark):
    n = None
    assert column(series.filled(frame(spark, [1.0, n, n, n, n, n, 2.0, n]), ["k"], "t", "x")) == [1, 1, 1, n, 2, 2, 2, 2]
    assert column(series.filled(frame(spark, [n, 1.0, n, n]), ["k"], "t", "x", None)) == [1, 1, 1, 1]


def test_trailing_mean(spark):
    smooth = lambda xs, hours, step: column(series.trailing_mean(frame(spark, xs), ["k"], "t", "x", hours, step), "smoothed")
    assert smooth([8.0, 2.0, 5.0, 11.0, 20.0], 2, 1) == pytest.approx([8.0, 5.0, 3.5, 8.0, 15.5])
    assert smooth([6.0] * 3 + [-6.0], 4, 1)[-1] == pytest.approx(3.0)
    assert smooth([3.0, 1.0, 2.0], 0.3, 1) == [3.0, 1.0, 2.0]
    xs = [((i * 37) % 100) / 100 for i in range(80)]
    assert smooth(xs, 6, 1 / 6) == pytest.approx(pd.Series(xs).rolling(36, 1).mean().tolist())


def test_future_rows_change_nothing(spark):
    xs = [((i * 13) % 50) / 50 for i in range(30)]
    early = column(series.trailing_mean(frame(spark, xs[:20]), ["k"], "t", "x"), "smoothed")
    assert column(series.trailing_mean(frame(spark, xs), ["k"], "t", "x"), "smoothed")[:20] == early


def test_runs(spark):
    flags = [0, 1, 1, 0, 1, None, 1, 1, 1]
    got = series.runs(frame(spark, [None if f is None else float(f) for f in flags]), ["k"], ["t"], F.col("x") == 1).orderBy("first").collect()
    assert [(r["first"], r["size"]) for r in got] == [(1, 2), (4, 1), (6, 3)]
    zeros = spark.createDataFrame([("a", i, x) for i, x in enumerate([0.0, 0.0, None, 0.0, 1.0])] + [("b", 0, 5.0)], "k string, t long, x double")
    assert {r.k: r.longest for r in audit.longest_zero_runs(zeros, "k", "t", "x").collect()} == {"a": 2, "b": 0}


def test_labels(spark):
    df = spark.createDataFrame([(0.0,), (0.1,), (48.0,), (48.17,), (None,)], "h double")
    assert [r[0] for r in df.select(series.horizon_label(F.lit(True), F.col("h"))).collect()] == [0, 1, 1, 0, 0]


def test_first_per_time(spark):
    df = spark.createDataFrame([("a", 1, 2), ("a", 1, 1), ("a", None, 0), ("b", 1, 5)], "k string, t long, pos long")
    assert sorted((r.k, r.pos) for r in series.first_per_time(df, ["k"], "t", "pos").collect()) == [("a", 1), ("b", 5)]


def windows(spark, times, xs=None):
    rows = spark.createDataFrame([("a", t, 1.0 if xs is None else xs[i]) for i, t in enumerate(times)], "k string, s long, x double")
    events = spark.createDataFrame([("a", 85800, 85800 + 600)], "k string, start_s0 long, end_s0 long")
    (r,) = series.judged_windows(rows, events, "k").collect()
    return r


def test_window_reasons(spark):
    full = [600 * i for i in range(144)]
    assert windows(spark, full).reason == "keep" and windows(spark, full).n_rows == 144
    assert windows(spark, full[:-1]).reason == "endpoint"
    drop = lambda n: [t for i, t in enumerate(full) if i % 2 == 0 or i > 2 * n]
    assert windows(spark, drop(7)).n_rows == 137 and windows(spark, drop(7)).reason == "keep"
    assert windows(spark, drop(8)).n_rows == 136 and windows(spark, drop(8)).reason == "coverage"
    assert windows(spark, [t for t in full if not 6000 < t < 7800]).reason == "keep"  # a gap of 30 minutes
    assert windows(spark, [t for t in full if not 6000 < t < 8400]).reason == "gap"
    assert windows(spark, full, [None] * 144).reason == "valid"
    off = [t + 5 for t in full[:-1]] + [full[-1]]
    assert windows(spark, off).n_rows == 144 and windows(spark, off).n_valid == 1


def test_grid_and_dense_steps(spark):
    w = spark.createDataFrame([("a", 85800, 0)], "k string, end_s long, start_s long")
    rows = series.grid(w, "k", spark.createDataFrame([("a", 600, 7.0), ("a", 605, 9.0)], "k string, s long, x double")).orderBy("timestep_idx").collect()
    assert len(rows) == 144 and [r.x for r in rows[:3]] == [None, 7.0, None]


def test_continuity(spark):
    df = spark.sql("select 'a' k, timestamp_ntz '2024-01-01 00:00:00' + make_dt_interval(0, 0, m) t from values (0), (10), (10), (40), (null), (null) v(m)")
    (r,) = series.continuity(df, ["k"], "t").collect()
    assert (r.rows, r.invalid_times, r.duplicates, r.gaps, r.max_gap) == (6, 2, 2, 1, 1800)


def test_scaler(spark):
    df = spark.createDataFrame([([1.0, 10.0], 1), ([3.0, 30.0], 1), ([1000.0, 1000.0], 0)], "f array<double>, m int")
    s = scaling.fit_scaler(scaling.long_tensor(df, ["m"], "f"), F.col("m") == 1).orderBy("feature_index")
    assert [(r["mean"], r["std"]) for r in s.collect()] == [(2, 1), (20, 10)]
    z = scaling.apply_scaler(spark.createDataFrame([(0, 100.0), (1, 200.0), (1, None)], "feature_index int, x double"), s).orderBy("feature_index", "x")
    assert [r.z for r in z.collect()] == [98, 0, 18]
    constant = spark.createDataFrame([([5.0],), ([5.0],)], "f array<double>")
    assert scaling.fit_scaler(scaling.long_tensor(constant.selectExpr("1 i", "f"), ["i"], "f")).first()["std"] == 1
    big = spark.range(20000).selectExpr("if(id % 2 = 0, 999999.0d, 1000001.0d) x", "0 feature_index")
    z = scaling.apply_scaler(big, scaling.fit_scaler(big)).agg(F.avg("z"), F.stddev_pop("z")).first()
    assert abs(z[0]) < 2e-4 and abs(z[1] - 1) < 2e-4


def test_flattened_rows_are_clipped(spark):
    df = spark.createDataFrame([([-20.0, 1.0], 1), ([3.0, 4.0], 0), ([30.0, float("inf")], 1)], "features array<double>, mask int")
    assert [r.features for r in scaling.masked_rows(df, []).collect()] == [[-10, 1], [10, 10]]


def test_boundaries_by_row(spark):
    rows = [(1, 0, "2024-01-10", "train"), (1, 1, "2023-07-31 10:00:00", " Prediction "), (1, 2, "2023-08-19 10:00:00", "PREDICTION"), (2, 0, None, "prediction"), (2, 1, "2023-01-01", "prediction")]
    r = spark.createDataFrame(rows, "event_id long, row_pos long, ts string, train_test string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    events = spark.createDataFrame([(1, 1, 2), (1, 0, 2), (1, 2, 1), (1, 1, 9), (1, None, 2), (2, 0, 1)], "event_id long, start_id long, end_id long")
    got = {(x.event_id, x.start_id, x.end_id): x.failure for x in audit.resolved_boundaries(r, events).collect()}
    assert got == {(1, 1, 2): None, (1, 0, 2): "time", (1, 2, 1): "order", (1, 1, 9): "range", (1, None, 2): "id", (2, 0, 1): "time"}


def test_channel_audit(spark):
    df = spark.createDataFrame([(i, x) for i, x in enumerate([1.0, 0.0, -2.0, None, float("nan"), float("inf")])], "i long, x double")
    (r,) = audit.channel_audit(df.selectExpr("x"), ["x"]).collect()
    assert (r.rows, r.missing, r.infinite, r.zeros, r.negatives, r.min, r.max, r.constant, r["median"]) == (6, 2, 1, 1, 1, -2, 1, False, 0)
    picked = audit.systematic(spark.range(10).selectExpr("id t", "cast(id as double) x", "'a' k"), "k", "t", 3).filter("_picked")
    assert sorted(r.t for r in picked.collect()) == [0, 3, 6]


def test_boundary_audit_and_guards(spark):
    r = spark.createDataFrame([(1, i, f"2024-01-0{i + 1}", "prediction") for i in range(3)], "event_id long, row_pos long, ts string, train_test string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    resolved = audit.resolved_boundaries(r, spark.createDataFrame([(1, 0, 2)], "event_id long, start_id long, end_id long"))
    written = spark.createDataFrame([(1, "not-a-timestamp", "2024-01-03 00:00:00")], "event_id long, event_start string, event_end string")
    assert audit.boundary_audit(resolved, written).first().mismatch == "event_start"
    nothing = spark.createDataFrame([], "event_id long")
    passed = spark.createDataFrame([(True,)], "passed boolean")
    assert audit.export_ready(nothing, resolved, passed).first().ready
    assert not audit.export_ready(resolved, resolved, passed).first().ready
    audit.require_calibration(True, True, {"site": "B"})
    for allowed, source in ((False, {"site": "B"}), (True, None)):
        with pytest.raises(ValueError):
            audit.require_calibration(True, allowed, source)
    df = spark.createDataFrame([([1.0, 2.0],), (None,)], "f array<double>")
    with pytest.raises(ValueError):
        audit.require_dimension(df, "f", 2)
    audit.require_dimension(df.filter("f is not null"), "f", 2)


def test_windows_equal_a_plain_version(spark):
    """Odd readings, on and off the grid, repeated and missing, against every window looked at by itself."""
    import numpy as np

    rng = np.random.default_rng(6)
    readings, events = [], []
    for key in range(4):
        start = 3600 * key + 17 * key
        s = np.arange(start - 9000, start + 40000, 600)
        s = s[rng.random(len(s)) < 0.9]
        s = np.sort(np.concatenate([s, s[:3], rng.integers(start - 9000, start + 40000, 12)]))
        readings += [(key, int(t), None if rng.random() < 0.2 else 1.0) for t in s]
        events.append((key, start, start + 30000))
    events.append((9, 0, 5000))
    for stride, lookback, gap in ((3600, 7200, 1500), (1200, 3000, 900), (600, 600, 600)):
        length = lookback // 600
        got = series.judged_windows(spark.createDataFrame(readings, "k int, s long, x double"), spark.createDataFrame(events, "k int, start_s0 long, end_s0 long"), "k", length, 0.8, gap, 600, stride, lookback)
        want = []
        for key, start, stop in events:
            for end in range(start, stop - 600 + 1, stride):
                begin = end - lookback + 600
                own = [(t, x) for k, t, x in readings if k == key and begin <= t <= end]
                gaps = [b - a for (a, _), (b, _) in zip(own, own[1:], strict=False)]
                valid = sum(x is not None and (end - t) % 600 == 0 for t, x in own)
                most = max(gaps, default=0)
                reason = "endpoint" if end not in [t for t, _ in own] else "coverage" if len(own) < 0.8 * length else "gap" if most > gap else "valid" if not valid else "keep"
                want.append((key, end, begin, len(own), most, valid, reason))
        assert sorted(map(tuple, got.collect())) == sorted(want)
    with pytest.raises(ValueError):
        series.judged_windows(got, got, "k", stride=700)


def test_window_features_from_pieces(spark):
    rng = random.Random(7)
    rows = [(k, rng.randint(-90_000, 200_000), rng.choice([None, float("nan"), 1e9 + rng.random(), 1e9 - 3])) for k in "aab" for _ in range(900)]
    events = [("a", 1200, 150_000), ("b", 0, 90_000)]
    df, ev = spark.createDataFrame(rows, "k string, s long, x double"), spark.createDataFrame(events, "k string, start_s0 long, end_s0 long")
    wide = series.candidates(ev)
    got = {(r.k, r.end_s): r for r in series.window_features(df, ev, wide, "k").collect()}
    checked = 0
    for k, start, end in events:
        for e in range(start, end - 599, 3600):
            own = sorted((s, x) for j, s, x in rows if j == k and e - 85_800 <= s <= e and x is not None and x == x)
            if not own:
                assert (k, e) not in got
                continue
            x, r = np.array([v for _, v in own]), got[k, e]
            assert (r.n, r.min, r.max, r.last, r.change) == (len(x), x.min(), x.max(), own[-1][1], own[-1][1] - own[0][1])
            assert r["mean"] == pytest.approx(x.mean(), rel=1e-14) and r.std == pytest.approx(x.std(), rel=1e-7)
            checked += 1
    assert checked == len(got) > 60
