"""Evaluation metrics at ties, edges and single classes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from galewatch.operators import metrics as M


def table(spark, rows):
    """rows: (event, time, hours, label, probability)"""
    return spark.createDataFrame([(e, "a1", t, h, y, p) for e, t, h, y, p in rows], "event_id long, asset_id string, window_end long, hours_to_fault double, label int, probability double")


def scores(spark, pairs):
    return table(spark, [(1, i, None, y, p) for i, (y, p) in enumerate(pairs)])


def test_ranking(spark):
    pairs = [(1, 0.9), (0, 0.9), (1, 0.5), (0, 0.2), (0, 0.2), (1, 0.2)]
    r = M.ranking(scores(spark, pairs)).first()
    pos, neg = [p for y, p in pairs if y], [p for y, p in pairs if not y]
    assert r.roc_auc == pytest.approx(sum((a > b) + (a == b) / 2 for a in pos for b in neg) / 9)
    assert r.pr_auc == pytest.approx((1 / 3) * (1 / 2) + (1 / 3) * (2 / 3) + (1 / 3) * (3 / 6))
    one = M.ranking(scores(spark, [(1, 0.1), (1, 0.2)])).first()
    assert (one.roc_auc, one.pr_auc, one.n) == (None, None, 2)


def test_running_sums_over_many_parts(spark, monkeypatch):
    pairs = [((i * 7) % 3 == 0, ((i * 37) % 101) / 100) for i in range(300)]
    whole = M.ranking(scores(spark, [(int(y), p) for y, p in pairs])).first()
    monkeypatch.setattr(M, "PARTS", 3)
    parts = M.ranking(scores(spark, [(int(y), p) for y, p in pairs])).first()
    assert tuple(parts) == pytest.approx(tuple(whole))


def test_threshold_choice(spark):
    assert M.threshold_among_scores(scores(spark, [(0, 0.1), (0, 0.4), (1, 0.6), (1, 0.9)])).first().threshold == 0.6
    assert M.threshold_among_scores(scores(spark, [(0, 0.1)])).first().threshold == 0.5
    assert M.threshold_of_most_f1(scores(spark, [(0, 0.1), (1, 0.5)]), [0.2, 0.3, 0.5, 0.6]).first().threshold == 0.2


def test_sweep_compares_strictly_or_not(spark):
    df = scores(spark, [(1, 0.3), (0, 0.3), (1, 0.5)])
    strict = {r.threshold: (r.n_tp, r.n_fp, r.n_fn, r.n_tn) for r in M.swept(df, [0.3, 0.4]).collect()}
    loose = {r.threshold: (r.n_tp, r.n_fp, r.n_fn, r.n_tn) for r in M.swept(df, [0.3, 0.4], False).collect()}
    assert strict == {0.3: (1, 0, 1, 1), 0.4: (1, 0, 1, 1)} and loose == {0.3: (2, 1, 0, 0), 0.4: (1, 0, 1, 1)}


def test_costs(spark):
    df = scores(spark, [(1, 0.9), (1, 0.2), (0, 0.8), (0, 0.1)])
    best = M.optimal_threshold(M.cost_curve(df, grid=[0.05, 0.15, 0.5, 0.85])).first()
    assert (best.threshold, best.total_cost) == (0.15, 1)
    assert M.cost_curve(df, grid=[0.05], fp_cost_by_asset={"a1": 3.0}).first().cost_fp_total == 6
    with pytest.raises(ValueError):
        M.cost_curve(df, fp_cost_by_asset={"other": 1.0})
    p = M.policy_costs(df).first()
    assert (p.reactive_only_cost, p.always_alarm_cost) == (20, 2)
    rows = {r.cost_ratio: r for r in M.cost_ratio_sensitivity(df, grid=[0.05, 0.15, 0.5, 0.85]).collect()}
    assert rows[10.0].model_cost == 1 and rows[10.0].reduction_vs_reactive_only_pct == 95


FAULT = [(1, t, h, int(h <= 48), p) for t, (h, p) in enumerate([(100.0, 0.9), (60.0, 0.1), (40.0, 0.9), (30.0, 0.8), (10.0, 0.2)])]


def test_lead_time(spark):
    df = table(spark, FAULT + [(2, 0, 90.0, 0, 0.1), (3, 0, None, 0, 0.99)])
    spike = {r.event_id: r for r in M.lead_time(df, 0.5).collect()}
    assert spike.keys() == {1, 2} and spike[1].lead_time_hours == 100 and not spike[1].within_label_horizon and spike[1].alarmed_in_horizon
    assert not spike[2].detected and spike[2].lead_time_hours is None and spike[2].max_probability_in_horizon is None
    run = {r.event_id: r for r in M.lead_time(df, 0.5, 2).collect()}
    assert run[1].lead_time_hours == 40 and run[1].within_label_horizon
    near = {r.event_id: r for r in M.lead_time(df, 0.5, 1, 72.0).collect()}
    assert near.keys() == {1} and near[1].lead_time_hours == 40  # an event that the search window empties isn't a miss
    s = M.lead_time_summary(M.lead_time(df, 0.5)).first()
    assert (s.n_fault_events, s.n_detected, s.detection_rate, s.n_beyond_label_horizon) == (2, 1, 0.5, 1)
    assert M.lead_time(df.filter("false"), 0.5).collect() == []
    with pytest.raises(ValueError):
        M.lead_time(df, 0.5, 0)


def test_alarm_episodes(spark):
    rows = [(1, t, None, 0, p) for t, p in enumerate([0.9, 0.9, 0.1, 0.9, 0.1, 0.9, 0.9, 0.9])] + [(2, 0, None, 0, 0.1)]
    df = table(spark, rows[::-1])
    r = M.false_alarm_rate(df, 0.5, 2).first()
    assert (r.n_normal_events, r.n_alarm_windows, r.n_alarm_episodes, r.n_events_with_alarm, r.event_alarm_rate) == (2, 6, 2, 1, 0.5)
    assert r.episodes_per_1000h == pytest.approx(2000 / 9)
    none = M.false_alarm_rate(table(spark, FAULT), 0.5).first()
    assert (none.n_normal_events, none.window_alarm_rate) == (0, None)


def test_reliability_edges(spark):
    rows = M.reliability_table(scores(spark, [(1, 0.3), (0, 0.6), (1, 0.7), (0, 1.0)])).orderBy("bin_lower").collect()
    # 0.3, 0.6 and 0.7 lie just below the edges that three, six and seven tenths are in floating point.
    assert [r["count"] for r in rows] == [0, 0, 1, 0, 0, 1, 1, 0, 0, 1] and rows[0].mean_predicted is None
    e = M.calibration_error(M.reliability_table(scores(spark, [(1, 0.25), (0, 0.25)]))).first()
    assert (e.ece, e.n_bins_populated) == (0.25, 1)


def test_breakdown_has_all_rows(spark):
    df = scores(spark, [(1, 0.9), (0, 0.2), (1, 0.4)])
    rows = {r.asset_id: r for r in M.breakdown(df, 0.5).collect()}
    assert rows.keys() == {"a1", "ALL"} and rows["ALL"].recall == 0.5 and rows["a1"].roc_auc == 1
    with pytest.raises(ValueError):
        M.breakdown(df, 0.5, "nothing")


def test_prepare(spark):
    df = scores(spark, [(1, 0.9), (0, 0.2)])
    assert M.prepare(df).count() == 2
    for bad in (df.drop("label"), df.filter("false"), df.selectExpr("event_id", "asset_id", "hours_to_fault", "label", "probability + 1 AS probability")):
        with pytest.raises(ValueError):
            M.prepare(bad)
    with pytest.raises(ValueError):
        M.prepare(df, split="val")


def test_running_sums_of_clustered_scores(spark):
    """Nearly all scores lie within a billionth, and the parts still are alike."""
    scores = [0.3 + i * 1e-13 for i in range(4000)] + [i / 50 for i in range(50)]
    df = spark.createDataFrame([(s, 1 + i % 3, g) for i, s in enumerate(scores) for g in ("a", None)], "probability double, n long, g string")
    for descending in (False, True):
        got = M.running(df, ["g"], {"upto": "n"}, descending).filter("g is null").orderBy("probability").collect()
        want, total = {}, 0
        for s, n in sorted(((s, 1 + i % 3) for i, s in enumerate(scores)), reverse=descending):
            want[s] = total = total + n
        assert len(got) == 4050 and all(want[r.probability] == r.upto for r in got)
    cuts = df.filter("g = 'a'").agg(F.percentile_approx("probability", [i / M.PARTS for i in range(1, M.PARTS)], M.CUT_ACCURACY).alias("c")).first().c
    assert np.bincount(np.searchsorted(cuts, scores, "right")).max() < 100
