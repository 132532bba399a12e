"""Histogram boosting against a plain version that holds all rows and asks for one node at a time."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from galewatch.operators import boosting as B
from galewatch.operators import models


def table(n=600, seed=0):
    rng = np.random.default_rng(seed)
    x = np.column_stack([rng.normal(size=n), rng.integers(0, 6, n).astype(float), rng.exponential(size=n)])
    y = (x[:, 0] + (x[:, 1] > 3) - 0.5 * x[:, 2] + rng.normal(scale=0.7, size=n) > 0.4).astype(int)
    x[rng.random(n) < 0.15, 0] = np.nan
    x[y == 1, 2] = np.where(rng.random((y == 1).sum()) < 0.3, np.nan, x[y == 1, 2])
    return x, y


def plain(x, y, rounds, leaves, least, l2, rate):
    """Raw scores of every row, with loops over nodes, features, bins and sides."""
    edges = [np.unique(np.quantile(v[~np.isnan(v)], [j / 255 for j in range(1, 255)])) for v in x.T]
    bins = np.column_stack([np.where(np.isnan(v), 255, np.searchsorted(e, v, "left")) for v, e in zip(x.T, edges, strict=True)])
    w = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    raw, trees = np.zeros(len(y)), []
    score = lambda g, h: g * g / (h + l2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-raw))
        g, h = np.rint((p - y) * w * B.UNIT) / B.UNIT, np.rint(p * (1 - p) * w * B.UNIT) / B.UNIT
        nodes, order = {0: np.arange(len(y))}, [0]

        def best(rows):
            found = None
            for f in range(x.shape[1]):
                b, missing = bins[rows, f], bins[rows, f] == 255
                for side in (False, True):
                    if side and not missing.any():
                        continue
                    for at in range(255):
                        left = np.where(missing, side, b <= at)
                        if left.sum() < least or (~left).sum() < least or h[rows[left]].sum() < 1e-3 or h[rows[~left]].sum() < 1e-3:
                            continue
                        gain = score(g[rows[left]].sum(), h[rows[left]].sum()) + score(g[rows[~left]].sum(), h[rows[~left]].sum()) - score(g[rows].sum(), h[rows].sum())
                        if gain > 1e-12 and (found is None or gain > found[0] + 1e-9):
                            found = (gain, left)
            return found

        splits = {0: best(nodes[0])}
        while len(order) < leaves and any(splits[n] for n in order):
            n = max((n for n in order if splits[n]), key=lambda n: (splits[n][0], -n))
            rows, left = nodes[n], splits[n][1]
            order.remove(n)
            for part in (rows[left], rows[~left]):
                k = len(nodes)
                nodes[k], splits[k] = part, best(part)
                order.append(k)
        for n in order:
            raw[nodes[n]] += -rate * g[nodes[n]].sum() / (h[nodes[n]].sum() + l2)
        trees.append(len(order))
    return raw, trees


def frame(spark, x, y, parts=5):
    rows = [(i, int(b), *(None if np.isnan(v) and i % 2 else float(v) for v in r)) for i, (r, b) in enumerate(zip(x, y, strict=True))]
    return spark.createDataFrame(rows, "i long, label int, a double, b double, c double").repartition(parts)


def test_equals_a_plain_version(spark):
    x, y = table()
    df = frame(spark, x, y)
    model = B.fit(df, ["a", "b", "c"], rounds=3, leaves=7, rate=0.3)
    raw, trees = plain(x, y, 3, 7, 20, 1.0, 0.3)
    assert [sum(f < 0 for f in t.feature) for t in model.trees] == trees == [7, 7, 7]
    got = {r.i: r.probability for r in models.scored(model, df).collect()}
    assert [got[i] for i in range(len(y))] == pytest.approx((1 / (1 + np.exp(-raw))).tolist(), abs=1e-7)


def test_same_model_however_rows_are_dealt_and_histograms_summed(spark, monkeypatch):
    x, y = table(400, 5)
    monkeypatch.setattr(B, "RECENT", 2)
    one = B.fit(frame(spark, x, y, 1), ["a", "b", "c"], rounds=5, leaves=6)
    monkeypatch.setattr(B, "DIRECT", 0)
    two = B.fit(frame(spark, x, y, 9), ["a", "b", "c"], rounds=5, leaves=6)
    assert one.dumps() == two.dumps()
    assert B.Boosted.loads(one.dumps()) == one


def test_passes_are_fewer_than_splits(spark):
    """Nodes that may be opened next are asked for together."""
    rng = np.random.default_rng(1)
    n, bins = 4000, rng.integers(0, 255, (4000, 3)).astype(np.uint8)
    g = np.rint(rng.normal(size=n) * B.UNIT).astype(np.int64) + (bins[:, 0].astype(np.int64) - 128) * B.UNIT // 64
    h, asked = np.full(n, B.UNIT // 4), []

    def ask(tree, nodes):
        asked.append(list(nodes))
        at = tree.leaves(bins)
        hist = lambda node, f, v: np.bincount(bins[at == node, f], None if v is None else v[at == node], 256).astype(np.int64)
        rows = B._judged(((m, f, hist(m, f, g), hist(m, f, h), hist(m, f, None)) for m in nodes for f in range(3)), 20, 1.0)
        return {m: [r for r in rows if r[0] == m] for m in nodes}

    tree = B.grow(ask, 31, 20, 1.0, 0.1)
    assert sum(f < 0 for f in tree.feature) == 31
    assert len(asked) < 15 and len(set(sum(asked, []))) == len(sum(asked, []))


def test_missing_side_is_learned(spark):
    x = np.column_stack([np.r_[np.linspace(0, 1, 200), np.full(100, np.nan)], np.zeros(300), np.zeros(300)])
    y = np.r_[np.zeros(200, int), np.ones(100, int)]
    model = B.fit(frame(spark, x, y), ["a", "b", "c"], rounds=4, rate=0.5)
    p = model.probabilities(np.array([[0.3, 0, 0], [np.nan, 0, 0]]))
    assert p[0] < 0.3 and p[1] > 0.7


def test_odd_tables(spark):
    x, y = table(60, 2)
    df = frame(spark, x, y).withColumn("raw", F.lit(1)).withColumn("empty", F.lit(None).cast("double"))
    model = B.fit(df, ["a", "empty"], rounds=2)
    assert json.loads(model.dumps())["edges"][1] == []
    assert models.scored(model, df, 0.5).filter("prediction is null or probability is null").count() == 0
    for bad in (df.filter("label = 1"), df.limit(0)):
        with pytest.raises(ValueError, match="labels"):
            B.fit(bad, ["a"])
    few = B.fit(df.orderBy("i").limit(30), ["a"], rounds=3, least=20)
    assert [len(t.feature) for t in few.trees] == [1, 1, 1]


def test_a_pass_is_one_small_job(spark, monkeypatch):
    """Rows stay with the executors between passes: no pass reads the table again, and none is planned anew."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(900, 3))
    df = frame(spark, x, (x[:, 0] * x[:, 1] > 0).astype(int), 3)
    asked, planned, ask, plan = [], [], B._pass, B._held
    monkeypatch.setattr(B, "_pass", lambda *a: asked.append(1) or ask(*a))
    monkeypatch.setattr(B, "_held", lambda *a: planned.append(1) or plan(*a))
    one = B.fit(df, ["a", "b", "c"], rounds=B.RECENT + 1, leaves=6)
    assert len(planned) == 2 and len(asked) > 2 * B.RECENT
    # The sums that are judged on executors give the same trees.
    monkeypatch.setattr(B, "DIRECT", 0)
    monkeypatch.setattr(B, "BLOCK", 100)
    assert B.fit(df, ["a", "b", "c"], rounds=B.RECENT + 1, leaves=6).dumps() == one.dumps()
