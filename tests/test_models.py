"""Models and live operators."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from galewatch.operators import boosting, logistic
from galewatch.operators import models as M
from galewatch.sources import files
from galewatch.streaming import live


def test_recurrent_scores_equal_a_plain_cell(spark):
    w = M.RecurrentWeights.random(3, 4, 2, 1)
    x = np.random.default_rng(0).normal(size=(2, 5, 3)).astype(np.float32)
    df = spark.createDataFrame([(i, s.tolist()) for i, s in enumerate(x)] + [(2, None), (3, x[0][:2].tolist())], "i long, features array<array<float>>")
    got = {r.i: r.probabilities for r in M.recurrent_scores(df, w).collect()}
    sig = lambda a: 1 / (1 + np.exp(-a))
    for i in (0, 1):
        seq = x[i].astype(float)
        for wi, wh, bi, bh in w.cells:
            h, out = np.zeros(4), []
            for t in seq:
                a, b = wi @ t + bi, wh @ h + bh
                r, z = sig(a[:4] + b[:4]), sig(a[4:8] + b[4:8])
                h = (1 - z) * np.tanh(a[8:] + r * b[8:]) + z * h
                out.append(h)
            seq = np.array(out)
        assert got[i] == pytest.approx(sig(seq @ w.head + w.bias).tolist(), abs=1e-5)
    assert got[2] is None and got[3] == pytest.approx(got[0][:2], abs=1e-6)
    assert M.RecurrentWeights.random(10).parameters() == 10593


def test_classifiers(spark):
    rows = [(i, int(i % 10 > 6), float(i % 10), None if i == 0 else 1.0) for i in range(200)]
    df = spark.createDataFrame(rows, "i long, label int, a double, b double")
    full = M.median_imputed(df, ["a", "b"])
    assert full.filter("b is null").count() == 0
    weights = {r.label: r.w for r in M.balanced_weights(df).groupBy("label").agg(F.sum("weight").alias("w")).collect()}
    assert weights == {0: pytest.approx(100), 1: pytest.approx(100)}
    for model in (logistic.fit(df, ["a", "b"]), boosting.fit(df, ["a", "b"], rounds=3)):
        assert M.scored(model, df, 0.5).filter("prediction <> label").count() <= 2
    assert M.positive_weight(df).first()[0] == pytest.approx(140 / 60)


def test_saved_model(spark, tmp_path):
    df = spark.createDataFrame([(i % 2, float(i % 2 + i % 3)) for i in range(60)], "label int, a double")
    model = logistic.fit(df, ["a"])
    files.save_text(spark, model.dumps(), str(tmp_path / "m"))
    assert logistic.Logistic.loads(files.load_text(spark, str(tmp_path / "m"))) == model


def test_asset_splits(spark):
    df = spark.createDataFrame([(f"a{i}", 10 + i * i % 7, i % 4) for i in range(10)], "asset_id string, rows long, positives long").repartition(3)
    counts, pdf = {"train": 6, "val": 2, "test": 2}, df.orderBy("asset_id").toPandas()
    # A plain loop over the trials.
    best, rows, yes = None, pdf["rows"].to_numpy(float), pdf["positives"].to_numpy(float)
    for trial in range(1200):
        order = M.trial_order(42, trial, 10)
        cost = 0.0
        for part in (order[:6], order[6:8], order[8:]):
            n, y = rows[part].sum(), yes[part].sum()
            cost += abs(n / rows.sum() - len(part) / 10) + abs(y / n - yes.sum() / rows.sum()) + 1000 * ((y == 0) + (y == n))
        if best is None or cost < best[0] - 1e-12:
            best = (cost, order)
    want = {pdf["asset_id"][i]: name for name, part in (("train", best[1][:6]), ("val", best[1][6:8]), ("test", best[1][8:])) for i in part}
    found = M.asset_splits(df, counts, 1200)
    assert found.columns == ["asset_id", "split"] and {r.asset_id: r.split for r in found.collect()} == want
    with pytest.raises(ValueError):
        M.asset_splits(df, {"train": 6})


def test_live_windows(spark, tmp_path):
    spark.sql("select timestamp '2024-01-01 00:00:00' + make_dt_interval(0, 0, id * 4) ts, 'a' asset_id, cast(id as double) x from range(10)").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, asset_id string, x double").parquet(str(tmp_path / "in"))
    for name, df in (("levels", live.live_levels(stream)), ("sliding", live.live_sliding(stream, width="20 minutes")), ("sessions", live.live_sessions(stream, gap="5 minutes"))):
        q = df.writeStream.outputMode("complete" if name != "sessions" else "append").format("memory").queryName(name).trigger(availableNow=True).start()
        q.awaitTermination(120)
    rows = spark.sql("select * from levels order by start").collect()
    assert [r.n for r in rows] == [3, 2, 3, 2] and rows[0]["mean"] == 1
    assert spark.sql("select max(n) from sliding").first()[0] == 5
