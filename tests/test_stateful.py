"""Live scans against the batch operators, on replayed tables, out of order and after a restart."""

import random

import pytest
from pyspark.sql import functions as F

from galewatch.operators import series
from galewatch.streaming import stateful


def rows(seed=5):
    r, out = random.Random(seed), []
    for key, n in (("a", 300), ("b", 40), ("c", 3)):
        t = 0
        for _ in range(n):
            t += r.choice([60, 600, 601, 3000])
            out.append((key, t, None if r.random() < 0.4 else r.random()))
    return out


def written(spark, data, path):
    spark.createDataFrame(data, "asset_id string, s long, x double").select("asset_id", F.timestamp_seconds("s").alias("ts"), "x").coalesce(1).write.mode("append").parquet(path)


def streamed(spark, path):
    return spark.readStream.schema("asset_id string, ts timestamp, x double").option("maxFilesPerTrigger", 1).parquet(path)


def expected(spark, data, least):
    df = spark.createDataFrame(data, "asset_id string, s long, x double")
    smooth = {(r.asset_id, r.s): r.smoothed for r in series.trailing_mean(df, ["asset_id"], "s", "x").collect()}
    runs = series.runs(df, ["asset_id"], ["s"], F.col("x") > 0.5, None).filter(F.col("size") >= least).groupBy("asset_id").count().collect()
    return smooth, {r.asset_id: r["count"] for r in runs}


@pytest.mark.parametrize("least", [1, 2])
def test_replay_equals_batch_operators(spark, tmp_path, least):
    data, path = rows(), str(tmp_path / "in")
    # Files overlap in time by less than the watermark allows, and are shuffled within.
    ordered = sorted(data, key=lambda r: r[1])
    for i in range(0, len(ordered), 60):
        part = ordered[i : i + 60]
        random.Random(i).shuffle(part)
        written(spark, part, path)
    scan = lambda: stateful.live_scan(streamed(spark, path), least=least, late="6 hours")
    out, check = str(tmp_path / "out"), str(tmp_path / "check")
    first = stateful.replayed(scan(), out, check).count()
    # After a restart the state goes on: a late reading is dropped, and far ones let the rest through.
    written(spark, [("a", 1, 9.0), *((k, 10**7, 0.0) for k in "abc")], path)
    written(spark, [(k, 2 * 10**7, 0.0) for k in "abc"], path)
    got = stateful.replayed(scan(), out, check).filter("ts < timestamp_seconds(10000000)").withColumn("s", F.unix_timestamp("ts")).collect()
    assert 0 < first < len(data) == len(got)
    smooth, episodes = expected(spark, data, least)
    x = {(k, s): v for k, s, v in data}
    for r in got:
        assert r.x == x[r.asset_id, r.s]
        assert r.smoothed == (None if smooth[r.asset_id, r.s] is None else pytest.approx(smooth[r.asset_id, r.s], abs=1e-12))
    for key in "abc":
        own = sorted((r.s, r) for r in got if r.asset_id == key)
        values = [x[key, s] for s, _ in own]
        for i, (_, r) in enumerate(own):
            near = [v for v in values[max(0, i - 2) : i + 1] if v is not None]
            assert r.filled == (near[-1] if near else None)
    found = {k: sum(r.alarm for r in got if r.asset_id == k) for k in "abc"}
    assert {k: n for k, n in found.items() if n} == episodes
