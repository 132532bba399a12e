"""Scans by parts against plain windows over whole keys."""

import random

import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from galewatch.operators import scans


@pytest.fixture(scope="module")
def rows(spark):
    """One key has nearly all rows; there are null keys and times, parts without a value, and long gaps."""
    r = random.Random(4)
    out, t = [], 0
    for _ in range(900):
        t += r.choice([1, 1, 2, 3, 60])
        out.append(("a", t, None if r.random() < 0.6 or 300 < t < 900 else float(r.randint(0, 3))))
    out += [("b", i, float(i % 2)) for i in range(25)] + [(None, i, None if i < 20 else 1.0) for i in range(30)] + [("c", 5, None), ("d", None, 2.0), ("d", 3, None)]
    r.shuffle(out)
    return spark.createDataFrame([(k, t, x, "kept") for k, t, x in out], "k string, t long, x double, other string").repartition(7).cache()


def of(df, *names):
    return sorted(([r[n] for n in names] for r in df.collect()), key=lambda v: [(x is None, x or 0) for x in map(lambda x: x if not isinstance(x, str) else hash(x), v)])


@pytest.mark.parametrize("limit", [None, 1, 2, 7])
@pytest.mark.parametrize("width", [3, 40, 10_000])
def test_fill(rows, limit, width):
    w = Window.partitionBy("k").orderBy("t")
    back, ahead = (Window.unboundedPreceding, Window.unboundedFollowing) if limit is None else (-limit, limit)
    plain = rows.withColumn("x", F.last("x", True).over(w.rowsBetween(back, 0))).withColumn("x", F.first("x", True).over(w.rowsBetween(0, ahead)))
    got = scans.filled(rows, ["k"], "t", "x", limit, width)
    assert got.columns == rows.columns and of(got, "k", "t", "x") == of(plain, "k", "t", "x")


@pytest.mark.parametrize("width", [3, 40, 10_000])
def test_runs_and_places(rows, width):
    flag = F.col("x") > 0
    assert of(scans.runs(rows, ["k"], ["t"], flag, width), "k", "first", "size") == of(scans.runs(rows, ["k"], ["t"], flag, None), "k", "first", "size")
    every = scans.runs(rows, ["k"], ["t"], F.lit(True), width)
    assert of(every, "k", "first", "size") == of(rows.groupBy("k").agg(F.lit(0).alias("first"), F.count("*").alias("size")), "k", "first", "size")
    plain = rows.withColumn("_place", F.row_number().over(Window.partitionBy("k").orderBy("t")) - 1)
    assert of(scans.placed(rows, ["k"], ["t"], width), "k", "t", "_place") == of(plain, "k", "t", "_place")


def test_trailing_mean(spark, monkeypatch):
    monkeypatch.setattr(scans, "CHUNK_LEAST", 20)
    monkeypatch.setattr(scans, "CHUNK_WINDOWS", 2)
    x = [((i * 37) % 101) / 7 for i in range(500)]
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate(x)] + [("b", 0, None), ("b", 1, 4.0)], "k string, t long, x double").repartition(5)
    for rows in (1, 2, 9, 36):
        got = {(r.k, r.t): r.smoothed for r in scans.trailing_mean(df, ["k"], "t", "x", rows, width=50).collect()}
        assert len(got) == 502 and [got["a", i] for i in range(500)] == pytest.approx(pd.Series(x).rolling(rows, 1).mean().tolist(), rel=1e-12)
        assert got["b", 0] is None and got["b", 1] == 4.0


@pytest.mark.parametrize("width", [5, 1000])
def test_steps(spark, width):
    places = [("a", p) for p in (0, 1, 7, 8, 60, 61, 300)] + [("b", 4), ("b", None), (None, 2), (None, 9)]
    got = {(r.k, r.p): r._step for r in scans.steps(spark.createDataFrame(places, "k string, p long"), ["k"], "p", width).collect()}
    assert [got["a", p] for p in (0, 1, 7, 8, 60, 61, 300)] == [None, 1, 6, 1, 52, 1, 239]
    assert got["b", 4] is None and got["b", None] is None and got[None, 9] == 7


def test_one_key_is_spread_over_tasks(spark):
    """All rows are of one key, and no task gets more than a few parts of it."""
    df = spark.range(20_000).select(F.lit("a").alias("k"), F.col("id").alias("t"), F.when(F.col("id") % 5 == 0, F.col("id").cast("double")).alias("x"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = scans.filled(df, ["k"], "t", "x", 3, 500).withColumn("task", F.spark_partition_id())
        sizes = [r["count"] for r in out.groupBy("task").count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert sum(sizes) == 20_000 and len(sizes) == 4 and max(sizes) < 12_000


def test_empty_table(spark):
    none = spark.createDataFrame([], "k string, t timestamp, x double")
    assert scans.filled(none, ["k"], "t", "x").count() == scans.runs(none, ["k"], ["t"], F.col("x") > 0).count() == scans.trailing_mean(none, ["k"], "t", "x", 3).count() == 0
