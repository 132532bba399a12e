import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from galewatch.operators import ordered, series
from galewatch.operators.ordered import numbered


def test_grid_equals_a_plain_join(spark):
    """Windows off the hour and across days, readings off the grid, before 1970 and of one second."""
    windows = spark.createDataFrame([(k, e, e - 90000 + 600, k + "!") for k in "ab" for e in (-300, 3301, 200000, 260000)], "k string, end_s long, start_s long, more string")
    rows = [("a", s, float(i)) for i, s in enumerate([-300, -300, -900, -86400, 3301, 2701, 2702, 200000, 172800, 172400, 113600, 86400])] + [("b", 259400, None), ("c", -300, 1.0)]
    readings = spark.createDataFrame(rows, "k string, s long, x double")
    got = sorted(series.grid(windows, "k", readings, keep=["more"]).select("k", "end_s", "timestep_idx", "s", F.coalesce("x", F.lit(-1.0)), "more").collect())
    steps = windows.select("k", "end_s", "more", F.posexplode(F.sequence("start_s", "end_s", F.lit(600).cast("long"))).alias("timestep_idx", "s"))
    assert got == sorted(steps.join(readings, ["k", "s"], "left").select("k", "end_s", "timestep_idx", "s", F.coalesce("x", F.lit(-1.0)), "more").collect())
    assert {r.timestep_idx for r in got} == set(range(150)) and len(got) > 8 * 150


def test_steps_are_made_after_the_last_shuffle(spark):
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        for name in ("j1_dense_grid", "f10_metadata"):
            plan = entry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().sparkPlan().toString()
            above = plan[: plan.index("Generate explode(_all")] if "Generate explode(_all" in plan else plan
            assert "Join" not in above and "Exchange" not in above, name
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)


def test_equal_rows_have_one_number(spark):
    df = spark.createDataFrame([(i % 2, i // 6, i // 3 % 4, i) for i in range(60)], "g int, a int, b int, i int")
    got = numbered(df, ["g"], ["a", "b"], "n", ties=True).collect()
    for g in (0, 1):
        places = {p: n for n, p in enumerate(sorted({(r.a, r.b) for r in got if r.g == g}))}
        assert [r.n for r in got if r.g == g] == [places[r.a, r.b] for r in got if r.g == g]
    assert len(got) == 60


def test_large_groups_are_met_by_broadcast(spark, monkeypatch):
    """Also where no table is small enough to be broadcast unasked; a null group is one, too."""
    monkeypatch.setattr(ordered, "SMALL", 20)
    monkeypatch.setattr(ordered, "LARGE", 40)
    df = spark.createDataFrame([(g, float(i * 7 % 53)) for g, n in (("a", 300), (None, 90), ("b", 30), ("c", 3)) for i in range(n)], "g string, x double")
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        out = ordered.quantile_arrays(df, ["g"], "x", [0.1, 0.5])
        assert "BroadcastHashJoin" in out._jdf.queryExecution().sparkPlan().toString()
        got = {r.g: r.q for r in out.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    for g, n in (("a", 300), (None, 90), ("b", 30), ("c", 3)):
        assert got[g] == pytest.approx(np.quantile([i * 7 % 53 for i in range(n)], [0.1, 0.5]))
