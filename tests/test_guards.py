"""Contracts, guards and JSON sources."""

import pytest
from pyspark.sql import functions as F

from galewatch.functions import physics
from galewatch.functions.scalars import from_epoch
from galewatch.operators import audit, series
from galewatch.sources import files


def test_sensors_of_a_nested_mapping():
    assert physics.required_sensors({"a": ["sensor_2", {"b": "power_1", "c": ("sensor_2", 7, None, "other")}], "d": "reactive_power_9", "e": "wind_speed_3"}) == ["power_1", "reactive_power_9", "sensor_2", "wind_speed_3"]
    assert all(physics.required_sensors(vars(s)) == s.sensors() for s in physics.SITES.values())


def test_legacy_columns():
    names = [f"sensor_{i}" for i in range(3)]
    available = ["sensor_0_avg", "sensor_0", "sensor_1", "sensor_2_average", "sensor_2_max"]
    assert physics.legacy_columns(available, names, 2) == {"sensor_0": "sensor_0_avg", "sensor_1": "sensor_1"}
    assert physics.legacy_columns(available, names, 3, True)["sensor_2"] == "sensor_2_average"
    with pytest.raises(ValueError):
        physics.legacy_columns(available, names)


def test_feature_order():
    assert physics.feature_order(True, {"features": ["b", "a"]}) == ["b", "a", "power_residual"] and physics.feature_order() == list(physics.FEATURES)


def test_audits_and_curves_as_json(spark, tmp_path):
    rows = spark.createDataFrame([("A", 50.0), ("A", 50.2), ("B", 46.0), ("C", None)], "site string, hz double")
    path = str(tmp_path / "audits")
    files.write_audits(audit.frequency_check(rows, F.col("hz"), ["site"]), path)
    assert files.passing_audit(spark, path, "A")["median_hz"] == pytest.approx(50.1)
    for site in ("B", "C", "D"):
        with pytest.raises(ValueError):
            files.passing_audit(spark, path, site)
    curve = physics.PowerCurve([1.0, 2.0], [3.0, 4.0], 5.0, {"site": "C"})
    files.save_curve(spark, curve, str(tmp_path / "curve"))
    assert files.load_curve(spark, str(tmp_path / "curve"), "C") == curve
    with pytest.raises(ValueError):
        files.load_curve(spark, str(tmp_path / "curve"), "A")


def test_a_report_has_all_rows_or_none(spark):
    with pytest.raises(ValueError):
        files.markdown(spark.range(12), 11)
    assert files.markdown(spark.range(12), 12).count("\n") == 13


def test_event_files(spark, tmp_path):
    df = spark.createDataFrame([(7, 3, "c"), (7, 5, "a"), (8, 1, "b")], "event long, s long, x string")
    files.write_event_files(df, "event", [F.desc("s")], str(tmp_path / "events"))
    rows = files.read_positions(spark, str(tmp_path / "events")).collect()
    assert sorted((r.event_id, r.row_pos, r.s, r.x) for r in rows) == [(7, 0, "5", "a"), (7, 1, "3", "c"), (8, 0, "1", "b")]
    assert sorted(r.event_id for r in files.event_files(spark, str(tmp_path / "events")).collect()) == [7, 8]


def test_fetched_files_are_whole_and_present_ones_stay(spark, tmp_path):
    df = spark.createDataFrame([(e, n, f"line {n}") for e in (1, 2, 3) for n in range(50)], "event long, s long, x string")
    source, target = str(tmp_path / "source"), str(tmp_path / "target")
    files.write_event_files(df, "event", ["s"], source)
    ids = lambda *e: spark.createDataFrame([(i,) for i in e], "event_id long")
    with pytest.raises(ValueError, match=r"\[7\]"):
        files.fetch_events(spark, source, target, ids(1, 7))
    assert [(r.event_id, r.fetched) for r in files.fetch_events(spark, source, target, ids(2, 2)).collect()] == [(2, True)]
    (tmp_path / "target" / "comma_2.csv").write_text("s,x\n1,changed\n")
    assert sorted((r.event_id, r.fetched) for r in files.fetch_events(spark, source, target).collect()) == [(1, True), (2, False), (3, True)]
    for e in (1, 3):
        assert (tmp_path / "target" / f"comma_{e}.csv").read_text() == (tmp_path / "source" / f"comma_{e}.csv").read_text()
    assert "changed" in (tmp_path / "target" / "comma_2.csv").read_text()


def test_calibration_guard(spark):
    cases = [
        ("A", False, False, False, None, None, None), ("A", True, False, False, None, None, "not allowed"), ("A", True, True, False, "A", "any", "not allowed"), ("A", True, True, True, "A", "any", None),
        ("A", True, True, True, "C", "train-normal", "other site"), ("C", True, False, False, None, None, None), ("C", True, True, False, "C", "train-normal", None), ("C", True, True, False, "C", None, "setting"),
    ]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, site string, uses boolean, has boolean, allowed boolean, of string, setting string, want string")
    got = df.withColumn("got", audit.calibration_failure(*map(F.col, ("site", "uses", "has", "allowed", "of", "setting"))))
    assert [(r.i, r.got) for r in got.orderBy("i").collect()] == [(i, c[-1]) for i, c in enumerate(cases)]


def test_input_violations(spark):
    df = spark.createDataFrame([("1",), ("x",), (None,), ("nan",), ("inf",), ("-Infinity",), ("",)], "a string")
    got = {(r.column, r.rule): r.violations for r in audit.input_violations(df, ["a"]).collect()}
    assert got == {("a", "missing"): 1, ("a", "number"): 2, ("a", "nan"): 1, ("a", "infinite"): 2, ("a", "empty"): 0}
    assert {r.violations for r in audit.input_violations(df.filter("false"), ["a"]).filter("rule = 'empty'").collect()} == {1}


def test_metadata_of_sequences(spark):
    events = spark.createDataFrame([("1", 0, 7200, True), ("2", 600, 7800, False)], "asset_id string, start_s0 long, end_s0 long, anomaly boolean")
    steps = series.grid(series.candidates(events, stride=3600, lookback=1800), "asset_id", spark.createDataFrame([("1", 0, 5.0)], "asset_id string, s long, x double"))
    rows = series.timestep_metadata(steps, events, "asset_id", F.lit("c"), F.lit("train"), F.col("asset_id"), F.col("x").isNotNull()).collect()
    assert len(rows) == 2 * 2 * 3 and {r.farm for r in rows} == {"C"} and sorted({(r.event_id, r.sequence_idx) for r in rows}) == [(1, 0), (1, 1), (2, 2), (2, 3)]
    first = {r.timestep_idx: r for r in rows if r.sequence_idx == 0}
    assert [str(first[i].window_end) for i in range(3)] == ["1969-12-31 23:40:00", "1969-12-31 23:50:00", "1970-01-01 00:00:00"]
    assert [first[i].mask for i in range(3)] == [0, 0, 1] and first[2].hours_to_fault == 2 and str(first[2].fault_time) == "1970-01-01 02:00:00" and first[2].label == 1
    assert all((r.fault_time, r.hours_to_fault, r.label) == (None, None, 0) for r in rows if r.event_id == 2)


def test_times_before_and_after_1970(spark):
    df = spark.createDataFrame([(-1,), (0,), (86399,), (4102444800,)], "s long").select(from_epoch(F.col("s")).cast("string").alias("t"))
    assert [r.t for r in df.collect()] == ["1969-12-31 23:59:59", "1970-01-01 00:00:00", "1970-01-01 23:59:59", "2100-01-01 00:00:00"]


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return {}

    class Session:
        sparkContext = Context()

    with pytest.raises(ValueError):
        files.shared_folder(Session())
