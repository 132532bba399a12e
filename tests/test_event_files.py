"""Event files: written and copied by tasks, with no work of the driver for each file."""

import numpy as np
import pytest

from galewatch.sources import files as S


def rows(spark, events, each=3):
    return spark.createDataFrame([(e, f"a,{e}" if i else None, float(i)) for e in range(events) for i in range(each)], "event_id long, name string, v double")


@pytest.fixture
def nothing_by_the_driver(monkeypatch):
    def refuse(*_):
        raise AssertionError("the driver renames files one by one")

    monkeypatch.setattr(S, "_named_files", refuse)


def test_tasks_write_and_copy(spark, tmp_path, nothing_by_the_driver):
    source, target = str(tmp_path / "a b"), str(tmp_path / "copy")
    df = rows(spark, 40).unionByName(spark.createDataFrame([(None, "lost", 0.0)], "event_id long, name string, v double"))
    S.write_event_files(df, "event_id", [S.F.desc("v")], source)
    assert sorted(p.name for p in (tmp_path / "a b").iterdir()) == sorted(f"comma_{e}.csv" for e in range(40))
    assert (tmp_path / "a b" / "comma_7.csv").read_text() == 'name,v\n"a,7",2.0\n"a,7",1.0\n,0.0\n'
    (tmp_path / "a b" / "comma_9.csv").write_bytes(b"name,v\r\nlast,1")
    some = spark.createDataFrame([(7,), (9,), (9,)], "event_id long")
    assert {(r.event_id, r.fetched) for r in S.fetch_events(spark, source, target, some).collect()} == {(7, True), (9, True)}
    assert (tmp_path / "copy" / "comma_9.csv").read_bytes() == b"name,v\r\nlast,1"
    (tmp_path / "copy" / "comma_7.csv").write_text("kept")
    again = S.fetch_events(spark, source, target).collect()
    assert len(again) == 40 and {r.event_id for r in again if not r.fetched} == {7, 9}
    assert (tmp_path / "copy" / "comma_7.csv").read_text() == "kept" and len(list((tmp_path / "copy").glob("comma_*.csv"))) == 40
    assert not list((tmp_path / "copy").glob("_*"))


def test_other_stores_get_the_same_files(spark, tmp_path, monkeypatch):
    S.write_event_files(rows(spark, 5), "event_id", [S.F.desc("v")], str(tmp_path / "one"))
    monkeypatch.setattr(S, "_mounted", lambda *_: None)
    S.write_event_files(rows(spark, 5), "event_id", [S.F.desc("v")], str(tmp_path / "two"))
    S.fetch_events(spark, str(tmp_path / "one"), str(tmp_path / "three"))
    text = [{p.name: p.read_text() for p in (tmp_path / d).glob("comma_*.csv")} for d in ("one", "two", "three")]
    assert len(text[0]) == 5 and text[0] == text[1] == text[2]


def test_a_file_written_again_has_no_old_checksum(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "x")
    with monkeypatch.context() as m:
        m.setattr(S, "_mounted", lambda *_: None)
        S.write_event_files(rows(spark, 2, 9), "event_id", ["v"], path)
    S.write_event_files(rows(spark, 2, 4), "event_id", ["v"], path)
    assert S.read_positions(spark, path, ",").count() == 8


def test_a_header_lists_no_file_by_itself(spark, tmp_path):
    rng = np.random.default_rng(2)
    for event in range(60):
        (tmp_path / f"comma_{event}.csv").write_text("time_stamp;v\n" + "".join(f"t;{x}\n" for x in rng.integers(0, 9, 4)))
    context = spark.sparkContext
    context.setJobGroup("headers", "")
    try:
        assert S.csv_columns(spark, str(tmp_path)) == ["time_stamp", "v"]
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    tracker = context.statusTracker()
    stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup("headers") for s in tracker.getJobInfo(j).stageIds]
    assert sum(s.numTasks for s in stages if s) < 20
    assert S.read_positions(spark, str(tmp_path)).count() == 240
