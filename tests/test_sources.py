"""Readers and writers on files made here."""

import hashlib

import numpy as np
import pytest

from galewatch.sources import files as S


@pytest.fixture
def folder(tmp_path):
    def make(name, text):
        (tmp_path / name).write_text(text, encoding="utf-8")
        return str(tmp_path / name)

    return make


@pytest.mark.parametrize("d", [",", ";", "\t"])
def test_delimiters(spark, folder, d):
    path = folder("x.csv", f"﻿event_id{d}asset_id{d}value\n1{d}A{d}10\n2{d}B{d}20\n")
    assert S.detect_delimiter(spark, path) == d
    assert [(r.asset_id, r.value) for r in S.read_csv(spark, path, ["asset_id", "value"]).collect()] == [("A", "10"), ("B", "20")]
    assert S.csv_columns(spark, path) == ["event_id", "asset_id", "value"]
    with pytest.raises(ValueError):
        S.read_csv(spark, path, ["missing"])


@pytest.mark.parametrize("text", ["", "one\n2\n"])
def test_no_delimiter(spark, folder, text):
    with pytest.raises(ValueError):
        S.detect_delimiter(spark, folder("x.csv", text))


def test_row_positions_of_split_files(spark, tmp_path):
    rng = np.random.default_rng(1)
    want = {}
    for event in (3, 11):
        values = rng.permutation(6000).tolist()
        (tmp_path / f"comma_{event}.csv").write_text("time_stamp,v\n" + "".join(f"t{v},{v}\n" for v in values))
        want |= {(event, i): str(v) for i, v in enumerate(values)}
    (tmp_path / "comma_event_info.csv").write_text("time_stamp,v\nx,0\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    try:
        rows = S.read_positions(spark, str(tmp_path), ",").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert {(r.event_id, r.row_pos): r.v for r in rows} == want
    assert sorted(r.event_id for r in S.event_files(spark, str(tmp_path)).collect()) == [3, 11]
    events = spark.createDataFrame([(3,), (4,)], "event_id long")
    assert [r.event_id for r in S.without_file(events, S.event_files(spark, str(tmp_path))).collect()] == [4]


def test_numpy_files(spark, tmp_path):
    x = np.arange(24, dtype=np.float32).reshape(4, 3, 2)
    np.save(tmp_path / "x.npy", x)
    np.save(tmp_path / "y.npy", np.asfortranarray(np.arange(6, dtype=np.uint8).reshape(3, 2)))
    rows = {(r.path.rsplit("/", 1)[1], r.row): r.x for r in S.read_numpy(spark, str(tmp_path)).collect()}
    assert rows["x.npy", 2] == x[2].ravel().tolist() and rows["y.npy", 1] == [2, 3] and len(rows) == 7


def test_scaler_provenance(spark, tmp_path):
    scaler = spark.createDataFrame([(1, 5.0, 2.0), (0, 3.0, 1.0)], "feature_index int, mean double, std double")
    path = str(tmp_path / "s")
    S.save_scaler(scaler, ["a", "b"], path, "C", "train")
    assert [(r.name, r["mean"]) for r in S.load_scaler(spark, path, ["a", "b"], "C").orderBy("feature_index").collect()] == [("a", 3), ("b", 5)]
    for names, site, split in ((["b", "a"], "C", "train"), (["a", "b"], "A", "train"), (["a", "b"], "C", "val")):
        with pytest.raises(ValueError):
            S.load_scaler(spark, path, names, site, split)


def test_small_files(spark, folder, tmp_path):
    assert S.load_yaml(spark, folder("m.yaml", "a: [1, 2]\nb: {c: x}\n")) == {"a": [1, 2], "b": {"c": "x"}}
    splits = S.load_splits(spark, folder("s.json", '{"assignments": {"7": "val", "10": "train"}}'))
    assert {r.asset_id: r.split for r in splits.collect()} == {"7": "val", "10": "train"}
    (r,) = S.fingerprints(spark, folder("f.bin", "abc")).collect()
    assert r.sha256 == hashlib.sha256(b"abc").hexdigest()
    df = spark.createDataFrame([("a", 1.5), ("b", None)], "k string, v double")
    assert S.markdown(df.orderBy("k")) == "| k | v |\n| --- | --- |\n| a | 1.5000 |\n| b |  |"
    assert [r.json for r in S.as_json(df).collect()] == ['{"k":"a","v":1.5}', '{"k":"b"}']
    S.append_json_lines(df, str(tmp_path / "log"))
    S.append_json_lines(df, str(tmp_path / "log"))
    assert S.read_json(spark, str(tmp_path / "log"), "k string").count() == 4
