"""The .npy data source: round trips, ranges of rows, and what NumPy itself reads and writes."""

import glob

import numpy as np
import pytest
from pyspark.sql import functions as F

from galewatch.sources.tensors import read_tensor, write_tensor


def test_round_trip_in_many_ranges(spark, tmp_path):
    df = spark.range(0, 1000, 1, 7).select(F.col("id"), F.array(*(F.col("id") * 6 + i for i in range(6))).alias("v"))
    path = str(tmp_path / "t")
    write_tensor(df, "v", path, (3, 2), "i4", size=1200)
    parts = sorted(glob.glob(path + "/*"))
    assert len(parts) > 20 and all(p.endswith(".npy") for p in parts)
    whole = np.concatenate([np.load(p) for p in parts])
    assert whole.shape == (1000, 3, 2) and whole.dtype == np.int32 and (whole.ravel() == np.arange(6000)).all()
    back = read_tensor(spark, path, size=500)
    assert back.rdd.getNumPartitions() > 40
    rows = back.orderBy("row").collect()
    assert [r.row for r in rows] == list(range(1000)) and [v for r in rows for v in r.x] == list(range(6000))


def test_a_file_that_numpy_wrote(spark, tmp_path):
    x = np.random.default_rng(1).normal(size=(50, 4)).astype(np.float32)
    np.save(tmp_path / "x.npy", x)
    assert np.allclose([r.x for r in read_tensor(spark, str(tmp_path / "x.npy"), size=100).orderBy("row").collect()], x)
    np.save(tmp_path / "one.npy", np.arange(5.0))
    assert [r.x for r in read_tensor(spark, str(tmp_path / "one.npy")).orderBy("row").collect()] == [[i] for i in range(5)]


def test_odd_tensors(spark, tmp_path):
    np.save(tmp_path / "none.npy", np.zeros((0, 3)))
    assert read_tensor(spark, str(tmp_path / "none.npy")).count() == 0
    (tmp_path / "empty").mkdir()
    assert read_tensor(spark, str(tmp_path / "empty")).count() == 0
    np.save(tmp_path / "f.npy", np.asfortranarray(np.ones((3, 2))))
    with pytest.raises(Exception, match="by columns"):
        read_tensor(spark, str(tmp_path / "f.npy")).count()
    bad = spark.createDataFrame([([1.0, 2.0],), ([1.0],)], "v array<double>")
    with pytest.raises(Exception, match="must have 2 numbers"):
        write_tensor(bad, "v", str(tmp_path / "bad"), (2,))
    assert not glob.glob(str(tmp_path / "bad") + "/*.npy")
