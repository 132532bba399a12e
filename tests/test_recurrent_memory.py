"""The recurrent network's tasks hold a bounded number of steps at once, whatever an Arrow batch has."""

import tracemalloc
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from galewatch.operators import models as M
from galewatch.operators import training as T


def batch(rows, steps=8, features=8):
    rng = np.random.default_rng(4)
    lists = lambda a, n: pa.ListArray.from_arrays(pa.array(np.arange(0, len(a) + 1, n, dtype=np.int32)), a)
    x = lists(lists(pa.array(rng.normal(size=rows * steps * features).astype(np.float32)), features), steps)
    y, m = (lists(pa.array(rng.integers(0, 2, rows * steps), pa.int32()), steps) for _ in range(2))
    return pa.RecordBatch.from_arrays([x, y, m], names=["features", "labels", "mask"])


def test_losses_go_over_few_steps_at_once(monkeypatch):
    w, own, seen = M.RecurrentWeights.random(8), batch(6000), []

    def watched(weights, x):
        seen.append(x.shape[0] * x.shape[1])
        return M.recurrent_probabilities(weights, x)

    monkeypatch.setattr(T, "recurrent_probabilities", watched)
    shared = SimpleNamespace(value=T.State.new(w).dumps())
    (got,) = T._losses(shared, 3.0)([own])
    assert sum(seen) == 48000 and max(seen) <= 16384
    x, y, m = T._sequences(own)[8]
    p = np.clip(M.recurrent_probabilities(w, x).astype(np.float64), 1e-12, 1 - 1e-12)
    assert got.column(0)[0].as_py() == pytest.approx(T.masked_loss(np.log(p / (1 - p)), y, m, 3.0), rel=1e-6)
    assert got.column(1)[0].as_py() == m.sum()


def test_sequences_are_read_without_a_python_object_for_each_number():
    own = batch(10_000)
    tracemalloc.start()
    x, y, m = T._sequences(own)[8]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 16e6
    rows = own.to_pylist()
    assert x[77].tolist() == rows[77]["features"] and y[9999].tolist() == rows[9999]["labels"] and m.shape == (10_000, 8)


def test_sequences_of_several_lengths():
    kinds = [pa.list_(pa.list_(pa.float32())), pa.list_(pa.int32()), pa.list_(pa.int32())]
    rows = [([[1.0, 2.0]], [1], [1]), (None, None, None), ([[3.0, 4.0], [5.0, 6.0]], [0, 1], [1, 0]), ([], [], []), ([[7.0, 8.0]], [0], [1])]
    own = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["features", "labels", "mask"])
    got = T._sequences(own.slice(1))
    assert got[2][0].tolist() == [[[3, 4], [5, 6]]] and got[1][0].tolist() == [[[7, 8]]] and got[2][1].tolist() == [[0, 1]] and set(got) == {1, 2}
    uneven = pa.RecordBatch.from_arrays([pa.array([[[1.0], [2.0]]], kinds[0]), pa.array([[1]], kinds[1]), pa.array([[1, 1]], kinds[2])], names=["features", "labels", "mask"])
    with pytest.raises(ValueError):
        T._sequences(uneven)


def test_scores_of_a_large_batch(spark):
    w, own = M.RecurrentWeights.random(8), batch(5000)
    df = spark.createDataFrame(pa.Table.from_batches([own])).repartition(1)
    x = T._sequences(own)[8][0]
    got = {tuple(r.features[0]): r.probabilities for r in M.recurrent_scores(df, w).collect()}
    assert len(got) == 5000
    want = M.recurrent_probabilities(w, x)
    assert all(got[tuple(map(float, s[0]))] == pytest.approx(p.tolist(), abs=1e-5) for s, p in zip(x[::50], want[::50], strict=True))
