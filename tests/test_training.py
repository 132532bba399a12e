"""Training of the recurrent network: gradients, masks, shards, early stopping and going on."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from galewatch.operators import training as T
from galewatch.operators.models import RecurrentWeights, cell_states, recurrent_probabilities


def weights(features=3, hidden=4, depth=2, seed=1, both_ways=False):
    w = RecurrentWeights.random(features, hidden, depth, seed, both_ways)
    return T.of_flat([p.astype(np.float64) for p in T.flat(w)])


@pytest.mark.parametrize("both_ways", [False, True])
def test_gradients_equal_differences(both_ways):
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(5, 6, 3)), (rng.random((5, 6)) < 0.4).astype(float)
    mask = (rng.random((5, 6)) < 0.8).astype(float)
    parts = [p.copy() for p in T.flat(weights(both_ways=both_ways))]
    assert len(parts) == (18 if both_ways else 10)
    _, grads = T.gradients(T.of_flat(parts), x, y, mask, 3.0)
    loss = lambda: T.gradients(T.of_flat(parts), x, y, mask, 3.0)[0]
    for p, g in zip(parts[:-1], grads[:-1], strict=True):
        assert p.shape == g.shape
        for at in [tuple(i) for i in np.argwhere(np.abs(g) >= np.sort(np.abs(g).ravel())[-2])[:2]]:
            old = p[at]
            p[at] = old + 1e-5
            up = loss()
            p[at] = old - 1e-5
            down = loss()
            p[at] = old
            assert (up - down) / 2e-5 == pytest.approx(g[at], rel=1e-3, abs=1e-8)
    assert grads[-1] == pytest.approx((T.gradients(T.of_flat([*parts[:-1], parts[-1] + 1e-5]), x, y, mask, 3.0)[0] - loss()) / 1e-5, rel=1e-3)


def test_masked_steps_change_nothing():
    rng = np.random.default_rng(1)
    x, y, mask = rng.normal(size=(4, 6, 3)), np.ones((4, 6)), np.ones((4, 6))
    mask[:, 4:] = 0
    one = T.gradients(weights(), x, y, mask, 2.0)
    other = x.copy()
    other[:, 4:] = 100  # after the last valid step
    two = T.gradients(weights(), other, 1 - y + mask * (2 * y - 1), mask, 2.0)
    assert one[0] == pytest.approx(two[0]) and all(np.allclose(a, b) for a, b in zip(one[1], two[1], strict=True))


@pytest.fixture(scope="module")
def sequences(spark):
    """The label of a step is whether the sum of the first feature so far is positive."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 8, 2))
    rows = [(i, s.tolist(), (s[:, 0].cumsum() > 0).astype(int).tolist(), [1] * 7 + [0]) for i, s in enumerate(x)]
    return spark.createDataFrame(rows, "i int, features array<array<float>>, labels array<int>, mask array<int>").cache()


def test_training_learns(sequences):
    train, val = sequences.filter("i < 320"), sequences.filter("i >= 320")
    state = T.train_recurrent(train, val, 2, hidden=8, epochs=12, rate=1e-2, dropout=0.1)
    losses = [v for _, _, v in state.history]
    assert state.best_loss == min(losses) < 0.7 * losses[0] and len(state.best) == 10
    again = T.train_recurrent(train.repartition(7), val, 2, hidden=8, epochs=12, rate=1e-2, dropout=0.1)
    assert np.allclose(again.history, state.history, rtol=1e-2)


def test_both_ways_are_a_plain_run_over_reversed_steps():
    w = weights(both_ways=True)
    x = np.random.default_rng(3).normal(size=(2, 5, 3))
    one, two = (RecurrentWeights([c], np.eye(4)[0], 0.0) for c in w.cells[:2])
    assert w.both_ways and not one.both_ways and len(w.layers()) == 2
    states = np.concatenate([cell_states(w.cells[0], x), cell_states(w.cells[1], x[:, ::-1])[:, ::-1]], 2)
    assert np.allclose(states[:, 0, :4], cell_states(w.cells[0], x[:, :1])[:, 0]) and np.allclose(states[:, -1, 4:], cell_states(w.cells[1], x[:, -1:])[:, 0])
    top = np.concatenate([cell_states(w.cells[2], states), cell_states(w.cells[3], states[:, ::-1])[:, ::-1]], 2)
    assert np.allclose(recurrent_probabilities(w, x), 1 / (1 + np.exp(-(top @ w.head + w.bias))), atol=1e-6)
    assert recurrent_probabilities(two, x).shape == (2, 5)


def test_what_comes_later_is_learned_both_ways_alone(sequences):
    """The label of a step is whether the sum of the features after it is positive."""
    later = F.transform(F.col("features"), lambda _, t: (F.aggregate(F.slice("features", t + 2, 8), F.lit(0.0).cast("float"), lambda s, f: s + f[0].cast("float")) > 0).cast("int"))
    rows = sequences.withColumn("features", F.col("features").cast("array<array<float>>")).withColumn("labels", later)
    train, val = rows.filter("i < 320"), rows.filter("i >= 320")
    one, two = (T.train_recurrent(train, val, 2, hidden=8, rate=1e-2, dropout=0.1, epochs=12, both_ways=b) for b in (False, True))
    assert two.best_loss < 0.75 * one.best_loss and len(two.best) == 18
    again = T.State.loads(two.dumps())
    assert T.of_flat(again.best).both_ways


def test_shards_are_averaged(sequences):
    train, val = sequences.filter("i < 320"), sequences.filter("i >= 320")
    state = T.train_recurrent(train, val, 2, hidden=8, epochs=8, rate=1e-2, dropout=0.0, shard=80)
    assert state.history[-1][2] < 0.85 * state.history[0][2]


def test_going_on_equals_not_stopping(sequences):
    train, val = sequences.filter("i < 320"), sequences.filter("i >= 320")
    saved = []
    whole = T.train_recurrent(train, val, 2, hidden=4, epochs=4, rate=1e-2, keep=lambda s: saved.append(s.dumps()))
    assert len(saved) == 4
    more = T.train_recurrent(train, val, 2, hidden=4, epochs=4, rate=1e-2, state=T.State.loads(saved[1]))
    assert np.allclose(more.history, whole.history, rtol=1e-3)


def test_early_stop_and_errors(sequences):
    train, val = sequences.filter("i < 320"), sequences.filter("i >= 320")
    state = T.train_recurrent(train, val.withColumn("labels", F.transform("labels", lambda y: 1 - y)), 2, hidden=4, epochs=30, rate=2e-2, patience=2)
    assert state.epoch < 30 and state.waited == 2
    assert T.masked_positive_weight(train) > 0
    with pytest.raises(ValueError):
        T.masked_positive_weight(train.withColumn("labels", F.transform("labels", lambda y: F.lit(0))))
    with pytest.raises(ValueError):
        T.train_recurrent(train, val, 2, epochs=0)


def test_latency():
    rows = T.latency(RecurrentWeights.random(10, 4), 12, 10, (1, 4), 3, 1)
    assert [r[0] for r in rows] == [1, 4] and all(0 < low <= mid <= high and per == mid / n for n, mid, low, high, per in rows)
