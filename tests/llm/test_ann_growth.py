"""Recall and lists read on tables with many lists, and vectors at the limits of doubles."""

import numpy as np
import pytest
from test_ann import answers

from galewatch.llm import ann


def measured(x, asked=150, k=5):
    """Share of true neighbours whose lists a query reads, and the share of lists that it reads."""
    rng = np.random.default_rng(1)

    def nearest(rows):
        like = x[rows] @ x.T
        like[np.arange(len(rows)), rows] = -9
        return np.argpartition(-like, k, 1)[:, :k].ravel()

    lists = min(ann.VALUES // (ann.SAMPLE * x.shape[1]), len(x) // ann.LIST)
    rest = rng.permutation(np.arange(asked, len(x)))
    sample, tried = rest[: lists * ann.SAMPLE], rest[lists * ann.SAMPLE :][: ann.TRIED]
    c = ann.calibrated(ann.fit(x[sample], lists), x[tried], np.repeat(np.arange(len(tried)), k), x[nearest(tried)])
    true = nearest(np.arange(asked))
    row, chosen = ann.lists_of_vectors(c, x[true])
    of = [set(chosen[row == i].tolist()) for i in range(len(true))]
    row, chosen = ann.lists_of_queries(c, x[:asked])
    read = [set(chosen[row == i].tolist()) for i in range(asked)]
    return np.mean([bool(of[i] & read[i // k]) for i in range(len(true))]), np.mean([len(r) for r in read]) / len(c.at)


@pytest.mark.parametrize("n", [100_000, 300_000])
def test_recall_holds_without_structure(n):
    recall, _ = measured(ann._unit(np.random.default_rng(1).standard_normal((n, 64), dtype=np.float32)))
    assert recall >= 0.92


def test_few_lists_are_read_where_there_is_structure():
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((1000, 64), dtype=np.float32)
    recall, read = measured(ann._unit(centres[rng.integers(0, 1000, 200_000)] + 0.35 * rng.standard_normal((200_000, 64), dtype=np.float32)))
    assert recall >= 0.95 and read < 0.05


def test_large_and_small_components(spark):
    rows = [(0, [1e200, 1e200]), (50, [1e-200, 1e-200]), (1, [1e200, 0.0]), (2, [1.0, 1.0]), (3, [5e-324, 0.0]), (4, [-1e308, -1e308])]
    got = answers(ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")))
    half = 0.5**0.5
    assert [i for i, _ in got[0]] == [2, 50, 1, 3, 4] and [i for i, _ in got[50]] == [0, 2, 1, 3, 4]
    assert [s for _, s in got[0]] == pytest.approx([1, 1, half, half, -1], abs=1e-13)


def test_parallel_vectors_tie(spark):
    rng = np.random.default_rng(3)
    v = rng.standard_normal(7)
    rows = [(i, (v * f).tolist()) for i, f in enumerate([1, 3, 7, 1 / 3, 0.1, 1e5, 11])]
    got = answers(ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")))
    assert got[0] == [(i, 1.0) for i in (1, 2, 3, 4, 5)]


def test_other_dimensions_are_compared_with_their_own(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.standard_normal(8).tolist()) for i in range(300)] + [(i, rng.standard_normal(3).tolist()) for i in range(300, 460)] + [(500, [1.0]), (501, [-2.0]), (550, [1.0, 0.0])]
    got = answers(ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), list_size=20))
    assert got.keys() == {*range(0, 460, 50), 500}
    assert got[500] == [(501, -1.0)]
    of = dict(rows)
    for q in (300, 350, 400, 450):
        y = np.array(of[q]) / np.linalg.norm(of[q])
        want = sorted((-float(np.dot(y, np.array(v) / np.linalg.norm(v))), i) for i, v in rows if len(v) == 3 and i != q)[:5]
        assert [i for i, _ in got[q]] == [i for _, i in want]
