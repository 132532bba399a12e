"""Answers against brute force."""

import numpy as np
import pytest

from galewatch.llm import ann


def brute(rows, k=5):
    """{query: [(id, score)]}; rows: (id, vector), each once."""
    ids = np.array([r[0] for r in rows])
    x = np.array([r[1] for r in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    out = {}
    for i in np.flatnonzero(ids % 50 == 0):
        s = np.round(x @ x[i], 12)
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != ids[i]][:k]
        out[int(ids[i])] = [(int(ids[j]), s[j]) for j in order]
    return out


def answers(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        own = out.setdefault(r.query_id, [])
        assert r.rank == len(own) + 1
        own.append((r.vec_id, r.score))
    return out


def test_one_list_is_exact(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").limit(120)
    got, want = answers(ann.nearest(table)), brute([(r.vec_id, r.embedding) for r in table.collect()])
    assert got.keys() == want.keys()
    for q in want:
        assert [i for i, _ in got[q]] == [i for i, _ in want[q]]
        assert np.allclose([s for _, s in got[q]], [s for _, s in want[q]])


def test_recall(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    got, want = answers(ann.nearest(table, list_size=32)), brute([(r.vec_id, r.embedding) for r in table.collect()])
    assert got.keys() == want.keys() and all(len(v) == 5 for v in got.values())
    assert np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 5 for q in want]) >= 0.95


def test_copies_ties_and_bad_vectors(spark, monkeypatch):
    monkeypatch.setattr(ann, "CHUNK", 3)
    good = [(i, [1.0, 0.0, 2.0]) for i in range(0, 120)] + [(i, [0.0, float(i), 1.0]) for i in range(120, 160)] + [(200, [2.0, 0.0, 4.0])]
    bad = [(None, [1.0, 1.0, 1.0]), (250, None), (300, [0.0, 0.0, 0.0]), (350, [1.0, None, 1.0]), (400, [float("nan"), 1.0, 1.0]), (450, [float("inf"), 1.0, 1.0]), (500, [])]
    docs = spark.createDataFrame([(i, v, 1, 0.5) for i, v in good + bad + good[:60]], "vec_id long, embedding array<float>, rank int, score double")
    got, want = answers(ann.nearest(docs, list_size=20)), brute(good)
    assert {q: [i for i, _ in v] for q, v in got.items()} == {q: [i for i, _ in v] for q, v in want.items()}


def test_few_and_no_rows(spark):
    rows = [(0, [1.0, 2.0]), (1, [2.0, 1.0]), (50, [1.0, 1.0])]
    got = answers(ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>")))
    assert {q: sorted(i for i, _ in v) for q, v in got.items()} == {0: [1, 50], 50: [0, 1]}
    empty = ann.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>"))
    assert empty.collect() == [] and empty.columns == ["query_id", "rank", "vec_id", "score"]
    assert ann.nearest(spark.createDataFrame(rows[1:2], "vec_id long, embedding array<float>")).collect() == []


def test_graph_finds_the_nearest_centroids():
    rng = np.random.default_rng(2)
    x = ann._unit(rng.normal(size=(4000, 16)))
    c = ann.fit(x, 128)
    q = ann._unit(rng.normal(size=(50, 16)))
    ids, far = c.search(q, 32)
    best = ((q[:, None] - c.at[None]) ** 2).sum(2).argmin(1)
    assert (ids[:, 0] == best).mean() > 0.95 and (np.diff(far, axis=1) >= 0).all()
    sizes = np.bincount(c.search(x, 1)[0][:, 0], minlength=len(c.at))
    assert sizes.max() < 8 * sizes.mean()


def test_scores_are_told_apart_to_the_last_digits(spark):
    """Cosines a few 1e-15 below one keep their order, and scaled copies tie, to the smaller id."""
    rows = [(50, [1.0, 0.0]), (1, [1.0, 9e-8]), (2, [3.0, 0.0]), (3, [1.0, 1e-7]), (4, [0.1, 0.0]), (5, [1.0, 0.3])]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).orderBy("rank").collect()
    assert [r.vec_id for r in got] == [2, 4, 1, 3, 5]
    assert [r.score for r in got] == pytest.approx([1.0, 1.0, 0.999999999999996, 0.9999999999999951, 1 / 1.09**0.5], abs=2e-16)


def test_parallel_vectors_tie(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=16)
    rows = [(100 - i, (v * s).tolist()) for i, s in enumerate([1.0, 1 / 3, 7.7, 1e-9, 123.456, 0.1])]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id = 100", k=5).orderBy("rank").collect()
    assert [r.vec_id for r in got] == [95, 96, 97, 98, 99] and {r.score for r in got} == {1.0}


def test_an_id_with_two_vectors_gets_one_list(spark):
    rows = [(50, [1.0, 0.0]), (50, [0.0, 1.0]), (1, [1.0, 0.1]), (2, [0.2, 1.0]), (3, [-1.0, -1.0])]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=2).orderBy("rank").collect()
    assert [(r.query_id, r["rank"], r.vec_id) for r in got] == [(50, 1, 1), (50, 2, 2)]
