import hashlib
import math

import numpy as np
import pytest

from galewatch.llm import centroids


def plain(rows, k, rounds, scale, seed):
    """Whole-number clustering with Python's own integers, every distance computed."""
    kept = [(i, [math.floor(scale * float(x)) for x in v]) for i, v in rows]
    kept.sort(key=lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    c = [list(v) for _, v in kept[:k]]

    def near(v):
        d = [sum((a - b) ** 2 for a, b in zip(v, m, strict=True)) for m in c]
        return min(range(len(c)), key=lambda j: (d[j], j)), min(d)

    for _ in range(rounds):
        own = {}
        for _, v in kept:
            own.setdefault(near(v)[0], []).append(v)
        for j, vs in own.items():
            c[j] = [sum(col) // len(vs) for col in zip(*vs, strict=True)]
    return sorted((i if i is not None else -1, *near(v)) for i, v in kept), c


def answer(found):
    return sorted((-1 if r["vec_id"] is None else r["vec_id"], r["cluster"], r["distance"]) for r in found.rows.collect())


@pytest.mark.parametrize("seed", [0, 1])
def test_as_a_plain_version(spark, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(5, 12)) * 3
    rows = [(i, (centres[i % 5] + rng.normal(size=12)).tolist()) for i in range(300)]
    found = centroids.clustered(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=5, rounds=4, dimensions=12, scale=256, seed=9, segment=4)
    want, c = plain(rows, 5, 4, 256, 9)
    assert answer(found) == want
    assert found.centroids.tolist() == c


def test_screening_spares_distances_and_finds_the_same():
    rng = np.random.default_rng(3)
    centres = rng.integers(-4000, 4000, (64, 32)) * rng.integers(1, 9, (64, 1))
    q = centres[rng.integers(0, 64, 2000)] + rng.integers(-50, 50, (2000, 32))
    norms, c_norms = (centroids.segment_norms(a, 8) for a in (q, centres))
    which, best, tried = centroids.nearest(q, norms, centres, c_norms)
    d = ((q[:, None] - centres[None]) ** 2).sum(2)
    assert (which == d.argmin(1)).all() and (best == d.min(1)).all()
    assert tried.mean() < 16


def test_ties_go_to_the_smaller_number():
    c = np.array([[4, 0], [0, 4], [4, 0]])
    q = np.array([[2, 2], [4, 0], [0, 0]])
    which, best, _ = centroids.nearest(q, centroids.segment_norms(q, 1), c, centroids.segment_norms(c, 1))
    assert which.tolist() == [0, 0, 0] and best.tolist() == [8, 0, 16]


def test_large_components_stay_exact():
    top = centroids.MOST - 1
    q, c = np.full((1, 64), top), np.stack([np.full(64, -top), np.full(64, -top + 1)])
    which, best, _ = centroids.nearest(q, centroids.segment_norms(q, 8), c, centroids.segment_norms(c, 8))
    assert which.tolist() == [1] and int(best[0]) == 64 * (2 * top - 1) ** 2


def test_odd_rows(spark):
    rows = [
        (1, [0.5, -0.5], "x"), (1, [0.5, -0.5], "x"), (2, None, "x"), (3, [1.0], "x"), (4, [1.0, None], "x"), (5, [float("nan"), 0.0], "x"),
        (6, [float("inf"), 0.0], "x"), (None, [-0.3, 0.1], None), (7, [0.0, 0.0], "x"), (7, [0.1, 0.0], "x"),
    ]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, cluster string")
    found = centroids.clustered(table, k=3, rounds=2, dimensions=2, scale=10, seed=3)
    kept = [(i, v) for i, v, _ in rows if v is not None and len(v) == 2 and all(x is not None and math.isfinite(x) for x in v)]
    assert answer(found) == plain(kept, 3, 2, 10, 3)[0]
    out = centroids.with_inertia(found).collect()
    assert len(out) == 5 and {r["inertia"] for r in out} == {sum(r["distance"] for r in out)}


def test_fewer_vectors_than_centroids_and_none(spark):
    one = spark.createDataFrame([(3, [1.0, 2.0])], "vec_id long, embedding array<float>")
    found = centroids.clustered(one, k=8, rounds=3, dimensions=2)
    assert answer(found) == [(3, 0, 0)] and found.centroids.tolist() == [[1024, 2048]]
    none = centroids.clustered(one.limit(0), dimensions=2)
    assert centroids.with_inertia(none).count() == 0


def test_a_component_beyond_exact_distances_is_an_error(spark):
    big = spark.createDataFrame([(3, [1e9, 2.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="too large"):
        centroids.clustered(big, dimensions=2)
