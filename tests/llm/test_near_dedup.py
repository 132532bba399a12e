"""Links and components against brute force."""

import random
from itertools import combinations

import numpy as np
import pytest

from galewatch.llm import near_dedup as N


def brute(rows, width, percent):
    """{id: (set size, component)}"""
    sets = {}
    for i, t in rows:
        words = (t or "").encode().lower().split()
        sets[i] = {tuple(words[k : k + width]) for k in range(len(words) - width + 1)} if len(words) >= width else ({tuple(words)} if words else set())
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    index = {}
    for i, s in sets.items():
        for x in s:
            index.setdefault(x, []).append(i)
    near = {p for ids in index.values() for p in combinations(sorted(ids), 2)}
    for i, j in near:
        if 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
            a, b = sorted((root(i), root(j)))
            up[b] = a
    return {i: (len(s), root(i)) for i, s in sets.items()}


def made(seed=3):
    """Chains and stars of edited copies whose similarities lie around the thresholds, and short texts."""
    rng, rows = random.Random(seed), []
    words = [f"w{i}" for i in range(400)]
    for _ in range(12):
        base = rng.choices(words, k=rng.choice([8, 20, 60, 200, 600]))
        for _ in range(rng.choice([2, 10, 40])):
            own = list(base)
            for _ in range(rng.randrange(0, max(2, len(own) // 20))):
                own[rng.randrange(len(own))] = rng.choice(words)
            if rng.random() < 0.3:
                base = own
            rows.append(" ".join(own).title() if rng.random() < 0.2 else "\n ".join(own))
    rows += ["", None, " ", "one", "One", "one two", "one  TWO", "one two three", rows[0], rows[5]]
    return list(enumerate(rows, 1))


@pytest.mark.parametrize(("width", "percent"), [(3, 85), (5, 80)])
def test_components_equal_brute_force(spark, monkeypatch, width, percent):
    monkeypatch.setattr(N, "CHUNK", 8)
    monkeypatch.setattr(N, "SPLIT", 3)
    rows = made()
    got = N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=width, percent=percent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows, width, percent)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got) and len(got) == len(rows)


@pytest.mark.parametrize("percent", [70, 80, 85])
def test_index_holds_every_link(spark, percent):
    """All pairs of different components that link are among the index's pairs; others are few."""
    from pyspark.sql import types as T

    rng, sets = np.random.default_rng(percent), {}
    pool = rng.integers(1, 2**62, 3000).astype(np.uint64)
    for family in range(8):
        base = rng.choice(pool, rng.integers(3, 120), replace=False)
        for _ in range(12):
            own = np.concatenate([rng.choice(base, max(1, int(len(base) * rng.uniform(0.8, 1))), replace=False), rng.choice(pool, rng.integers(0, 12))])
            sets[len(sets) + 1] = np.unique(own)
    comp = {i: min(i, (i - 1) // 3 * 3 + 1) for i in sets}
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("x", T.BinaryType())])
    frame = spark.createDataFrame([(i, bytearray(x.tobytes())) for i, x in sets.items()], schema)
    got = N.indexed_pairs(spark.createDataFrame(list(comp.items()), "id long, comp long"), frame, percent).collect()
    want = set()
    for i, j in combinations(sets, 2):
        both = len(np.intersect1d(sets[i], sets[j]))
        if comp[i] != comp[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
            want.add((i, j))
    pairs = {tuple(sorted((r.a, r.b))) for r in got}
    assert want and want <= pairs and len(pairs) == len(got)
    assert all(comp[i] != comp[j] for i, j in pairs) and all((r.n, r.m) == (len(sets[r.a]), len(sets[r.b])) for r in got)


def test_look_alikes_never_meet(spark, monkeypatch):
    """A template with own words: too little in common for a link, large buckets, and no pairs at all."""
    monkeypatch.setattr(N, "CHUNK", 64)
    rng = random.Random(2)
    rows = [(i, " ".join([f"t{k}" for k in range(88)] + [f"own{i}x{k}" for k in range(12)])) for i in range(1, 1601)]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    seen = N.sketches(docs, 1, "doc_id", "text").collect()
    nodes = spark.createDataFrame([(r.doc_id, r.digest) for r in seen], "id long, digest binary")
    sets = N.shingle_sets(docs, nodes, 1, "doc_id", "text")
    assert N.indexed_pairs(nodes.select("id", nodes.id.alias("comp")), sets, 80).isEmpty()
    got = N.near_duplicates(docs, width=1, percent=80).collect()
    assert all(r.kept and r.n_shingles == 100 for r in got) and len(got) == 1600


def test_table_equals_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.collect()], 3, 85)
    got = N.near_duplicates(docs, width=3, percent=85).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want


def test_estimates_are_near_similarities():
    rng = np.random.default_rng(5)
    for n, shared in ((40, 30), (2000, 1700), (300, 10)):
        both = rng.integers(0, 2**63, shared).astype(np.uint64)
        sets = [np.unique(np.concatenate([both, rng.integers(0, 2**63, n - shared).astype(np.uint64)])) for _ in range(2)]
        s = N.registers([N._mixed(x) for x in sets])
        e = N.estimate(s[0], s[1], np.array(n), np.array(n))
        assert abs(e - shared / (2 * n - shared)) < 0.2


def test_odd_rows(spark, odd_documents, no_documents):
    rows = N.near_duplicates(odd_documents, width=3, percent=85).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in rows) == [
        (0, 0, False), (1, 1, True), (2, 2, True), (3, 3, True), (4, 4, True), (5, 5, True), (6, 6, True), (7, 5, False), (7, 5, False)
    ]
    assert N.near_duplicates(no_documents).collect() == []
