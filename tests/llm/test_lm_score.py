"""Counts and base scores against a plain version; the attention model's gradients, windows and probabilities."""

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from galewatch.llm import attention, lm_score
from galewatch.llm.common import swept
from galewatch.llm.queries import vocabulary

RANKS = "byte_bpe_50k.tiktoken"


@pytest.fixture(scope="module")
def pieces():
    return attention.Pieces(vocabulary(RANKS), 600)


@pytest.fixture
def quick(monkeypatch):
    """A model of a few steps, trained here: workers have their own copy of the module."""

    def fitted(learned, size, pieces, block=0):
        return attention.train(pieces, [lm_score.words_of(r.text)[:200] for r in learned.orderBy("doc_id", "text").limit(50).collect()], 40)

    monkeypatch.setattr(lm_score, "fitted", fitted)


def brute(rows):
    fold = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7
    counts = Counter()
    for i, t in rows:
        if fold(i) != 2:
            counts.update([*lm_score.words_of(t or ""), None])
    n, v = sum(counts.values()), len(counts)
    out = []
    for i, t in rows:
        c = [counts[w] for w in [*lm_score.words_of(t or ""), None]]
        out.append((i, fold(i) == 2, len(c), sum(x > 0 for x in c), n, round(sum(math.log10((x + 1) / (n + v + 1)) for x in c), 6)))
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [8_000_000, 20_000])
def test_base_scores(spark, quick, block):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = lm_score.score_documents(docs, vocabulary(RANKS), block=block, bucket=100_000).collect()
    assert sorted(((*r[:5], round(r.base_score, 6)) for r in rows), key=str) == brute([(r.doc_id, r.text) for r in docs.collect()])
    assert all(math.isfinite(r.score) and r.score < 0 for r in rows)


def test_odd_rows(spark, quick, odd_documents, no_documents):
    rows = lm_score.score_documents(odd_documents, vocabulary(RANKS)).collect()
    assert sorted(((*r[:5], round(r.base_score, 6)) for r in rows), key=str) == brute([(r.doc_id, r.text) for r in odd_documents.collect()])
    assert lm_score.score_documents(no_documents, vocabulary(RANKS)).collect() == []
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    only = spark.createDataFrame([(held, "nothing to learn from")], "doc_id long, text string")
    (row,) = lm_score.score_documents(only, vocabulary(RANKS)).collect()
    assert (row.held_out, row.n_tokens, row.n_known, row.train_tokens) == (True, 5, 0, 0) and math.isfinite(row.score)


def test_gradients_equal_differences(pieces):
    rng = np.random.default_rng(0)
    m = attention.new_model(pieces, np.ones(pieces.size))
    for name in "eqkvdubt":
        setattr(m, name, getattr(m, name).astype(np.float64))
    seen = rng.integers(0, 30, (3, attention.WINDOW))
    want = rng.integers(0, 30, (3, attention.WINDOW))
    seen[0, :8] = want[0, :8] = pieces.pad
    _, grads = attention.gradients(m, seen, want, pieces)
    for w, g in zip(m.parts(), grads, strict=True):
        for at in map(tuple, np.argwhere(np.abs(g) > np.abs(g).max() / 2)[:3]):
            old, e = w[at], 1e-4
            w[at] = old + e
            up = attention.gradients(m, seen, want, pieces)[0]
            w[at] = old - e
            down = attention.gradients(m, seen, want, pieces)[0]
            w[at] = old
            assert abs((up - down) / (2 * e) - g[at]) < 0.02 * abs(g[at]) + 1e-6


def test_pieces_spell_words(pieces):
    words = [b"the", "übergrößen".encode(), b"x", b"thething", bytes(range(33, 60)), "日本".encode()]
    ids, first = pieces.split(np.frombuffer(b"".join(words), np.uint8), np.array([len(w) for w in words]))
    assert first.sum() == len(words) and ((ids >= pieces.count) == first).all()
    by_id = {i: bytes([i]) for i in range(256)}
    letters = {int(pieces.of[b]): b for b in attention.LETTERS}
    for n, table in pieces.by_length.items():
        for code in np.flatnonzero(table >= 0).tolist():
            by_id[int(table[code])] = bytes(letters[(code >> 6 * (n - 1 - j)) & 63] for j in range(n))
    spelled = [[]]
    for i, f in zip(ids.tolist(), first.tolist(), strict=True):
        spelled += [[]] if f else []
        spelled[-1].append(by_id[i % pieces.count])
    assert [b"".join(s) for s in spelled[1:]] == words


def test_every_place_is_scored_once_and_sums_to_one(pieces):
    texts = [[b"the"] * n for n in (0, 1, 10, 200)] + [[b"an", b"other"] * 9]
    seen, want, begin, size, _ = attention.sequences(pieces, texts)
    place, inside = attention.windows(begin, size)
    scored = place[:, attention.CONTEXT :][inside[:, attention.CONTEXT :]]
    assert sorted(scored.tolist()) == list(range(len(seen)))
    m = attention.train(pieces, texts, 30)
    tables = np.ascontiguousarray(m.tables().T)
    start = tables[pieces.count : pieces.end + 1].sum(0)
    logs, starts = attention.score(m, tables, start, seen, want, begin, size, pieces.pad)
    mix = attention._forward(m, np.where(inside, seen[place], pieces.pad), pieces.pad)[-1][:, attention.CONTEXT :][inside[:, attention.CONTEXT :]]
    assert np.allclose((mix * tables[want[scored]]).sum(1), np.exp(logs[scored]), rtol=1e-3)
    assert np.allclose(mix @ start, np.exp(starts[scored]), rtol=1e-3) and np.allclose(mix @ tables.sum(0), 1, atol=1e-4)


def test_training_lowers_the_loss(spark, pieces):
    texts = [lm_score.words_of(r.text)[:150] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    held, learned = texts[::5], [t for i, t in enumerate(texts) if i % 5]

    def loss(m):
        tables = np.ascontiguousarray(m.tables().T)
        s = attention.sequences(pieces, held)
        return -attention.score(m, tables, tables.sum(0), *s[:4], pieces.pad)[0].mean()

    assert loss(attention.train(pieces, learned, 500)) < loss(attention.train(pieces, learned, 1)) - 0.5


def test_score_is_the_mixture(spark, quick, pieces):
    """The model's log10 probability of whole texts, from plain counts and the network's own word probabilities."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60)
    rows = [(r.doc_id, r.text or "") for r in docs.collect()]
    got = {r.doc_id: r.score for r in lm_score.score_documents(docs, vocabulary(RANKS), block=20_000, bucket=30_000).collect()}
    learned = [(i, t) for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2]
    counts = Counter(w for _, t in learned for w in [*lm_score.words_of(t), None])
    n, v = sum(counts.values()), len(counts)
    full = attention.Pieces(vocabulary(RANKS))
    model = attention.train(full, [lm_score.words_of(t)[:200] for _, t in sorted(learned)[:50]], 40)
    tables = model.tables()
    for i, t in rows[:25]:
        seen, want, begin, size, starts = attention.sequences(full, [lm_score.words_of(t)])
        place, inside = attention.windows(begin, size)
        mix = attention._forward(model, np.where(inside, seen[place], full.pad), full.pad)[-1][:, attention.CONTEXT :][inside[:, attention.CONTEXT :]]
        p = (mix * tables.T[want]).sum(1)
        begins = mix @ tables[:, full.count : full.end + 1].sum(1)
        heads = [*np.flatnonzero(starts).tolist(), len(want) - 1]
        total = 0.0
        for w, a in zip([*lm_score.words_of(t), None], heads, strict=True):
            b = heads[heads.index(a) + 1] if w is not None else len(want)
            # A word is its pieces, given that one starts here, and then another word or the end.
            spelled = p[a:b].prod() / begins[a] * (begins[b] if w is not None else 1)
            joined = max(counts[w] - lm_score.DISCOUNT, 0) / n + lm_score.DISCOUNT * v / n * spelled
            total += math.log10((1 - lm_score.SPELLED) * joined + lm_score.SPELLED * spelled)
        assert abs(total - got[i]) < 1e-3 * abs(total) + 1e-3


def test_fitting_does_not_depend_on_partitions(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    size = sum(len((r.text or "").encode()) for r in docs.collect())
    pieces = attention.Pieces(vocabulary(RANKS))
    model = lm_score.fitted(docs, size, pieces, block=size // 3)
    again = lm_score.fitted(docs.repartition(7), size, pieces, block=size // 3)
    assert all(np.array_equal(a, b) for a, b in zip(model.parts(), again.parts(), strict=True))
    assert all(np.isfinite(w).all() for w in model.parts())


def test_every_text_is_learned_from(spark):
    """As many windows as all texts have, whatever the shards; a word of any length is spelled whole."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    texts = [lm_score.words_of(r.text or "") for r in docs.collect()] + [[b"a" * 5000]]
    pieces = attention.Pieces(vocabulary(RANKS))
    whole = attention.window_count(attention.sequences(pieces, texts))
    place, inside = attention.windows(*attention.sequences(pieces, texts)[2:4], 0)
    assert sorted(place[inside].tolist()) == list(range(len(attention.sequences(pieces, texts)[0]))) and len(place) == whole
    docs = docs.unionByName(spark.createDataFrame([(None, "a" * 5000)], docs.schema))
    start = spark.sparkContext.broadcast(attention.new_model(pieces, np.ones(pieces.size)).vector())
    dealt = docs.selectExpr("pmod(xxhash64(doc_id, text), 5) shard", "text").repartitionById(5, F.col("shard").cast("int"))
    rows = dealt.mapInArrow(lm_score._refined(pieces, start), lm_score.MEANS).filter("part = 0").collect()
    assert sum(r.weight for r in rows) == whole


def test_the_setting_for_shuffles_is_put_back(spark):
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    with pytest.raises(ZeroDivisionError), swept(spark):
        assert spark.conf.get(name) == "true"
        1 / 0  # noqa: B018
    assert spark.conf.get(name) == before


def test_means_of_means(monkeypatch, pieces):
    rows = [{"part": 0, "shard": i, "weight": i + 1, "values": np.full(3, i, np.float32).tobytes()} for i in range(7)]

    def level(rows):
        return [r for b in lm_score._averaged(iter([pa.RecordBatch.from_pylist(rows)])) for r in b.to_pylist()]

    monkeypatch.setattr(lm_score, "GROUP", 3)
    once = level(rows)
    assert [(r["shard"], r["weight"]) for r in once] == [(0, 6), (1, 15), (2, 7)]
    (last,) = level(once)
    assert last["weight"] == 28 and np.allclose(np.frombuffer(last["values"], np.float32), sum(i * (i + 1) for i in range(7)) / 28)


def test_parameters_on_end(pieces):
    m = attention.new_model(pieces, np.ones(pieces.size))
    again = attention.Model.of_vector(m.vector(), pieces)
    assert all(np.array_equal(a, b) for a, b in zip(m.parts(), again.parts(), strict=True))
    texts = [[b"some", b"words"] * 30, [b"others"] * 50]
    start = attention.train(pieces, texts, 50)
    more, count = attention.refine(pieces, attention.Model.of_vector(start.vector(), pieces), texts * 200)
    assert count == attention.window_count(attention.sequences(pieces, texts)) * 200
    s = attention.sequences(pieces, texts)

    def loss(m):
        tables = np.ascontiguousarray(m.tables().T)
        return -attention.score(m, tables, tables.sum(0), *s[:4], pieces.pad)[0].mean()

    assert loss(more) < loss(start)


def test_each_different_word_is_split_once(pieces, monkeypatch):
    """Repeated words cost no further splitting, within a call and from one batch of texts to the next; ids are as without that."""
    texts = [[b"the", b"others", b"the"] * 50, [], [b"the"], [b"some", b"the"] * 7]
    whole = attention.sequences(pieces, texts)
    split, split_bytes = attention.Pieces.split, []

    def watched(self, raw, size):
        split_bytes.append(len(raw))
        return split(self, raw, size)

    monkeypatch.setattr(attention.Pieces, "split", watched)
    assert all(np.array_equal(a, b) for a, b in zip(attention.sequences(pieces, texts), whole, strict=True))
    assert split_bytes == [len(b"theotherssome")]
    splitter = attention.Splitter(pieces)
    parts = [splitter.sequences(splitter.numbered([t])[0]) for t in texts]
    assert sum(split_bytes) == 2 * split_bytes[0]
    assert np.array_equal(np.concatenate([p[1] for p in parts]), whole[1]) and np.array_equal(np.concatenate([p[4] for p in parts]), whole[4])
    ids, first = split(pieces, np.frombuffer(b"".join(w for t in texts for w in t), np.uint8), np.array([len(w) for t in texts for w in t]))
    assert np.array_equal(whole[1][whole[1] != pieces.end], ids) and np.array_equal(whole[4][whole[1] != pieces.end], first)


def test_ids_that_texts_lack_keep_their_rows(pieces):
    """What isn't learned is not moved either, but stays part of what tables sum to."""
    texts = [[b"some", b"words"] * 300, [b"others"] * 500]
    start = attention.new_model(pieces, np.ones(pieces.size))
    there = np.unique(np.concatenate([*attention.sequences(pieces, texts)[:2], [pieces.pad]]))
    more, _ = attention.refine(pieces, attention.Model.of_vector(start.vector(), pieces), texts)
    lacking = np.setdiff1d(np.arange(pieces.size), there)
    assert np.array_equal(more.e[lacking], start.e[lacking]) and np.array_equal(more.t[:, lacking], start.t[:, lacking])
    assert not np.array_equal(more.e[there], start.e[there]) and np.allclose(more.tables().sum(1), 1, atol=1e-4)


def test_counts_of_a_block():
    """Training counts of all words, those of other texts alone included, whatever is merged in between."""
    texts = [(7, 1, "a b a"), (7, 0, "b c"), (8, 1, "a"), (7, 1, "c a d"), (7, 0, "e e")]
    batch = pa.RecordBatch.from_pylist([dict(zip(("block", "learn", "text"), t, strict=True)) for t in texts])
    got: dict[int, dict] = {}
    for sent in lm_score._counted(3)(iter([batch, batch])):
        for r in sent.to_pylist():
            assert {h % 3 for h in np.frombuffer(r["hashes"], np.uint64).tolist()} == {r["bucket"]}
            got.setdefault(r["block"], {}).update(zip(np.frombuffer(r["hashes"], np.uint64).tolist(), np.frombuffer(r["counts"], np.int64).tolist(), strict=True))
    named = dict(zip(lm_score.hashed([b"a", b"b", b"c", b"d", b"e"]).tolist(), "abcde", strict=True))
    assert {b: {named[h]: c for h, c in x.items()} for b, x in got.items()} == {7: {"a": 6, "b": 2, "c": 2, "d": 2, "e": 0}, 8: {"a": 2}}
