"""Gradients against differences, pooling against one text at a time, held-out accuracy."""

import zlib

import numpy as np
import pytest

from galewatch.llm import langid


def test_gradients_equal_differences():
    rng = np.random.default_rng(0)
    net = langid.Network.new(["a", "b", "c"], hidden=3)
    for name in ("x", "u", "v", "c"):
        setattr(net, name, getattr(net, name).astype(np.float64))
    seen, label = rng.integers(97, 102, (4, 7)).astype(np.int16), np.array([0, 1, 2, 1])
    seen[0, 5:] = langid.PAD
    # States are kept in 32 bits, so differences are coarse.
    _, grads = langid.gradients(net, seen, label)
    for w, g in zip((net.x, net.u, net.v, net.c), grads, strict=True):
        for at in map(tuple, np.argwhere(np.abs(g) > 0.02)[:5]):
            old, e = w[at], 1e-2
            w[at] = old + e
            up = langid.gradients(net, seen, label)[0]
            w[at] = old - e
            down = langid.gradients(net, seen, label)[0]
            w[at] = old
            assert abs((up - down) / (2 * e) - g[at]) < 0.05 * abs(g[at]) + 2e-3


def test_pooling_is_by_text():
    net = langid.Network.new(["a", "b"])
    texts = [b"x" * n for n in (1, 255, 256, 257, 1000, 5000)] + [b"", b"abc"]
    together = langid.pooled(net, texts)
    for t, p in zip(texts, together, strict=True):
        assert np.allclose(langid.pooled(net, [t])[0], p, atol=1e-5)
        assert abs(p.sum() - bool(t)) < 1e-4


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = {r.doc_id: r for r in docs.collect()}
    rows = langid.identify(docs).collect()
    assert len(rows) == len(want) and all(0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert {r.doc_id for r in held} == {i for i in want if zlib.crc32(str(i).encode()) % 5 == 0}
    long = [r for r in held if len(want[r.doc_id].text) > 100]
    assert np.mean([r.lang_pred == want[r.doc_id].lang for r in long]) > 0.95
    assert sum(r.reject for r in rows) < 0.01 * len(rows)


def test_texts_without_letters_and_tables_without_labels(spark, odd_documents, no_documents):
    docs = odd_documents.selectExpr("*", "if(doc_id > 4, 'de', 'en') AS lang").union(odd_documents.selectExpr("100 as doc_id", "'12 34 ²!'", "source", "spans", "rid", "kept", "null"))
    rows = {r.doc_id: r for r in langid.identify(docs).collect()}
    assert {i: rows[i].lang_pred for i in (1, 2, 100)} == dict.fromkeys((1, 2, 100), "und")
    assert rows[100].reject and rows[100].score == 0 and rows[3].lang_pred in ("de", "en")
    assert {r.lang_pred for r in langid.identify(odd_documents.selectExpr("doc_id", "text", "cast(null as string) lang")).collect()} == {"und"}
    assert langid.identify(no_documents.selectExpr("*", "text AS lang")).collect() == []


def plain_probabilities(net, text):
    """The mean over bytes, one byte after the other, of both directions' states: each segment begins some bytes before and after."""
    sig = lambda a: 1 / (1 + np.exp(-a))
    k, total = net.u.shape[1], np.zeros(len(net.languages))

    def states(way, some):
        h, out = np.zeros(k), []
        for byte in some:
            took, added = net.x[way][byte].astype(float), h @ net.u[way]
            z, r = sig(took[:k] + added[:k]), sig(took[k : 2 * k] + added[k : 2 * k])
            new = np.tanh(took[2 * k :] + r * added[2 * k :])
            h = (1 - z) * new + z * h
            out.append(h)
        return out

    for left in range(0, len(text), langid.SEGMENT):
        right = min(len(text), left + langid.SEGMENT)
        begin, end = max(0, left - langid.WARM), min(len(text), left + langid.SEGMENT + langid.WARM)
        ahead = states(0, text[begin:right])[left - begin :]
        back = states(1, text[left:end][::-1])[::-1][: right - left]
        for f, b in zip(ahead, back, strict=True):
            e = np.exp(f @ net.v[0] + b @ net.v[1] + net.c)
            total += e / e.sum()
    return total / len(text)


def test_predictions_equal_a_plain_version(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labelled = langid.sample(docs, "doc_id", "text", "lang", 5)
    net = langid.train([t for t, _ in labelled], [n for _, n in labelled])
    rows = {r.doc_id: r for r in langid.identify(docs).collect()}
    checked = 0
    for d in docs.collect():
        r = rows[d.doc_id]
        if d.text is None or not any(map(str.isalpha, d.text)):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        elif len(d.text) < 4000:
            p = plain_probabilities(net, d.text.encode())
            assert net.languages[int(p.argmax())] == r.lang_pred and abs(p.max() - r.score) < 1e-4
            checked += 1
    assert checked > 100


def test_many_languages_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(langid, "LANGUAGES", 2)
    docs = spark.createDataFrame([(i, "some text", f"l{i % 3}") for i in range(1, 30)], "doc_id long, text string, lang string")
    with pytest.raises(ValueError, match="languages at most"):
        langid.identify(docs)
