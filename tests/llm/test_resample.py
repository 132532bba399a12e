import hashlib
import math
import re
import zlib
from collections import Counter

import pytest

from galewatch.llm import resample


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text))


def plain(docs, target, n, buckets, percent, seed, least):
    def features(text):
        w = words(text)
        return [zlib.crc32(" ".join(w[i : i + k]).encode()) % buckets for k in range(1, n + 1) for i in range(len(w) - k + 1)]

    source, aim = Counter(b for _, t in docs for b in features(t)), Counter(b for t in target for b in features(t))
    s, t = sum(source.values()), sum(aim.values())
    gain = [math.floor(1000 * math.log((aim[b] + 1) * (s + buckets) / ((source[b] + 1) * (t + buckets)))) for b in range(buckets)]
    rows = []
    for i, text in docs:
        f = features(text)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([i, len(f), weight, score, None, len(words(text)) >= least])
    able = sorted((r for r in rows if r[5]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for rank, r in enumerate(able[: len(able) * percent // 100], 1):
        r[4] = rank
    return key([tuple(r[:5]) for r in rows])


def key(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x or 0) for x in r))


def texts():
    out = [(i, " ".join(f"w{(i * 7 + j * j) % (9 + i % 31)}" for j in range(i % 57))) for i in range(120)]
    # Long ones: chunks end within words, a word is longer than a chunk, chunks without words, letters beyond the first plane.
    out += [(200, "Alpha beta, " * 300), (201, "x" * 500 + " y " + "z" * 300), (202, " - " * 400), (203, "a" + " " * 700 + "b c"), (204, "𝔞𝔟 ÄÖ straße " * 90), (205, "w1 w2 " * 250 + "w3")]
    return out


@pytest.mark.parametrize("n", [1, 2, 3])
@pytest.mark.parametrize("size", [64, 65536])
def test_as_a_plain_version(spark, n, size):
    docs, target = texts(), ["w1 w2 w3 alpha", "beta alpha, Beta", None, "long text of its own " * 40]
    found = resample.resampled(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(t,) for t in target], "text string"), n=n, buckets=97, percent=30, seed=5, least=10, size=size)
    assert key(map(tuple, found.collect())) == plain(docs, target, n, 97, 30, 5, 10)


def test_odd_documents(spark, odd_documents):
    docs = [(r["doc_id"], r["text"]) for r in odd_documents.collect()]
    target = spark.createDataFrame([("wort und mehr", 1)], "text string, doc_id int")
    found = resample.resampled(odd_documents, target, n=2, buckets=11, percent=50, seed=1, least=2, size=100)
    assert key(map(tuple, found.collect())) == plain(docs, ["wort und mehr"], 2, 11, 50, 1, 2)


def test_repeated_long_rows_are_documents_each(spark):
    docs = [(3, "one two three four " * 50)] * 4 + [(3, "another text of that id " * 50), (None, "no id " * 60), (None, "no id " * 60)]
    found = resample.resampled(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([("two",)], "text string"), n=2, buckets=31, percent=40, seed=2, least=1, size=80)
    assert key(map(tuple, found.collect())) == plain(docs, ["two"], 2, 31, 40, 2, 1)


def test_empty_tables(spark, no_documents):
    aim = spark.createDataFrame([("two",)], "text string")
    assert resample.resampled(no_documents, aim).count() == 0
    docs = spark.createDataFrame([(1, "a b c"), (2, None)], "doc_id long, text string")
    found = resample.resampled(docs, aim.limit(0), n=1, buckets=7, percent=100, least=1)
    assert key(map(tuple, found.collect())) == plain([(1, "a b c"), (2, None)], [], 1, 7, 100, 2024, 1)


def test_chunks_own_every_word_once(spark):
    text = "ab cd, efg " * 40 + "h" * 90 + " i"
    df = spark.createDataFrame([(1, text)], "id long, _text string")
    rows = resample.chunked(df, ["id"], 3, 50).orderBy("part").collect()
    assert len(rows) > 5
    assert [w for r in rows for w in r["own"]] == words(text)
    for one, two, three in zip(rows, [*rows[1:], None], [*rows[2:], None, None], strict=True):
        after = [*(two["own"] if two else []), *(three["own"] if three else [])]
        assert one["carry"] == after[:2]
