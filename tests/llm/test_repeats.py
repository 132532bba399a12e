"""Suffix order against sorting, and removal against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from galewatch.llm import repeats as R
from galewatch.llm.suffixes import common_prefixes, joined, suffix_order, words_of


def check_order(strings, depth):
    symbols, begin = joined(strings)
    of = np.repeat(np.arange(len(strings)), [len(s) + 1 for s in strings])
    order = suffix_order(symbols, depth)
    assert sorted(order.tolist()) == list(range(len(symbols)))
    heads = [strings[of[i]][i - begin[of[i]] :][:depth] for i in order]
    assert heads == sorted(heads)
    full = [i for i, s in enumerate(strings) if s]
    own = [s for s in strings if s]
    symbols, begin = joined(own)
    count = np.array([len(s) // 3 + 1 for s in own])
    part = suffix_order(symbols, depth, None, begin, count)
    of = np.repeat(np.arange(len(own)), [len(s) + 1 for s in own])
    kept = part[part - begin[of[part]] < count[of[part]]]
    assert sorted(kept.tolist()) == [b + i for b, c in zip(begin, count, strict=True) for i in range(c)]
    heads = [own[of[i]][i - begin[of[i]] :][:depth] for i in kept]
    assert heads == sorted(heads) and len(full) == len(own)
    order = suffix_order(symbols, depth)
    heads = [own[of[i]][i - begin[of[i]] :][:depth] for i in order]
    for some in (np.arange(len(order)), np.flatnonzero(order % 5 != 2)):
        same = common_prefixes(order[some], symbols, words_of(symbols, depth), depth)
        picked = [heads[i] for i in some]
        assert same.tolist() == [len(a) == depth and a == b for a, b in zip(picked, picked[1:], strict=False)]


@pytest.mark.parametrize("letters", [1, 2, 3, 255])
def test_suffix_order(letters):
    rng = np.random.default_rng(letters)
    draw = lambda n: bytes(rng.integers(0, letters + 1, n).astype(np.uint8))
    for depth in (24, 200, 512):
        check_order([draw(n) for n in (1, 2, 3, 50, 400)], depth)
    base = draw(60)
    check_order([base * 9, base[:30], base[10:] * 3, base * 9, b"", draw(200) + base * 5], 24)


def brute(rows, least):
    raws = [(i, (t or "").encode()) for i, t in rows]
    count = Counter(raw[a : a + least] for _, raw in raws for a in range(len(raw) - least + 1))
    out = []
    for i, raw in raws:
        gone = np.zeros(len(raw) + 2, bool)
        for a in range(len(raw) - least + 1):
            if count[raw[a : a + least]] > 1:
                gone[a + 1 : a + least + 1] = True
        out.append((i, len(raw), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum()), hashlib.sha256(bytes(b for b, g in zip(raw, gone[1:], strict=False) if not g)).hexdigest()))
    return sorted(out, key=str)


def made():
    rng = random.Random(4)
    letters = "abcdefghij é😀"
    fresh = lambda n: "".join(rng.choices(letters, k=n))
    passage, other = fresh(300), fresh(260)
    rows = [fresh(rng.randrange(40)) + passage[: rng.randrange(150, 301)] + fresh(rng.randrange(300)) for _ in range(60)]
    rows += [fresh(50) + other + fresh(30) + other + passage, passage, passage, "z" * 1000, "z" * 200, "z" * 199, "ab" * 300, None, "", fresh(3000)]
    rows += [passage[:120] + fresh(5) + passage[125:], rows[3], rows[3]]
    return [(i if i != 9 else None, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize(("group", "together"), [(400, 64), (7, 64), (7, 2)])
def test_removal_equals_brute_force(spark, monkeypatch, group, together):
    monkeypatch.setattr(R, "GROUP", group)
    monkeypatch.setattr(R, "TOGETHER", together)
    monkeypatch.setattr(R, "HOT_LEAST", 2)
    rows = made()
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, start string, h int")
    assert sorted(map(tuple, R.remove_repeats(docs).collect()), key=str) == brute(rows, 200)


def test_long_texts_in_pieces(monkeypatch):
    rng = random.Random(1)
    text = bytes(rng.choices(b"abcd", k=5000))
    whole = list(R.segments([text]))
    monkeypatch.setattr(R, "PIECE", 700)
    windows = lambda found: {(i, h, s + j, part[j : j + 200]) for i, h, s, n, part in found for j in range(n)}
    assert windows(R.segments([text])) == windows(whole) and len(windows(whole)) == 4801


def test_table_and_no_rows(spark, no_documents):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert sorted(map(tuple, R.remove_repeats(docs).collect()), key=str) == brute([(r.doc_id, r.text) for r in docs.collect()], 200)
    assert R.remove_repeats(no_documents).collect() == []
