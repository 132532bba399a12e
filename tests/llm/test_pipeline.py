"""Each stage on what its predecessor kept, against plain versions; and the whole run."""

import pytest

pipeline = pytest.importorskip("corpus_pipeline")

from test_near_dedup import brute  # noqa: E402
from test_row_operators import plain_spans  # noqa: E402

from galewatch.llm import langid  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = spark.createDataFrame([(9001, "12 34 56", None, "s", 8), (9002, None, "en", None, 0), (9003, "token=abcdefgh123 is here and there", "en", "s", 35)], docs.schema)
    docs = docs.unionByName(extra).unionByName(docs.limit(3))
    kept = {}
    for name, stage in pipeline.STAGES:
        before = {(r.doc_id, r.text) for r in docs.collect()}
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        if name != "packing":
            assert out.columns == docs.columns
            kept[name] = {(r.doc_id, r.text) for r in out.collect()}
        if name == "language_id":
            rejected = {r.doc_id for r in langid.identify(docs).collect() if r.reject}
            assert {9001, 9002} <= rejected and kept[name] == {x for x in before if x[0] not in rejected}
        if name == "exact_dedup":
            top = {}
            for i, t in before:
                top[t] = max(i, top.get(t, -1))
            assert kept[name] == {(i, t) for t, i in top.items()} and out.count() == len(top)
        if name == "near_dedup":
            want = brute(list(before), 5, 80)
            assert kept[name] == {(i, t) for i, t in before if want[i][1] == i}
        if name == "secret_scan":
            assert {i for i, _ in kept[name]} == {i for i, _ in before} and not any(plain_spans(t) for _, t in kept[name])
            clean = {(i, t) for i, t in before if not plain_spans(t)}
            assert len(clean & kept[name]) >= len(clean) - 2 and all(r.n_chars == len(r.text) for r in out.collect())
        if name == "packing":
            assert {r.doc_id for r in out.collect()} == {i for i, _ in kept["secret_scan"]}
        docs = out


def test_run(spark):
    rows = pipeline.run(spark, SF).collect()
    assert rows and sum(r.length for r in rows) == sum(r.doc_tokens for r in rows if r.start == 0)
