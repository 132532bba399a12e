"""Odd inputs for every operator and stage: clashing names, null and least ids, repeated rows, empty tables; and who answers."""

import hashlib

import duckdb
import numpy as np
import pytest

from galewatch.llm import exact_dedup, langid, near_dedup, packing, pieces, queries, repeats, secrets
from galewatch.llm.queries import token_pattern, vocabulary

SF = "/root/testdata/sf0.01"
NAMES = "kept_id kept_sha kept_number gone_id _gone_id _kept_id _kept_sha id rid h r level sha top key digest component block role list chunk".split()


def clashing(spark, rows):
    """rows: (doc_id, text), with a column for each name that an operator might use itself."""
    return spark.createDataFrame([(i, t, "en", *range(len(NAMES))) for i, t in rows], "doc_id long, text string, lang string, " + ", ".join(f"{n} int" for n in NAMES))


ROWS = [(1, "the same words in the same order, again"), (2, "the same words in the same order, again"), (2, "the same words in the same order, again"), (None, None), (3, ""), (4, "quite another text, of its own")]


def test_stages_take_any_column_names(spark):
    docs = clashing(spark, ROWS)
    one = exact_dedup.deduplicated(docs)
    assert one.columns == docs.columns and sorted((r.doc_id, r.text) for r in one.collect()) == [(2, ROWS[0][1]), (3, ""), (4, ROWS[-1][1])]
    two = near_dedup.deduplicated(docs)
    assert two.columns == docs.columns and sorted(two.toPandas().doc_id.fillna(-1)) == [-1, 1, 3, 4]
    three = secrets.redact(docs, vocabulary("byte_bpe_50k.tiktoken"), token_pattern())
    assert three.columns == docs.columns and three.count() == 6
    four = langid.identified(docs)
    assert four.columns == docs.columns and four.count() == 4


def test_queries_take_any_column_names(spark):
    docs = clashing(spark, ROWS)
    assert exact_dedup.exact_duplicates(docs).count() == 6
    assert near_dedup.near_duplicates(docs).count() == 6
    assert repeats.remove_repeats(docs).count() == 6
    assert packing.pack_documents(docs, vocabulary("word_bpe_49k.json")).filter("start = 0").count() == 6
    assert langid.identify(docs).count() == 6
    assert pieces.encode_documents(docs, vocabulary("piece_bpe_32k.model")).count() == 6
    assert secrets.scan(docs, vocabulary("byte_bpe_50k.tiktoken"), token_pattern()).count() == 6


def test_null_ids_are_less_than_the_least(spark):
    least = -(2**63)
    docs = clashing(spark, [(least, "a"), (None, "a"), (None, "b"), (None, "b")])
    rows = exact_dedup.exact_duplicates(docs).collect()
    assert sorted((r.text_sha256 == hashlib.sha256(b"a").hexdigest(), r.keep_id, r.group_size, r.kept) for r in rows if r.text_sha256 == hashlib.sha256(b"a").hexdigest()) == [(True, least, 2, False), (True, least, 2, True)]
    kept = exact_dedup.deduplicated(docs).collect()
    assert sorted((r.text, r.doc_id) for r in kept) == [("a", least), ("b", None)]


def test_hot_groups_are_joined_apart(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "HOT_LEAST", 2)
    docs = clashing(spark, [(i, "hot") for i in range(40)] + [(i, f"cold {i // 2}") for i in range(40, 50)])
    rows = exact_dedup.exact_duplicates(docs).collect()
    assert len(rows) == 50 and {(r.keep_id, r.group_size) for r in rows} == {(39, 40)} | {(i, 2) for i in range(41, 50, 2)}
    assert sum(r.kept for r in rows) == 6


def test_no_rows(spark, no_documents):
    none = no_documents.selectExpr("doc_id", "text", "cast(null as string) lang")
    for found in (exact_dedup.deduplicated(none), near_dedup.deduplicated(none), langid.identified(none), langid.identify(none), near_dedup.near_duplicates(none), secrets.redact(none, vocabulary("byte_bpe_50k.tiktoken"), token_pattern()), repeats.remove_repeats(none)):
        assert found.collect() == []


def test_pieces_of_a_whole_table_equal_the_librarys(spark):
    import sentencepiece

    path = vocabulary("piece_bpe_32k.model")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    want = {}
    for r in docs.collect():
        ids = lib.encode(r.text or "")
        want[r.doc_id] = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(lib.decode(ids).encode()).hexdigest())
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in pieces.encode_documents(docs, path).collect()}
    assert got == want


def test_pieces_come_from_the_agenda(spark, monkeypatch):
    """With an agenda that never merges, the reported columns are those of its ids, or the run fails."""
    path = vocabulary("piece_bpe_32k.model")
    coder = pieces.PieceEncoder(path)
    own = [coder.symbol[c] for c in "▁the"]
    coder.encode = lambda texts: [np.array(own, np.int32).tobytes() for _ in texts]
    docs = spark.createDataFrame([(1, "the")], "doc_id long, text string")

    class Context:
        def mapInArrow(self, run, schema):
            self.run = run
            return self

        def select(self, *columns):
            return self

    import pyarrow as pa

    monkeypatch.setitem(pieces._encoders, path, coder)
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array([1], pa.int64()), "text": ["the"]})
    (out,) = list(pieces.encode_documents(Context(), path, strict=False).run([batch]))
    (row,) = out.to_pylist()
    assert row["n_tokens"] == len(own) and not row["agreed"] and row["ids_sha256"] == hashlib.sha256(",".join(map(str, own)).encode()).hexdigest()
    with pytest.raises(ValueError):
        list(pieces.encode_documents(Context(), path).run([batch]))
    assert docs.count() == 1


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "labels", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    found = con.execute(queries.ORACLE[name])
    columns = sorted(d[0] for d in found.description)
    df = queries.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert sorted(df.columns) == columns
    show = lambda rows, names: sorted(tuple(repr(r[names.index(c)]) for c in columns) for r in rows)
    assert show([tuple(r) for r in df.collect()], df.columns) == show(found.fetchall(), [d[0] for d in found.description])


def test_rejection_is_above_chance(spark):
    assert langid.rejected(0.0, 4) and langid.rejected(0.49, 4) and not langid.rejected(0.51, 4)
    assert langid.rejected(0.6, 2) and not langid.rejected(0.7, 2) and not langid.rejected(1.0, 1)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    planted = spark.createDataFrame([(90001, "ωψχ φ", None), (90002, "123 456", None), (90003, None, None)], "doc_id long, text string, lang string")
    rows = langid.identify(docs.select("doc_id", "text", "lang").unionByName(planted)).collect()
    gone = {r.doc_id for r in rows if r.reject}
    assert {90002, 90003} <= gone and len(gone) <= 3 + 0.005 * len(rows)
    assert all(r.reject == langid.rejected(r.score, 4) for r in rows)


def test_a_rare_language_is_learned(spark, monkeypatch):
    monkeypatch.setattr(langid, "TOTAL", 40)
    docs = spark.createDataFrame([(i, "wort und mehr davon", f"l{i % 20}") for i in range(200)], "doc_id long, text string, lang string")
    found = langid.sample(docs, "doc_id", "text", "lang", 5)
    assert len({lang for _, lang in found}) == 20 and len(found) <= 40


def test_unused_names():
    class Frame:
        columns = ["A", "_a"]

    from galewatch.llm.common import unused

    assert unused("a", Frame()) == "__a" and unused("b", Frame()) == "b"


