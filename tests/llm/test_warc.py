"""Records against ones written by hand, and odd pages."""

import hashlib
import time
import uuid

import pytest

from galewatch.llm import warc

PAGE = """<!DOCTYPE html><html lang="de"><head><title> Zw&ouml;lf &amp;
 drei </title><style>p { color: red }</style></head><body><!-- <p>no</p> --><p>Caf&#233;&nbsp;&#x26; T&uuml;r &lt;b&gt;</p>
<script>if (a < b) { document.write("<p>no</p>") }</script><ul><li><a href="/x">one</a><li><A HREF='y'>two</A></ul>AT&T &unknown; &amp;amp; &#0;</body></html>"""
TEXT = "Zwölf &\ndrei\nCafé & Tür <b>\none\ntwo\nAT&T &unknown; &amp; �"


def sha(s):
    return "sha256:" + hashlib.sha256(s.encode()).hexdigest()


@pytest.fixture(scope="module")
def rows(spark):
    pages = [(1, "http://a/1", PAGE), (1, "http://a/1", PAGE), (2, None, None), (3, "u", ""), (None, "v", "text only"), (5, "w", "<p>never <script>closed" + "x" * 200_000)]
    df = spark.createDataFrame([(*p, "clash", b"", 0) for p in pages], "page_id long, url string, html string, record_id string, content binary, refers_to int")
    return warc.derivatives(df).collect()


def test_conversion_record(rows):
    one, again = [r for r in rows if r.page_id == 1 and r.record_type == "conversion"]
    assert one == again and one.content == TEXT
    assert (one.target_uri, one.content_type, one.content_length, one.block_digest) == ("http://a/1", "text/plain; charset=utf-8", len(TEXT.encode()), sha(TEXT))
    assert one.source_digest == sha(PAGE) and one.source_headers == f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(PAGE.encode())}\r\n"


def test_metadata_record(rows):
    meta, _ = [r for r in rows if r.page_id == 1 and r.record_type == "metadata"]
    want = f"title: Zwölf & drei\r\nlanguage: de\r\noutlinks: 2\r\nsource-status: 200\r\nsource-length: {len(PAGE.encode())}\r\n"
    assert (meta.content, meta.content_type, meta.block_digest) == (want, "application/warc-fields", sha(want))


def test_identifiers_link_the_records_of_a_page(rows):
    of = {}
    for r in rows:
        assert uuid.UUID(r.record_id[10:-1]) and r.record_id.startswith("<urn:uuid:") and r.record_id.endswith(">")
        of.setdefault((r.page_id, r.target_uri), set()).add(r.refers_to)
    assert all(len(v) == 1 for v in of.values()) and len(set.union(*of.values())) == len(of) == 5
    assert len({r.record_id for r in rows}) == 10


def test_odd_pages(rows):
    text = {r.page_id: r for r in rows if r.record_type == "conversion"}
    assert len(rows) == 12 and text[2].content == text[3].content == "" and text[2].target_uri == ""
    assert text[None].content == "text only" and text[5].content == "never"


def test_no_pages(spark):
    assert warc.derivatives(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_serialized(spark):
    page = spark.createDataFrame([(1, "http://a/1", "<p>x")], "page_id long, url string, html string")
    records = warc.derivatives(page)
    (r,) = records.filter("record_type = 'conversion'").collect()
    (got,) = [s.record for s in warc.serialized(records, "2024-01-02T03:04:05Z").collect() if s.record_type == "conversion"]
    head, _, body = got.partition("\r\n\r\n")
    lines = head.split("\r\n")
    assert lines[0] == "WARC/1.1" and body == "x\r\n\r\n"
    fields = dict(line.split(": ", 1) for line in lines[1:])
    assert fields["WARC-Type"] == "conversion" and fields["WARC-Date"] == "2024-01-02T03:04:05Z" and fields["Content-Length"] == "1"
    assert (fields["WARC-Refers-To"], fields["WARC-Record-ID"], fields["WARC-Target-URI"]) == (r.refers_to, r.record_id, "http://a/1")
    assert fields["WARC-Block-Digest"] == sha("x") and fields["WARC-Source-Payload-Digest"] == sha("<p>x")
    assert fields["WARC-Source-HTTP"] == "HTTP/1.1 200 OK; Content-Type: text/html; charset=utf-8; Content-Length: 4"


def test_long_pages_of_unclosed_tags_take_no_longer(spark):
    """A million characters of each kind, within a second of a plain page of that length (and of it twice, as machines vary)."""

    def took(html):
        pages = spark.createDataFrame([(1, "http://a/", html)], "page_id long, url string, html string")
        best = float("inf")
        for _ in range(2):
            began = time.perf_counter()
            warc.derivatives(pages).write.format("noop").mode("overwrite").save()
            best = min(best, time.perf_counter() - began)
        return best

    size = 1_000_000
    plain = took("<p>some words</p> " * (size // 18))
    for tag in ("<title>", "<a ", "<html ", "<html lang=", "<script ", "<style ", "<!-- ", "</script ", "<", "<p ", "&#"):
        assert took(tag * (size // len(tag))) < 2 * plain + 1, tag


def test_unclosed_tags(spark):
    pages = spark.createDataFrame([(1, "u", '<html lang="de" x><title>A &amp; b<p>text <a href=x>l</a><script src=y>no</script > end<style>no')], "page_id long, url string, html string")
    got = {r.record_type: r.content for r in warc.derivatives(pages).collect()}
    assert "title: A & b\r\nlanguage: de\r\noutlinks: 1\r\n" in got["metadata"] and got["conversion"] == "A & b\ntext l end"
