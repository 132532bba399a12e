"""Derivative records of archived web pages.

Each response gives a metadata record and a plain-text conversion record, as web archives hold them beside their
responses: both refer to the response's identifier, keep its target, and carry its HTTP headers and digests. All of it
is column expressions, so pages never leave the executors' JVM, and nothing is shuffled.
"""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Tags that end a line of text.
BLOCKS = "p|div|br|hr|li|ul|ol|dl|dt|dd|tr|td|th|table|h1|h2|h3|h4|h5|h6|nav|main|article|section|header|footer|aside|blockquote|pre|title|figure|form|body|head|html"
#: (pattern, replacement), in order, from markup to text. What isn't closed runs to the end or to the next <, so no character is looked at from many starts.
STEPS = (
    (r"(?is)<script\b.*?(?:</script\s*>|\z)", ""),
    (r"(?is)<style\b.*?(?:</style\s*>|\z)", ""),
    (r"(?s)<!--.*?(?:-->|\z)", ""),
    (rf"(?i)</?({BLOCKS})\b[^<>]*>", "\n"),
    (r"<[^<>]*>", ""),
)
#: A character reference after its ampersand, and the characters of the named ones: the standard library's table. Spaces that don't break are spaces.
REFERENCE = r"^(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});"
NAMED = {name: " " if point == 160 else chr(point) for name, point in sorted(name2codepoint.items())} | {"apos": "'"}
SPACES = ((r"[ \t\r\f]+", " "), (r" ?\n[ \n]*", "\n"))
#: A tag ends before the next <, and a title's text does.
TITLE, LANGUAGE, LINK = r"(?i)<title[^<>]*>([^<]*)", r'(?i)<html\b[^<>]*\blang="([^"<>]*)"', r"(?i)<a\s[^<>]*href="
VERSION, SOFTWARE = "WARC/1.1", "galewatch derivatives"


def _replaced(c: Column, steps: tuple) -> Column:
    for pattern, by in steps:
        c = F.regexp_replace(c, F.lit(pattern), F.lit(by))
    return c


def _character(name: Column) -> Column:
    """The character that a reference names; null for an unknown name. No character is U+FFFD."""
    hexadecimal = F.lower(F.substring(name, 2, 1)) == "x"
    point = F.when(hexadecimal, F.conv(F.substring(name, F.lit(3), F.length(name)), 16, 10)).otherwise(F.substring(name, F.lit(2), F.length(name))).cast("long")
    known = (point > 0) & (point < 0x110000) & ~point.between(0xD800, 0xDFFF)
    number = F.when(point == 160, " ").when(known, F.decode(F.unhex(F.lpad(F.hex(point), 8, "0")), "UTF-32")).otherwise("\ufffd")
    named = F.create_map(*[F.lit(x) for pair in NAMED.items() for x in pair])
    return F.when(F.startswith(name, F.lit("#")), number).when(name != "", F.element_at(named, name))


def _once(value: Column, use) -> Column:
    """use(value), with value computed once however often use mentions it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _decoded(part: Column) -> Column:
    """What comes after an ampersand, with its reference as a character if there is one."""
    plain = F.concat(F.lit("&"), part)
    rest = lambda name: F.coalesce(F.concat(_character(name), F.substring(part, F.length(name) + 2, F.length(part))), plain)
    return _once(F.regexp_extract(part, REFERENCE, 1), rest)


def _characters(c: Column) -> Column:
    """Character references as their characters, each once: what is between two ampersands is looked at by itself."""
    joined = lambda parts: F.concat(F.element_at(parts, 1), F.array_join(F.transform(F.slice(parts, 2, F.greatest(F.lit(0), F.size(parts) - 1)), _decoded), ""))
    return _once(c, lambda text: F.when(F.contains(text, F.lit("&")), _once(F.split(text, "&", -1), joined)).otherwise(text))


def plain_text(html: Column) -> Column:
    """The text of a page: no scripts, styles, comments or tags; a line for each block; character references as characters."""
    return F.trim(_replaced(_characters(_replaced(html, STEPS)), SPACES), F.lit(" \n"))


def record_id(kind: str, *of: Column) -> Column:
    """A UUID that depends on the page alone, so that a run can be repeated."""
    h = F.md5(F.concat_ws("\n", F.lit(kind), *of).cast("binary"))
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def _digest(c: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(c.cast("binary"), 256))


def derivatives(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Two rows per page: page_id, record_type (metadata, conversion), record_id, refers_to, target_uri, source_headers,
    source_digest, content_type, content_length (bytes), block_digest, content.

    A null page or address is empty, and gives records like any other; a null id stays null and counts as empty text in
    identifiers. Repeated rows give equal records. Other columns aren't read, whatever their names. An empty table gives
    no rows. A page of any length is converted whole, in time that grows with its length, unclosed tags or not: a script or
    style without an end runs to the page's end, any other tag, and a title, to the next <.
    """
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.coalesce(F.col(url).cast("string"), F.lit("")).alias("target_uri"), F.coalesce(F.col(html).cast("string"), F.lit("")).alias("html"))
    key = F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.col("target_uri")
    headers = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length("html").cast("string"), F.lit("\r\n"))
    title = F.trim(_replaced(_characters(F.regexp_extract("html", TITLE, 1)), ((r"[ \t\r\f\n]+", " "),)))
    fields = F.concat(
        F.lit("title: "), title, F.lit("\r\nlanguage: "), F.regexp_extract("html", LANGUAGE, 1),
        F.lit("\r\noutlinks: "), F.regexp_count("html", F.lit(LINK)).cast("string"), F.lit("\r\nsource-status: 200\r\nsource-length: "), F.octet_length("html").cast("string"), F.lit("\r\n"),
    )
    made = rows.select(
        "page_id",
        "target_uri",
        record_id("response", *key).alias("refers_to"),
        headers.alias("source_headers"),
        _digest(F.col("html")).alias("source_digest"),
        F.explode(
            F.array(
                F.struct(F.lit("metadata").alias("record_type"), record_id("metadata", *key).alias("record_id"), F.lit("application/warc-fields").alias("content_type"), fields.alias("content")),
                F.struct(F.lit("conversion").alias("record_type"), record_id("conversion", *key).alias("record_id"), F.lit("text/plain; charset=utf-8").alias("content_type"), plain_text(F.col("html")).alias("content")),
            )
        ).alias("r"),
    )
    out = made.select("page_id", "r.record_type", "r.record_id", "refers_to", "target_uri", "source_headers", "source_digest", "r.content_type", F.col("r.content").alias("content"))
    return out.select("page_id", "record_type", "record_id", "refers_to", "target_uri", "source_headers", "source_digest", "content_type", F.octet_length("content").cast("long").alias("content_length"), _digest(F.col("content")).alias("block_digest"), "content")


def serialized(records: DataFrame, date: str) -> DataFrame:
    """(page_id, record_type, record): each record as it stands in an archive file, dated `date` (ISO 8601, UTC)."""
    named = (
        ("WARC-Type", "record_type"), ("WARC-Record-ID", "record_id"), ("WARC-Refers-To", "refers_to"), ("WARC-Target-URI", "target_uri"),
        ("WARC-Block-Digest", "block_digest"), ("WARC-Source-Payload-Digest", "source_digest"), ("Content-Type", "content_type"), ("Content-Length", "content_length"),
    )
    lines = [F.lit(f"{VERSION}\r\nWARC-Date: {date}\r\nWARC-Software: {SOFTWARE}\r\n")]
    for name, column in named:
        lines += [F.lit(f"{name}: "), F.col(column).cast("string"), F.lit("\r\n")]
    source = F.concat(F.lit("WARC-Source-HTTP: "), F.regexp_replace(F.trim(F.col("source_headers"), F.lit("\r\n")), "\r\n", "; "), F.lit("\r\n"))
    return records.select("page_id", "record_type", F.concat(*lines, source, F.lit("\r\n"), "content", F.lit("\r\n\r\n")).alias("record"))


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def oracle() -> str:
    """The same in DuckDB's SQL."""

    def replaced(c: str, steps) -> str:
        for pattern, by in steps:
            by = "chr(10)" if by == "\n" else _quoted(by)
            c = f"regexp_replace({c}, {_quoted(pattern)}, {by}, 'g')"
        return c

    names = "MAP {" + ", ".join(f"{_quoted(k)}: {_quoted(v)}" for k, v in NAMED.items()) + "}"

    def characters(c: str) -> str:
        name = f"regexp_extract(x, {_quoted(REFERENCE)}, 1)"
        point = f"CASE WHEN lower(substr({name}, 2, 1)) = 'x' THEN ('0x' || substr({name}, 3))::BIGINT ELSE try_cast(substr({name}, 2) AS BIGINT) END"
        number = f"CASE WHEN {point} = 160 THEN ' ' WHEN {point} > 0 AND {point} < 1114112 AND NOT {point} BETWEEN 55296 AND 57343 THEN chr(({point})::INTEGER) ELSE chr(65533) END"
        found = f"CASE WHEN {name} LIKE '#%' THEN {number} ELSE {names}[{name}] END"
        return f"array_to_string(list_transform(string_split({c}, '&'), lambda x, i: CASE WHEN i = 1 THEN x ELSE coalesce({found} || substr(x, length({name}) + 2), '&' || x) END), '')"

    def identifier(kind: str) -> str:
        h = f"md5({_quoted(kind)} || chr(10) || coalesce(page_id::VARCHAR, '') || chr(10) || target_uri)"
        return "'<urn:uuid:' || " + " || '-' || ".join(f"substr({h}, {a}, {n})" for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))) + " || '>'"

    crlf = "chr(13) || chr(10)"
    text = f"trim({replaced(characters(replaced('html', STEPS)), SPACES)}, ' ' || chr(10))"
    first = ((r"[ \t\r\f\n]+", " "),)
    title = replaced(characters(f"regexp_extract(html, {_quoted(TITLE)}, 1)"), first)
    title = f"trim({title}, ' ')"
    fields = (
        f"'title: ' || {title} || {crlf} || 'language: ' || regexp_extract(html, {_quoted(LANGUAGE)}, 1) || {crlf} || 'outlinks: ' || len(regexp_extract_all(html, {_quoted(LINK)})) || {crlf}"
        f" || 'source-status: 200' || {crlf} || 'source-length: ' || strlen(html) || {crlf}"
    )
    each = f"""page_id, '{{0}}' AS record_type, {{1}} AS record_id, {identifier("response")} AS refers_to, target_uri,
        'HTTP/1.1 200 OK' || {crlf} || 'Content-Type: text/html; charset=utf-8' || {crlf} || 'Content-Length: ' || strlen(html) || {crlf} AS source_headers,
        'sha256:' || sha256(html) AS source_digest, '{{2}}' AS content_type, {{3}} AS content"""
    one = each.format("metadata", identifier("metadata"), "application/warc-fields", fields)
    two = each.format("conversion", identifier("conversion"), "text/plain; charset=utf-8", text)
    return f"""
        WITH p AS (SELECT page_id, coalesce(url, '') AS target_uri, coalesce(html, '') AS html FROM pages),
        r AS (SELECT {one} FROM p UNION ALL SELECT {two} FROM p)
        SELECT page_id, record_type, record_id, refers_to, target_uri, source_headers, source_digest, content_type,
               strlen(content) AS content_length, 'sha256:' || sha256(content) AS block_digest, content
        FROM r
    """
