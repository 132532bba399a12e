"""Secret scan: fixed patterns, and strings that a public vocabulary can't compress.

A random string gets few characters per token under a byte-pair vocabulary, while words, paths and identifiers get many.
Runs of key characters with a digit are reported where they are below the ratio. Others are split at their separators;
parts that are words, numbers, digests or UUIDs are left out, and what lies between them is reported by the same ratio.
"""

from __future__ import annotations

import base64
import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of

# Fixed values.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "dense")
WORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")

RUN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
DIGEST = re.compile(r"(?:[0-9a-f]+|[0-9A-F]+)\Z")
DIGEST_SIZES = frozenset((32, 40, 48, 56, 64, 96, 128))
UUID = re.compile(r"(?<![0-9A-Za-z])[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}(?![0-9A-Za-z])")
#: A UUID, no digit, digits alone, or a name with a number: such a whole run is judged by its stretches alone.
NAMED = re.compile(
    r"(?:[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"
    r"|[0-9_+/=-]+"
    r"|[A-Za-z_+/=-]+"
    r"|[A-Za-z]+(?:[_/-][A-Za-z]+)*[_-]?[0-9]{1,6})\Z"
)
PART = re.compile(r"[A-Za-z0-9]+")
#: Parts shorter than this say nothing by themselves; of a string without a digit, one part has to be as long as the second.
SHORT, LONG = 5, 12
SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, n_dense long, base_sha256 string, spans string"
#: Characters a token below which a run counts as random.
RATIO = 1.9


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, in order."""
    low = text.lower()
    found = []
    if any(w in low for w in WORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    if longest(text) >= 32:
        found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def longest(text: str) -> int:
    return max(map(len, text.split()), default=0)


def _digest(s: str) -> bool:
    return len(s) in DIGEST_SIZES and bool(DIGEST.match(s))


def random_parts(run: str, count, ratio: float = RATIO) -> list[tuple[int, int]]:
    """(start, end) of the whole run, or of its stretches of 20 characters or more, below the ratio.

    A stretch begins and ends with a part below the ratio, so that words, numbers and digests beside a key don't dilute
    it; within it are further such parts and short ones, as keys have separators too. Short ones beside it that aren't
    in lower case belong to it.
    """
    if not NAMED.match(run) and not _digest(run) and len(run) < ratio * count(run):
        return [(0, len(run))]
    uuids = [m.span() for m in UUID.finditer(run)]
    stretches, fresh, edge = [], True, None
    for m in PART.finditer(run):
        a, b = m.span()
        part, short = m[0], b - a < SHORT
        if any(x < b and a < y for x, y in uuids) or _digest(part) or not (short or (not part.isdigit() and b - a < ratio * count(part))):
            fresh, edge = True, None
        elif short and part.islower():
            edge = None
        elif short:
            edge = a if edge is None else edge
            if not fresh and stretches[-1][1] == a - 1:
                stretches[-1][1] = b
        else:
            if fresh:
                stretches.append([a if edge is None else edge, b, b - a])
            else:
                stretches[-1][1:] = b, max(stretches[-1][2], b - a)
            fresh = False
    found = []
    for a, b, most in stretches:
        # A base64 key's padding is its own.
        while b < len(run) and run[b] == "=":
            b += 1
        s = run[a:b]
        if b - a >= 20 and (most >= LONG or any(c.isdigit() for c in s)) and b - a < ratio * count(s):
            found.append((a, b))
    return found


def dense_spans(text: str, taken: list[tuple[int, int, int]], count, ratio: float = RATIO) -> list[tuple[int, int, int]]:
    """Stretches with few characters a token that overlap none of taken; count gives a string's number of tokens."""
    if longest(text) < 20:
        return []
    found = []
    for m in RUN.finditer(text):
        for a, b in random_parts(m[0], count, ratio):
            a, b = m.start() + a, m.start() + b
            if not any(x < b and a < y for x, _, y in taken):
                found.append((a, 3, b))
    return found


def load_vocabulary(path: str, pattern: str):
    """A tiktoken encoding of a rank file."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan(docs: DataFrame, vocabulary: str, pattern: str, doc_id: str = "doc_id", text: str = "text", ratio: float = RATIO) -> DataFrame:
    """Per row: doc_id, counts by kind, base_sha256 and spans (kind:start:end in code points, end exclusive).

    vocabulary is a tiktoken rank file that exists on every node. No shuffle: rows are scanned where they are read.
    Null texts are empty and give zero counts and empty spans; repeated rows give repeated results, and an empty table
    no rows. Texts of any length are scanned whole. Other columns aren't read, whatever their names.
    """

    def run(batches):
        vocab = []

        def count(s: str) -> int:
            if not vocab:
                vocab.append(load_vocabulary(vocabulary, pattern))
            return len(vocab[0].encode_ordinary(s))

        for batch in batches:
            out = {"n_assign": [], "n_access": [], "n_hex": [], "n_dense": [], "base_sha256": [], "spans": []}
            for t in batch.column(1).to_pylist():
                base = base_spans(t)
                extra = dense_spans(t, base, count, ratio)
                kinds = [k for _, k, _ in base]
                for k, name in enumerate(("n_assign", "n_access", "n_hex")):
                    out[name].append(kinds.count(k))
                out["n_dense"].append(len(extra))
                out["base_sha256"].append(hashlib.sha256(written(base).encode()).hexdigest())
                out["spans"].append(written(sorted(base + extra)))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v, pa.int64() if k[0] == "n" else pa.string()) for k, v in out.items())], names=["doc_id", *out])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(text).alias("text")).mapInArrow(run, SCHEMA)


def redact(docs: DataFrame, vocabulary: str, pattern: str, text: str = "text", mark: str = "[SECRET]", ratio: float = RATIO) -> DataFrame:
    """The rows with each found span replaced by mark; spans that overlap or meet are replaced by one.

    Other columns, whatever their names, and texts without a span, null and empty ones too, stay as they are. Repeated
    rows are treated alike. An empty table stays empty.
    """
    place = docs.columns.index(text)

    def run(batches):
        vocab = []

        def count(s: str) -> int:
            if not vocab:
                vocab.append(load_vocabulary(vocabulary, pattern))
            return len(vocab[0].encode_ordinary(s))

        def clean(t: str | None) -> str | None:
            if not t:
                return t
            base = base_spans(t)
            out, at = [], 0
            for a, _, b in sorted(base + dense_spans(t, base, count, ratio)):
                if b > at:
                    out += [t[at:a], mark] if a >= at else []
                    at = b
            return "".join([*out, t[at:]]) if at else t

        for batch in batches:
            column = pa.array([clean(t) for t in batch.column(place).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([column if i == place else c for i, c in enumerate(batch.columns)], names=batch.schema.names)

    return docs.mapInArrow(run, docs.schema)
