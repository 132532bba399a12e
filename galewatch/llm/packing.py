"""Packing documents into token sequences, in order, by dynamic programming.

The documents of a partition are one stream of tokens. Places where a window may be cut are ends of documents, ends of
sentences, and other places inside long sentences and near the stream's end. The cheapest cuts are found by

    cost(j) = min over i of cost(i) + padding(place j - place i) + truncation(j) + a constant for each window

with at most `capacity` tokens between i and j. As padding falls by one with each token, the minimum over i is that of
cost(i) + place(i) over a sliding window, kept in a monotone queue; windows whose size is a power of two have no padding
and are further transitions.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .agenda import PairTable, merge_all
from .common import rare_collections, text_of

CAPACITY = 4096
#: Costs in padding tokens: a cut at a sentence's end, any other cut inside a document, and a window.
SENTENCE, INSIDE, WINDOW = 6, 40, 2
#: Tokens between further places in a long sentence, and of a stream that is packed at once.
STEP, BLOCK = 64, 1 << 20
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: Chunks, and words, kept by a worker.
KEPT = 800_000


def places(ends: np.ndarray, sentences: np.ndarray, capacity: int = CAPACITY, step: int = STEP) -> tuple[np.ndarray, np.ndarray]:
    """Where windows may be cut, from 0 to the last end, and what a cut costs there."""
    total = int(ends[-1])
    cost = np.full(total + 1, -1, np.int32)
    cost[::step] = INSIDE
    cost[max(0, total - capacity) :] = INSIDE
    cost[sentences] = SENTENCE
    cost[ends] = 0
    cost[0] = 0
    # Near a sentence's end the regular places don't help.
    at = np.flatnonzero(cost >= 0)
    ahead = np.minimum(np.searchsorted(at[cost[at] != INSIDE], at, "right"), np.count_nonzero(cost[at] != INSIDE) - 1)
    gap = at[cost[at] != INSIDE][ahead] - at
    keep = (cost[at] != INSIDE) | (gap > step) | (at >= total - capacity)
    return at[keep], cost[at[keep]]


def cuts(place: np.ndarray, truncation: np.ndarray, capacity: int = CAPACITY) -> list[int]:
    """The cheapest sequence of places, from the first to the last."""
    total = int(place[-1])
    index = np.full(total + 1, -1)
    index[place] = np.arange(len(place))
    # Windows without padding: for each place, those that lie a power of two before it.
    ends, begins = [], []
    for k in range(capacity.bit_length()):
        want = place - (1 << k)
        source = np.where(want >= 0, index[np.maximum(want, 0)], -1)
        at = np.flatnonzero(source >= 0)
        ends.append(at)
        begins.append(source[at])
    ends, begins = np.concatenate(ends), np.concatenate(begins)
    order = np.argsort(ends, kind="stable")
    sources = begins[order].tolist()
    first = np.searchsorted(ends[order], np.arange(len(place) + 1)).tolist()

    pos, cut = place.tolist(), truncation.tolist()
    cost, back = [0.0] * len(pos), [-1] * len(pos)
    queue: deque[int] = deque([0])
    key = [0.0] * len(pos)  # cost + place
    for j in range(1, len(pos)):
        at = pos[j]
        while queue and at - pos[queue[0]] > capacity:
            queue.popleft()
        if queue:
            source = queue[0]
            best = key[source] + capacity - at
        else:
            source, best = -1, float("inf")
        for i in sources[first[j] : first[j + 1]]:
            if cost[i] < best:
                source, best = i, cost[i]
        best += cut[j] + WINDOW
        cost[j], back[j] = best, source
        key[j] = k = best + at
        while queue and key[queue[-1]] >= k:
            queue.pop()
        queue.append(j)
    path, j = [], len(pos) - 1
    while j > 0:
        path.append(pos[j])
        j = back[j]
    return [0, *path[::-1]]


def pack(streams: list[np.ndarray], enders: np.ndarray, capacity: int = CAPACITY) -> Iterator[tuple[int, int, int, int, int]]:
    """(which document, start, length, which window, offset) of each piece of documents given as token ids."""
    size = np.fromiter(map(len, streams), np.int64, len(streams))
    ends = np.cumsum(size)
    flat = np.concatenate(streams)
    sentences = np.flatnonzero(enders[flat]) + 1
    path = cuts(*places(ends, sentences, capacity), capacity)
    doc, begin, ends = 0, 0, ends.tolist()
    for window, (a, b) in enumerate(zip(path, path[1:], strict=False)):
        at = a
        while at < b:
            end = min(b, ends[doc])
            yield doc, at - begin, end - at, window, at - a
            at = end
            if at == ends[doc]:
                begin, doc = at, doc + 1


def lowered(text: str) -> str:
    """A text of Latin-1 characters in lower case, which the vocabulary makes it anyway; others as they are."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return text
    return text.lower()


class ChunkTokenizer:
    """Token ids of texts, as the library gives them.

    The vocabulary drops white space, so chunks between spaces are encoded once each. A chunk that is a word of common
    letters and marks after it, which the vocabulary splits there, is put together from the word's ids, which are merged here for many words at once; the
    library encodes all others, and the first words that are merged here are checked against it.
    """

    #: Letters that have one lower-case form and no decomposition to undo.
    SIMPLE = re.compile(r"""([A-Za-zÀ-ÖØ-öø-ÿ]+)([!"#$%&()*+,\-./:;=>?@\[\\\]^_`{|}~]*)""")

    def __init__(self, path: str, kept: int = KEPT):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {"": b""}
        self.words: dict[str, bytes] = {"": b""}
        self.kept, self.checked = kept, 0
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.table = PairTable({(vocab[x], vocab[y]): (rank, vocab[x + y]) for rank, (x, y) in reversed(list(enumerate(merges)))})
        # Bytes that print as themselves keep their character; the others have those from 256 on, in order.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        shown = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(sorted(set(range(256)) - set(plain)))}
        self.inner, self.last = (np.array([vocab[shown[b] + x] for b in range(256)], np.int32) for x in ("", end))
        self.enders = np.zeros(max(vocab.values()) + 3, bool)
        for token, i in vocab.items():
            word = token.removesuffix(end)
            self.enders[i] = token.endswith(end) and word[-1:] in tuple(".!?") and not any(c.isalnum() for c in word)

    def by_library(self, names: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.library.encode_batch_fast(names, add_special_tokens=False)]

    def merge(self, words: list[str]) -> None:
        raw = [w.encode() for w in words]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        flat = np.frombuffer(b"".join(raw), np.uint8)
        symbols, ends = self.inner[flat], np.cumsum(size) - 1
        symbols[ends] = self.last[flat[ends]]
        for which, merged, stop in merge_all(symbols, size, self.table):
            ids, at = merged.astype("<u4").tobytes(), 0
            for i, end in zip(which.tolist(), (4 * stop).tolist(), strict=True):
                self.words[words[i]] = ids[at:end]
                at = end
        if self.checked < 5000:
            self.checked += len(words)
            if self.by_library(words) != [self.words[w] for w in words]:
                raise ValueError("this vocabulary's words aren't merged by rank")

    def learn(self, chunks: set[str]) -> None:
        simple, other, match = [], [], self.SIMPLE.fullmatch
        for c in chunks:
            m = match(c)
            if m:
                simple.append((c, m[1].lower(), m[2]))
            else:
                other.append(c)
        if len(self.words) > self.kept:
            self.words = {"": b""}
        if new := {w for _, w, _ in simple}.difference(self.words):
            self.merge(list(new))
        other += {mark for _, _, mark in simple if mark not in self.known}
        self.known.update(zip(other, self.by_library(other), strict=True))
        for c, word, mark in simple:
            self.known[c] = self.words[word] + self.known[mark]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Per text, its ids as unsigned little-endian 32-bit integers."""
        cut = [lowered(t).replace("\n", " ").split(" ") for t in texts]
        if len(self.known) > self.kept:
            self.known = {"": b""}
        get, found, holes, new = self.known.get, [], [], set()
        for chunks in cut:
            parts = list(map(get, chunks))
            if None in parts:
                empty = [i for i, part in enumerate(parts) if part is None]
                new.update([chunks[i] for i in empty])
                holes.append((parts, chunks, empty))
            found.append(parts)
        if new:
            self.learn(new)
        get = self.known.__getitem__
        for parts, chunks, empty in holes:
            for i in empty:
                parts[i] = get(chunks[i])
        return [b"".join(parts) for parts in found]


_tokenizers: dict[str, ChunkTokenizer] = {}


def pack_documents(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", end_id: int = 2, capacity: int = CAPACITY, block: int = BLOCK) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    path is a tokenizer file that exists on every node; a document's tokens are its ids and end_id. Partitions are
    packed by themselves, in blocks of about `block` tokens, so nothing is shuffled and memory is bounded by a block and
    one document; within a block the cuts are the cheapest. Null and empty texts are one token. Repeated rows are packed as often as they come; ids may be null.
    An empty table gives no rows. A sequence is padded to capacity unless its size is a power of two. Other columns
    aren't read, whatever their names.
    """

    def run(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        rare_collections()
        coder = _tokenizers.get(path) or _tokenizers.setdefault(path, ChunkTokenizer(path))
        end, first = np.array([end_id], "<u4").tobytes(), TaskContext.get().partitionId() << 36
        held: list[tuple[int | None, bytes]] = []
        tokens = 0

        def flush():
            nonlocal first, tokens, held
            rows, window = [], -1
            for d, start, length, window, offset in pack([np.frombuffer(x, "<u4") for _, x in held], coder.enders, capacity):
                raw = held[d][1]
                rows.append((held[d][0], start, length, zlib.crc32(raw[4 * start : 4 * (start + length)]), len(raw) // 4, first + window, offset))
            first, tokens, held = first + window + 1, 0, []
            names = [c.split()[0] for c in SCHEMA.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=names)

        for batch in batches:
            for i, raw in zip(batch.column(0).to_pylist(), coder.encode(batch.column(1).to_pylist()), strict=True):
                held.append((i, raw + end))
                tokens += len(raw) // 4 + 1
                if tokens >= block:
                    yield flush()
        if held:
            yield flush()

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(text).alias("text")).mapInArrow(run, SCHEMA)
