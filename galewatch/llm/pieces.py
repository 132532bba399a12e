"""Encoding and decoding with a merge-type SentencePiece vocabulary.

Text becomes symbols, one a character, with spaces as U+2581 and one put in front. A score-ordered agenda of adjacent
pairs merges symbols as long as a pair's characters make a piece, the best score first and the leftmost among equals;
what is no piece then falls back to bytes. No piece holds U+2581 after another character, so text is cut before each
run of spaces, and each chunk's ids are found once and kept. What is reported comes from these ids; every Arrow batch is
checked against the library's, which doesn't answer, but fails the run where it differs.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .agenda import PairTable, merge_all
from .common import rare_collections, text_of

SPACE = "▁"
CHUNK = re.compile(" *[^ ]+| +")
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, agreed boolean"
#: Symbols from here on are characters that no piece has.
FREE = 1 << 24
#: Chunks kept by a worker.
KEPT = 300_000


class PieceEncoder:
    """Ids of texts under one vocabulary file."""

    def __init__(self, path: str, kept: int = KEPT):
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.kept, self.known = kept, {}
        pieces = {}
        self.byte = [0] * 256
        for i in range(sp.get_piece_size()):
            if sp.is_byte(i):
                self.byte[int(sp.id_to_piece(i)[1:-1], 16)] = i
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                pieces[sp.id_to_piece(i)] = i
        if any(SPACE in p.lstrip(SPACE) for p in pieces):
            raise ValueError("a piece spans words; this vocabulary can't be cut at spaces")
        # Symbols: pieces have their ids; characters that are in pieces but aren't pieces come after them.
        self.symbol = dict(pieces)
        for c in sorted({c for p in pieces for c in p} - pieces.keys()):
            self.symbol[c] = sp.get_piece_size() + len(self.symbol)
        self.text = {i: p for p, i in self.symbol.items()}
        self.pieces = frozenset(pieces.values())
        self.size, self.decimal = sp.get_piece_size(), [str(i) for i in range(sp.get_piece_size())]
        self.plain = np.zeros(self.size + 1, bool)
        self.plain[list(self.pieces)] = True
        self.of_point = (FREE + np.arange(0x110000)).astype(np.int32)
        for c, i in self.symbol.items():
            if len(c) == 1:
                self.of_point[ord(c)] = i
        pairs = {}
        for p, i in pieces.items():
            for cut in range(1, len(p)):
                if p[:cut] in self.symbol and p[cut:] in self.symbol:
                    pairs[self.symbol[p[:cut]], self.symbol[p[cut:]]] = (i, i)
        # By score from the best on; pieces of one score share a rank, and the leftmost pair goes first.
        ranks = {s: r for r, s in enumerate(sorted({sp.get_score(i) for i in pieces.values()}, reverse=True))}
        self.table = PairTable({k: (ranks[sp.get_score(i)], i) for k, (i, _) in pairs.items()})

    def _ids(self, merged: list[int]) -> list[int]:
        out = []
        for s in merged:
            out += [s] if s in self.pieces else [self.byte[b] for b in (self.text.get(s) or chr(s - FREE)).encode()]
        return out

    def learn(self, chunks: set[str]) -> None:
        """Find the ids of new chunks, all at once."""
        names = list(chunks)
        points = np.frombuffer("".join(names).replace(" ", SPACE).encode("utf-32-le", "surrogatepass"), np.uint32)
        size, known = np.fromiter(map(len, names), np.int64, len(names)), self.known
        for which, flat, ends in merge_all(self.of_point[points], size, self.table):
            begins = np.concatenate([[0], ends[:-1]])
            simple = np.logical_and.reduceat(self.plain[np.minimum(flat, self.size)], begins).tolist()
            raw, at = flat.tobytes(), 0
            for i, end, easy in zip(which.tolist(), (4 * ends).tolist(), simple, strict=True):
                part = raw[at:end]
                known[names[i]] = part if easy else np.array(self._ids(np.frombuffer(part, np.int32).tolist()), np.int32).tobytes()
                at = end

    def encode(self, texts: list[str]) -> list[bytes]:
        """Per text, its ids as 32-bit integers."""
        cut = [CHUNK.findall(" " + t.replace(SPACE, " ")) if t else [] for t in texts]
        if len(self.known) > self.kept:
            self.known.clear()
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


_encoders: dict[str, PieceEncoder] = {}


def encode_documents(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", strict: bool = True) -> DataFrame:
    """Per row: doc_id, n_tokens, ids_sha256, decoded_sha256, agreed.

    Ids, and the text decoded from them, are the agenda's. agreed says whether the library encodes the text alike; if
    strict, a text that it doesn't is an error, so that wrong ids aren't passed on. path exists on every node. No
    shuffle. Null texts are empty: no ids and the digests of empty strings. Repeated rows give repeated results, texts of
    any length are encoded whole, and an empty table gives no rows. Other columns aren't read, whatever their names.
    """

    def run(batches):
        rare_collections()
        coder = _encoders.setdefault(path, None) or PieceEncoder(path)
        _encoders[path] = coder
        for batch in batches:
            texts = batch.column(1).to_pylist()
            library = coder.library.encode(texts, num_threads=1)
            ids = [np.frombuffer(raw, np.int32).tolist() for raw in coder.encode(texts)]
            decoded = coder.library.decode(ids) if texts else []
            same = [own == other for own, other in zip(ids, library, strict=True)]
            if strict and not all(same):
                raise ValueError(f"the library encodes document {batch.column(0)[same.index(False)].as_py()} otherwise")
            decimal = coder.decimal.__getitem__
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(list(map(len, ids)), pa.int64()),
                    pa.array([hashlib.sha256(",".join(map(decimal, own)).encode()).hexdigest() for own in ids], pa.string()),
                    pa.array([hashlib.sha256(d.encode()).hexdigest() for d in decoded], pa.string()),
                    pa.array(same, pa.bool_()),
                ],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "agreed"],
            )

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(text).alias("text")).mapInArrow(run, SCHEMA)
