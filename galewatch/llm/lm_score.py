"""Scores of texts under a language model that is fitted to the corpus itself.

A word's probability joins its count over all training documents, discounted, with how the attention model spells it in
its context; the mass that the discount frees goes to spelling, so that every word has some. Counts cover all training
documents:

1. Documents are dealt into blocks of about BLOCK bytes; each block counts its words, and writes one array of hashes and
   one of counts for each bucket of hashes that it has words of.
2. Each bucket adds up the counts of all blocks and returns to each block those of its words.
3. Each block scores its documents with its words' counts. A block sees only its own words, so memory is bounded.

Words are told apart by 64-bit hashes. A frequent word costs each block one entry, whatever its count.

The attention model learns from the whole texts of all training documents. They are dealt into shards of about BLOCK
bytes. It starts with steps on the first shard; then every shard goes on from there by one pass over all of its own
texts, and the results are averaged by their numbers of windows. Parameters are averaged on executors, in parts; one
model of fixed size reaches the driver.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import attention
from .common import settled, swept, text_of
from .langid import fold
from .near_dedup import _words

#: Bytes of text in a block, and for each bucket of word hashes.
BLOCK, BUCKET = 8_000_000, 40_000_000
#: Parts of a model's parameters that are averaged apart, and shards that one task averages of a part.
PARTS, GROUP = 64, 1000
#: What counts are discounted by, and the share of spelling apart from that: the best of a few on a split of training rows.
DISCOUNT, SPELLED = 0.75, 0.8
SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
MEANS = "part long, shard long, weight long, values binary"
SENT = "bucket long, block long, hashes binary, counts binary, tokens long, types long"
_names = [c.split()[0] for c in SENT.split(", ")]


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split()  # A-Z only, and the six ASCII spaces


def hashed(words: list[bytes]) -> np.ndarray:
    if len(_words) > 400_000:
        _words.clear()
    return np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))


def _sent(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=_names)


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    names, inverse = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return names, np.bincount(inverse, np.concatenate([p[1] for p in parts]), len(names)).astype(np.int64)


def _tallied(learned: Counter, other: set) -> list[tuple[np.ndarray, np.ndarray]]:
    """Hashes and training counts of words of training texts, and of those of other texts."""
    return [(hashed(list(learned)), np.fromiter(learned.values(), float, len(learned))), (hashed(list(other)), np.zeros(len(other)))]


def _counted(buckets: int):
    """Rows of (block, learn, text) -> each block's words and training counts, by bucket."""

    def run(batches: Iterator[pa.RecordBatch]):
        held: dict[int, tuple[list, Counter, set]] = {}
        for batch in batches:
            for block, learn, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                merged, learned, other = held.setdefault(block, ([], Counter(), set()))
                (learned if learn else other).update(words_of(text))
                if len(learned) + len(other) > 500_000:
                    merged[:] = [_merged([*merged, *_tallied(learned, other)])]
                    learned.clear(), other.clear()
        for block, (merged, learned, other) in held.items():
            names, counts = _merged([*merged, *_tallied(learned, other)])
            at = (names % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(at, kind="stable")
            touched, edge = np.unique(at[order], return_index=True)
            for b, pick in zip(touched.tolist(), np.split(order, edge[1:]), strict=True):
                yield _sent([(b, block, names[pick].tobytes(), counts[pick].tobytes(), 0, 0)])

    return run


def _totalled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each bucket's counts, added up over blocks and returned to them; its numbers of tokens and types come with its first row."""
    held: dict[int, list[tuple]] = {}
    for batch in batches:
        for row in batch.to_pylist():
            held.setdefault(row["bucket"], []).append((row["block"], np.frombuffer(row["hashes"], np.uint64), np.frombuffer(row["counts"], np.int64)))
    for bucket, rows in held.items():
        names, total = _merged([r[1:3] for r in rows])
        sums = int(total.sum()), int((total > 0).sum())
        for block, h, _ in rows:
            yield _sent([(bucket, block, h.tobytes(), total[np.searchsorted(names, h)].tobytes(), *sums)])
            sums = 0, 0
    held.clear()


def _words_of_batches(batches: Iterator[pa.RecordBatch]) -> list[list[bytes]]:
    return [words_of(t) for batch in batches for t in batch.column("text").to_pylist()]


def _started(pieces: attention.Pieces):
    def run(batches):
        model = attention.train(pieces, _words_of_batches(batches))
        yield pa.RecordBatch.from_arrays([pa.array([model.vector().tobytes()], pa.binary())], names=["model"])

    return run


def _refined(pieces: attention.Pieces, start):
    """One shard's texts -> its model's parameters, in parts, with its weight."""

    def run(batches):
        shard, batches = None, iter(batches)
        for batch in batches:
            if batch.num_rows:
                shard = batch.column("shard")[0].as_py()
                break
        if shard is None:
            return
        words = _words_of_batches([batch]) + _words_of_batches(batches)
        model, weight = attention.refine(pieces, attention.Model.of_vector(start.value, pieces), words, shard + 1)
        for i, part in enumerate(np.array_split(model.vector(), PARTS)):
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([shard], pa.int64()), pa.array([weight], pa.int64()), pa.array([part.tobytes()], pa.binary())], names=["part", "shard", "weight", "values"])

    return run


def _averaged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The weighted means of each part and group of shards, with their weights."""
    sums: dict[tuple[int, int], list] = {}
    for batch in batches:
        for row in batch.to_pylist():
            x = row["weight"] * np.frombuffer(row["values"], np.float32).astype(np.float64)
            own = sums.setdefault((row["part"], row["shard"] // GROUP), [0, 0])
            own[0], own[1] = own[0] + x, own[1] + row["weight"]
    for (part, group), (x, weight) in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([group], pa.int64()), pa.array([weight], pa.int64()), pa.array([(x / weight).astype(np.float32).tobytes()], pa.binary())], names=["part", "shard", "weight", "values"])


def fitted(learned: DataFrame, size: int, pieces: attention.Pieces, block: int = BLOCK) -> attention.Model:
    """The attention model of training rows (doc_id, text) with `size` bytes of text in all."""
    shards = max(1, -(-size // block))
    h = F.xxhash64("doc_id", "text")
    rows = learned.select(h.alias("h"), "text", F.pmod(F.xxhash64(h, F.lit("shard")), F.lit(shards)).alias("shard"))
    first = rows.filter("shard = 0").repartition(1).sortWithinPartitions("h", "text").mapInArrow(_started(pieces), "model binary").collect()
    if not first:
        return attention.train(pieces, [])
    start = np.frombuffer(first[0][0], np.float32)
    shared = learned.sparkSession.sparkContext.broadcast(start)
    dealt = rows.repartitionById(shards, F.col("shard").cast("int")).sortWithinPartitions("h", "text")
    means = dealt.mapInArrow(_refined(pieces, shared), MEANS)
    # Means of means, by groups of shards, until one of each part is left.
    while shards > 0:
        groups = -(-shards // GROUP)
        at = (F.col("part") * groups + F.floor(F.col("shard") / GROUP)).cast("int")
        means = means.repartitionById(PARTS * groups, at).sortWithinPartitions("part", "shard").mapInArrow(_averaged, MEANS)
        shards = groups if groups > 1 else 0
    means = means.collect()
    if not means:
        return attention.Model.of_vector(start, pieces)
    return attention.Model.of_vector(np.concatenate([np.frombuffer(r["values"], np.float32) for r in sorted(means, key=lambda r: r["part"])]), pieces)


class Scorer:
    """Scores of texts, given all counts that their words need."""

    def __init__(self, model: attention.Model, pieces: attention.Pieces):
        self.model, self.pieces, self.splitter = model, pieces, attention.Splitter(pieces)
        self.names, self.counts = None, np.zeros(1)
        self.tables = np.ascontiguousarray(model.tables().T)
        self.starting = self.tables[pieces.count : pieces.end + 1].sum(0)

    def numbered(self, texts: list[list[bytes]], names: np.ndarray, total: np.ndarray) -> np.ndarray:
        """The splitter's numbers of all words and ends, in order; counts are those of each number."""
        if names is not self.names or len(self.counts) > 400_000:
            self.splitter.clear()
            self.names, self.counts = names, np.zeros(1)
        of, fresh = self.splitter.numbered(texts)
        if fresh:
            self.counts = np.concatenate([self.counts, total[np.searchsorted(names, hashed(fresh))]])
        return of

    def spelled(self, of: np.ndarray) -> np.ndarray:
        """Natural log probabilities of all words and ends, in order, given their numbers."""
        p = self.pieces
        seen, want, begin, size, starts = self.splitter.sequences(of)
        logs, starting = attention.score(self.model, self.tables, self.starting, seen, want, begin, size, p.pad)
        ends = want == p.end
        first = np.flatnonzero(starts | ends)
        word = np.add.reduceat(logs, first) - starting[first]
        inner = ~ends[first]
        word[inner] += starting[first[np.flatnonzero(inner) + 1]]
        return word

    def rows(self, texts: list[list[bytes]], names: np.ndarray, total: np.ndarray, documents: int, tokens: int, types: int) -> list[tuple]:
        """(n_tokens, n_known, train_tokens, base_score, score) of each text."""
        size = np.array([len(t) + 1 for t in texts])
        ends = np.cumsum(size) - 1
        of = self.numbered(texts, names, total)
        counts = self.counts[of]
        counts[ends] = documents
        n, v = tokens + documents, types + (documents > 0)
        base = np.log10((counts + 1) / (n + (v + 1)))
        spelled = np.exp(self.spelled(of))
        if n:
            joined = np.maximum(counts - DISCOUNT, 0) / n + DISCOUNT * v / n * spelled
            score = np.log10(np.maximum((1 - SPELLED) * joined + SPELLED * spelled, 1e-300))
        else:
            score = np.log10(np.maximum(spelled, 1e-300))
        begin = ends - size + 1
        known, base, score = (np.add.reduceat(x, begin) for x in ((counts > 0).astype(np.int64), base, score))
        return list(zip(size.tolist(), known.tolist(), [n] * len(texts), base.tolist(), score.tolist(), strict=True))


def _scored(broadcast, sums: tuple[int, int, int]):
    """From one block's rows, counts before texts. sums: training documents, word tokens and types of the corpus."""

    def run(batches: Iterator[pa.RecordBatch]):
        model, pieces = broadcast.value
        scorer = Scorer(model, pieces)
        block, parts, names, total = None, [], None, None
        for batch in batches:
            blocks, roles = batch.column("block").to_numpy(), batch.column("role").to_numpy()
            edge = [0, *(np.flatnonzero((blocks[1:] != blocks[:-1]) | (roles[1:] != roles[:-1])) + 1).tolist(), batch.num_rows]
            for a, b in zip(edge, edge[1:], strict=False):
                if a == b:
                    continue
                part = batch.slice(a, b - a)
                if blocks[a] != block:
                    block, parts, names = blocks[a], [], None
                if roles[a] == 0:
                    for h, c in zip(part.column("hashes").to_pylist(), part.column("counts").to_pylist(), strict=True):
                        parts.append((np.frombuffer(h, np.uint64), np.frombuffer(c, np.int64)))
                    continue
                if names is None:
                    parts.append((np.empty(0, np.uint64), np.empty(0, np.int64)))
                    names, total = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
                    order = np.argsort(names)
                    names, total, parts = names[order], total[order], []
                for i in range(0, part.num_rows, 64):
                    some = part.slice(i, 64)
                    rows = scorer.rows([words_of(t) for t in some.column("text").to_pylist()], names, total, *sums)
                    kinds = [pa.int64()] * 3 + [pa.float64()] * 2
                    columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                    yield pa.RecordBatch.from_arrays([some.column("doc_id"), some.column("held_out"), *columns], names=[c.split()[0] for c in SCHEMA.split(", ")])

    return run


def score_documents(docs: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text", parts: int = 7, held: int = 2, block: int = BLOCK, bucket: int = BUCKET) -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Tokens are lower-cased words and one end a text. Rows whose id's checksum has the remainder `held` by `parts` are
    held out; all others are counted, and the attention model learns from the whole texts of all of them. Null texts are
    empty, a null id counts as empty text in the checksum, repeated rows count as often as they come. Where nothing is left to learn from, counts are zero and the untrained model scores. Texts of any length are
    scored whole. An empty table gives no rows. Other columns aren't read, whatever their names. vocabulary is a tiktoken
    rank file on the driver.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(text).alias("text")).withColumn("held_out", fold("doc_id", parts) == held)
    length = F.octet_length("text")
    size, learned, documents = rows.agg(F.sum(length), F.sum(F.when(~F.col("held_out"), length)), F.count_if(~F.col("held_out"))).first()
    blocks, buckets = max(1, -(-(size or 0) // block)), max(1, -(-(size or 0) // bucket))
    pieces = attention.Pieces(vocabulary)
    with swept(spark):
        model = fitted(rows.filter(~F.col("held_out")).select("doc_id", "text"), learned or 0, pieces, block)
    broadcast = spark.sparkContext.broadcast((model, pieces))

    dealt = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)))
    at = lambda name: F.col(name).cast("int")
    counts = dealt.select("block", (~F.col("held_out")).cast("int").alias("learn"), "text").repartitionById(blocks, at("block")).mapInArrow(_counted(buckets), SENT)
    with swept(spark):
        counts = settled(counts.repartitionById(buckets, at("bucket")).mapInArrow(_totalled, SENT), "lz4")
    tokens, types = counts.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("types"), F.lit(0))).first()
    nothing = {c: F.lit(None).cast(t) for c, t in (("doc_id", "long"), ("held_out", "boolean"), ("text", "string"), ("hashes", "binary"), ("counts", "binary"))}
    order = ["block", "role", *nothing]
    one = counts.withColumns({"role": F.lit(0)} | {c: nothing[c] for c in ("doc_id", "held_out", "text")}).select(order)
    two = dealt.withColumns({"role": F.lit(1)} | {c: nothing[c] for c in ("hashes", "counts")}).select(order)
    both = one.unionByName(two).repartitionById(blocks, at("block")).sortWithinPartitions("block", "role")
    return both.mapInArrow(_scored(broadcast, (documents, tokens, types)), SCHEMA)
