"""Near-duplicates by HyperMinHash.

A document's distinct word shingles are hashed to 64 bits. The low bits pick one of 128 buckets; a bucket keeps the
least of its other bits as a register of 16 bits, the number of leading zeros and the ten bits after them. Buckets
without a shingle take the register of another by fixed probing. Bands of four registers propose partners.

1. Documents of one shingle set are one node, so copies cost nothing further.
2. Shingles that no other node of the large buckets has are counted. They bound what two nodes can share, and the node
   with the least share of them is a bucket's centre, as edited copies have more of them than what they are copies of.
3. In each band's bucket every node is paired with the centre: as many pairs as nodes. A pair is estimated from its registers, with the chance that unequal minima share a register taken off, and pairs
   that may link are confirmed on full shingle sets. Links give components by alternating large and small stars.
4. Only buckets of three or more nodes with more than one component may hold a further link. In one of at most CHUNK
   nodes each node outside the main component is held against all nodes of other components: by their registers, and
   exactly by their differences from the centre, which are short for edited copies. The nodes of larger ones are
   looked up by an index of their least shared shingles, which no link escapes, so look-alikes that share too little
   never meet. Nodes that are connected already are never compared, so a group of copies is not expanded into pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import settled, text_of, unused

REGISTERS, MANTISSA, ROWS = 128, 10, 4
BANDS = REGISTERS // ROWS
BITS = 64 - 7
#: How far below the threshold an estimate may be: about eight standard deviations, so that estimates lose as few links as bands do.
MARGIN = 0.25
#: Most nodes of a bucket that are compared in one task; nodes of a bucket from which on its nodes' own shingles are counted; pairs with one centre that are compared together.
CHUNK, LARGE, SPLIT = 1024, 8, 256
WIDTH, PERCENT = 5, 80
SKETCH = "doc_id long, n_shingles long, digest binary, sketch binary"

_probe = np.random.default_rng(11).integers(0, REGISTERS, (40, REGISTERS))


class _Words(dict):
    """Word -> hash, found once."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


_words = _Words()


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def shingles(text: str, width: int) -> np.ndarray:
    """Sorted distinct hashes of all runs of `width` words; of all words as one run, if fewer; none without words."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # A-Z only, and the six ASCII spaces
    if not words:
        return np.empty(0, np.uint64)
    if len(_words) > 400_000:
        _words.clear()
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    take = min(width, len(words))
    out = np.full(len(words) - take + 1, take, np.uint64)
    for i in range(take):
        out = (out + h[i : len(h) - take + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return np.unique(_mixed(out))


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """(sets, REGISTERS) of 16-bit registers; sets aren't empty."""
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    flat = np.concatenate(sets)
    bucket = np.repeat(np.arange(len(sets)), size) * REGISTERS + (flat & np.uint64(REGISTERS - 1)).astype(np.int64)
    least = np.full(len(sets) * REGISTERS, np.uint64(2**64 - 1))
    np.minimum.at(least, bucket, flat >> np.uint64(7))
    empty = (least == np.uint64(2**64 - 1)).reshape(-1, REGISTERS)
    part, power = np.frexp(least.astype(np.float64))
    zeros = np.clip(BITS - power, 0, 63)
    value = (zeros * (1 << MANTISSA) + ((part - 0.5) * (2 << MANTISSA)).astype(np.int64)).reshape(-1, REGISTERS)
    own, left = value.copy(), empty.copy()
    for probe in _probe:
        if not left.any():
            break
        fill = left & ~empty[:, probe]
        value[fill] = own[:, probe][fill]
        left &= ~fill
    for row in np.flatnonzero(left.any(1)):  # few shingles: the next bucket that has one
        full = np.flatnonzero(~left[row])
        at = np.flatnonzero(left[row])
        value[row, at] = value[row, full[np.searchsorted(full, at) % len(full)]]
    return value.astype("<u2")


def collision_share(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The chance that unequal minima of sets of n and m shingles share a register: of one level, and of one mantissa."""
    out = np.zeros(np.broadcast(n, m).shape)
    low = lambda x, k: np.exp(-x / REGISTERS / 2.0 ** (k + 1)) - np.exp(-x / REGISTERS / 2.0**k)
    for k in range(40):
        out += low(n, k) * low(m, k)
    return out / (1 << MANTISSA)


def estimate(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Similarity of sets by their registers, less chance collisions."""
    p = collision_share(n, m)
    return ((a == b).mean(-1) - p) / (1 - p)


def sketches(docs: DataFrame, width: int, doc_id: str, text: str) -> DataFrame:
    """Per row: doc_id, n_shingles, digest of the shingle set, sketch; both null for an empty set."""

    def run(batches):
        import xxhash

        for batch in batches:
            sets = [shingles(t, width) for t in batch.column(1).to_pylist()]
            some = [s for s in sets if len(s)]
            rows = iter(registers(some)) if some else iter(())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                    pa.array([next(rows).tobytes() if len(s) else None for s in sets], pa.binary()),
                ],
                names=["doc_id", "n_shingles", "digest", "sketch"],
            )

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(text).alias("text")).mapInArrow(run, SKETCH)


def _may_link(percent: int) -> Column:
    """Whether nodes of n and m shingles, of which u and w are theirs alone (null: not counted), may link by size."""
    most = F.least("n", "m", F.when(F.col("u").isNotNull() & F.col("w").isNotNull(), F.least(F.col("n") - F.col("u"), F.col("m") - F.col("w"))))
    return 100 * most >= percent * (F.col("n") + F.col("m") - most)


def _band_rows(nodes: DataFrame, *more: str) -> DataFrame:
    """One row per node and band: key, id, n, and more."""
    width = 2 * ROWS
    bands = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.xxhash64(F.substring(F.col("sketch"), b * width + 1, F.lit(width)), b))
    return nodes.select("id", "n", *more, F.posexplode(bands).alias("band", "key"))


def _sketch_filter(percent: int):
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            one, two = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u2").reshape(-1, REGISTERS) for c in ("sa", "sb"))
            n, m = (batch.column(c).to_numpy() for c in ("n", "m"))
            keep = pa.array(estimate(one, two, n, m) >= percent / 100 - MARGIN)
            yield batch.select(["a", "b"]).filter(keep)

    return run


COMPARED = "a long, b long, linked boolean, lacks binary, adds binary"


def _compared(percent: int):
    """Pairs with full sets -> whether they link, and what a lacks of b and adds to it, where that is less than half of a."""

    def run(batches):
        for batch in batches:
            out = []
            for x, y in zip(batch.column("xa").to_pylist(), batch.column("xb").to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                lacks, adds = np.setdiff1d(y, x, assume_unique=True), np.setdiff1d(x, y, assume_unique=True)
                both = len(x) - len(adds)
                near = 2 * (len(lacks) + len(adds)) < len(x)
                out.append((100 * both >= percent * (len(x) + len(y) - both), lacks.tobytes() if near else None, adds.tobytes() if near else None))
            columns = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.bool_(), pa.binary(), pa.binary()), strict=True)] if out else [pa.array([], k) for k in (pa.bool_(), pa.binary(), pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), *columns], names=["a", "b", "linked", "lacks", "adds"])

    return run


def shingle_sets(docs: DataFrame, wanted: DataFrame, width: int, doc_id: str, text: str) -> DataFrame:
    """(id, x): the sorted shingle hashes of wanted nodes (id, digest)."""

    def of_text(batches):
        import xxhash

        for batch in batches:
            sets = [shingles(t, width) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["id", "digest", "x"]
            )

    texts = docs.select(F.col(doc_id).cast("long").alias("id"), text_of(text).alias("text")).join(wanted.select("id"), "id", "left_semi")
    sets = texts.mapInArrow(of_text, "id long, digest binary, x binary").join(wanted.select("id", "digest"), ["id", "digest"], "left_semi").select("id", "x")
    return settled(sets.dropDuplicates(["id"]), "lz4")


def _listed(batches):
    for batch in batches:
        x = [np.frombuffer(b, np.int64) for b in batch.column("x").to_pylist()]
        rest = [c for c in batch.schema.names if c != "x"]
        yield pa.RecordBatch.from_arrays([*map(batch.column, rest), pa.array(x, pa.list_(pa.int64()))], names=[*rest, "x"])


def own_shingles(sets: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, u): how many shingles each of ids has that no other of them has."""
    each = sets.join(ids, "id", "left_semi").mapInArrow(_listed, "id long, x array<long>").select("id", F.explode("x").alias("h"))
    alone = each.groupBy("h").agg(F.count("*").alias("c"), F.min("id").alias("id")).filter("c = 1").groupBy("id").agg(F.count("*").alias("u"))
    return settled(ids.join(alone, "id", "left").select("id", F.coalesce("u", F.lit(0)).cast("long").alias("u")))


def compared(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of nodes with their comparison on full shingle sets.

    The pairs of a b that has many are dealt in chunks, each with its own copy of b's set.
    """
    hot = settled(pairs.groupBy("b").agg(F.count("*").alias("pairs")).filter(F.col("pairs") > SPLIT).select("b", F.ceil(F.col("pairs") / SPLIT).alias("chunks")))
    dealt = pairs.join(hot, "b", "left").withColumn("chunk", F.coalesce(F.pmod(F.xxhash64("a"), "chunks"), F.lit(0).cast("long"))).drop("chunks")
    one, two = sets.select(F.col("id").alias("a"), F.col("x").alias("xa")), sets.select(F.col("id").alias("b"), F.col("x").alias("xb"))
    two = two.join(hot, "b", "left").withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(F.col("chunks") - 1, F.lit(0).cast("long"))))).drop("chunks")
    return settled(dealt.join(one, "a").join(two, ["b", "chunk"]).select("a", "b", "xa", "xb").mapInArrow(_compared(percent), COMPARED))


def components(links: DataFrame) -> DataFrame:
    """(id, component) of every id in links (a, b); the component is its least id. Alternating large and small stars."""
    edges = links.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    edges, before = settled(edges), None
    while True:
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = settled(both.join(least, "a").filter("b > a").select(F.col("m").alias("a"), "b").filter("a <> b").distinct())
        # Small star: each id with its lesser neighbours, all tied to the least of them.
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(least, "b").select(F.col("m").alias("x"), F.col("a").alias("y")).union(least.select(F.col("m").alias("x"), F.col("b").alias("y")))
        edges = settled(small.filter("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return edges.select(F.col("b").alias("id"), F.col("a").alias("component")).union(edges.select("a", "a").distinct())


def indexed_pairs(nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b, n, m) of different components among nodes (id, comp), with every pair that links.

    Shingles are put into one order: first those that one component has alone, then the others, rarest first. The first
    shingle that two linked sets share stands early in both, as what follows it holds all they share. So a set is found
    by its first shingles alone, and a smaller one by still fewer, as the union is at least as large as the larger set.
    What is left from there on bounds what a pair shares. Long lists of a shingle are dealt in chunks.
    """
    each = sets.join(nodes.select("id", "comp").distinct(), "id").select("id", "comp", "x").mapInArrow(_listed, "id long, comp long, x array<long>")
    each = each.select("id", "comp", F.size("x").cast("long").alias("n"), F.explode("x").alias("h"))
    common = each.groupBy("h").agg(F.count("*").alias("c"), F.min("comp").alias("p"), F.max("comp").alias("q")).filter("p <> q").select("h", "c")
    found = each.join(common, "h").groupBy("id").agg(F.first("comp").alias("comp"), F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("c", "h"))).alias("x"))
    # Places from which on a set holds at least what it has to share: with any set, and with one that is no smaller.
    found = found.withColumns({"own": F.col("n") - F.size("x"), "last": F.expr(f"n - (n * {percent} + 99) div 100"), "least": F.expr(f"n - (n * {2 * percent} + {99 + percent}) div {100 + percent}")})
    rows = found.filter("own <= last").select("id", "comp", "n", "own", "least", F.posexplode(F.slice("x", F.lit(1), (F.col("last") - F.col("own") + 1).cast("int"))).alias("pos", "x"))
    rows = settled(rows.select(F.col("x.h").alias("h"), "id", "comp", "n", (F.col("n") - F.col("own") - F.col("pos")).alias("left"), (F.col("own") + F.col("pos") <= F.col("least")).alias("early")))
    lists = rows.groupBy("h").agg(F.min("comp").alias("p"), F.max("comp").alias("q"), F.count_if("early").alias("c")).filter("p <> q and c > 0")
    rows = settled(rows.join(lists.select("h", F.ceil(F.col("c") / CHUNK).alias("chunks")), "h"))
    one = rows.select("h", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk"), F.col("id").alias("a"), "comp", "n", "left")
    two = rows.filter("early").select("h", F.pmod(F.xxhash64("id"), "chunks").alias("chunk"), F.col("id").alias("b"), F.col("comp").alias("comp_b"), F.col("n").alias("m"), F.col("left").alias("left_b"))
    smaller = (F.col("m") < F.col("n")) | ((F.col("m") == F.col("n")) & (F.col("b") < F.col("a")))
    enough = (100 + percent) * F.least("left", "left_b") >= percent * (F.col("n") + F.col("m"))
    return one.join(two, ["h", "chunk"]).filter((F.col("comp") != F.col("comp_b")) & smaller & enough).select("a", "b", "n", "m").distinct()


class _Differences:
    """Sets of hashes of many nodes; counts what each has in common with one of them."""

    def __init__(self, raw: list[bytes | None]):
        self.size = np.array([len(x or b"") // 8 for x in raw])
        self.end = np.cumsum(self.size)
        names, self.flat = np.unique(np.frombuffer(b"".join(x or b"" for x in raw), np.uint64), return_inverse=True)
        self.mark = np.zeros(len(names), bool)

    def common(self, i: int) -> np.ndarray:
        own = self.flat[self.end[i] - self.size[i] : self.end[i]]
        self.mark[own] = True
        sums = np.concatenate([[0], np.cumsum(self.mark[self.flat])])
        self.mark[own] = False
        return sums[self.end] - sums[self.end - self.size]


def _crossing(percent: int):
    """From rows sorted by key: pairs of different components, of which one is outside the main component.

    Two nodes whose differences from the bucket's centre are known are compared exactly by them, and given only if they
    link (sure). Others are given if their registers say that they may link.
    """

    def group(rows: list[pa.RecordBatch]) -> pa.RecordBatch | None:
        t = pa.Table.from_batches(rows)
        s = np.frombuffer(b"".join(t.column("sketch").to_pylist()), "<u2").reshape(-1, REGISTERS)
        i, n, comp, other = (t.column(c).to_numpy() for c in ("id", "n", "comp", "other"))
        band = t.column("band")[0].as_py()
        shared = n - t.column("u").fill_null(0).to_numpy() if t.column("u").null_count == 0 else n
        lacks, adds = (t.column(c).to_pylist() for c in ("lacks", "adds"))
        near = np.array([x is not None for x in lacks])
        lacks, adds = _Differences(lacks), _Differences(adds)
        a, b, sure = [], [], []
        for x in np.flatnonzero(other):
            most = np.minimum(np.minimum(shared, shared[x]), np.minimum(n, n[x]))
            able = (comp != comp[x]) & (100 * most >= percent * (n + n[x] - most)) & (~other | (i > i[x]))
            able = np.flatnonzero(able)
            if able.size:
                able = able[estimate(s[able], s[x], n[able], n[x]) >= percent / 100 - MARGIN]
                # Of the bands that two nodes share, the first pairs them.
                bands = (s[able].reshape(-1, BANDS, ROWS) == s[x].reshape(BANDS, ROWS)).all(2)
                able = able[bands.argmax(1) == band]
            if not able.size:
                continue
            exact = near[able] & near[x]
            keep = ~exact
            if exact.any():
                centre = n[x] - adds.size[x] + lacks.size[x]
                union = lacks.size[x] + lacks.size[able] - lacks.common(x)[able]
                both = centre - union + adds.common(x)[able]
                keep |= exact & (100 * both >= percent * (n[x] + n[able] - both))
            a += [int(i[x])] * int(keep.sum())
            b += i[able[keep]].tolist()
            sure += exact[keep].tolist()
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(sure, pa.bool_())], names=["a", "b", "sure"]) if a else None

    def run(batches: Iterator[pa.RecordBatch]):
        held, last = [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column("key").to_numpy()
            edge = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), batch.num_rows]
            for x, y in zip(edge, edge[1:], strict=False):
                now = key[x]
                if held and now != last:
                    if (out := group(held)) is not None:
                        yield out
                    held = []
                held.append(batch.slice(x, y - x))
                last = now
        if held and (out := group(held)) is not None:
            yield out

    return run


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (the least id reachable by links) and kept (it is the row's own).

    Documents link if 100 * intersection >= percent * union of their shingle sets. Null texts are empty; a document
    without words links with nothing. Rows of one id are one document. Rows without an id take no part: their component
    is null and kept is false. Texts of any length are read whole, one batch at a time. An empty table gives no rows.
    Other columns aren't read, whatever their names.
    """
    seen = settled(sketches(docs, width, doc_id, text))
    able = seen.filter("digest is not null and doc_id is not null")
    nodes = classes = settled(able.groupBy("digest").agg(F.min("doc_id").alias("id"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch")))

    rows = _band_rows(nodes)
    keys = settled(rows.groupBy("key").agg(F.count("*").alias("c")).filter("c > 1"))
    members = settled(rows.join(keys, "key").groupBy("id").agg(F.max("c").alias("c")))
    sets = shingle_sets(docs, nodes.join(members, "id", "left_semi"), width, doc_id, text)
    own = own_shingles(sets, members.filter(F.col("c") >= LARGE).select("id"))
    nodes = settled(nodes.join(members.select("id"), "id").join(own, "id", "left"))

    rows = _band_rows(nodes, "u").join(keys, "key")
    rank = F.struct((F.coalesce("u", F.lit(0)) / F.col("n")).alias("share"), F.xxhash64("id").alias("rank"), F.col("id").alias("b"), F.col("n").alias("m"), F.col("u").alias("w"))
    centres = settled(rows.groupBy("key").agg(F.first("c").alias("c"), F.min(rank).alias("centre")).select("key", "c", "centre.b", "centre.m", "centre.w"))
    star = _band_rows(nodes, "u").join(centres, "key").filter((F.col("id") != F.col("b")) & _may_link(percent)).select(F.col("id").alias("a"), "n", "b", "m").distinct()
    one, two = (nodes.groupBy(F.col("id").alias(x)).agg(F.first("sketch").alias(f"s{x}")) for x in "ab")

    def estimated(pairs: DataFrame) -> DataFrame:
        return settled(pairs.join(one, "a").join(two, "b").select("a", "b", "n", "m", "sa", "sb").mapInArrow(_sketch_filter(percent), "a long, b long"))

    stars = compared(estimated(star), sets, percent)
    links = stars.filter("linked").select("a", "b")
    found = settled(components(links))

    named = nodes.join(found, "id", "left").select("id", "n", "u", "sketch", F.coalesce("component", "id").alias("comp"))
    busy = centres.filter("c > 2").join(found.withColumnRenamed("id", "b"), "b", "left").select("key", "c", "b", F.coalesce("component", "b").alias("main"))
    mixed = _band_rows(named, "comp").join(busy, "key").groupBy("key").agg(F.first("c").alias("c"), F.first("main").alias("main"), F.first("b").alias("b"), F.min("comp").alias("p"), F.max("comp").alias("q")).filter("p <> q")
    mixed = settled(mixed.select("key", "b", "main", (F.col("c") > CHUNK).alias("large")))
    if not mixed.isEmpty():
        dealt = _band_rows(named, "u", "comp", "sketch").join(mixed.filter("not large"), "key").withColumn("other", F.col("comp") != F.col("main"))
        dealt = dealt.join(stars.select(F.col("a").alias("id"), "b", "lacks", "adds"), ["id", "b"], "left")
        own = F.when(F.col("id") == F.col("b"), F.lit(b""))
        dealt = dealt.withColumns({"lacks": F.coalesce("lacks", own), "adds": F.coalesce("adds", own)})
        dealt = dealt.select("key", "band", "id", "n", "u", "comp", "other", "sketch", "lacks", "adds").repartition("key").sortWithinPartitions("key")
        more = dealt.mapInArrow(_crossing(percent), "a long, b long, sure boolean")
        large = mixed.filter("large").select("key")
        if not large.isEmpty():
            wanted = _band_rows(named, "comp").join(large, "key", "left_semi").select("id", "comp").distinct()
            more = more.union(estimated(indexed_pairs(wanted, sets, percent)).withColumn("sure", F.lit(False)))
        more = settled(more.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("sure").alias("sure")))
        if not more.isEmpty():
            also = compared(more.filter("not sure").select("a", "b"), sets, percent).filter("linked")
            links = links.union(more.filter("sure").select("a", "b")).union(also.select("a", "b"))
            found = settled(components(links))

    label = settled(classes.join(found, "id", "left").select("digest", F.coalesce("component", "id").alias("component")))
    out = seen.join(label, "digest", "left").withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(False)).alias("kept"))


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """The rows whose id is the least of their component's, or that have none, with all their columns, whatever their names.

    Rows of one id are one document, and stay or go together. Null and empty texts, and texts without words, link with
    nothing and stay. Texts of any length are read whole. An empty table stays empty.
    """
    found, name = near_duplicates(docs, doc_id, text, width, percent), unused("gone_id", docs)
    gone = found.filter("not kept and doc_id is not null").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(gone, F.col(doc_id).cast("long") == F.col(name), "left_anti")
