"""Removal of repeated passages: every byte covered by a string of `least` bytes that also starts anywhere else.

Each window of `least` bytes is assigned to an anchor, its 32-byte string of least hash, so equal windows have equal
anchors at equal offsets. Consecutive windows of one anchor are a segment. Anchors that occur once hold nothing that
repeats. Of the others, segments that are equal as a whole are removed as such, and the different segments of an anchor
are written one after another, their suffixes sorted in two stages, and the windows whose common prefix with a
neighbour is `least` bytes or more are removed.

An anchor's segments are dealt into groups of about GROUP. Where an anchor has several groups, windows that occur once
in a group are compared between groups by a 128-bit digest. Thus no task's work grows with how often a passage occurs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import settled, text_of
from .suffixes import common_prefixes, joined, suffix_order, words_of

LEAST, ANCHOR = 200, 32
#: Segments of an anchor in one group, and bytes sorted at once.
GROUP, SORTED = 400, 1_500_000
#: A segment is hot from this share of all segments that may repeat on, and this number; fewer than the share's inverse can be hot.
HOT_SHARE, HOT_LEAST = 50_000, 64
#: Groups whose windows are compared in one task; those of an anchor with more are dealt by digest.
TOGETHER = 64
#: Bytes of a text handled at once, and bits for a place among them.
PIECE, BITS = 4_000_000, 24
_ROOT = 0x9E3779B97F4A7C15
_powers: dict[str, np.ndarray] = {}


def _hashes(flat: np.ndarray) -> np.ndarray:
    """A hash of the ANCHOR bytes from each place on."""
    n = len(flat) + 1
    if len(_powers.get("up", ())) < n:
        size = max(n, 1 << 20)
        for name, root in (("up", _ROOT), ("down", pow(_ROOT, -1, 1 << 64))):
            p = np.full(size, np.uint64(root))
            p[0] = 1
            _powers[name] = np.multiply.accumulate(p)
    sums = np.zeros(n, np.uint64)
    np.cumsum((flat.astype(np.uint64) + np.uint64(1)) * _powers["down"][: n - 1], out=sums[1:])
    h = (sums[ANCHOR:] - sums[:-ANCHOR]) * _powers["up"][: n - ANCHOR]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def _units(texts: list[bytes], least: int) -> Iterator[list[tuple[int, int, bytes]]]:
    """(which text, start, bytes) of texts' pieces, which overlap by a window, several at a time."""
    units, size = [], 0
    for i, t in enumerate(texts):
        for a in range(0, max(1, len(t) - least + 1), PIECE):
            part = t[a : a + PIECE + least - 1]
            if len(part) < least:
                continue
            if size + len(part) > 2 * PIECE:
                yield units
                units, size = [], 0
            units.append((i, a, part))
            size += len(part)
    if units:
        yield units


def anchors(units: list[tuple[int, int, bytes]], least: int = LEAST) -> tuple[bytes, np.ndarray, ...]:
    """All bytes; and of each segment the unit, its anchor's hash, its place in all bytes and in its text, and its number of windows."""
    raw = b"".join(u[2] for u in units)
    size = np.fromiter((len(u[2]) for u in units), np.int64, len(units))
    begin = np.cumsum(size) - size
    h = _hashes(np.frombuffer(raw, np.uint8))
    mask = np.uint64((1 << BITS) - 1)
    key = (h & ~mask) | np.arange(len(h), dtype=np.uint64)
    # The least of `wide` keys from each place on: least of its block's rest and of the next block's start.
    wide = least - ANCHOR + 1
    blocks = -(-len(key) // wide)
    padded = np.full(blocks * wide, np.uint64(2**64 - 1))
    padded[: len(key)] = key
    rows = padded.reshape(blocks, wide)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    rest = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    anchor = (np.minimum(rest[: len(key) - wide + 1], ahead[wide - 1 : len(key)]) & mask).astype(np.int64)
    unit = np.repeat(np.arange(len(units)), size)[: len(anchor)]
    valid = np.arange(len(anchor)) + least <= (begin + size)[unit]
    new = valid.copy()
    new[1:] &= (anchor[1:] != anchor[:-1]) | ~valid[:-1] | (unit[1:] != unit[:-1])
    first = np.flatnonzero(new)
    count = np.diff(np.append(np.cumsum(valid)[first] - 1, int(valid.sum())))
    where = unit[first]
    start = first - begin[where] + np.array([u[1] for u in units])[where]
    return raw, where, h[anchor[first]].view(np.int64), first, start, count


def segments(texts: list[bytes], least: int = LEAST) -> Iterator[tuple[int, int, int, int, bytes]]:
    """(which text, anchor's hash, start, windows, bytes) of all segments."""
    for units in _units(texts, least):
        raw, where, name, first, start, count = anchors(units, least)
        for u, x, a, s, n in zip(where.tolist(), name.tolist(), first.tolist(), start.tolist(), count.tolist(), strict=True):
            yield units[u][0], x, s, n, raw[a : a + n + least - 1]


def _anchor_hashes(least: int):
    def run(batches):
        for batch in batches:
            for units in _units([t.encode("utf-8", "surrogatepass") for t in batch.column(0).to_pylist()], least):
                yield pa.RecordBatch.from_arrays([pa.array(anchors(units, least)[2])], names=["h"])

    return run


def _occurrences(least: int):
    def run(batches):
        import xxhash

        digest = xxhash.xxh3_64_digest
        for batch in batches:
            for units in _units([t.encode("utf-8", "surrogatepass") for t in batch.column(2).to_pylist()], least):
                raw, where, name, first, start, count = anchors(units, least)
                s = np.frombuffer(b"".join([digest(raw[a:b]) for a, b in zip(first.tolist(), (first + count + least - 1).tolist(), strict=True)]), np.int64)
                at = pa.array(np.array([u[0] for u in units])[where])
                yield pa.RecordBatch.from_arrays([pa.array(name), pa.array(s), batch.column(0).take(at), batch.column(1).take(at), pa.array(start), pa.array(count)], names=["h", "s", "d", "k", "start", "n"])

    return run


def _cut(least: int):
    """Rows of texts with the segments wanted of them -> one row per segment with its bytes."""

    def run(batches):
        for batch in batches:
            rows, which = [], []
            for i, (text, wanted) in enumerate(zip(batch.column("text").to_pylist(), batch.column("wanted").to_pylist(), strict=True)):
                raw = text.encode("utf-8", "surrogatepass")
                for w in wanted:
                    which.append(i)
                    rows.append((w["h"], w["group"], w["groups"], w["copies"], w["start"], w["n"], raw[w["start"] : w["start"] + w["n"] + least - 1]))
            if rows:
                at = pa.array(which, pa.int64())
                columns = [pa.array(c, pa.binary() if j == 6 else pa.int64()) for j, c in enumerate(zip(*rows, strict=True))]
                names = ["h", "group", "groups", "copies", "start", "n", "part"]
                yield pa.RecordBatch.from_arrays([*columns[:4], batch.column("d").take(at), batch.column("k").take(at), *columns[4:]], names=[*names[:4], "d", "k", *names[4:]])

    return run


CUT = "h long, group long, groups long, copies long, d long, k long, start long, n long, part binary"
FOUND = "d long, k long, start long, stop long, h long, part long, digests binary, owners binary"
_kinds = [pa.int64()] * 6 + [pa.binary()] * 2
_found = [c.split()[0] for c in FOUND.split(", ")]


def _ranges(doc: np.ndarray, key: np.ndarray, start: np.ndarray, least: int) -> list[tuple]:
    """(d, k, start, stop) of runs of windows that start one after another."""
    if not len(start):
        return []
    order = np.lexsort((start, key, doc))
    doc, key, start = doc[order], key[order], start[order]
    edge = np.concatenate([[True], (start[1:] > start[:-1] + 1) | (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])])
    first, last = np.flatnonzero(edge), np.append(np.flatnonzero(edge)[1:] - 1, len(start) - 1)
    return list(zip(doc[first].tolist(), key[first].tolist(), start[first].tolist(), (start[last] + least).tolist(), strict=True))


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), _kinds, strict=True)], names=_found)


def _merged(least: int):
    """From packed windows sorted by h and part: those that more than one group has."""

    def group(rows: list[tuple[bytes, bytes]]) -> list[tuple]:
        digests = np.frombuffer(b"".join(r[0] for r in rows), np.uint64).reshape(-1, 2)
        owners = np.frombuffer(b"".join(r[1] for r in rows), np.int64).reshape(-1, 3)
        order = np.lexsort((digests[:, 0], digests[:, 1]))
        same = (digests[order[1:]] == digests[order[:-1]]).all(1)
        twice = np.zeros(len(order), bool)
        twice[1:] |= same
        twice[:-1] |= same
        owners = owners[order[twice]]
        owners = owners[owners[:, 2] >= 0]
        return [(*r, None, None, None, None) for r in _ranges(owners[:, 0], owners[:, 1], owners[:, 2], least)]

    def run(batches):
        held, last = [], None
        for batch in batches:
            for h, part, digests, owners in zip(*(batch.column(c).to_pylist() for c in ("h", "part", "digests", "owners")), strict=True):
                if held and (h, part) != last:
                    if out := group(held):
                        yield _rows(out)
                    held = []
                held.append((digests, owners))
                last = h, part
        if held and (out := group(held)):
            yield _rows(out)

    return run


def _repeated(rows: list[pa.RecordBatch], least: int) -> pa.RecordBatch | None:
    """Sort the suffixes of whole groups of segments: ranges that repeat, and, of anchors with several groups, all different windows, packed."""
    t = pa.Table.from_batches(rows)
    parts, n, copies, groups = t.column("part").to_pylist(), *(t.column(c).to_numpy() for c in ("n", "copies", "groups"))
    symbols, begin = joined(parts)
    words = words_of(symbols, least)
    owner = np.repeat(np.arange(len(parts)), n + least)
    order = suffix_order(symbols, least, words, begin, n)
    own = owner[order]
    starts = order - begin[own] < n[own]  # a suffix of `least` bytes that its segment owns
    order, own = order[starts], own[starts]
    same = common_prefixes(order, symbols, words, least)
    twice = np.zeros(len(order), bool)
    twice[1:] |= same
    twice[:-1] |= same
    doc, key, start = (t.column(c).to_numpy() for c in ("d", "k", "start"))
    # Segments with copies are removed as a whole elsewhere; here they are witnesses.
    hit = twice & (copies[own] == 1)
    out = [(*r, None, None, None, None) for r in _ranges(doc[own[hit]], key[own[hit]], (order - begin[own] + start[own])[hit], least)]
    several = groups[own] > 1
    if several.any():
        import xxhash

        leads = np.concatenate([[True], ~same]) & several
        order, own, single = order[leads], own[leads], (~twice & (copies[own] == 1))[leads]
        digests = np.frombuffer(b"".join([xxhash.xxh3_128_digest(parts[o][i : i + least]) for o, i in zip(own.tolist(), (order - begin[own]).tolist(), strict=True)]), np.uint64).reshape(-1, 2)
        owners = np.stack([doc[own], key[own], np.where(single, order - begin[own] + start[own], -1)], 1)
        anchor, number = t.column("h").to_numpy()[own], t.column("group").to_numpy()[own]
        part = (digests[:, 0] % -(-groups[own] // TOGETHER).astype(np.uint64)).astype(np.int64)
        by = np.lexsort((part, number, anchor))
        new = np.flatnonzero(np.concatenate([[True], (np.diff(anchor[by]) != 0) | (np.diff(number[by]) != 0) | (np.diff(part[by]) != 0)]))
        for pick in np.split(by, new[1:]):
            out.append((None, None, None, None, int(anchor[pick[0]]), int(part[pick[0]]), digests[pick].tobytes(), owners[pick].tobytes()))
    return _rows(out) if out else None


def _sorted_groups(least: int):
    """From rows sorted by h and group: whole groups are gathered up to SORTED bytes and sorted at once."""

    def run(batches):
        held, size, last = [], 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            h, g = batch.column("h").to_numpy(), batch.column("group").to_numpy()
            weight = batch.column("n").to_numpy() + least - 1
            edge = [0, *(np.flatnonzero((h[1:] != h[:-1]) | (g[1:] != g[:-1])) + 1).tolist(), batch.num_rows]
            for a, b in zip(edge, edge[1:], strict=False):
                now = (h[a], g[a])
                if held and now != last and size >= SORTED:
                    if (out := _repeated(held, least)) is not None:
                        yield out
                    held, size = [], 0
                held.append(batch.slice(a, b - a))
                size += int(weight[a:b].sum())
                last = now
        if held and (out := _repeated(held, least)) is not None:
            yield out

    return run


def _rest(least: int):
    def run(batches):
        for batch in batches:
            rows = []
            for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                raw = text.encode("utf-8", "surrogatepass")
                kept, at, removed, count, end = [], 0, 0, 0, -1
                for a, b in sorted((x["start"], x["stop"]) for x in spans or ()):
                    if a > end:
                        kept.append(raw[at:a])
                        count += 1
                        removed += b - a
                        at = end = b
                    elif b > end:
                        removed += b - end
                        at = end = b
                kept.append(raw[at:])
                rows.append((len(raw), removed, count, hashlib.sha256(b"".join(kept)).hexdigest()))
            n = [pa.array(c, pa.string() if j == 3 else pa.int64()) for j, c in enumerate(zip(*rows, strict=True))] if rows else [pa.array([], pa.string() if j == 3 else pa.int64()) for j in range(4)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *n], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return run


REST = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """d, k: a row's key, of its id (a null one as the least number) and its text."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(text).alias("text"))
    return rows.select(F.coalesce("doc_id", F.lit(-(2**63))).alias("d"), F.xxhash64("doc_id", "text").alias("k"), "text", "doc_id")


def spans(docs: DataFrame, least: int = LEAST, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(d, k, start, stop): byte ranges that are covered by repeated strings; they may overlap."""
    rows = _keyed(docs, doc_id, text)
    seen = rows.select("d", "k", "text").mapInArrow(_occurrences(least), "h long, s long, d long, k long, start long, n long")
    hashes = rows.select("text").mapInArrow(_anchor_hashes(least), "h long")
    twice = settled(hashes.groupBy("h").agg(F.count("*").alias("c")).filter("c > 1").select("h"))
    hits = settled(seen.join(twice, "h", "left_semi"))
    least_place: Column = F.min(F.struct("d", "k", "start", "n")).alias("at")
    parts = settled(hits.groupBy("h", "s").agg(F.count("*").alias("copies"), least_place))
    # A segment with a large share of all hits, of which there are few, is found by broadcast, so that no task gets its copies.
    total = parts.agg(F.sum("copies")).first()[0] or 0
    hot = F.broadcast(parts.filter((F.col("copies") > HOT_LEAST) & (F.col("copies") * HOT_SHARE > total)).select("h", "s"))
    again = hits.join(hot, ["h", "s"], "left_anti").join(parts.filter("copies > 1").select("h", "s"), ["h", "s"], "left_semi")
    whole = hits.join(hot, ["h", "s"], "left_semi").unionByName(again).select("d", "k", "start", (F.col("start") + F.col("n") + least - 1).alias("stop"))
    mixed = settled(parts.groupBy("h").agg(F.count("*").alias("different")).filter("different > 1").select("h", F.ceil(F.col("different") / GROUP).alias("groups")))
    wanted = parts.join(mixed, "h").select("at.*", "h", F.pmod("s", "groups").alias("group"), "groups", "copies")
    wanted = wanted.groupBy("d", "k").agg(F.collect_list(F.struct("h", "group", "groups", "copies", "start", "n")).alias("wanted"))
    texts = rows.select("d", "k", "text").join(wanted, ["d", "k"])
    cut = texts.mapInArrow(_cut(least), CUT).dropDuplicates(["h", "group", "d", "k", "start"])
    cut = cut.repartition("h", "group").sortWithinPartitions("h", "group")
    found = settled(cut.mapInArrow(_sorted_groups(least), FOUND))
    packed = found.filter("digests is not null").repartition("h", "part").sortWithinPartitions("h", "part")
    between = packed.mapInArrow(_merged(least), FOUND)
    keep = ["d", "k", "start", "stop"]
    return whole.select(keep).union(found.filter("digests is null").select(keep)).union(between.select(keep))


def remove_repeats(docs: DataFrame, least: int = LEAST, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    Texts are UTF-8 bytes, null ones empty; strings of `least` bytes never cross documents, and are judged on the input.
    Repeated rows are copies of each other, so all of them lose all bytes if they have `least` of them. Rows without
    an id take part like others. An empty table gives no rows. Other columns aren't read.
    """
    rows = _keyed(docs, doc_id, text)
    ranges = spans(docs, least, doc_id, text).groupBy("d", "k").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    return rows.join(ranges, ["d", "k"], "left").select("doc_id", "text", "spans").mapInArrow(_rest(least), REST)
