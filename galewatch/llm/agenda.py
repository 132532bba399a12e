"""Pair merging for many short strings at once.

Each string's adjacent symbol pairs form an agenda ordered by rank, then place. In each round every string takes the
best pair of its agenda, merges it and scores the two pairs that the new symbol makes; rounds go on until no string has
a pair left. Strings are rows of arrays, so a round is a few NumPy operations for all of them. Long strings have a heap.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np

NONE = np.int32(2**31 - 1)
#: Symbols up to which a string is merged in the array form.
WIDE = 24


class PairTable:
    """(left, right) -> (rank, merged symbol), as an open-addressing table."""

    def __init__(self, pairs: dict[tuple[int, int], tuple[int, int]]):
        self.pairs = pairs
        bits = max(4, (4 * len(pairs)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, -1, np.int64)
        self.rank = np.full(1 << bits, NONE, np.int32)
        self.made = np.zeros(1 << bits, np.int32)
        if not pairs:
            return
        key = np.array([a << 32 | b for a, b in pairs], np.int64)
        rank, made = (np.array(x, np.int32) for x in zip(*pairs.values(), strict=True))
        at, left = self._home(key), np.arange(len(key))
        while left.size:
            free = self.keys[at[left]] == -1
            first = np.unique(at[left[free]], return_index=True)[1]
            put = left[free][first]
            self.keys[at[put]], self.rank[at[put]], self.made[at[put]] = key[put], rank[put], made[put]
            left = np.setdiff1d(left, put, assume_unique=True)
            at[left] = (at[left] + 1) & self.mask

    def _home(self, key: np.ndarray) -> np.ndarray:
        return ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = (left.astype(np.int64) << 32) | right
        at = self._home(key)
        open_ = np.flatnonzero((self.keys[at] != key) & (self.keys[at] != -1))
        while open_.size:
            at[open_] = (at[open_] + 1) & self.mask
            now = self.keys[at[open_]]
            open_ = open_[(now != key[open_]) & (now != -1)]
        hit = self.keys[at] == key
        return np.where(hit, self.rank[at], NONE), self.made[at]


def merge_long(symbols: list[int], table: PairTable) -> list[int]:
    """One string by a heap of (rank, place, left, right)."""
    pairs, n = table.pairs, len(symbols)
    symbol, after, before = list(symbols), [*range(1, n), -1], [-1, *range(n - 1)]
    agenda = [(pairs[p][0], i, *p) for i in range(n - 1) if (p := (symbol[i], symbol[i + 1])) in pairs]
    heapq.heapify(agenda)
    while agenda:
        _, i, a, b = heapq.heappop(agenda)
        j = after[i]
        if symbol[i] != a or j < 0 or symbol[j] != b:
            continue
        symbol[i], symbol[j] = pairs[a, b][1], -1
        after[i] = k = after[j]
        if k >= 0:
            before[k] = i
            if (p := (symbol[i], symbol[k])) in pairs:
                heapq.heappush(agenda, (pairs[p][0], i, *p))
        if (h := before[i]) >= 0 and (p := (symbol[h], symbol[i])) in pairs:
            heapq.heappush(agenda, (pairs[p][0], h, *p))
    return [s for s in symbol if s >= 0]


def _merge_rows(symbol: np.ndarray, size: np.ndarray, table: PairTable) -> np.ndarray:
    """Rows of symbols (-1 after the end and where merged away), merged."""
    count, width = symbol.shape
    place = np.arange(width)
    after = np.where(place + 1 < size[:, None], place + 1, -1).astype(np.int32)
    before = np.broadcast_to((place - 1).astype(np.int32), symbol.shape).copy()
    rank, made = np.full(symbol.shape, NONE, np.int32), np.zeros(symbol.shape, np.int32)
    row, col = np.nonzero(after >= 0)
    rank[row, col], made[row, col] = table.find(symbol[row, col], symbol[row, col + 1])
    rows = np.arange(count)
    while rows.size:
        best = rank[rows].argmin(1)
        live = rank[rows, best] != NONE
        rows, best = rows[live], best[live]
        if not rows.size:
            break
        gone = after[rows, best]
        symbol[rows, best] = made[rows, best]
        symbol[rows, gone], rank[rows, gone] = -1, NONE
        nxt = after[rows, gone]
        after[rows, best], rank[rows, best] = nxt, NONE
        has = nxt >= 0
        r, b, n = rows[has], best[has], nxt[has]
        before[r, n] = b
        rank[r, b], made[r, b] = table.find(symbol[r, b], symbol[r, n])
        prev = before[rows, best]
        has = prev >= 0
        r, b, p = rows[has], best[has], prev[has]
        rank[r, p], made[r, p] = table.find(symbol[r, p], symbol[r, b])
    return symbol


def merge_all(symbols: np.ndarray, size: np.ndarray, table: PairTable, block: int = 4096) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """symbols: those of all strings on end, size: how many each has. Gives (which strings, their merged symbols on end, where each ends)."""
    start = np.cumsum(size) - size
    for i in np.flatnonzero(size > WIDE):
        out = np.array(merge_long(symbols[start[i] : start[i] + size[i]].tolist(), table), np.int32)
        yield np.array([i]), out, np.array([len(out)])
    short = np.flatnonzero((size <= WIDE) & (size > 0))
    short = short[np.argsort(size[short], kind="stable")]
    for at in range(0, len(short), block):
        part = short[at : at + block]
        n = size[part]
        place = np.arange(n.max())
        inside = place < n[:, None]
        rows = np.where(inside, symbols[np.where(inside, start[part][:, None] + place, 0)], np.int32(-1))
        rows = _merge_rows(rows, n, table)
        kept = rows >= 0
        yield part, rows[kept], np.cumsum(kept.sum(1))
