"""Two-stage suffix sorting and adjacent common prefixes, for many strings at once.

Strings are arrays of symbols, bytes plus one, with a zero after each. Suffixes are compared up to their own string's end
and to a depth; those that are equal so far are in any order, but next to each other.
"""

from __future__ import annotations

import numpy as np

#: Symbols of nine bits in a word.
STEP = 7


def joined(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all strings, and where each begins."""
    size = np.fromiter(map(len, strings), np.int64, len(strings)) + 1
    symbols = np.frombuffer(b"".join([s + b"\0" for s in strings]), np.uint8).astype(np.int16) + 1
    begin = np.cumsum(size) - size
    symbols[begin + size - 1] = 0
    return symbols, begin


def words_of(symbols: np.ndarray, depth: int) -> np.ndarray:
    """STEP symbols from each place on as one number, with zeros after the string's end."""
    n = len(symbols)
    padded = np.zeros(n + depth + 2 * STEP, np.uint64)
    padded[:n] = symbols
    size = n + depth + STEP
    out, live = np.zeros(size, np.uint64), np.ones(size, bool)
    for i in range(STEP):
        here = padded[i : i + size]
        live &= here != 0
        out = (out << np.uint64(9)) | np.where(live, here, np.uint64(0))
    return out


def prefix_hashes(symbols: np.ndarray, depth: int) -> np.ndarray:
    """A 64-bit hash of up to depth symbols from each place on, within the string."""
    n = len(symbols)
    root = 0x9E3779B97F4A7C15
    up, down = (np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n, np.uint64(x))])) for x in (root, pow(root, -1, 1 << 64)))
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(symbols.astype(np.uint64) * down[:n], out=sums[1:])
    stops = np.append(np.flatnonzero(symbols == 0), n)
    stop = stops[np.cumsum(np.concatenate([[0], symbols[:-1] == 0]))] if n else stops[:0]
    h = (sums[np.minimum(stop, np.arange(n) + depth)] - sums[:n]) * up[:n]
    return h ^ (h >> np.uint64(31))


def _rising(symbols: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than its successor. The last one isn't."""
    n = len(symbols)
    change = np.flatnonzero(symbols[1:] != symbols[:-1])
    runs = np.diff(np.concatenate([[0], change + 1, [n]]))
    up = np.concatenate([symbols[change] < symbols[change + 1], [False]])
    return np.repeat(up, runs)


def _direct(places: np.ndarray, words: np.ndarray, whole: np.ndarray, depth: int) -> np.ndarray:
    """Places in the order of their first depth symbols, STEP at a time.

    Places that are alike to the full depth by hash are sorted as one; only tied ones are looked at again.
    """
    _, at, alike = np.unique(whole[places], return_index=True, return_inverse=True)
    some = places[at]
    key = words[some]
    order = np.argsort(key)
    key = key[order]
    tied_to = np.concatenate([[False], key[1:] == key[:-1]]) if len(order) else np.zeros(0, bool)
    at = np.arange(len(order))
    for d in range(STEP, depth, STEP):
        tied = tied_to.copy()
        tied[:-1] |= tied_to[1:]
        at, tied_to = at[tied], tied_to[tied]
        if not at.size:
            break
        group = np.cumsum(~tied_to)
        own = order[at]
        # What ended before has no more symbols; its words are beyond its string.
        key = np.where(words[some[own] + d - STEP] & np.uint64(511), words[some[own] + d], np.uint64(0))
        again = np.lexsort((key, group))
        order[at], key = own[again], key[again]
        tied_to[1:] &= key[1:] == key[:-1]
    rank = np.empty(len(order), np.int32)
    rank[order] = np.arange(len(order))
    return places[np.argsort(rank[alike], kind="stable")]


def needed(symbols: np.ndarray, rising: np.ndarray, begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Which places the order of each string's first `count` ones depends on: up to the next that is sorted directly."""
    direct = np.append(np.flatnonzero(rising), len(symbols) - 1)
    stop = direct[np.searchsorted(direct, begin + count - 1)] + 1
    edge = np.zeros(len(symbols) + 1, np.int32)
    np.add.at(edge, begin, 1)
    np.add.at(edge, stop, -1)
    return np.cumsum(edge)[:-1] > 0


def suffix_order(symbols: np.ndarray, depth: int, words: np.ndarray | None = None, begin: np.ndarray | None = None, count: np.ndarray | None = None) -> np.ndarray:
    """All places in the order of their suffixes' first depth symbols at least; of strings that begin at `begin` and
    aren't empty, only the first `count` places each and what their order depends on.

    Suffixes smaller than their successors are sorted directly. The others are induced: buckets are scanned in
    ascending order, and a suffix whose successor is met goes to the next free place in its first symbol's bucket. A
    bucket is handled as arrays: what earlier buckets put there, then, round by round, what it puts there itself.
    """
    n = len(symbols)
    if not n:
        return np.zeros(0, np.int64)
    words = words_of(symbols, depth) if words is None else words
    rising = _rising(symbols)
    wanted = np.ones(n, bool) if begin is None else needed(symbols, rising, begin, count)
    inducible = wanted & ~rising
    direct = _direct(np.flatnonzero(rising & wanted), words, prefix_hashes(symbols, depth), depth)
    ends = np.searchsorted(symbols[direct], np.arange(258))
    induced: list[list[np.ndarray]] = [[] for _ in range(257)]
    if wanted[n - 1]:
        induced[symbols[n - 1]].append(np.array([n - 1]))  # the empty suffix comes first
    out = []
    for c in range(257):
        now, rounds = (np.concatenate(induced[c]) if induced[c] else np.zeros(0, np.int64)), []
        while now.size:
            rounds.append(now)
            before = now[now > 0] - 1
            now = before[(symbols[before] == c) & inducible[before]]
        bucket = np.concatenate([*rounds, direct[ends[c] : ends[c + 1]]])
        if not bucket.size:
            continue
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        before = before[(symbols[before] > c) & inducible[before]]
        if before.size:
            first = symbols[before]
            order = np.argsort(first, kind="stable")
            before, first = before[order], first[order]
            edge = np.flatnonzero(np.concatenate([[True], first[1:] != first[:-1]]))
            for part in np.split(before, edge[1:]):
                induced[symbols[part[0]]].append(part)
    return np.concatenate(out)


def common_prefixes(order: np.ndarray, symbols: np.ndarray, words: np.ndarray, depth: int) -> np.ndarray:
    """For each place of order but the first, whether it shares depth symbols of its string with the one before.

    If the places one to the left are neighbours too, what is shared is one less than theirs, so only the symbol at the
    end is compared; the others are compared from the start, word by word.
    """
    n = len(symbols)
    if len(order) < 2:
        return np.zeros(0, bool)
    before = np.full(n + 1, -9)
    before[order[1:] + 1] = order[:-1] + 1  # of the place one to the right
    i, j = order[1:], order[:-1]
    chained = before[i] == j
    full = np.zeros(n, bool)
    alive = np.flatnonzero(~chained)
    for d in [*range(0, depth - STEP, STEP), depth - STEP]:
        same = words[i[alive] + d] == words[j[alive] + d]
        same &= words[i[alive] + d] & np.uint64(511) != 0
        alive = alive[same]
        if not alive.size:
            break
    full[i[alive]] = True
    # Along the text: what a chain starts with, as long as no symbol differs.
    link, bad = np.zeros(n, bool), np.zeros(n, bool)
    link[i[chained]] = True
    end, other = i[chained] + depth - 1, j[chained] + depth - 1
    last = symbols[np.minimum(end, n - 1)]
    bad[i[chained]] = (np.maximum(end, other) >= n) | (last != symbols[np.minimum(other, n - 1)]) | (last == 0)
    start = np.maximum.accumulate(np.where(link, 0, np.arange(n)))
    wrong = np.cumsum(bad)
    full[link] = (full[start] & (wrong == wrong[start]))[link]
    return full[i]
