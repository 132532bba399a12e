"""A small causal self-attention model over subword ids, trained and run in NumPy.

Subwords are pieces of up to four bytes of a public byte-pair vocabulary, matched greedily from each word's start; a
word's first piece has an id of its own, so words end where the next one starts. The model has one attention layer with
a learned bias by distance. Its output is a mixture of unigram tables, weighted by the state, so a token's probability
costs one row of the tables and no sum over the vocabulary.
"""

from __future__ import annotations

import base64
from dataclasses import dataclass

import numpy as np

#: Pieces, model width, tables, tokens of a window, and of those that are context only.
PIECES, WIDTH, TABLES, WINDOW, CONTEXT = 4096, 16, 48, 32, 8
STEPS, BATCH, RATE = 2000, 96, 0.02
#: Windows of a step, and its rate, where a model goes on learning.
MANY, GENTLE = 384, 0.01
#: Windows that are scored at once, and that are learned from at once.
AT_ONCE, LEARNED = 256, 384
#: Logits are held within these bounds, so that exponents stay in single precision.
FAR = 40
#: Numbers that steps on one array after the other take at once, so that they stay in a core's cache.
NEAR = 16384
#: Bytes of a piece, and what they may be.
LENGTHS = (2, 3, 4)
LETTERS = bytes(range(97, 123)) + b"\xc3" + bytes(range(0xA0, 0xC0)) + b"'-.,"


class Pieces:
    """ids: single bytes, then pieces; those at a word's start are `count` higher; then end, begin and padding."""

    def __init__(self, path: str, count: int = PIECES):
        self.of = np.zeros(256, np.int32)
        for i, b in enumerate(LETTERS, 1):
            self.of[b] = i
        self.by_length = {n: np.full(64**n, -1, np.int16) for n in LENGTHS}
        with open(path, "rb") as f:
            ranked = sorted((int(rank), base64.b64decode(token)) for token, rank in map(bytes.split, f))
        at = 256
        for _, token in ranked:
            if len(token) in LENGTHS and at < count and all(self.of[b] for b in token):
                code = 0
                for b in token:
                    code = code * 64 + int(self.of[b])
                self.by_length[len(token)][code] = at
                at += 1
        self.count, self.end, self.begin, self.pad, self.size = count, 2 * count, 2 * count + 1, 2 * count + 2, 2 * count + 3

    def split(self, raw: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """raw: the bytes of all words on end, size: each word's. Gives ids and, for each, whether it starts a word."""
        n = len(raw)
        if not n:
            return np.zeros(0, np.int32), np.zeros(0, bool)
        ends = np.cumsum(size)
        starts = ends - size
        c = np.zeros(n + max(LENGTHS), np.int32)
        c[:n] = self.of[raw]
        left = np.repeat(ends, size) - np.arange(n)
        code, piece, length = c[:n], raw.astype(np.int32), np.ones(n, np.int64)
        for many in LENGTHS:
            code = (code << 6) | c[many - 1 : n + many - 1]
            hit = self.by_length[many][code]
            ok = np.flatnonzero((hit >= 0) & (left >= many))
            piece[ok], length[ok] = hit[ok], many
        chosen = np.zeros(n, bool)
        now, stop = starts, ends
        while now.size:
            chosen[now] = True
            now = now + length[now]
            on = now < stop
            now, stop = now[on], stop[on]
        first = np.zeros(n, bool)
        first[starts] = True
        at = np.flatnonzero(chosen)
        return piece[at] + self.count * first[at], first[at]


@dataclass
class Model:
    e: np.ndarray  # embeddings
    q: np.ndarray
    k: np.ndarray
    v: np.ndarray
    d: np.ndarray  # bias by distance
    u: np.ndarray  # state to tables
    b: np.ndarray
    t: np.ndarray  # tables, as logarithms up to a constant
    rest: np.ndarray | float = -np.inf  # logarithms of what tables hold besides t, which isn't learned

    @classmethod
    def of_vector(cls, x: np.ndarray, pieces: Pieces) -> Model:
        """A model from its parameters on end."""
        shapes = [w.shape for w in new_model(pieces, np.ones(pieces.size)).parts()]
        ends = np.cumsum([int(np.prod(shape)) for shape in shapes])
        return cls(*(part.reshape(shape).astype(np.float32) for part, shape in zip(np.split(x, ends[:-1]), shapes, strict=True)))

    def vector(self) -> np.ndarray:
        return np.concatenate([w.ravel() for w in self.parts()])

    def parts(self) -> list[np.ndarray]:
        return [self.e, self.q, self.k, self.v, self.d, self.u, self.b, self.t]

    def tables(self) -> np.ndarray:
        rows = self.t.T
        top = np.maximum(rows.max(0), self.rest)
        p = rows - top
        np.exp(p, out=p)
        p /= p.sum(0) + np.exp(self.rest - top)
        return p.T


def new_model(pieces: Pieces, counts: np.ndarray, seed: int = 3) -> Model:
    rng = np.random.default_rng(seed)
    draw = lambda scale, *shape: rng.normal(0, scale, shape).astype(np.float32)
    t = np.log(counts + 0.1)[None] + draw(0.7, TABLES, pieces.size)
    t[:, [pieces.begin, pieces.pad]] = -30  # never predicted
    w = WIDTH
    return Model(draw(0.5, pieces.size, w), draw(w**-0.5, w, w), draw(w**-0.5, w, w), draw(w**-0.5, w, w), np.zeros(WINDOW, np.float32), draw(w**-0.5, w, TABLES), np.zeros(TABLES, np.float32), t.astype(np.float32))


_distance = np.arange(WINDOW)[:, None] - np.arange(WINDOW)


def exponential(x: np.ndarray) -> np.ndarray:
    """Exponentials of x, in its place, held within FAR."""
    flat = x.ravel(order="K")
    for i in range(0, flat.size, NEAR):
        y = flat[i : i + NEAR]
        np.minimum(y, FAR, out=y)
        np.maximum(y, -FAR, out=y)
        np.exp(y, out=y)
    return x


def _by_distance(m: Model) -> np.ndarray:
    """What a token's weight for another is multiplied by; zero for later ones."""
    return np.where(_distance >= 0, np.exp(np.clip(m.d, -FAR, FAR))[np.maximum(_distance, 0)], 0)


def _asking(m: Model) -> np.ndarray:
    """Queries' and keys' weights as one matrix: x @ _asking(m) @ x.T are the logits."""
    return (m.q @ m.k.T) * np.float32(WIDTH**-0.5)


def _forward(m: Model, seen: np.ndarray, pad: int):
    x = m.e.take(seen, 0)
    flat = x.reshape(-1, WIDTH)
    y = (flat @ _asking(m)).reshape(x.shape)
    a = exponential(np.matmul(y, x.transpose(0, 2, 1)))
    a *= _by_distance(m).astype(a.dtype)
    hidden = seen == pad
    if hidden.any():
        some = np.flatnonzero(hidden.any(1))
        a[some] *= ~hidden[some][:, None, :] | (_distance == 0)
    a /= (a.reshape(-1, WINDOW) @ np.ones(WINDOW, a.dtype)).reshape(*seen.shape, 1)
    met = np.matmul(a, x)
    h = met.reshape(-1, WIDTH) @ m.v
    h += flat
    z = h @ m.u
    z += m.b
    exponential(z)
    z /= (z @ np.ones(TABLES, z.dtype))[:, None]
    return x, y, a, met, h.reshape(x.shape), z.reshape(*seen.shape, TABLES)


def _add(sums: np.ndarray, of: np.ndarray, rows: np.ndarray) -> None:
    """Adds each row to the one of sums that has its number."""
    order = np.argsort(of.astype(np.uint16) if len(sums) <= 65536 else of, kind="stable")
    names = of[order]
    begin = np.flatnonzero(np.concatenate([[True], names[1:] != names[:-1]]))
    sums[names[begin]] += np.add.reduceat(rows.take(order, 0), begin, 0)


def gradients(m: Model, seen: np.ndarray, want: np.ndarray, pieces: Pieces) -> tuple[float, list[np.ndarray]]:
    """Mean loss in nats over want (where it isn't padding), and gradients in the order of Model.parts.

    Memory is that of LEARNED windows, however many there are.
    """
    tables, asking = np.ascontiguousarray(m.tables().T), _asking(m)
    count = max(1, int((want != pieces.pad).sum()))
    loss = 0.0
    goals, held, de = np.zeros_like(tables), np.zeros(TABLES, tables.dtype), np.zeros_like(m.e)
    dm, dv, du, db, dd = (np.zeros_like(w) for w in (asking, m.v, m.u, m.b, _distance.astype(m.d.dtype)))
    for i in range(0, len(seen), LEARNED):
        some, goal = seen[i : i + LEARNED], want[i : i + LEARNED].ravel()
        x, y, a, met, h, mix = _forward(m, some, pieces.pad)
        flat, met, mix = x.reshape(-1, WIDTH), met.reshape(-1, WIDTH), mix.reshape(-1, TABLES)
        real = goal != pieces.pad
        share = tables.take(goal, 0)
        share *= mix
        p = np.maximum(share @ np.ones(TABLES, share.dtype), 1e-30)
        loss -= float(np.log(p)[real].sum()) / count
        weight = real / np.float32(count)
        share *= (weight / p)[:, None]
        one = np.ones(len(goal), share.dtype)
        _add(goals, goal, share)
        held += one @ share
        dz = mix
        dz *= weight[:, None]
        dz -= share
        du += h.reshape(-1, WIDTH).T @ dz
        db += one @ dz
        dx = dz @ m.u.T
        back = dx @ m.v.T
        dv += met.T @ dx
        ds = np.matmul(back.reshape(x.shape), x.transpose(0, 2, 1))
        ds -= np.einsum("ij,ij->i", back, met).reshape(*some.shape, 1)
        ds *= a
        dd += ds.sum(0)
        dy = np.matmul(ds, x).reshape(-1, WIDTH)
        dm += flat.T @ dy
        dx += dy @ asking.T
        dx += np.matmul(ds.transpose(0, 2, 1), y).reshape(-1, WIDTH)
        dx += np.matmul(a.transpose(0, 2, 1), back.reshape(x.shape)).reshape(-1, WIDTH)
        _add(de, some.ravel(), dx)
    dt = tables
    dt *= held
    dt -= goals
    dm *= np.float32(WIDTH**-0.5)
    dd = np.bincount(np.maximum(_distance, 0).ravel(), dd.ravel(), WINDOW)[:WINDOW]
    return loss, [de, dm @ m.k, dm.T @ m.q, dv, dd.astype(np.float32), du, db, dt.T]


def windows(begin: np.ndarray, size: np.ndarray, context: int = CONTEXT) -> tuple[np.ndarray, np.ndarray]:
    """(windows, WINDOW) places in the flat array of all sequences, and which are inside the window's own sequence.

    The first `context` places of a window are those of its neighbour; the others cover every place once.
    """
    fresh = WINDOW - context
    parts = -(-size // fresh)
    owner = np.repeat(np.arange(len(size)), parts)
    first = (np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)) * fresh
    place = first[:, None] + np.arange(-context, fresh)
    inside = (place >= 0) & (place < size[owner][:, None])
    return np.where(inside, place + begin[owner][:, None], 0), inside


def score(m: Model, tables: np.ndarray, starting: np.ndarray, seen: np.ndarray, want: np.ndarray, begin: np.ndarray, size: np.ndarray, pad: int) -> tuple[np.ndarray, np.ndarray]:
    """Natural log probabilities of want at each place, and of anything that starts a word or ends the text.

    The same model as in training with fewer passes over memory: weights are normalised after they are used, and masks
    are factors. Only places that are scored have queries.
    """
    place, inside = windows(begin, size)
    logs, starts = np.zeros(len(seen)), np.zeros(len(seen))
    by_distance = _by_distance(m).astype(np.float32)[CONTEXT:]
    asked = m.e @ _asking(m)
    known = np.concatenate([m.e, np.ones((len(m.e), 1), np.float32)], 1)
    known[pad] = 0
    own, met = m.e @ m.u + m.b, m.v @ m.u
    totals = np.stack([np.ones(TABLES, np.float32), starting], 1)
    for i in range(0, len(place), AT_ONCE):
        at, ok = place[i : i + AT_ONCE], inside[i : i + AT_ONCE]
        ids = np.where(ok, seen.take(at), pad)
        fresh = ids[:, CONTEXT:]
        x = known.take(ids, 0)
        a = exponential(np.matmul(asked.take(fresh, 0), x[..., :WIDTH].transpose(0, 2, 1)))
        a *= by_distance
        took = np.matmul(a, x).reshape(-1, WIDTH + 1)
        mix = (took[:, :WIDTH] / np.maximum(took[:, WIDTH:], 1e-30)) @ met
        mix += own.take(fresh.ravel(), 0)
        exponential(mix)
        at, ok = at[:, CONTEXT:].ravel(), ok[:, CONTEXT:].ravel()
        total, start = (mix @ totals).T
        goal = np.einsum("ij,ij->i", mix, tables.take(want.take(at), 0))
        at = at[ok]
        starts[at] = (start / total)[ok]
        logs[at] = (goal / total)[ok]
    return np.log(np.maximum(logs, 1e-30)), np.log(np.maximum(starts, 1e-30))


class _Numbers(dict):
    """Keys -> 0, 1, ... in the order in which they come; `fresh` lists them."""

    def __missing__(self, key):
        self[key] = n = len(self)
        self.fresh.append(key)
        return n


class Splitter:
    """Splits texts, given as lists of words, into ids; each different word is split once, until it is cleared."""

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.clear()

    def clear(self) -> None:
        # An end is number 0, and its id comes first.
        self.numbers = _Numbers({None: 0})
        self.ids, self.source, self.size = np.array([self.pieces.end], np.int32), np.zeros(1, np.int64), np.ones(1, np.int64)

    def numbered(self, texts: list[list[bytes]]) -> tuple[np.ndarray, list[bytes]]:
        """The numbers of all words and ends in order, and the words that are new, in the order of their numbers."""
        flat = [w for text in texts for w in (*text, None)]
        self.numbers.fresh = fresh = []
        of = np.fromiter(map(self.numbers.__getitem__, flat), np.int32, len(flat))
        if fresh:
            ids, first = self.pieces.split(np.frombuffer(b"".join(fresh), np.uint8), np.fromiter(map(len, fresh), np.int64, len(fresh)))
            source = np.flatnonzero(first)
            self.source = np.concatenate([self.source, source + len(self.ids)])
            self.size = np.concatenate([self.size, np.diff(source, append=len(ids))])
            self.ids = np.concatenate([self.ids, ids.astype(np.int32)])
        return of, fresh

    def sequences(self, of: np.ndarray) -> tuple[np.ndarray, ...]:
        """For numbers of words and ends: inputs and targets of all on end, where each text begins and its size, and where words start."""
        many = self.size[of]
        ends = np.cumsum(many)
        starts = np.zeros(int(ends[-1]) if len(ends) else 0, bool)
        want = self.ids[np.arange(len(starts)) + np.repeat(self.source[of] - (ends - many), many)]
        starts[(ends - many)[of > 0]] = True
        stop = ends[of == 0]
        begin = np.zeros_like(stop)
        begin[1:] = stop[:-1]
        seen = np.empty_like(want)
        seen[1:] = want[:-1]
        seen[begin] = self.pieces.begin
        return seen, want, begin, stop - begin, starts


def sequences(pieces: Pieces, words: list[list[bytes]]) -> tuple[np.ndarray, ...]:
    """For texts as lists of words: inputs and targets of all on end, where each begins and its size, and where words start."""
    splitter = Splitter(pieces)
    return splitter.sequences(splitter.numbered(words)[0])


def _moved(w: np.ndarray, g: np.ndarray, a: np.ndarray, b: np.ndarray, step: int, rate: float) -> None:
    """One step of Adam, in place, on arrays of one dimension; g, the gradient, is used up."""
    for i in range(0, w.size, NEAR):
        x, d, one, two = (y[i : i + NEAR] for y in (w, g, a, b))
        one *= 0.9
        one += 0.1 * d
        d *= d
        d *= 0.01
        two *= 0.99
        two += d
        np.sqrt(two, out=d)
        d += 1e-8
        np.divide(one, d, out=d)
        d *= rate * (1 - 0.99**step) ** 0.5 / (1 - 0.9**step)
        x -= d


@dataclass
class _Part:
    """The ids that some texts have, as numbers of their own."""

    size: int
    pad: int


def _descend(pieces: Pieces, m: Model, texts: tuple[np.ndarray, ...], picks: list[np.ndarray], rate: float) -> Model:
    """Adam, a step for each of picks (numbers of windows), at a rate that falls to zero over the second half.

    Rows of ids that the texts don't have stay as they are, and so does what tables give them before normalisation.
    """
    seen, want, begin, length, _ = texts
    place, inside = windows(begin, length, 0)
    there = np.zeros(pieces.size, bool)
    there[seen], there[want], there[pieces.pad] = True, True, True
    ids = np.flatnonzero(there)
    number = np.cumsum(there, dtype=np.int32) - 1
    seen, want, part = number[seen], number[want], _Part(len(ids), int(number[pieces.pad]))
    others = m.t[:, ~there]
    top = others.max(1, initial=-80)
    # Tables lie by token, as they are read and as their gradients come.
    own = Model(m.e[ids], m.q, m.k, m.v, m.d, m.u, m.b, np.ascontiguousarray(m.t.T[ids]).T, top + np.log(np.maximum(np.exp(others - top[:, None]).sum(1), 1e-30)))
    parts = own.parts()
    one, two = [np.zeros_like(w) for w in parts], [np.zeros_like(w) for w in parts]
    for step, pick in enumerate(picks, 1):
        at, ok = place[pick], inside[pick]
        _, grads = gradients(own, np.where(ok, seen.take(at), part.pad), np.where(ok, want.take(at), part.pad), part)
        now = rate * min(1, 2 * (1 - step / (len(picks) + 1)))
        for each in zip(parts, grads, one, two, strict=True):
            _moved(*(y.ravel(order="K") for y in each), step, now)
    m.e[ids], m.t[:, ids] = own.e, own.t
    return m


def window_count(texts: tuple[np.ndarray, ...]) -> int:
    """Windows without context, which are learned from: every token is in one."""
    return int((-(-texts[3] // WINDOW)).sum())


def train(pieces: Pieces, words: list[list[bytes]], steps: int = STEPS, seed: int = 3) -> Model:
    """A new model after so many steps on random windows of the texts."""
    texts = sequences(pieces, words)
    m = new_model(pieces, np.bincount(texts[1], minlength=pieces.size).astype(np.float64), seed)
    if not words:
        return m
    rng = np.random.default_rng(seed)
    return _descend(pieces, m, texts, list(rng.integers(0, window_count(texts), (steps, BATCH))), RATE)


def refine(pieces: Pieces, m: Model, words: list[list[bytes]], seed: int = 3) -> tuple[Model, int]:
    """m after one pass over all windows of the texts, in random order, and how many there are."""
    texts = sequences(pieces, words)
    count = window_count(texts)
    order = np.random.default_rng(seed).permutation(count)
    return _descend(pieces, m, texts, np.array_split(order, -(-count // MANY)) if count else [], GENTLE), count
