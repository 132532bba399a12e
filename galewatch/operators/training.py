"""Training of the recurrent network: shards of sequences are learned from on executors, and their results averaged.

An epoch is one job. Every shard goes over its own sequences in mini-batches with Adam, from the weights and moments that
all share, and gives back its own; means weighted by valid steps are the next epoch's. With one shard this is the plain
algorithm. The driver holds a few copies of the weights, whatever the number of sequences.
"""

from __future__ import annotations

import io
import statistics
import time
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import require_positive
from .models import AT_ONCE, RecurrentWeights, by_steps, recurrent_probabilities, steps_of

#: Sequences of a shard, about; and parts of the weights that are averaged apart.
SHARD = 20_000


def _sigmoid(a: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-a))


def masked_loss(logits: np.ndarray, y: np.ndarray, mask: np.ndarray, weight: float) -> float:
    """Binary cross-entropy of logits in which positives weigh `weight`, summed over valid steps."""
    soft = np.maximum(-logits, 0) + np.log1p(np.exp(-np.abs(logits)))  # -log of the sigmoid
    return float(((weight * y * soft + (1 - y) * (soft + logits)) * mask).sum())


def _forward(cell: tuple[np.ndarray, ...], x: np.ndarray) -> tuple[np.ndarray, np.ndarray, list]:
    """A cell's states after each step (sequences, steps, size), and what its back-propagation needs."""
    wi, wh, bi, bh = cell
    k, (rows, steps) = wh.shape[1], x.shape[:2]
    h = np.zeros((steps + 1, rows, k), x.dtype)
    kept, took = [], x @ wi.T + bi
    for t in range(steps):
        g, i = h[t] @ wh.T + bh, took[:, t]
        r, z = _sigmoid(i[:, :k] + g[:, :k]), _sigmoid(i[:, k : 2 * k] + g[:, k : 2 * k])
        n = np.tanh(i[:, 2 * k :] + r * g[:, 2 * k :])
        h[t + 1] = n + z * (h[t] - n)
        kept.append((r, z, n, g[:, 2 * k :]))
    return h[1:].transpose(1, 0, 2), h, kept


def _backward(cell: tuple[np.ndarray, ...], x: np.ndarray, h: np.ndarray, kept: list, down: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Gradients of the cell's four parts, and of its input, from those of its states."""
    wi, wh, _, _ = cell
    k, steps = wh.shape[1], x.shape[1]
    dwh, dbh, dtook, back = np.zeros_like(wh), np.zeros(3 * k, x.dtype), np.zeros((*x.shape[:2], 3 * k), x.dtype), np.zeros_like(h[0])
    for t in reversed(range(steps)):
        r, z, n, g = kept[t]
        here = back + down[:, t]
        dn = here * (1 - z) * (1 - n * n)
        dr, dz = dn * g * r * (1 - r), here * (h[t] - n) * z * (1 - z)
        dtook[:, t] = np.concatenate([dr, dz, dn], 1)
        state = np.concatenate([dr, dz, dn * r], 1)
        dwh += state.T @ h[t]
        dbh += state.sum(0)
        back = here * z + state @ wh
    flat = dtook.reshape(-1, 3 * k)
    return [flat.T @ x.reshape(-1, x.shape[2]), dwh, flat.sum(0), dbh], dtook @ wi


def gradients(w: RecurrentWeights, x: np.ndarray, y: np.ndarray, mask: np.ndarray, weight: float, dropout: float = 0.0, rng: np.random.Generator | None = None) -> tuple[float, list[np.ndarray]]:
    """Mean masked loss of a batch (sequences, steps, features), and gradients in the order of flat()."""
    saved = []
    for layer in w.layers():
        # The second cell of a layer goes over the steps in reverse.
        runs = [(cell, x[:, :: 1 - 2 * i], *_forward(cell, x[:, :: 1 - 2 * i])) for i, cell in enumerate(layer)]
        x = np.concatenate([run[2][:, :: 1 - 2 * i] for i, run in enumerate(runs)], 2)
        drop = np.ones_like(x) if not dropout else (rng.random(x.shape) >= dropout).astype(x.dtype) / (1 - dropout)
        saved.append((runs, drop))
        x = x * drop
    logits = x @ w.head + w.bias
    count = max(1.0, float(mask.sum()))
    loss = masked_loss(logits, y, mask, weight) / count
    p = _sigmoid(logits)
    d = (p * (1 + (weight - 1) * y) - weight * y) * mask / count
    out = [np.einsum("bt,btk->k", d, x), np.array(d.sum())]
    down = d[..., None] * w.head
    for runs, drop in reversed(saved):
        down, above, parts = down * drop, 0.0, []
        for i, (cell, x, _, h, kept) in enumerate(runs):
            k, turn = cell[1].shape[1], slice(None, None, 1 - 2 * i)
            own, dx = _backward(cell, x, h, kept, down[:, turn, i * k : (i + 1) * k])
            parts += own
            above = above + dx[:, turn]
        out, down = [*parts, *out], above
    return loss, out


def flat(w: RecurrentWeights) -> list[np.ndarray]:
    return [p for cell in w.cells for p in cell] + [w.head, np.array(w.bias, np.float32)]


def of_flat(parts: Sequence[np.ndarray]) -> RecurrentWeights:
    return RecurrentWeights([tuple(parts[i : i + 4]) for i in range(0, len(parts) - 2, 4)], parts[-2], float(parts[-1]))


@dataclass
class State:
    """What training goes on from: weights, Adam's moments and steps, and the best so far."""

    parts: list[np.ndarray]
    one: list[np.ndarray]
    two: list[np.ndarray]
    steps: float = 0.0
    epoch: int = 0
    best_loss: float = float("inf")
    best: list[np.ndarray] = field(default_factory=list)
    waited: int = 0
    history: list[tuple[int, float, float]] = field(default_factory=list)

    @classmethod
    def new(cls, w: RecurrentWeights) -> State:
        parts = [p.astype(np.float32) for p in flat(w)]
        return cls(parts, [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts])

    def dumps(self) -> bytes:
        raw, n = io.BytesIO(), len(self.parts)
        arrays = {f"{k}{i}": p for k in ("parts", "one", "two", "best") for i, p in enumerate(getattr(self, k))}
        np.savez(raw, **arrays, count=n, scalars=np.array([self.steps, self.epoch, self.best_loss, self.waited]), history=np.array(self.history, float).reshape(-1, 3))
        return raw.getvalue()

    @classmethod
    def loads(cls, raw: bytes) -> State:
        with np.load(io.BytesIO(raw)) as z:
            n = int(z["count"])
            lists = [[z[f"{k}{i}"] for i in range(n) if f"{k}{i}" in z] for k in ("parts", "one", "two", "best")]
            steps, epoch, best, waited = z["scalars"].tolist()
            return cls(*lists[:3], steps, int(epoch), best, lists[3], int(waited), [(int(e), a, b) for e, a, b in z["history"].tolist()])


def _sequences(batch: pa.RecordBatch) -> dict[int, tuple[np.ndarray, ...]]:
    """Arrays of features, labels and mask by number of steps; sequences without steps are left out."""
    x, *others = (batch.column(c) for c in ("features", "labels", "mask"))
    return {n: (steps_of(x, at, n), *(_numbers(c, at, n) for c in others)) for n, at in by_steps(x)}


def _numbers(column: pa.Array, at: np.ndarray, steps: int) -> np.ndarray:
    own = column.take(pa.array(at))
    if (own.value_lengths().fill_null(0).to_numpy(zero_copy_only=False) != steps).any():
        raise ValueError("labels and mask must have a number for each step")
    return own.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(len(at), steps)


def _joined(batches) -> dict[int, tuple[np.ndarray, ...]]:
    found: dict[int, list] = {}
    for batch in batches:
        for n, arrays in _sequences(batch).items():
            found.setdefault(n, []).append(arrays)
    return {n: tuple(np.concatenate([a[i] for a in own]) for i in range(3)) for n, own in sorted(found.items())}


def _epoch(shared, weight: float, rate: float, batch_size: int, accumulate: int, dropout: float, seed: int):
    """A shard's sequences -> its weights, moments, steps, loss and number of valid steps."""

    def run(batches):
        state, data = State.loads(shared.value), _joined(batches)
        if not data:
            return
        rng = np.random.default_rng([seed, state.epoch])
        parts, one, two, steps = [p.copy() for p in state.parts], state.one, state.two, state.steps
        picks = [(n, p) for n, (x, _, _) in data.items() for p in np.array_split(rng.permutation(len(x)), -(-len(x) // batch_size))]
        total, valid = 0.0, float(sum(m.sum() for _, _, m in data.values()))
        held, many = [np.zeros_like(p) for p in parts], 0
        for at, i in enumerate(rng.permutation(len(picks)), 1):
            n, pick = picks[i]
            x, y, m = (a[pick] for a in data[n])
            loss, grads = gradients(of_flat(parts), x, y, m, weight, dropout, rng)
            total += loss * max(1.0, float(m.sum()))
            held, many = [a + g for a, g in zip(held, grads, strict=True)], many + 1
            if at % accumulate and at < len(picks):
                continue
            steps += 1
            for j, g in enumerate(held):
                g = g / many
                one[j] = 0.9 * one[j] + 0.1 * g
                two[j] = 0.999 * two[j] + 0.001 * g * g
                parts[j] = (parts[j] - rate * (one[j] / (1 - 0.9**steps)) / (np.sqrt(two[j] / (1 - 0.999**steps)) + 1e-8)).astype(np.float32)
            held, many = [np.zeros_like(p) for p in parts], 0
        values = np.concatenate([a.ravel().astype(np.float64) for a in (*parts, *one, *two)])
        yield pa.RecordBatch.from_arrays([pa.array([max(valid, 1.0)]), pa.array([steps]), pa.array([total]), pa.array([values], pa.list_(pa.float64()))], names=["weight", "steps", "loss", "values"])

    return run


def _losses(shared, weight: float):
    def run(batches):
        w = of_flat(State.loads(shared.value).parts)
        for batch in batches:
            loss, valid = 0.0, 0.0
            for n, (x, y, m) in _sequences(batch).items():
                for i in range(0, len(x), at_once := max(1, AT_ONCE // n)):
                    own = slice(i, i + at_once)
                    p = np.clip(recurrent_probabilities(w, x[own]).astype(np.float64), 1e-12, 1 - 1e-12)
                    loss, valid = loss + masked_loss(np.log(p / (1 - p)), y[own], m[own], weight), valid + float(m[own].sum())
            yield pa.RecordBatch.from_arrays([pa.array([loss]), pa.array([valid])], names=["loss", "valid"])

    return run


def masked_positive_weight(df: DataFrame) -> float:
    """Valid negative steps for each valid positive one; an error without a positive one."""
    step = df.select(F.explode(F.arrays_zip("labels", "mask")).alias("s")).filter("s.mask <> 0")
    yes, no = step.agg(F.count_if(F.col("s.labels") == 1), F.count_if(F.col("s.labels") != 1)).first()
    if not yes:
        raise ValueError("there is no positive step to learn from")
    return no / yes


def train_recurrent(
    train: DataFrame, val: DataFrame, features: int, hidden: int = 32, depth: int = 2, dropout: float = 0.3, rate: float = 1e-3, epochs: int = 20, batch_size: int = 32, accumulate: int = 1,
    patience: int = 5, seed: int = 42, state: State | None = None, shard: int = SHARD, keep=None, both_ways: bool = False,
) -> State:
    """The state after training, of which best are the weights with the least loss on val.

    Rows are sequences: features array<array<float>>, labels and mask array<int>. Steps with a mask of 0 count nowhere.
    Training ends after `epochs`, or `patience` epochs without a lower loss on val. It goes on from state where one is
    given; keep(state) is called after each epoch, as to save it. A gradient is the mean of `accumulate` batches'. With
    both_ways the network also goes over the steps in reverse, which needs whole sequences: such scores aren't causal.
    """
    for name, value in (("rate", rate), ("epochs", epochs), ("batch_size", batch_size), ("accumulate", accumulate), ("patience", patience), ("shard", shard)):
        require_positive(value, name)
    weight = masked_positive_weight(train)
    state = state or State.new(RecurrentWeights.random(features, hidden, depth, seed, both_ways))
    columns = [F.col("features").cast("array<array<float>>").alias("features"), F.col("labels").cast("array<int>").alias("labels"), F.col("mask").cast("array<int>").alias("mask")]
    key = F.xxhash64(*columns)
    shards = max(1, -(-train.count() // shard))
    dealt = train.select(*columns, key.alias("k")).repartitionById(shards, F.pmod("k", F.lit(shards)).cast("int")).sortWithinPartitions("k").drop("k")
    held_out, context = val.select(*columns), train.sparkSession.sparkContext
    shapes = [p.shape for p in state.parts]
    ends = np.cumsum([int(np.prod(s)) for s in shapes * 3])
    while state.epoch < epochs and state.waited < patience:
        shared = context.broadcast(state.dumps())
        found = dealt.mapInArrow(_epoch(shared, weight, rate, batch_size, accumulate, dropout, seed), "weight double, steps double, loss double, values array<double>")
        # Means are taken where the rows are; a row a parameter comes back.
        pieces = found.select("weight", "steps", "loss", F.posexplode("values").alias("i", "x")).groupBy("i").agg((F.sum(F.col("x") * F.col("weight")) / F.sum("weight")).alias("x"), F.max("steps").alias("steps"), F.sum("loss").alias("loss"), F.sum("weight").alias("weight"))
        rows = sorted(pieces.collect(), key=lambda r: r["i"])
        if not rows:
            raise ValueError("there is no sequence to learn from")
        values = [p.reshape(s).astype(np.float32) for p, s in zip(np.split(np.array([r["x"] for r in rows]), ends[:-1]), shapes * 3, strict=True)]
        n = len(shapes)
        state.parts, state.one, state.two, state.steps, state.epoch = values[:n], values[n : 2 * n], values[2 * n :], rows[0]["steps"], state.epoch + 1
        now = context.broadcast(state.dumps())
        loss, valid = held_out.mapInArrow(_losses(now, weight), "loss double, valid double").agg(F.sum("loss"), F.sum("valid")).first()
        mean = (loss or 0.0) / max(valid or 0.0, 1.0)
        state.history.append((state.epoch, rows[0]["loss"] / rows[0]["weight"], mean))
        if mean < state.best_loss:
            state.best_loss, state.best, state.waited = mean, [p.copy() for p in state.parts], 0
        else:
            state.waited += 1
        if keep is not None:
            keep(state)
    return state


def latency(weights: RecurrentWeights, steps: int, features: int, batches: Sequence[int] = (1, 64), repeats: int = 50, warm: int = 10) -> list[tuple[int, float, float, float, float]]:
    """(batch, median, least, most, median a sequence) of inference on this machine, in milliseconds."""
    out = []
    for batch in batches:
        x = np.random.default_rng(0).standard_normal((batch, steps, features)).astype(np.float32)
        took = []
        for i in range(warm + repeats):
            began = time.perf_counter()
            recurrent_probabilities(weights, x)
            if i >= warm:
                took.append(1e3 * (time.perf_counter() - began))
        out.append((batch, statistics.median(took), min(took), max(took), statistics.median(took) / batch))
    return out


def table_latency(df: DataFrame, weights: RecurrentWeights, batches: Sequence[int] = (1, 64), repeats: int = 50) -> DataFrame:
    """batch, median_ms, min_ms, max_ms, ms_per_sequence, timed: inference over df's sequences (features), timed in the tasks that hold them.

    Of every Arrow batch that a task gets, the first sequences are timed as one batch of each size, `repeats` times after a
    tenth as many to warm up; where there are fewer, the batch is smaller, and its row says so.
    """
    shared = df.sparkSession.sparkContext.broadcast(weights)

    def run(found):
        for batch in found:
            x = [r for r in batch.column("features").to_pylist() if r]
            for size in batches:
                some = [r for r in x[:size] if len(r) == len(x[0])]
                if not some:
                    continue
                data, took = np.array(some, np.float32), []
                for i in range(repeats + max(1, repeats // 10)):
                    began = time.perf_counter()
                    recurrent_probabilities(shared.value, data)
                    took.append(1e3 * (time.perf_counter() - began))
                took = took[-repeats:]
                yield pa.RecordBatch.from_arrays([pa.array([len(some)] * repeats, pa.int32()), pa.array(took)], names=["batch", "ms"])

    rows = df.select(F.col("features").cast("array<array<float>>").alias("features")).mapInArrow(run, "batch int, ms double")
    return rows.groupBy("batch").agg(F.median("ms").alias("median_ms"), F.min("ms").alias("min_ms"), F.max("ms").alias("max_ms"), (F.median("ms") / F.first("batch")).alias("ms_per_sequence"), F.count("*").alias("timed"))
