"""Models: weights and scores of classifiers; a recurrent network's inference in Arrow batches."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import boosting
from .boosting import Boosted
from .logistic import Logistic, known, medians
from .ordered import numbered


def balanced_weights(df: DataFrame, label: str = "label", out: str = "weight") -> DataFrame:
    """n / (classes * n of the row's class)."""
    counts = df.groupBy(label).agg(F.count("*").alias("_n"))
    total = counts.agg(F.sum("_n").alias("_all"), F.count("*").alias("_classes"))
    return df.join(F.broadcast(counts.crossJoin(total)), label).withColumn(out, F.col("_all") / (F.col("_classes") * F.col("_n"))).drop("_n", "_all", "_classes")


def positive_weight(df: DataFrame, label: str = "label") -> DataFrame:
    """pos_weight: negatives for each positive."""
    yes, no = F.count_if(F.col(label) == 1), F.count_if(F.col(label) == 0)
    return df.agg(F.try_divide(no.cast("double"), yes.cast("double")).alias("pos_weight"))


def median_imputed(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Missing values as the column's exact median."""
    return df.withColumns({c: known(c, m) for c, m in zip(columns, medians(df, columns), strict=True)})


def scored(model: Logistic | Boosted, df: DataFrame, threshold: float | None = None) -> DataFrame:
    """df with probability, and prediction (p >= threshold)."""
    out = df.withColumn("probability", model.probability()) if isinstance(model, Logistic) else boosting.with_probability(model, df)
    return out if threshold is None else out.withColumn("prediction", (F.col("probability") >= threshold).cast("int"))


class RecurrentWeights:
    """Cells of (input, state, input bias, state bias) with gates in the order reset, update, candidate; and a head.

    A layer is one cell, or two where the network goes both ways: one over the steps as they are, one over them reversed,
    with the states of both at a step side by side as the next layer's input.
    """

    def __init__(self, cells: Sequence[tuple[np.ndarray, ...]], head: np.ndarray, bias: float):
        self.cells, self.head, self.bias = list(cells), head, bias

    @classmethod
    def random(cls, features: int, hidden: int = 32, depth: int = 2, seed: int = 0, both_ways: bool = False) -> RecurrentWeights:
        rng, cells, size, ways = np.random.default_rng(seed), [], features, 1 + both_ways
        s = hidden**-0.5
        for _ in range(depth):
            for _ in range(ways):
                cells.append(tuple(rng.uniform(-s, s, shape).astype(np.float32) for shape in ((3 * hidden, size), (3 * hidden, hidden), (3 * hidden,), (3 * hidden,))))
            size = hidden * ways
        s = size**-0.5
        return cls(cells, rng.uniform(-s, s, size).astype(np.float32), 0.0)

    @property
    def both_ways(self) -> bool:
        return self.head.size == 2 * self.cells[0][1].shape[1]

    def layers(self) -> list[list[tuple[np.ndarray, ...]]]:
        """The cells of each layer."""
        ways = 1 + self.both_ways
        return [self.cells[i : i + ways] for i in range(0, len(self.cells), ways)]

    def parameters(self) -> int:
        return sum(w.size for cell in self.cells for w in cell) + self.head.size + 1


def cell_states(cell: tuple[np.ndarray, ...], x: np.ndarray) -> np.ndarray:
    """x: (sequences, steps, features). A cell's state after each step."""
    wi, wh, bi, bh = cell
    k = wh.shape[1]
    h, out, taken = np.zeros((len(x), k), np.float32), np.empty((*x.shape[:2], k), np.float32), x @ wi.T + bi
    for t in range(x.shape[1]):
        g, i = h @ wh.T + bh, taken[:, t]
        r, z = (1 / (1 + np.exp(-(i[:, a : a + k] + g[:, a : a + k]))) for a in (0, k))
        n = np.tanh(i[:, 2 * k :] + r * g[:, 2 * k :])
        h = n + z * (h - n)
        out[:, t] = h
    return out


def recurrent_probabilities(weights: RecurrentWeights, x: np.ndarray) -> np.ndarray:
    """x: (sequences, steps, features), all steps a sequence's own. The probability at each step."""
    for layer in weights.layers():
        ways = [cell_states(layer[0], x), *(cell_states(c, x[:, ::-1])[:, ::-1] for c in layer[1:])]
        x = ways[0] if len(ways) == 1 else np.concatenate(ways, 2)
    return 1 / (1 + np.exp(-(x @ weights.head + weights.bias)))


#: Steps that the network goes over at once, of all sequences together; a single sequence may have more.
AT_ONCE = 16_384


def by_steps(x: pa.Array) -> list[tuple[int, np.ndarray]]:
    """(steps, places) of sequences with as many steps; null and empty ones have no place."""
    size = x.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return [(int(n), np.flatnonzero(size == n)) for n in np.unique(size) if n]


def steps_of(x: pa.Array, at: np.ndarray, steps: int) -> np.ndarray:
    """(sequences, steps, features) of those places, straight from Arrow's buffers."""
    inner = x.take(pa.array(at)).flatten()
    width = np.unique(inner.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False))
    if len(width) != 1 or width[0] < 0:
        raise ValueError("all steps must have as many features")
    return inner.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(len(at), steps, int(width[0]))


def recurrent_scores(df: DataFrame, weights: RecurrentWeights, features: str = "features") -> DataFrame:
    """df (a sequence a row, features array<array<float>>) with probabilities array<float>; the weights are broadcast."""
    shared = df.sparkSession.sparkContext.broadcast(weights)

    @F.arrow_udf("array<float>")
    def score(x: pa.Array) -> pa.Array:
        size = x.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(size, dtype=np.int64)
        out = np.empty(int(ends[-1]) if len(ends) else 0, np.float32)
        for n, at in by_steps(x):
            for some in np.array_split(at, -(-len(at) * n // AT_ONCE)):
                if len(some):
                    out[(ends[some] - n)[:, None] + np.arange(n)] = recurrent_probabilities(shared.value, steps_of(x, some, n))
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(out), mask=pa.array(size == 0))

    return df.withColumn("probabilities", score(F.col(features).cast("array<array<float>>")))


#: Assets that the split search takes, which every task holds; and trials of a task.
MOST_ASSETS, TRIALS_A_TASK = 100_000, 500


def trial_order(seed: int, trial: int, assets: int) -> np.ndarray:
    """The permutation of a trial, by its number alone: any task can make any of them."""
    return np.random.default_rng([seed, trial]).permutation(assets)


def trial_cost(order: np.ndarray, rows: np.ndarray, positives: np.ndarray, edges: np.ndarray) -> float:
    """How far splits, cut from the order at edges, are from their share of rows and from the positive share of all; 1000 for each without positives or without negatives."""
    n, yes = (np.diff(np.r_[0, np.cumsum(v[order])][edges]) for v in (rows, positives))
    off = np.abs(n / rows.sum() - np.diff(edges) / len(rows)) + np.abs(yes / np.maximum(n, 1) - positives.sum() / rows.sum())
    return float(off.sum() + 1000 * ((yes == 0) + (yes == n)).sum())


def asset_splits(df: DataFrame, counts: dict[str, int], trials: int = 20000, seed: int = 42) -> DataFrame:
    """asset_id, split: splits of given numbers of assets that are alike in rows and positive share.

    df: asset_id, rows, positives, one row an asset, MOST_ASSETS at most. Trials are dealt to tasks; the least cost wins,
    of equal ones the first trial, as in a plain loop. Assets are in the order of their ids before they are permuted.
    """
    spark = df.sparkSession
    assets = df.select("asset_id", F.col("rows").cast("double").alias("rows"), F.col("positives").cast("double").alias("positives")).orderBy("asset_id").limit(MOST_ASSETS + 1).toArrow()
    if assets.num_rows > MOST_ASSETS:
        raise ValueError(f"the split search takes {MOST_ASSETS} assets at most")
    if sum(counts.values()) != assets.num_rows:
        raise ValueError("counts must add up to the number of assets")
    edges = np.cumsum([0, *counts.values()])
    shared = spark.sparkContext.broadcast(tuple(assets.column(c).to_numpy() for c in ("rows", "positives")))

    def search(batches):
        rows, positives = shared.value
        best = None
        for batch in batches:
            for trial in batch.column("id").to_pylist():
                found = (trial_cost(trial_order(seed, trial, len(rows)), rows, positives, edges), trial)
                best = found if best is None or found < best else best
        if best:
            yield pa.RecordBatch.from_arrays([pa.array([best[0]]), pa.array([best[1]])], names=["cost", "trial"])

    best = spark.range(0, trials, 1, max(1, -(-trials // TRIALS_A_TASK))).mapInArrow(search, "cost double, trial long").agg(F.min(F.struct("cost", "trial")).alias("best")).first()["best"]
    order, names, ids = trial_order(seed, best["trial"], assets.num_rows), list(counts), assets.column("asset_id").to_pylist()
    split = np.repeat(np.arange(len(names)), list(counts.values()))
    return spark.createDataFrame([(ids[i], names[k]) for i, k in zip(order.tolist(), split.tolist(), strict=True)], df.select("asset_id").schema.add("split", "string"))


def numbered_sequences(df: DataFrame, by: str = "split", order: Sequence[str] = ("event_id", "end_s")) -> DataFrame:
    """sequence_idx from 0 in each split, by event and window end."""
    return numbered(df, [by], list(order), "sequence_idx")
