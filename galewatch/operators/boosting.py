"""Histogram gradient boosting of trees, grown best first.

Features are binned once, by exact quantiles. A pass sums gradients and Hessians of the rows in each open node by feature
and bin, on executors; the node's best split follows from its histograms. Trees grow where the loss falls most, up to a
number of leaves. Missing values are a bin of their own, of which a split learns the side.

Gradients are whole multiples of a small unit, so histograms are sums of integers: the model is the same, however rows are
dealt and in whatever order tasks end or are run again. A pass looks at all nodes that the tree may open next, so a tree
takes about as many passes as it is deep, not one for each leaf.
"""

from __future__ import annotations

import json
import pickle
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import require_positive
from ..sources.files import shared_folder
from .logistic import class_weights
from .ordered import quantile_arrays

#: Bins of a feature's values; one more is for missing ones.
BINS = 255
#: Gradients are multiples of 1 / UNIT; sums of 2^63 / UNIT rows and more would not fit.
UNIT = 2**26
#: Trees that are applied anew in each pass, at most, before rows are written with their sums.
RECENT = 16
#: Bytes of histograms that come to the driver as tasks give them; beyond, they are summed and judged on executors.
DIRECT = 64_000_000
#: Rows of a block.
BLOCK = 100_000
LEAST_HESSIAN = 1e-3


@dataclass
class Tree:
    """Nodes by number; a leaf has no feature (-1). Bins up to `at` go left, missing ones where `missing_left` says."""

    feature: list[int] = field(default_factory=lambda: [-1])
    at: list[int] = field(default_factory=lambda: [0])
    missing_left: list[bool] = field(default_factory=lambda: [False])
    left: list[int] = field(default_factory=lambda: [-1])
    right: list[int] = field(default_factory=lambda: [-1])
    value: list[float] = field(default_factory=lambda: [0.0])

    def add(self) -> int:
        for name, nothing in (("feature", -1), ("at", 0), ("missing_left", False), ("left", -1), ("right", -1), ("value", 0.0)):
            getattr(self, name).append(nothing)
        return len(self.feature) - 1

    def leaves(self, bins: np.ndarray) -> np.ndarray:
        """The leaf of each row of bins (rows, features)."""
        feature, at, missing, left, right = (np.array(getattr(self, n)) for n in ("feature", "at", "missing_left", "left", "right"))
        node = np.zeros(len(bins), np.int64)
        live = np.arange(len(bins)) if feature[0] >= 0 else np.zeros(0, np.int64)
        while live.size:
            n = node[live]
            b = bins[live, feature[n]]
            goes = np.where(b == BINS, missing[n], b <= at[n])
            node[live] = np.where(goes, left[n], right[n])
            live = live[feature[node[live]] >= 0]
        return node


@dataclass
class Boosted:
    columns: list[str]
    #: Of each feature, the largest values of its bins but the last.
    edges: list[list[float]]
    base: float
    trees: list[Tree] = field(default_factory=list)

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.where(np.isnan(v), BINS, np.searchsorted(np.array(e), v, "left")).astype(np.uint8) for v, e in zip(x.T, self.edges, strict=True)])

    def raw(self, bins: np.ndarray) -> np.ndarray:
        out = np.full(len(bins), self.base)
        for t in self.trees:
            out += np.array(t.value)[t.leaves(bins)]
        return out

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.raw(self.binned(x))))

    def dumps(self) -> str:
        return json.dumps({"columns": self.columns, "edges": self.edges, "base": self.base, "trees": [vars(t) for t in self.trees]})

    @classmethod
    def loads(cls, text: str) -> Boosted:
        d = json.loads(text)
        return cls(d["columns"], d["edges"], d["base"], [Tree(**t) for t in d["trees"]])


def edges_of(df: DataFrame, columns: Sequence[str]) -> list[list[float]]:
    """Each column's quantiles at whole shares of BINS, once each; nulls and NaN don't count."""
    pairs = F.inline(F.array(*(F.struct(F.lit(i).alias("i"), F.col(c).cast("double").alias("x")) for i, c in enumerate(columns))))
    long = df.select(pairs).filter("x is not null and not isnan(x)")
    found = {r["i"]: r["q"] for r in quantile_arrays(long, ["i"], "x", [j / BINS for j in range(1, BINS)]).collect()}
    return [np.unique(found.get(i, [])).tolist() for i in range(len(columns))]


def _matrix(batch: pa.RecordBatch, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column("bins").to_pylist()), np.uint8).reshape(-1, width)


def _binned(model: Boosted, weights: dict[int, float]):
    """Rows (y, x) -> y, w, raw, bins (a byte a feature)."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1).astype(float)
                y = batch.column("y").to_numpy()
                bins = model.binned(x)
                yield pa.RecordBatch.from_arrays([pa.array(y), pa.array(np.where(y == 1, weights[1], weights[0])), pa.array(np.full(len(y), model.base)), pa.array([r.tobytes() for r in bins], pa.binary())], names=["y", "w", "raw", "bins"])

    return run


ROWS = "y int, w double, raw double, bins binary"


def _summed(trees: Sequence[Tree], width: int):
    """Rows with trees' values added to raw."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                bins, raw = _matrix(batch, width), batch.column("raw").to_numpy().copy()
                for t in trees:
                    raw += np.array(t.value)[t.leaves(bins)]
                yield pa.RecordBatch.from_arrays([batch.column("y"), batch.column("w"), pa.array(raw), batch.column("bins")], names=["y", "w", "raw", "bins"])

    return run


def _held(rows: DataFrame, width: int) -> RDD:
    """rows as pickled blocks (w, y, raw, bins) that stay with the executors, so that a pass is one small job; a lost one is read again from the table."""

    def run(batches):
        many = 0
        held: list[tuple] = []
        for batch in batches:
            if batch.num_rows:
                held.append((batch.column("w").to_numpy(), batch.column("y").to_numpy(), batch.column("raw").to_numpy(), _matrix(batch, width)))
                many += batch.num_rows
            if many >= BLOCK:
                yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps([np.concatenate(x) for x in zip(*held, strict=True)])], pa.binary())], names=["block"])
                held, many = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps([np.concatenate(x) for x in zip(*held, strict=True)])], pa.binary())], names=["block"])

    return rows.mapInArrow(run, "block binary").rdd.map(lambda r: bytes(r[0])).persist(StorageLevel.MEMORY_AND_DISK)


def _histograms(trees: Sequence[Tree], growing: Tree, wanted: Sequence[int], width: int):
    """A task's blocks -> node, feature, and histograms of g, h and rows of the wanted leaves of the growing tree."""
    many = BINS + 1

    def run(blocks):
        slot = np.full(len(growing.feature), -1)
        slot[list(wanted)] = np.arange(len(wanted))
        size = len(wanted) * many
        sums = np.zeros((3, width, size), np.int64)
        for block in blocks:
            w, y, raw, bins = pickle.loads(block)
            raw = raw.copy()
            for t in trees:
                raw += np.array(t.value)[t.leaves(bins)]
            own = slot[growing.leaves(bins)]
            keep = own >= 0
            y, w, p = y[keep], w[keep], 1 / (1 + np.exp(-raw[keep]))
            g, h = np.rint((p - y) * w * UNIT), np.rint(p * (1 - p) * w * UNIT)
            base = own[keep] * many
            for f in range(width):
                at = base + bins[keep, f]
                # Whole numbers below 2^53 in a block: doubles add them exactly.
                for k, v in enumerate((g, h, None)):
                    sums[k, f] += np.bincount(at, v, size).astype(np.int64)
        g, h, n = sums.reshape(3, width, len(wanted), many)
        for i, node in enumerate(wanted):
            for f in range(width):
                if n[f, i].any():
                    yield node, f, g[f, i], h[f, i], n[f, i]

    return run


def best_split(g: np.ndarray, h: np.ndarray, n: np.ndarray, least: int, l2: float) -> tuple | None:
    """(gain, at, missing_left, left sums of g, h, n) of the best split of one node by one feature, the first of equal ones; None where no split is allowed or gains."""
    whole = [int(v.sum()) for v in (g, h, n)]
    score = lambda a, b: (a / UNIT) ** 2 / (b / UNIT + l2)
    found = None
    for missing_left in (False, True):
        if missing_left and not n[BINS]:
            continue
        left = [np.cumsum(v[:BINS]) + (v[BINS] if missing_left else 0) for v in (g, h, n)]
        right = [a - b for a, b in zip(whole, left, strict=True)]
        able = (left[2] >= least) & (right[2] >= least) & (left[1] >= LEAST_HESSIAN * UNIT) & (right[1] >= LEAST_HESSIAN * UNIT)
        if not able.any():
            continue
        gain = np.where(able, score(left[0].astype(float), left[1].astype(float)) + score(right[0].astype(float), right[1].astype(float)) - score(float(whole[0]), float(whole[1])), -np.inf)
        at = int(gain.argmax())
        if gain[at] > 0 and (found is None or gain[at] > found[0]):
            # Where none is missing, a missing value goes with the more.
            side = missing_left if n[BINS] else bool(left[2][at] > right[2][at])
            found = (float(gain[at]), at, side, *(int(v[at]) for v in left))
    return found


def _judged(rows: Iterable[tuple], least: int, l2: float) -> list[tuple]:
    """Histograms of (node, feature), in any order and several pieces each -> (node, feature, gain, at, missing_left, left sums of g, h, n, sums of g, h, n) of each; without a split the gain is 0."""
    met: dict[tuple[int, int], np.ndarray] = {}
    for node, feature, *sums in rows:
        own = np.array(sums)
        met[node, feature] = met[node, feature] + own if (node, feature) in met else own
    out = []
    for (node, feature), (g, h, n) in sorted(met.items()):
        found = best_split(g, h, n, least, l2) or (0.0, 0, False, 0, 0, 0)
        out.append((node, feature, *found, int(g.sum()), int(h.sum()), int(n.sum())))
    return out


def _pass(held: RDD, recent: Sequence[Tree], growing: Tree, wanted: Sequence[int], width: int, least: int, l2: float) -> dict[int, list[tuple]]:
    """The splits of each wanted node, by feature."""
    found = held.mapPartitions(_histograms(recent, growing, wanted, width))
    if held.getNumPartitions() * len(wanted) * width * (BINS + 1) * 24 <= DIRECT:
        splits = _judged(found.collect(), least, l2)
    else:
        sums = found.map(lambda r: (r[:2], np.array(r[2:]))).reduceByKey(np.add)
        splits = sums.mapPartitions(lambda rows: _judged(((*k, *v) for k, v in rows), least, l2)).collect()
    out: dict[int, list[tuple]] = {}
    for s in sorted(splits):
        out.setdefault(s[0], []).append(s)
    return out


def _best(splits: Sequence[tuple]) -> tuple | None:
    """The split with the most gain, of the first such feature."""
    top = max(splits, key=lambda s: (s[2], -s[1]))
    return top if top[2] > 0 else None


def grow(ask, leaves: int, least: int, l2: float, rate: float) -> Tree | None:
    """A tree, grown best first. ask(tree, nodes) gives each node's splits (as _judged), none for one without rows.

    `known` has nodes' best splits, None where there is none. Those that may be opened next are put below their parents ahead of
    time, so that one question is about all of them.
    """
    ahead, known, sums = Tree(), {}, {}

    def learn(nodes: list[int]) -> None:
        found = ask(ahead, nodes)
        for n in nodes:
            if found.get(n):
                sums[n], known[n] = found[n][0][8:], _best(found[n])

    learn([0])
    if 0 not in known:
        return None
    open_, split = [0], {}
    while len(open_) < leaves:
        unknown = [n for n in open_ if n not in known]
        if unknown:
            # Below every open node whose split is known, too: they are likely to be asked for next.
            for n in [n for n in open_ if known.get(n)]:
                unknown += _below(ahead, known, sums, n, least)
            learn(sorted(set(unknown)))
            continue
        able = [n for n in open_ if known[n]]
        if not able:
            break
        n = max(able, key=lambda n: (known[n][2], -n))
        _below(ahead, known, sums, n, least)
        split[n] = (ahead.left[n], ahead.right[n])
        open_.remove(n)
        open_ += split[n]
    for n in open_:
        g, h, _ = sums[n]
        ahead.value[n] = -rate * (g / UNIT) / (h / UNIT + l2)
    return _pruned(ahead, split)


def _below(ahead: Tree, known: dict, sums: dict, n: int, least: int) -> list[int]:
    """Put a known node's children below it, with their sums; those whose split must be asked for. One too small to be split needn't be."""
    if ahead.feature[n] < 0:
        (g, h, count), (_, feature, _, at, side, left_g, left_h, left_n, *_) = sums[n], known[n]
        left, right = ahead.add(), ahead.add()
        ahead.feature[n], ahead.at[n], ahead.missing_left[n], ahead.left[n], ahead.right[n] = feature, at, side, left, right
        sums[left], sums[right] = (left_g, left_h, left_n), (g - left_g, h - left_h, count - left_n)
        for child in (left, right):
            if sums[child][2] < 2 * least:
                known[child] = None
    return [c for c in (ahead.left[n], ahead.right[n]) if c not in known]


def _pruned(ahead: Tree, split: dict[int, tuple[int, int]]) -> Tree:
    """The tree of nodes that were opened, numbered from the root."""
    out, todo = Tree(), [(0, 0)]
    while todo:
        old, new = todo.pop()
        if old in split:
            out.feature[new], out.at[new], out.missing_left[new] = ahead.feature[old], ahead.at[old], ahead.missing_left[old]
            out.left[new], out.right[new] = out.add(), out.add()
            todo += [(split[old][1], out.right[new]), (split[old][0], out.left[new])]
        else:
            out.value[new] = ahead.value[old]
    return out


def fit(df: DataFrame, columns: Sequence[str], label: str = "label", rounds: int = 250, rate: float = 0.05, leaves: int = 31, least: int = 20, l2: float = 1.0) -> Boosted:
    """Boosted trees for labels 0 and 1 of equal weight as classes; rows without a label don't count."""
    for name, value in (("rounds", rounds), ("rate", rate), ("leaves", leaves), ("least", least)):
        require_positive(value, name)
    columns, spark = list(columns), df.sparkSession
    df = df.filter(F.col(label).isNotNull())
    weights = class_weights(df, label)
    model = Boosted(columns, edges_of(df, columns), 0.0)  # balanced classes: even odds
    values = df.select(F.col(label).cast("int").alias("y"), F.array(*(F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))) for c in columns)).alias("x"))
    rows, path = _written(values.mapInArrow(_binned(model, weights), ROWS), None)
    held, recent = _held(rows, len(columns)), []
    for _ in range(rounds):
        tree = grow(lambda t, nodes: _pass(held, recent, t, nodes, len(columns), least, l2), leaves, least, l2, rate)  # noqa: B023
        if tree is None:
            break
        model.trees.append(tree)
        recent.append(tree)
        if len(recent) == RECENT:
            held.unpersist()
            rows, path = _written(rows.mapInArrow(_summed(recent, len(columns)), ROWS), path)
            held, recent = _held(rows, len(columns)), []
    held.unpersist()
    _delete(spark, path)
    return model


def _written(df: DataFrame, last: str | None) -> tuple[DataFrame, str]:
    """df as a table, after which the last one goes."""
    spark = df.sparkSession
    path = shared_folder(spark)
    df.write.option("compression", "zstd").parquet(path)
    if last:
        _delete(spark, last)
    return spark.read.schema(ROWS).parquet(path), path


def _delete(spark, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def with_probability(model: Boosted, df: DataFrame, out: str = "probability") -> DataFrame:
    """df with the model's probability, in Arrow batches; missing values go where their splits say."""

    @F.pandas_udf("double")
    def score(*x: pd.Series) -> pd.Series:
        return pd.Series(model.probabilities(np.column_stack([v.to_numpy(float) for v in x])))

    return df.withColumn(out, score(*(F.col(c).cast("double") for c in model.columns)))
