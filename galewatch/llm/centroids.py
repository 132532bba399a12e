"""Clustering of vectors around centroids, in whole numbers, with block-norm screening.

A component x is the integer floor(scale * x), so sums, means and squared distances are exact, whatever the order of rows.
Of each vector the norms of its segments are kept beside it: by the Cauchy-Schwarz inequality the product of two segments
is at most that of their norms, so the sum of squared differences of norms is a lower bound of the squared distance. A
vector's centroids are tried in the order of their bounds, and only while a bound isn't above the least distance found.

A round is one job: tasks sum up their own vectors by centroid, and a row a centroid and component comes to the driver.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settled, unused

#: Components of a segment; and the size of an integer component that keeps squared distances within 64 bits.
SEGMENT, MOST = 8, 2**27
#: Centroids at most, as all are in the memory of every task, with components of this number of dimensions at most.
MOST_CENTROIDS, MOST_DIMENSIONS = 4096, 64
#: Bounds are lowered by so much of the norms' squares, which is more than doubles lose.
SLACK = 1e-9


@dataclass
class Clustering:
    #: vec_id, cluster, distance, tried (centroids that got an exact distance).
    rows: DataFrame
    centroids: np.ndarray


def integers(table: DataFrame, dimensions: int, scale: int, segment: int, vec_id: str, vector: str) -> DataFrame:
    """vec_id, q, norms of the vectors that take part."""
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    rows = table.select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("v")).filter(F.col("v").isNotNull() & (F.size("v") == dimensions))
    rows = rows.filter(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    whole = lambda x: F.when(F.abs(x * scale) < MOST, F.floor(x * scale)).otherwise(F.raise_error(F.lit("a component is too large for exact distances")).cast("long"))
    rows = rows.select("vec_id", F.transform("v", whole).alias("q"))
    norm = lambda a: F.sqrt(F.aggregate(F.slice("q", a + 1, F.lit(segment)), F.lit(0).cast("long"), lambda s, x: s + x * x).cast("double"))
    return rows.withColumn("norms", F.array(*(norm(F.lit(a)) for a in range(0, dimensions, segment))))


def segment_norms(c: np.ndarray, segment: int) -> np.ndarray:
    return np.stack([np.sqrt((c[:, a : a + segment] ** 2).sum(1).astype(float)) for a in range(0, c.shape[1], segment)], 1)


def nearest(q: np.ndarray, norms: np.ndarray, c: np.ndarray, c_norms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cluster, squared distance, distances computed) of each row of q; ties to smaller numbers."""
    one, two = (norms**2).sum(1)[:, None], (c_norms**2).sum(1)[None]
    low = one + two - 2 * norms @ c_norms.T - SLACK * (one + two)
    order = np.argsort(low, 1, kind="stable")
    best, which, tried = np.full(len(q), np.iinfo(np.int64).max), np.full(len(q), len(c)), np.zeros(len(q), np.int64)
    live = np.arange(len(q))
    for j in range(len(c)):
        at = order[live, j]
        # Bounds ascend: a row whose bound is above its best is done.
        open_ = low[live, at] <= best[live].astype(float)
        live, at = live[open_], at[open_]
        if not live.size:
            break
        diff = q[live] - c[at]
        d = np.einsum("ij,ij->i", diff, diff)
        tried[live] += 1
        better = (d < best[live]) | ((d == best[live]) & (at < which[live]))
        best[live[better]], which[live[better]] = d[better], at[better]
    return which, best, tried


def _columns(batch: pa.RecordBatch, dimensions: int) -> tuple[np.ndarray, np.ndarray]:
    return batch.column("q").flatten().to_numpy().reshape(-1, dimensions), batch.column("norms").flatten().to_numpy().reshape(batch.num_rows, -1)


def _sums(shared, dimensions: int):
    """A task's vectors -> cluster, n, sums: a row a centroid that has some."""

    def run(batches):
        c, c_norms = shared.value
        n, sums = np.zeros(len(c), np.int64), np.zeros(c.shape, np.int64)
        for batch in batches:
            if batch.num_rows:
                q, norms = _columns(batch, dimensions)
                which, _, _ = nearest(q, norms, c, c_norms)
                n += np.bincount(which, minlength=len(c))
                order = np.argsort(which, kind="stable")
                found, first = np.unique(which[order], return_index=True)
                sums[found] += np.add.reduceat(q[order], first, axis=0)
        some = np.flatnonzero(n)
        if some.size:
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(n[some]), pa.array(list(sums[some]), pa.list_(pa.int64()))], names=["cluster", "n", "sums"])

    return run


def _assigned(shared, dimensions: int):
    def run(batches):
        c, c_norms = shared.value
        for batch in batches:
            if batch.num_rows:
                which, best, tried = nearest(*_columns(batch, dimensions), c, c_norms)
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(which.astype(np.int32)), pa.array(best), pa.array(tried.astype(np.int32))], names=["vec_id", "cluster", "distance", "tried"])

    return run


def clustered(table: DataFrame, k: int = 8, rounds: int = 10, dimensions: int = 64, scale: int = 1024, seed: int = 3, segment: int = SEGMENT, vec_id: str = "vec_id", vector: str = "embedding") -> Clustering:
    """Each vector's cluster after `rounds` of assigning and averaging, and the centroids.

    Vectors that are null, of another number of dimensions, or with a null or non-finite component take no part. The first
    centroids are the k vectors whose ids have the smallest SHA-256 of `seed:id`; fewer vectors are fewer centroids.
    Repeated rows are vectors each; of one id's, the lesser components are first. A null id is hashed as an empty text, and
    stays. An empty table has no rows and no centroids. Other columns aren't read. A component of MOST / scale or more in
    size is an error, as a squared distance would not fit into 64 bits.
    """
    if not 0 < k <= MOST_CENTROIDS or not 0 < dimensions <= MOST_DIMENSIONS:
        raise ValueError(f"k may be {MOST_CENTROIDS} at most, and dimensions {MOST_DIMENSIONS}")
    spark = table.sparkSession
    rows = settled(integers(table, dimensions, scale, segment, vec_id, vector))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = rows.select(digest.alias("h"), "q").orderBy("h", "q").limit(k).collect()
    c = np.array([r["q"] for r in first], np.int64).reshape(-1, dimensions)
    if not len(c):
        return Clustering(spark.createDataFrame([], "vec_id long, cluster int, distance long, tried int"), c)
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast((c, segment_norms(c, segment)))
        sums = rows.select("q", "norms").mapInArrow(_sums(shared, dimensions), "cluster int, n long, sums array<long>")
        wide = F.col("x").cast("decimal(38,0)")
        found = sums.select("cluster", "n", F.posexplode("sums").alias("i", "x")).groupBy("cluster", "i").agg(F.sum(wide).alias("x"), F.sum("n").alias("n"))
        c = c.copy()
        for r in found.collect():
            c[r["cluster"], r["i"]] = int(r["x"]) // r["n"]
        shared.unpersist()
    shared = spark.sparkContext.broadcast((c, segment_norms(c, segment)))
    return Clustering(settled(rows.mapInArrow(_assigned(shared, dimensions), "vec_id long, cluster int, distance long, tried int")), c)


def with_inertia(found: Clustering) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256; a row a cluster is looked up in the plan."""
    sums = {r["cluster"]: r["d"] for r in found.rows.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}
    rows = [(i, sums[i], sum(sums.values()), hashlib.sha256(",".join(map(str, found.centroids[i].tolist())).encode()).hexdigest()) for i in sorted(sums)]
    key = unused("_of", found.rows)
    per = found.rows.sparkSession.createDataFrame(rows, f"{key} int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.rows.join(F.broadcast(per), F.col("cluster") == F.col(key)).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def oracle(k: int = 8, rounds: int = 10, dimensions: int = 64, scale: int = 1024, seed: int = 3) -> str:
    """The same as SQL over embeddings: rounds are unrolled."""
    far = lambda c: f"SELECT vec_id, arg_min(struct_pack(k := k, d := d), d * {MOST_CENTROIDS} + k) AS b FROM (SELECT v.vec_id, {c}.k, sum((v.x - {c}.x) * (v.x - {c}.x))::BIGINT AS d FROM v JOIN {c} ON v.i = {c}.i GROUP BY 1, 2) GROUP BY 1"
    steps = []
    for r, now in enumerate(range(1, rounds + 1)):
        steps.append(f"a{r} AS MATERIALIZED ({far(f'c{r}')})")
        mean = "CASE WHEN s >= 0 THEN s // n ELSE -((-s + n - 1) // n) END"
        steps.append(f"m{r} AS (SELECT k, i, {mean} AS x FROM (SELECT a.b.k AS k, v.i, sum(v.x)::BIGINT AS s, count(*) AS n FROM a{r} a JOIN v ON a.vec_id = v.vec_id GROUP BY 1, 2))")
        steps.append(f"c{now} AS MATERIALIZED (SELECT c.k, c.i, coalesce(m.x, c.x) AS x FROM c{r} c LEFT JOIN m{r} m ON c.k = m.k AND c.i = m.i)")
    return f"""
WITH kept AS (SELECT vec_id, embedding FROM embeddings WHERE len(embedding) = {dimensions} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
v AS MATERIALIZED (SELECT vec_id, t.i, floor({scale} * embedding[t.i]::DOUBLE)::BIGINT AS x FROM kept, range(1, {dimensions + 1}) t(i)),
f AS (SELECT vec_id, row_number() OVER (ORDER BY sha256('{seed}:' || vec_id)) - 1 AS k FROM kept),
c0 AS MATERIALIZED (SELECT k, i, x FROM f JOIN v ON f.vec_id = v.vec_id WHERE k < {k}),
{", ".join(steps)},
fin AS MATERIALIZED (SELECT vec_id, b.k AS k, b.d AS d FROM ({far(f'c{rounds}')})),
h AS (SELECT k, sha256(string_agg(x::VARCHAR, ',' ORDER BY i)) AS h FROM c{rounds} GROUP BY k)
SELECT vec_id, fin.k::INTEGER AS cluster, d AS distance, sum(d) OVER (PARTITION BY fin.k)::BIGINT AS cluster_inertia, sum(d) OVER ()::BIGINT AS inertia, h.h AS centroid_sha256 FROM fin JOIN h ON fin.k = h.k"""
