"""Approximate nearest neighbours by balanced posting lists.

Centroids are fitted on a bounded sample by splitting it in two, again and again, each time at the median, so lists are
balanced. A vector goes to the list of its nearest centroid, and, near a boundary, to those of others that are about as
near and that no chosen centroid is nearer to. Centroids are searched by a graph in memory: from an entry, the best
unexpanded nodes of a beam are replaced by their neighbours. A query reads the lists whose centroids are within a ratio
of its nearest one's distance. How large the ratio must be depends on the data, so it is fitted too: a few sampled
vectors are held against the whole table, and the ratio is the one within which nearly all of their neighbours' lists
are. Where vectors have no structure, a ratio that keeps recall leaves many lists to read; where they have, few. Scores
of what is read are exact, in double precision.

Equal vectors are indexed once, with as many of their least ids as a query can use. Lists are dealt in chunks, so no
task grows with a list. Vectors of another dimension than most are a list for each dimension, read by all of its queries.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import settled

#: Vectors of a list, sampled vectors for each list, and sampled numbers at most: with 64 dimensions, 125,000 vectors and 7,812 lists.
LIST, SAMPLE, VALUES = 128, 16, 8_000_000
#: Neighbours of a centroid in the graph, random links besides, the beam's width at least, and nodes expanded at once.
NEAR, FAR, BEAM, EXPAND = 16, 8, 64, 8
#: A vector's copies at most, and how much farther than its nearest centroid a further one may be.
COPIES, BOUNDARY = 4, 1.12
#: Lists read at least, the share of neighbours that the ratio has to cover, and the sampled queries whose neighbours are looked at.
READ_LEAST, COVER, TRIED = 8, 0.97, 256
CHUNK = 4096
#: Candidates whose scores in doubles are so near to the k-th best are scored again with more digits.
NEARLY = 1e-12


@dataclass
class Centroids:
    at: np.ndarray
    links: np.ndarray
    entry: int
    #: The ratio of squared distances, what is added to both so that it is defined at a centroid, and lists read at most.
    ratio: float = 1.0
    scale: float = 0.0
    most: int = BEAM

    def search(self, x: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
        """(ids, squared distances) of the nearest centroids found, nearest first; ids are -1 where there are fewer."""
        count, total = len(x), len(self.at)
        beam = min(beam, total)
        rows = np.arange(count)[:, None]
        seen = np.zeros((count, total), bool)
        ids = np.full((count, beam), -1)
        far = np.full((count, beam), np.inf, np.float32)
        open_ = np.zeros((count, beam), bool)
        ids[:, 0], open_[:, 0], seen[:, self.entry] = self.entry, True, True
        far[:, 0] = ((x - self.at[self.entry]) ** 2).sum(1)
        live, wide = np.arange(count), min(EXPAND, beam)
        while live.size:
            live = live[open_[live].any(1)]
            if not live.size:
                break
            r = np.arange(len(live))[:, None]
            best = np.argpartition(np.where(open_[live], far[live], np.inf), wide - 1, 1)[:, :wide]
            able = open_[live[:, None], best]
            open_[live[:, None], best] = False
            near = np.where(able[:, :, None], self.links[ids[live[:, None], best]], self.entry).reshape(len(live), -1)
            # Of a node that several links lead to, one counts.
            order = np.argsort(near, 1, kind="stable")
            near = near[r, order]
            new = ~seen[live[:, None], near]
            new[:, 1:] &= near[:, 1:] != near[:, :-1]
            seen[live[:, None], near] = True
            d = 2 - 2 * np.matmul(self.at[near], x[live, :, None])[..., 0]
            d[~new] = np.inf
            all_d = np.concatenate([far[live], d], 1)
            pick = np.argpartition(all_d, beam - 1, 1)[:, :beam]
            ids[live] = np.concatenate([ids[live], near], 1)[r, pick]
            open_[live] = np.concatenate([open_[live], new], 1)[r, pick] & np.isfinite(all_d[r, pick])
            far[live] = all_d[r, pick]
        order = np.argsort(far, 1, kind="stable")
        far = far[rows, order]
        return np.where(np.isfinite(far), ids[rows, order], -1), np.maximum(far, 0)


def _halves(x: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Two means, then a split at the median of which is nearer."""
    a, b = x[rng.choice(len(x), 2, replace=False)]
    side = np.zeros(len(x), bool)
    for _ in range(6):
        lean = x @ (b - a)
        order = np.argsort(lean, kind="stable")
        side[:] = False
        side[order[len(x) // 2 :]] = True
        a, b = x[~side].mean(0), x[side].mean(0)
    return np.flatnonzero(~side), np.flatnonzero(side)


def fit(x: np.ndarray, lists: int, seed: int = 5) -> Centroids:
    """x: unit vectors. About `lists` balanced centroids and their graph."""
    rng = np.random.default_rng(seed)
    parts, size = [np.arange(len(x))], max(2, len(x) // max(1, lists))
    done = []
    while parts:
        p = parts.pop()
        if len(p) < 2 * size or len(done) + len(parts) + 1 >= lists:
            done.append(p)
        else:
            one, two = _halves(x[p], rng)
            parts[:0] = [p[one], p[two]]
    at = np.stack([x[p].mean(0) for p in done]).astype(np.float32)
    at /= np.maximum(np.linalg.norm(at, axis=1, keepdims=True), 1e-12)
    n = len(at)
    links = np.zeros((n, min(n, NEAR) + FAR), np.int64)
    for a in range(0, n, 1024):
        like = at[a : a + 1024] @ at.T
        links[a : a + 1024, : min(n, NEAR)] = np.argpartition(-like, min(n, NEAR) - 1, 1)[:, : min(n, NEAR)]
    links[:, min(n, NEAR) :] = rng.integers(0, n, (n, FAR))
    return Centroids(at, links, int((at @ at.mean(0)).argmax()))


def calibrated(c: Centroids, asked: np.ndarray, of: np.ndarray, neighbours: np.ndarray) -> Centroids:
    """c with the ratio within which COVER of the neighbours' lists are. neighbours: unit vectors, of: which of asked each is near to."""
    if not len(neighbours):
        return c
    far = np.maximum(2 - 2 * asked @ c.at.T, 0)
    nearest = far.min(1)
    scale = float(nearest.mean()) + 1e-6
    row, chosen = lists_of_vectors(c, neighbours)
    needed = np.full(len(neighbours), np.inf)
    np.minimum.at(needed, row, (far[of[row], chosen] + scale) / (nearest[of[row]] + scale))
    ratio = float(np.quantile(needed, COVER))
    most = int(((far + scale) <= ratio * (nearest + scale)[:, None]).sum(1).max())
    return replace(c, ratio=ratio, scale=scale, most=max(BEAM, min(len(c.at), most)))


def _tried(asked, k: int):
    """Rows of vec -> a task's k nearest to each of the sampled queries but themselves: query, score, vec."""

    def run(batches):
        y = asked.value
        kept = np.full((len(y), k), -np.inf, np.float32)
        vectors = np.zeros((len(y), k, y.shape[1]))
        for batch in batches:
            if not batch.num_rows:
                continue
            raw = _matrix(batch.column("vec"))
            like = y @ _unit(raw).T
            like[like > 1 - 1e-6] = -np.inf
            for i in np.flatnonzero(like.max(1) > kept[:, -1]):
                score = np.concatenate([kept[i], like[i]])
                pick = np.argsort(-score, kind="stable")[:k]
                kept[i], vectors[i] = score[pick], np.concatenate([vectors[i], raw])[pick] if len(raw) <= 4 * k else np.stack([vectors[i, j] if j < k else raw[j - k] for j in pick])
        row, col = np.nonzero(np.isfinite(kept))
        yield pa.RecordBatch.from_arrays([pa.array(row, pa.int64()), pa.array(kept[row, col].astype(float), pa.float64()), pa.array(list(vectors[row, col]), pa.list_(pa.float64()))], names=["query", "score", "vec"])

    return run


def _calibrated(distinct: DataFrame, c: Centroids, asked: np.ndarray, k: int) -> Centroids:
    """c with its ratio fitted to what the vectors asked have as neighbours among all vectors."""
    shared = distinct.sparkSession.sparkContext.broadcast(asked)
    found = distinct.select("vec").mapInArrow(_tried(shared, k), "query long, score double, vec array<double>")
    best = found.withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec"))).filter(F.col("r") <= k).select("query", "vec")
    best = best.orderBy("query", "vec").toArrow()
    if not best.num_rows:
        return c
    return calibrated(c, asked, best.column("query").to_numpy(), _unit(_matrix(best.column("vec").combine_chunks())))


def _normalized(x: np.ndarray) -> np.ndarray:
    """Unit vectors; the largest component comes to one first, so that no square is infinite or zero."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _unit(x: np.ndarray) -> np.ndarray:
    return _normalized(np.asarray(x, np.float64)).astype(np.float32)


def lists_of_vectors(c: Centroids, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, list) pairs: each vector's nearest list and its further ones."""
    ids, far = c.search(x, 16)
    row, chosen = [], []
    taken = np.zeros((len(x), 0), np.int64)
    for j in range(ids.shape[1]):
        able = (ids[:, j] >= 0) & (far[:, j] <= BOUNDARY**2 * far[:, 0] + 1e-12) & ((taken >= 0).sum(1) < COPIES)
        if taken.shape[1]:
            # A centroid that lies nearer to a chosen one than to the vector adds little.
            between = 2 - 2 * np.einsum("rcd,rd->rc", c.at[taken], c.at[ids[:, j]])
            able &= ~((between < far[:, j, None]) & (taken >= 0)).any(1)
        taken = np.concatenate([taken, np.where(able, ids[:, j], -1)[:, None]], 1)
        row.append(np.flatnonzero(able))
        chosen.append(ids[able, j])
    return np.concatenate(row), np.concatenate(chosen)


def lists_of_queries(c: Centroids, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, list) pairs that queries read."""
    ids, far = c.search(x, c.most)
    read = (ids >= 0) & ((far + c.scale <= c.ratio * (far[:, :1] + c.scale)) | (np.arange(ids.shape[1]) < READ_LEAST))
    row, col = np.nonzero(read)
    return row, ids[row, col]


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _dealt(broadcast, deal):
    def run(batches):
        c = broadcast.value
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                row, chosen = deal(c, _unit(_matrix(part.column("vec"))))
                at = pa.array(row, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(chosen, pa.int64()), *(col.take(at) for col in part.columns)], names=["list", *part.schema.names])

    return run


def exact_cosines(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The cosines of q and the rows of x, worked out with more digits than a double has and then rounded to one, so that parallel vectors have the same."""
    scaled = lambda v: v.astype(np.longdouble) / np.abs(v).max(-1, keepdims=True)
    q, x = scaled(q), scaled(x)
    return np.clip(((x * q).sum(1) / np.sqrt((x * x).sum(1) * (q * q).sum())).astype(np.float64), -1.0, 1.0)


def _scored(k: int):
    """From rows sorted by list and chunk, candidates before queries: each query's best candidates there."""

    def best(q: pa.RecordBatch, ids: list, plain: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
        asked = _matrix(q.column("vec"))
        score = _normalized(asked) @ x.T
        least = np.array([i[0] for i in ids])
        own = q.column("key").to_pylist()
        out = {"query": [], "score": [], "ids": []}
        for i, s in enumerate(score):
            some = np.arange(len(s))
            if len(s) > k:
                some = np.flatnonzero(s >= np.partition(s, len(s) - k)[len(s) - k] - NEARLY)
            exact = exact_cosines(asked[i], plain[some])
            for j in np.lexsort((least[some], -exact))[:k].tolist():
                out["query"].append(own[i])
                out["score"].append(float(exact[j]))
                out["ids"].append(ids[some[j]])
        return pa.RecordBatch.from_arrays([pa.array(out["query"], pa.int64()), pa.array(out["score"], pa.float64()), pa.array(out["ids"], pa.list_(pa.int64()))], names=list(out))

    def run(batches: Iterator[pa.RecordBatch]):
        last, ids, rows, plain, x = None, [], [], None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            col = [batch.column(c).to_numpy() for c in ("list", "chunk", "role")]
            edge = [0, *(np.flatnonzero(np.any([c[1:] != c[:-1] for c in col], axis=0)) + 1).tolist(), batch.num_rows]
            for a, b in zip(edge, edge[1:], strict=False):
                now, part = (col[0][a], col[1][a]), batch.slice(a, b - a)
                if now != last:
                    last, ids, rows, x = now, [], [], None
                if not col[2][a]:
                    ids += part.column("ids").to_pylist()
                    rows.append(_matrix(part.column("vec")))
                elif rows:
                    if x is None:
                        plain = np.concatenate(rows)
                        x = _normalized(plain)
                    yield best(part, ids, plain, x)

    return run


def usable(table: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """(vec_id, vec, size) of vectors that take part: finite and not zero."""
    v = F.col(vector).cast("array<double>")
    rows = table.select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("vec")).filter("vec_id is not null and vec is not null")
    rows = rows.filter(F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0))
    return rows.withColumn("size", F.size("vec"))


def nearest(table: DataFrame, queries: str = "vec_id % 50 = 0", k: int = 5, vec_id: str = "vec_id", vector: str = "embedding", list_size: int = LIST) -> DataFrame:
    """Per query and rank: query_id, rank, vec_id, score: the k nearest found by cosine, ties to smaller ids.

    queries is a condition on vec_id. Candidates are all rows with another id than the query's and of its dimension. Null
    ids and vectors, zero ones and ones with a null or non-finite component take no part. Vectors of another dimension
    than most are compared with all of theirs. Rows repeated with id and vector count once. An empty table gives no rows;
    fewer than k candidates are all given. Scores are the cosines to a double's last digits, and those of parallel vectors are the same. An
    id with several vectors is asked with each of them and gets one list, of the best over all. Vectors of any
    length fit; the centroids' sample has about VALUES numbers, and what is broadcast a SAMPLE-th of them. Other columns
    aren't read, whatever their names.
    """
    spark = table.sparkSession
    rows = usable(table, vec_id, vector)
    top = rows.groupBy("size").count().orderBy(F.desc("count"), "size").first()
    if not top:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rank = F.dense_rank().over(Window.partitionBy("vec").orderBy("vec_id"))
    distinct = settled(rows.withColumn("r", rank).filter(F.col("r") <= k + 1).groupBy("vec").agg(F.sort_array(F.collect_set("vec_id")).alias("ids")))
    usual = F.size("vec") == top["size"]
    count = distinct.filter(usual).count()
    lists = int(max(1, min(count // list_size, VALUES // (SAMPLE * top["size"]))))
    # About SAMPLE vectors a list, and no fewer than some, by hash; of the others, about TRIED to fit the ratio with.
    share = max(lists * SAMPLE, 64) / count
    place = F.xxhash64("vec", F.lit("sample")) / F.lit(2.0**64) + 0.5
    some = distinct.filter(usual & (place < share + TRIED / count)).select("vec", (place < share).alias("fit")).orderBy("vec").toArrow()
    if not some.num_rows:
        some = distinct.filter(usual).limit(1).select("vec", F.lit(True).alias("fit")).toArrow()
    sample, fits = _unit(_matrix(some.column("vec").combine_chunks())), some.column("fit").to_numpy()
    fits = fits if fits.any() else ~fits
    asked = sample[~fits] if not fits.all() else sample[:TRIED]
    centroids = fit(sample[fits], lists)
    centroids = spark.sparkContext.broadcast(_calibrated(distinct.filter(usual), centroids, asked[:TRIED], k))
    own = (-F.size("vec")).cast("long").alias("list")

    postings = distinct.filter(usual).mapInArrow(_dealt(centroids, lists_of_vectors), "list long, vec array<double>, ids array<long>")
    postings = settled(postings.union(distinct.filter(~usual).select(own, "vec", "ids")))
    # A row for each list and rarer dimension.
    chunks = postings.groupBy("list").agg(F.ceil(F.count("*") / CHUNK).alias("chunks"))
    asked = rows.filter(F.expr(queries)).select("vec_id", "vec")
    keys = settled(asked.groupBy("vec").agg(F.min("vec_id").alias("key")))
    reads = keys.filter(usual).mapInArrow(_dealt(centroids, lists_of_queries), "list long, vec array<double>, key long")
    reads = reads.union(keys.filter(~usual).select(own, "vec", "key"))
    nothing = F.lit(None)
    left = postings.join(F.broadcast(chunks), "list").select("list", F.pmod(F.xxhash64("vec"), "chunks").alias("chunk"), F.lit(0).alias("role"), nothing.cast("long").alias("key"), "ids", "vec")
    right = reads.join(F.broadcast(chunks), "list").select(
        "list", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk"), F.lit(1).alias("role"), "key", nothing.cast("array<long>").alias("ids"), "vec"
    )
    both = left.union(right).repartition("list", "chunk").sortWithinPartitions("list", "chunk", "role")
    found = both.mapInArrow(_scored(k + 1), "query long, score double, ids array<long>")
    found = found.select("query", "score", F.explode("ids").alias("id")).groupBy("query", "id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    found = settled(found.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k + 1).select(F.col("query").alias("key"), "id", "score"))
    # Back from different query vectors to all queries.
    per = asked.join(keys, "vec").select(F.col("vec_id").alias("query_id"), "key").distinct()
    answers = found.groupBy("key").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "id"))).alias("all"))
    kept = F.slice(F.filter("all", lambda x: x["id"] != F.col("query_id")), 1, k)
    return per.join(answers, "key").select("query_id", F.posexplode(kept).alias("pos", "x")).select("query_id", (F.col("pos") + 1).alias("rank"), F.col("x.id").alias("vec_id"), (-F.col("x.s")).alias("score"))
