"""Approximate nearest neighbours by learned partitions.

A bounded sample of the vectors gives a neighbour graph, which is cut into balanced partitions of few crossing edges.
A small classifier (softmax over the normalised vector and one hidden layer) learns which partitions a vector's graph
neighbours lie in. Every vector of the table is indexed in its most probable partition; a query searches its most
probable partitions and reranks their vectors by exact cosine. How many partitions a query probes is measured on the
sample: the fewest that reach ``aim`` recall there. Recall depends on the data: vectors without clusters need many.

The number of partitions grows with the counted rows, as far as the sample bears it. A partition is searched in chunks of
vectors: every vector is sent once (once for each ``queries`` queries of its partition), queries go to the chunks and stream past
them, so that a frequent vector makes no task larger and memory holds one chunk.

Vectors that are null, zero, or hold null or non-finite components take no part. Vectors of different dimension are not
compared: each dimension is searched by itself. Vectors with a null id are ignored; of repeated rows of one id the smallest
vector holds; an empty table gives an empty result. Ties go to the smaller id. Scores are cosines in double precision of the
original vectors, scaled by powers of two, so that no component is too large or too small to be squared.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .frames import buckets, small_batches, written


@dataclass(frozen=True)
class Settings:
    """``sample`` rows are fitted on the driver, up to ``sample_most`` where the table needs more ``partitions`` than that for about ``rows`` rows each;
    ``chunk`` vectors and ``queries`` queries at most meet in one task's group."""

    k: int = 5
    sample: int = 6000
    sample_most: int = 24_000
    partitions: int = 16
    rows: int = 32_768
    graph: int = 10
    hidden: int = 64
    epochs: int = 30
    aim: float = 0.97
    chunk: int = 8192
    queries: int = 32_768
    seed: int = 5


def usable(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, v) with v as array<double>, without vectors that take no part."""
    v = vectors.select(vectors[key].cast("long").alias("id"), vectors[vector].cast("array<double>").alias("v")).where("id IS NOT NULL AND v IS NOT NULL AND size(v) > 0")
    finite = F.forall("v", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))
    return v.where(finite & F.exists("v", lambda x: x != 0)).groupBy("id").agg(F.min("v").alias("v"))


def matrix(column) -> np.ndarray:
    """Rows scaled by a power of two to components under 1: cosines stay the same, to the last bit."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(flat)
    if not n:
        return np.zeros((0, 0))
    x = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def graph_of(x: np.ndarray, k: int) -> np.ndarray:
    """The k nearest neighbours of every row."""
    out = np.zeros((len(x), k), dtype=np.int64)
    for a in range(0, len(x), 512):
        near = (x[a : a + 512] @ x.T).astype(np.float32)
        near[np.arange(len(near)), np.arange(a, a + len(near))] = -2
        out[a : a + 512] = np.argpartition(-near, k - 1, axis=1)[:, :k]
    return out


def halves(rows: np.ndarray, x: np.ndarray, near: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Two halves of equal size: split along the main direction, then swaps that cut fewer edges of the graph."""
    own = x[rows] - x[rows].mean(axis=0)
    axis = rng.normal(size=x.shape[1])
    for _ in range(20):
        axis = own.T @ (own @ axis)
        axis /= np.linalg.norm(axis) + 1e-300
    side = np.zeros(len(x), dtype=np.int8)
    order = rows[np.argsort(own @ axis, kind="stable")]
    side[order[: len(rows) // 2]], side[order[len(rows) // 2 :]] = -1, 1
    inside = np.zeros(len(x), dtype=bool)
    inside[rows] = True
    a = np.repeat(np.arange(len(x)), near.shape[1])
    b = near.ravel()
    keep = inside[a] & inside[b]
    a, b = np.concatenate((a[keep], b[keep])), np.concatenate((b[keep], a[keep]))
    for _ in range(12):
        pull = np.bincount(a, side[b], minlength=len(x))
        gain = -pull * side  # edges saved by changing sides
        left, right = rows[side[rows] < 0], rows[side[rows] > 0]
        left, right = left[np.argsort(-gain[left], kind="stable")], right[np.argsort(-gain[right], kind="stable")]
        n = min(len(left), len(right))
        better = np.flatnonzero(gain[left[:n]] + gain[right[:n]] > 0)
        swaps = better[: max(1, len(better) // 2)] if len(better) else better
        if not len(swaps):
            break
        side[left[swaps]], side[right[swaps]] = 1, -1
    return rows[side[rows] < 0], rows[side[rows] > 0]


def balanced(x: np.ndarray, near: np.ndarray, n: int, rng: np.random.Generator) -> np.ndarray:
    parts = [np.arange(len(x))]
    while len(parts) < n:
        parts = [h for p in parts for h in halves(p, x, near, rng)]
    out = np.zeros(len(x), dtype=np.int64)
    for i, p in enumerate(parts):
        out[p] = i
    return out


@dataclass
class Router:
    """The classifier and the number of partitions a query probes."""

    dim: int
    layers: list[np.ndarray]
    probes: int = 1

    def scores(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, w3, b3 = self.layers
        return np.maximum(x @ w1 + b1, 0) @ w2 + x @ w3 + b3


def learn(x: np.ndarray, aim: np.ndarray, settings: Settings, rng: np.random.Generator) -> list[np.ndarray]:
    """Fit the classifier to the distributions ``aim`` by Adam."""
    d, p, h = x.shape[1], aim.shape[1], settings.hidden
    layers = [rng.normal(0, (2 / d) ** 0.5, (d, h)), np.zeros(h), rng.normal(0, (1 / h) ** 0.5, (h, p)), np.zeros((d, p)), np.zeros(p)]
    m, s, step = [np.zeros_like(w) for w in layers], [np.zeros_like(w) for w in layers], 0
    for _ in range(settings.epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(x), 128):
            i = order[at : at + 128]
            w1, b1, w2, w3, b3 = layers
            hid = np.maximum(x[i] @ w1 + b1, 0)
            z = hid @ w2 + x[i] @ w3 + b3
            e = np.exp(z - z.max(axis=1, keepdims=True))
            g = (e / e.sum(axis=1, keepdims=True) - aim[i]) / len(i)
            back = (g @ w2.T) * (hid > 0)
            grads = [x[i].T @ back, back.sum(0), hid.T @ g, x[i].T @ g, g.sum(0)]
            step += 1
            for j, grad in enumerate(grads):
                m[j], s[j] = 0.9 * m[j] + 0.1 * grad, 0.999 * s[j] + 0.001 * grad**2
                layers[j] = layers[j] - 0.005 * (m[j] / (1 - 0.9**step)) / (np.sqrt(s[j] / (1 - 0.999**step)) + 1e-8)
    return layers


def fit(vectors: DataFrame, count: int, settings: Settings = Settings()) -> Router:
    """Learn partitions and router from the sample, the rows of smallest id hash of ``count`` rows of one dimension."""
    n = settings.partitions
    while n * settings.rows < count and 40 * n < settings.sample_most:
        n *= 2
    rows = vectors.select("id", "v").orderBy(F.xxhash64("id"), "id").limit(max(settings.sample, min(40 * n, settings.sample_most))).toArrow()
    x = unit(matrix(rows.column("v")))
    dim = x.shape[1]
    rng = np.random.default_rng(settings.seed)
    # copies of one vector would fill the graph with themselves
    x = np.unique(x, axis=0)
    x = x[rng.permutation(len(x))]
    held = x[: max(1, len(x) // 10)]
    while n > 1 and len(x) < 40 * n:
        n //= 2
    if n == 1:
        h = settings.hidden
        return Router(dim, [np.zeros((dim, h)), np.zeros(h), np.zeros((h, 1)), np.zeros((dim, 1)), np.zeros(1)])
    near = graph_of(x, settings.graph)
    part = balanced(x, near, n, rng)
    aim = np.zeros((len(x), n))
    np.add.at(aim, (np.repeat(np.arange(len(x)), near.shape[1]), part[near].ravel()), 1 / (near.shape[1] + 1))
    aim[np.arange(len(x)), part] += 1 / (near.shape[1] + 1)
    # learnt without the held-out tenth, which then measures the recall
    router = Router(dim, learn(x[len(held) :], aim[len(held) :], settings, rng))
    place = router.scores(x).argmax(axis=1)
    order = np.argsort(-router.scores(held), axis=1)
    true = np.argpartition(-(held @ x.T), settings.k, axis=1)[:, : settings.k + 1]
    for router.probes in range(1, n + 1):
        hit = (place[true][:, :, None] == order[:, None, : router.probes]).any(axis=2)
        if hit.mean() >= settings.aim:
            break
    return router


class Chunk:
    """Vectors of one chunk, of which ``nearest`` gives the exact best of some queries."""

    def __init__(self, ids: np.ndarray, v: np.ndarray, settings: Settings):
        order = np.argsort(ids, kind="stable")
        ids, v = ids[order], v[order]
        # of equal vectors only the smallest ids can be among the nearest (one more, for the query's own)
        _, group = np.unique(v, axis=0, return_inverse=True)
        by = np.argsort(group.ravel(), kind="stable")
        g = group.ravel()[by]
        kept = np.sort(by[np.arange(len(g)) - np.searchsorted(g, g) <= settings.k])
        self.ids, self.v, self.k = ids[kept], v[kept], settings.k
        self.norm = np.sqrt((self.v * self.v).sum(axis=1))

    def nearest(self, q_ids: np.ndarray, q: np.ndarray) -> pa.RecordBatch:
        ids, v, norm, q_norm = self.ids, self.v, self.norm, np.sqrt((q * q).sum(axis=1))
        out_q, out_v, out_s = [], [], []
        k = min(self.k, len(ids))
        for a in range(0, len(q), 128):
            rough = (q[a : a + 128] @ v.T) / norm / q_norm[a : a + 128, None]
            rough[q_ids[a : a + 128, None] == ids[None, :]] = -np.inf
            least = np.partition(rough, len(ids) - k, axis=1)[:, len(ids) - k]
            for i in range(len(rough)):
                some = np.flatnonzero((rough[i] >= least[i] - 1e-9) & np.isfinite(rough[i]))
                exact = (v[some] * q[a + i]).sum(axis=1) / (norm[some] * q_norm[a + i])
                best = np.lexsort((ids[some], -exact))[: self.k]
                out_q.append(np.full(len(best), q_ids[a + i]))
                out_v.append(ids[some][best])
                out_s.append(exact[best])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_q)), pa.array(np.concatenate(out_v)), pa.array(np.concatenate(out_s))], names=["query_id", "vec_id", "score"])


def streamed(settings: Settings):
    """A function for ``mapInArrow`` over (part, chunk, group, role, id, v) in that order: the vectors of a chunk (role 0), then its queries."""

    def run(batches):
        key, held, chunk = None, [], None
        for batch in batches:
            keys = np.stack([batch.column(i).to_numpy() for i in range(4)], axis=1)
            cuts = np.concatenate(([0], np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1, [len(keys)]))
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                *own, role = keys[a].tolist()
                if own != key:
                    key, held, chunk = own, [], None
                ids, v = batch.column(4).slice(a, b - a).to_numpy(), matrix(batch.column(5).slice(a, b - a))
                if role == 0:
                    held.append((ids, v))
                elif held or chunk:
                    if chunk is None:
                        chunk, held = Chunk(np.concatenate([i for i, _ in held]), np.concatenate([x for _, x in held]), settings), []
                    yield chunk.nearest(ids, v)

    return run


def search_one(vectors: DataFrame, queries: DataFrame, count: int, settings: Settings) -> DataFrame:
    """(query_id, vec_id, score) within one dimension: the best of each chunk."""
    spark = vectors.sparkSession
    router = fit(vectors, count, settings)

    def routed(most: int):
        def run(batches):
            for batch in batches:
                if batch.num_rows:
                    best = np.argsort(-router.scores(unit(matrix(batch.column(1)))), axis=1, kind="stable")[:, :most]
                    at = pa.array(np.repeat(np.arange(batch.num_rows), best.shape[1]))
                    yield pa.RecordBatch.from_arrays([pa.array(best.ravel().astype(np.int32)), batch.column(0).take(at), batch.column(1).take(at)], names=["part", "id", "v"])

        return run

    ddl = "part int, id long, v array<double>"
    index = written(vectors.select("id", "v").mapInArrow(routed(1), ddl), "ann-index")
    asked = written(queries.select("id", "v").mapInArrow(routed(router.probes), ddl), "ann-queries")
    # one row a partition: a bounded number
    size = {r["part"]: r["count"] for r in index.groupBy("part").count().collect()}
    wanted = {r["part"]: r["count"] for r in asked.groupBy("part").count().collect()}
    chunks = F.create_map(*[F.lit(x) for p, n in size.items() for x in (p, -(-n // settings.chunk))])
    groups = F.create_map(*[F.lit(x) for p, n in (wanted or {-1: 1}).items() for x in (p, -(-n // settings.queries))])
    chunk = F.pmod(F.xxhash64("id"), chunks[F.col("part")]).cast("int")
    group = F.pmod(F.xxhash64("id", F.lit(3)), groups[F.col("part")]).cast("int")
    left = index.where(F.col("part").isin(*(wanted or {-1: 1}))).select("part", chunk.alias("chunk"), F.explode(F.sequence(F.lit(0), groups[F.col("part")] - 1)).alias("group"), F.lit(0).alias("role"), "id", "v")
    right = asked.where(F.col("part").isin(*size)).select("part", F.explode(F.sequence(F.lit(0), chunks[F.col("part")] - 1)).alias("chunk"), group.alias("group"), F.lit(1).alias("role"), "id", "v")
    met = left.union(right).repartition(buckets(spark, count * router.dim * 8), "part", "chunk", "group").sortWithinPartitions("part", "chunk", "group", "role")
    return met.mapInArrow(streamed(settings), "query_id long, vec_id long, score double")


def search(vectors: DataFrame, queries: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(query_id, rank, vec_id, score): the nearest found of each query but itself. Both frames as ``usable`` gives them."""
    spark = vectors.sparkSession
    small_batches(spark)
    vectors = written(vectors, "ann-vectors")
    # one row a dimension: models have one or a few
    sizes = {r["dim"]: r["count"] for r in vectors.groupBy(F.size("v").alias("dim")).count().collect()}
    found = spark.createDataFrame([], "query_id long, vec_id long, score double")
    for dim, count in sorted(sizes.items()):
        found = found.union(search_one(vectors.where(F.size("v") == dim), queries.where(F.size("v") == dim), count, settings))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= settings.k).select("query_id", "rank", "vec_id", "score")
