"""Approximate nearest neighbours over learned partitions.

1. A bounded sample of the vectors gets its exact neighbour graph.
2. The graph is cut into balanced parts by recursive spectral bisection with a median split.
3. A softmax classifier learns, from each sample vector, which parts its neighbours lie in.
4. Every vector is stored in its likeliest part, and large parts in chunks. The queries - the
   vectors whose id is divisible by ``every`` - go to their most probable parts until their
   probability adds up to ``mass``, which is set on the sample so that the parts searched hold
   TARGET_RECALL of the neighbours, and are ranked exactly there.
5. The best of all parts searched make the answer.

How much is searched is up to the data: vectors without any clusters (random directions) leave the
router nothing to learn, and most parts have to be visited for the recall asked for.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, narrow

#: The sample has SAMPLE_A_PART vectors for each part, MAX_SAMPLE in all; the parts grow with the table, from LEAST_PARTS to MAX_PARTS.
MAX_SAMPLE, SAMPLE_A_PART = 32_768, 256
PART_ROWS, LEAST_PARTS, MAX_PARTS = 2000, 8, 1024
EVERY = 100
GRAPH_K = 10
TARGET_RECALL = 0.95
#: Vectors and queries in one task; a part with more is searched in several chunks and groups.
CHUNK_ROWS, GROUP_QUERIES = 50_000, 50_000
BLOCK = 1024
SEED = 41


def nearest(queries: np.ndarray, data: np.ndarray, k: int, skip: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Places and squared distances of the k nearest rows of ``data``, block by block; ``skip`` is a row each query leaves out."""
    k = min(k, len(data) - (skip is not None))
    at, dist = np.zeros((len(queries), max(k, 0)), np.int64), np.zeros((len(queries), max(k, 0)))
    if k <= 0:
        return at, dist
    norm = (data * data).sum(axis=1)
    for i in range(0, len(queries), BLOCK):
        q = queries[i : i + BLOCK]
        d = norm[None, :] - 2 * (q @ data.T) + (q * q).sum(axis=1)[:, None]
        if skip is not None:
            d[np.arange(len(q)), skip[i : i + BLOCK]] = np.inf
        best = np.argpartition(d, k - 1, axis=1)[:, :k] if k < d.shape[1] else np.tile(np.arange(d.shape[1]), (len(q), 1))
        own = np.take_along_axis(d, best, axis=1)
        order = np.argsort(own, axis=1, kind="stable")
        at[i : i + BLOCK], dist[i : i + BLOCK] = np.take_along_axis(best, order, axis=1), np.take_along_axis(own, order, axis=1)
    return at, np.maximum(dist, 0)


def bisect(neighbours: np.ndarray, levels: int) -> np.ndarray:
    """Part of each node: the graph halved ``levels`` times at the median of its Fiedler vector."""
    n, k = neighbours.shape
    parts = np.zeros(n, np.int64)
    rows, cols = np.repeat(np.arange(n), k), neighbours.ravel()
    rng = np.random.RandomState(SEED)
    for level in range(levels):
        inside = parts[rows] == parts[cols]
        a, b = np.concatenate([rows[inside], cols[inside]]), np.concatenate([cols[inside], rows[inside]])
        degree = np.maximum(np.bincount(a, minlength=n), 1)
        size = np.bincount(parts, minlength=1 << level)
        x = rng.standard_normal(n)
        for _ in range(60):  # lazy random walk, kept free of each part's constant vector
            weight = np.bincount(parts, weights=degree, minlength=len(size))
            x -= (np.bincount(parts, weights=degree * x, minlength=len(size)) / np.maximum(weight, 1))[parts]
            x = 0.5 * x + 0.5 * np.bincount(a, weights=x[b], minlength=n) / degree
            norm = np.sqrt(np.bincount(parts, weights=x * x, minlength=len(size)))
            x /= np.maximum(norm, 1e-12)[parts]
        order = np.lexsort((np.arange(n), x, parts))
        rank = np.empty(n, np.int64)
        rank[order] = np.arange(n) - (np.cumsum(size) - size)[parts[order]]
        parts = parts * 2 + (rank >= (size // 2)[parts])
    return parts


def softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


@dataclass(frozen=True)
class Router:
    weights: np.ndarray
    mass: float

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return softmax(x @ self.weights[:-1] + self.weights[-1])

    def parts(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, part) of every part to search."""
        p = self.probabilities(x)
        order = np.argsort(-p, axis=1, kind="stable")
        before = np.cumsum(np.take_along_axis(p, order, axis=1), axis=1) - np.take_along_axis(p, order, axis=1)
        query, rank = np.nonzero(before < self.mass)
        return query, order[query, rank]


def fit(sample: np.ndarray, n_parts: int) -> Router:
    dim = sample.shape[1] if sample.ndim == 2 else 0
    if n_parts < 2:
        return Router(np.zeros((dim + 1, 1), np.float32), 1.0)
    graph, _ = nearest(sample, sample, GRAPH_K, np.arange(len(sample)))
    parts = bisect(graph, n_parts.bit_length() - 1)
    # where a vector's neighbours lie, and itself
    soft = np.zeros((len(sample), n_parts), np.float32)
    np.add.at(soft, (np.repeat(np.arange(len(sample)), graph.shape[1]), parts[graph].ravel()), 1.0)
    soft[np.arange(len(sample)), parts] += 1
    soft /= soft.sum(axis=1, keepdims=True)
    x = np.hstack([sample, np.ones((len(sample), 1), np.float32)]).astype(np.float32)
    share = np.maximum(soft.sum(axis=0), 1e-6)
    centre = (soft.T @ sample) / share[:, None]
    spread = max(float((sample - centre[parts]).var()), 1e-6)
    w = v = np.vstack([centre.T / spread, -(centre * centre).sum(axis=1) / (2 * spread)]).astype(np.float32)
    rate = 2.0 / max(float((x * x).sum(axis=1).mean()), 1e-6)
    for k in range(200):
        new = v - rate * (x.T @ (softmax(x @ v) - soft)) / len(x)
        v, w = new + k / (k + 3) * (new - w), new
    p = softmax(x @ w)
    stored = p.argmax(axis=1)
    order = np.argsort(-p, axis=1, kind="stable")
    cum = np.cumsum(np.take_along_axis(p, order, axis=1), axis=1)
    rank = np.empty_like(order)
    np.put_along_axis(rank, order, np.tile(np.arange(n_parts), (len(x), 1)), axis=1)
    # the probability that comes before a neighbour's part must be under the mass
    at = np.take_along_axis(rank, stored[graph], axis=1)
    needed = np.where(at > 0, np.take_along_axis(cum, np.maximum(at - 1, 0), axis=1), 0.0)
    return Router(w, float(min(1.0, np.quantile(needed, TARGET_RECALL) + 1e-6)))


def vectors(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id, v: one row an id (of repeated ids the greatest vector), of the most frequent length, with finite numbers only."""
    rows = narrow(df, {"id": id_col, "v": vector_col}).select(F.col("id").cast("long").alias("id"), F.col("v").cast("array<float>").alias("v"))
    rows = rows.where("id is not null and size(v) > 0 and not exists(v, x -> x is null or isnan(x) or abs(x) = float('infinity'))")
    rows = cut(rows.groupBy("id").agg(F.max("v").alias("v")))
    sizes = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return rows.where(F.size("v") == sizes[0]["n"]) if sizes else rows


def _matrix(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten()).reshape(len(column), -1).astype(np.float32)


def parts_for(n: int, part_rows: int) -> int:
    """A power of two: parts of about ``part_rows`` vectors, LEAST_PARTS or more unless there are fewer than two vectors for each."""
    parts = 1
    while parts < MAX_PARTS and 4 * parts <= n and (parts * part_rows < n or parts < LEAST_PARTS):
        parts *= 2
    return parts


def neighbours(df: DataFrame, *, k: int = 10, every: int = EVERY, id_col: str = "vec_id", vector_col: str = "embedding", max_sample: int = MAX_SAMPLE, part_rows: int = PART_ROWS) -> DataFrame:
    """id, neighbours (ids, nearest first), distances (Euclidean) of every vector whose id is divisible by ``every``, itself left out.

    All vectors are searched. Ids are whole numbers. Rows with a null id, a null, empty or unequally
    long vector, or components that are null, NaN or infinite neither search nor are found. Of rows
    that repeat an id the greatest vector counts. Ties in distance go to the lesser id. With fewer
    than k others there are fewer neighbours; a lone vector has an empty list. Extra columns are not read. An empty table gives no
    rows. ``max_sample`` bounds the rows that graph, parts, router and ``mass`` are fitted on.
    """
    rows = vectors(df, id_col, vector_col)
    n = rows.count()
    n_parts = parts_for(n, part_rows)
    sample = rows.orderBy(F.xxhash64("id", F.lit(SEED)), "id").limit(min(max_sample, SAMPLE_A_PART * n_parts) if n_parts > 1 else 1).toArrow()
    known = _matrix(sample.column("v")) if len(sample) else np.zeros((0, 0), np.float32)
    router = fit(known, n_parts)

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), 2048):
                part = batch.slice(i, 2048)
                home = router.probabilities(_matrix(part.column("v"))).argmax(axis=1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(home), part.column("id"), part.column("v")], ["part", "id", "v"])

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), 2048):
                part = batch.slice(i, 2048)
                query, to = router.parts(_matrix(part.column("v")))
                yield pa.RecordBatch.from_arrays([pa.array(to.astype(np.int32)), part.column("id").take(pa.array(query)), part.column("v").take(pa.array(query))], ["part", "id", "v"])

    def search(table: pa.Table) -> pa.Table:
        ids, v, query = np.asarray(table.column("id")), _matrix(table.column("v")), np.asarray(table.column("query")).astype(bool)
        order = np.argsort(ids[~query], kind="stable")  # in id order, so that ties fall to the lesser id
        own, data = ids[~query][order], v[~query][order]
        at, dist = nearest(v[query], data, k + 1) if len(data) else (np.zeros((int(query.sum()), 0), np.int64), np.zeros((int(query.sum()), 0)))
        found = own[at] if len(data) else at
        keep = found != ids[query][:, None]
        offs = np.concatenate([[0], np.cumsum(keep.sum(axis=1))]).astype(np.int32)
        pairs = pa.StructArray.from_arrays([pa.array(np.round(np.sqrt(dist[keep]), 6)), pa.array(found[keep])], ["d", "id"])
        return pa.table({"id": pa.array(ids[query]), "near": pa.ListArray.from_arrays(pa.array(offs), pairs)})

    kind = "part int, id long, v array<float>"
    stored = cut(rows.mapInArrow(store, kind))
    asked = cut(rows.where(F.col("id") % every == 0).mapInArrow(route, kind))
    # one number a part comes to the driver: its vectors and its queries
    sizes = {r["part"]: r for r in stored.withColumn("q", F.lit(0)).unionByName(asked.withColumn("q", F.lit(1))).groupBy("part").agg(F.count_if(F.col("q") == 0).alias("rows"), F.count_if(F.col("q") == 1).alias("queries")).collect()}
    pieces = lambda name, most: F.element_at(F.array(*[F.lit(max(1, -(-sizes[p][name] // most)) if p in sizes else 1) for p in range(n_parts)]), F.col("part") + 1)
    chunks, groups = pieces("rows", CHUNK_ROWS), pieces("queries", GROUP_QUERIES)
    mine = lambda many: F.pmod(F.xxhash64("id"), many).cast("int")
    upto = lambda many: F.explode(F.sequence(F.lit(0), many - 1))
    both = stored.select("part", mine(chunks).alias("chunk"), upto(groups).alias("grp"), F.lit(False).alias("query"), "id", "v")
    both = both.unionByName(asked.select("part", upto(chunks).alias("chunk"), mine(groups).alias("grp"), F.lit(True).alias("query"), "id", "v"))
    found = both.groupBy("part", "chunk", "grp").applyInArrow(search, "id long, near array<struct<d: double, id: long>>")
    best = found.groupBy("id").agg(F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, k).alias("near"))
    return best.select(F.col("id").alias(id_col), F.col("near.id").alias("neighbours"), F.col("near.d").alias("distances"))
