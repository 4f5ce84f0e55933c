"""Approximate nearest neighbours by collision-counting hashing.

Every vector is projected on ``PROJECTIONS`` random lines; each line is a sorted
array. A query opens a window around its own projection on every line; a vector
collides on a line when it lies in the window. Windows widen step by step
(virtual rehashing: the search radius grows by ``GROWTH``), collisions are
counted incrementally, and a vector that collides on more than ``THRESHOLD`` of
the lines is verified with the true cosine. A query stops once the k best
verified vectors lie within the search radius.

Vectors are dealt into shards of about ``SHARD_ROWS`` rows; each shard builds its
sorted arrays in one task, takes the queries in blocks and gives its best k per
query, merged exactly.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

SHARD_ROWS = 8192
PROJECTIONS, GROWTH, THRESHOLD, WIDTH = 96, 1.15, 0.58, 2.0
START_RADIUS = 0.3
STEPS, QUERIES = 16, 64            # windows looked up at once


class Index:
    """Sorted projection arrays of one shard."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.lexsort((*vectors.T[::-1], ids))
        ids, vectors = ids[order], vectors[order]
        first = np.concatenate([[True], ids[1:] != ids[:-1]])    # rows of one id: the smallest vector counts
        self.ids, self.vectors = ids[first], vectors[first]
        self.norms = np.sqrt(np.einsum("ij,ij->i", self.vectors, self.vectors))
        self.lines = np.random.default_rng(97 + vectors.shape[1]).standard_normal((vectors.shape[1], PROJECTIONS))
        place = (self.vectors / self.norms[:, None]) @ self.lines
        place = np.ascontiguousarray(place.T)                    # a line's array is a row
        order = np.argsort(place, axis=1, kind="stable")
        self.sorted = np.take_along_axis(place, order, axis=1)
        rank = np.arange(len(self.ids), dtype=np.min_scalar_type(len(self.ids)))
        self.rank = np.empty(place.shape, rank.dtype)            # a vector's place on every line
        np.put_along_axis(self.rank, order, rank[None, :], axis=1)
        self.gap, self.inside = np.empty_like(self.rank), np.empty(place.shape, bool)   # used again by every step

    def windows(self, at: np.ndarray, radius: float) -> np.ndarray:
        """First and last place (excluded) of the next ``STEPS`` windows of every query on every line: (step, end, query, line)."""
        half = np.zeros(STEPS)
        for t in range(STEPS):
            half[t] = WIDTH * radius / 2
            radius *= GROWTH
        out = np.zeros((STEPS, 2, *at.shape), np.int64)
        for j, line in enumerate(self.sorted):
            out[:, 0, :, j] = np.searchsorted(line, at[None, :, j] - half[:, None])
            out[:, 1, :, j] = np.searchsorted(line, at[None, :, j] + half[:, None], "right")
        return out

    def search_all(self, own: np.ndarray, queries: np.ndarray, k: int):
        """``search`` of every query; their windows are looked up together."""
        for i in range(0, len(own), QUERIES):
            part = queries[i:i + QUERIES]
            at = np.stack([(q / np.sqrt(q @ q)) @ self.lines for q in part])
            ends = self.windows(at, START_RADIUS)
            for o, q, x, e in zip(own[i:i + QUERIES].tolist(), part, at, np.moveaxis(ends, 2, 0), strict=True):
                yield o, self._search(o, q, k, x, e)

    def search(self, own: int, query: np.ndarray, k: int) -> list[tuple[int, float]]:
        """Up to k best (id, cosine) of this shard, best first, ties to the smaller id."""
        return next(self.search_all(np.array([own]), query[None, :], k))[1]

    def _search(self, own, query, k, at, ends):
        # what is seen only grows with the windows, so the first step that ends the search is found by bisection
        norm = np.sqrt(query @ query)
        need = int(np.ceil(THRESHOLD * PROJECTIONS))
        cos, known = np.zeros(len(self.ids)), np.zeros(len(self.ids), bool)

        def step(t, radius):
            """Best k (place, cosine) of the vectors that collide often enough at a step, and whether the search ends there."""
            first, width = ends[t, 0], ends[t, 1] - ends[t, 0]
            # places before the window wrap around to large numbers
            np.subtract(self.rank, first[:, None].astype(self.rank.dtype), out=self.gap)
            np.less(self.gap, width[:, None].astype(self.rank.dtype), out=self.inside)
            seen = np.add.reduce(self.inside.view(np.uint8), axis=0, dtype=np.uint8) >= need
            fresh = np.flatnonzero(seen & ~known)
            cos[fresh] = np.einsum("ij,j->i", self.vectors[fresh], query) / (self.norms[fresh] * norm)
            known[fresh] = True
            found = np.flatnonzero(seen & (self.ids != own))
            if len(found) > max(k, 1):
                found = found[cos[found] >= -np.partition(-cos[found], max(k, 1) - 1)[max(k, 1) - 1]]
            found = found[np.lexsort((self.ids[found], -cos[found]))[:max(k, 1)]]
            return found, seen.all() or (len(found) >= k and np.sqrt(max(0.0, 2 - 2 * cos[found[k - 1]])) <= radius)

        radius = START_RADIUS
        while True:
            radii = [radius]
            for _ in range(STEPS):
                radii.append(radii[-1] * GROWTH)
            lo, hi, best = 0, len(ends), None                    # hi: first known step that ends it
            while lo < hi:
                t = (lo + hi) // 2
                found, done = step(t, radii[t])
                lo, hi, best = (lo, t, found) if done else (t + 1, hi, best)
            if best is not None:
                return list(zip(self.ids[best].tolist(), cos[best].tolist(), strict=True))[:k]
            radius = radii[-1]
            ends = self.windows(at[None, :], radius)[:, :, 0]


def _matrix(column) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.float64).reshape(len(column), -1)


def _shards(k: int):
    """Rows sorted by (shard, dim, kind): a shard's vectors, then its queries -> best k per query."""
    def run(batches):
        key, ids, vectors, index = None, [], [], None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            s, kind = batch.column("shard").to_numpy(), batch.column("kind").to_numpy()
            dim = batch.column("dim").to_numpy()
            group = np.concatenate([[0], np.flatnonzero((s[1:] != s[:-1]) | (kind[1:] != kind[:-1]) | (dim[1:] != dim[:-1])) + 1, [len(s)]])
            out = [[], [], []]
            for a, z in zip(group[:-1].tolist(), group[1:].tolist(), strict=True):
                part = t.slice(a, z - a).combine_chunks()
                if key != (s[a], dim[a]):
                    key, ids, vectors, index = (s[a], dim[a]), [], [], None
                own, vec = part.column("id").to_numpy(), _matrix(part.column("v").chunk(0))
                if kind[a] == 0:
                    ids.append(own), vectors.append(vec)
                    continue
                if not ids:
                    continue
                if index is None:
                    index = Index(np.concatenate(ids), np.concatenate(vectors))
                for q, best in index.search_all(own, vec, k):
                    for i, x in best:
                        out[0].append(q), out[1].append(i), out[2].append(x)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())],
                                             names=["query_id", "vec_id", "score"])
    return run


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k nearest vectors (largest cosine) of each query: query_id, rank (from 1), vec_id, score.

    A query's own id is no candidate; ties go to the smaller id. Vectors that are
    null, empty, zero or hold null or non-finite components, and rows with a null
    id, take no part. Of several rows with one id the smallest vector counts.
    Vectors of another length than the query's are no candidates. Other columns
    are not read.
    """
    def clean(df):
        bad = "exists(v, x -> x is null or isnan(x) or abs(x) = double('infinity'))"
        return (df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
                .where("id is not null and v is not null").where(f"not {bad} and exists(v, x -> x <> 0)")
                .withColumn("dim", F.size("v")))

    parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    base = clean(vectors)
    shards = max(1, -(-base.count() // SHARD_ROWS))
    asked = clean(queries).groupBy("id").agg(F.min(F.struct("v", "dim")).alias("x")).select("id", "x.v", "x.dim")
    rows = (base.select(F.pmod(F.xxhash64("id"), F.lit(shards)).alias("shard"), "dim", F.lit(0).alias("kind"), "id", "v")
            .union(asked.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1)).cast("array<long>")), "dim", F.lit(1), "id", "v")))
    local = (rows.repartition(max(parts, min(shards, 4 * parts)), "shard").sortWithinPartitions("shard", "dim", "kind")
             .mapInArrow(_shards(k), "query_id long, vec_id long, score double"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return local.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
