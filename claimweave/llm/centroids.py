"""Centroid clustering (Lloyd's rounds) whose nearest-centroid search is the threshold algorithm.

Vectors become whole numbers, floor(SCALE * x), so sums, means and distances are exact and reruns
agree to the last digit. For every dimension the centroids lie in a list sorted by their value there.
A vector enters each list at its own value and walks outward, to the nearer neighbour first; centroids met for
the first time get their exact distance. A centroid not met yet is in every dimension at least as far
as that list's frontier, so once the sum of the squared frontier distances strictly exceeds the best
exact distance, the search ends; at equality it goes on, as an unmet centroid of a smaller number could tie.

Start centroids are the kept vectors with the least SHA-256 of "<seed>:<id>". Each round is one pass: tasks
add up their vectors by cluster, so what is shuffled is k rows a task, and only the k centroids reach
the driver (k * dimensions numbers, held against MOST_NUMBERS).

Defined results: a vector that is null, of another length, or with a component that is null or not finite
is left out. Components are kept within 2**27 after scaling (x within 2**19), so that a
distance fits 64 bits; that is far beyond any embedding. Ties of distance go to the smaller centroid.
Rows that repeat are vectors of their own; starts of one id are ordered by their components, a null id counts
as an empty text. Fewer vectors than k give as many centroids; none give no rows. An empty cluster keeps its
centroid. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimweave.llm.common import written

K = 40
DIMENSIONS = 64
ROUNDS = 5
SCALE = 256
SEED = 2
# k * dimensions: the numbers that the driver holds and sends to every task.
MOST_NUMBERS = 1 << 22
_LIMIT = 1 << 27
_CHUNK = 1024
_FAR = np.int64(1) << np.int64(31)


class SortedLists:
    """Per dimension, the centroids in the order of their value there."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids
        self.k, self.dimensions = centroids.shape
        self.order = np.argsort(centroids, axis=0, kind="stable")
        values = np.take_along_axis(centroids, self.order, axis=0)
        # A sentinel at both ends, farther away than any centroid.
        edge = np.full((1, self.dimensions), _FAR)
        self.values = np.concatenate([-edge, values, edge])

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(cluster, squared distance, centroids met) of every row of x."""
        rows = len(x)
        best = np.full(rows, np.iinfo(np.int64).max)
        cluster = np.zeros(rows, np.int64)
        met = np.zeros((rows, self.k), bool)
        # The next place below and above each value, in lists with sentinels.
        above = np.empty(x.shape, np.int64)
        for d in range(self.dimensions):
            above[:, d] = np.searchsorted(self.values[:, d], x[:, d], side="left")
        below = above - 1
        dims = np.arange(self.dimensions)
        walking = np.arange(rows)
        while len(walking):
            v, a, b = x[walking], above[walking], below[walking]
            up, down = self.values[a, dims] - v, v - self.values[b, dims]
            climb = up <= down
            place = np.where(climb, a, b)
            # Lists that are used up stand at a sentinel and name no centroid.
            real = (place > 0) & (place <= self.k)
            named = self.order[np.clip(place - 1, 0, self.k - 1), dims]
            seen = np.zeros((len(walking), self.k), bool)
            at, dim = np.nonzero(real)
            seen[at, named[at, dim]] = True
            new_row, new = np.nonzero(seen & ~met[walking])
            met[walking[new_row], new] = True
            distance = ((v[new_row] - self.centroids[new]) ** 2).sum(axis=1)
            # The least (distance, number) of the new ones of every row: sorted, so the first of a row.
            first = np.lexsort((new, distance, new_row))
            who, start = np.unique(new_row[first], return_index=True)
            d, c, g = distance[first][start], new[first][start], walking[who]
            better = (d < best[g]) | ((d == best[g]) & (c < cluster[g]))
            best[g[better]], cluster[g[better]] = d[better], c[better]
            a, b = np.where(climb & real, a + 1, a), np.where(~climb & real, b - 1, b)
            above[walking], below[walking] = a, b
            # A list is used up when all centroids have been met in it, and then so is the search.
            frontier = np.minimum(self.values[a, dims] - v, v - self.values[b, dims])
            done = (frontier >= _FAR // 2).any(axis=1)
            threshold = (np.where(done[:, None], 0, frontier) ** 2).sum(axis=1)
            walking = walking[~(done | (threshold > best[walking]))]
        return cluster, best, met.sum(axis=1)


def _vectors(batch: pa.RecordBatch) -> np.ndarray:
    lists = batch.column(batch.schema.get_field_index("vector"))
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return flat.reshape(len(lists), -1) if len(lists) else flat.reshape(0, 1)


def _summing(centroids: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = SortedLists(centroids)
        total, count = np.zeros_like(centroids), np.zeros(len(centroids), np.int64)
        for batch in batches:
            x = _vectors(batch)
            for start in range(0, len(x), _CHUNK):
                part = x[start : start + _CHUNK]
                cluster, _, _ = lists.nearest(part)
                np.add.at(total, cluster, part)
                count += np.bincount(cluster, minlength=len(count))
        found = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays(
            [pa.array(found, pa.int32()), pa.array(count[found]), pa.array(total[found].tolist(), pa.list_(pa.int64()))],
            names=["cluster", "n", "sums"])

    return sums


def _assigning(centroids: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = SortedLists(centroids)
        for batch in batches:
            x = _vectors(batch)
            found = [lists.nearest(x[s : s + _CHUNK]) for s in range(0, len(x), _CHUNK)]
            cluster, distance, met = (np.concatenate([f[i] for f in found]) if found else np.empty(0, np.int64) for i in range(3))
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index("id")), pa.array(cluster, pa.int32()), pa.array(distance), pa.array(met, pa.int32())],
                names=["id", "cluster", "distance", "n_met"])

    return assigned


def whole_vectors(df: DataFrame, id_column: str, vector: str, dimensions: int, scale: int) -> DataFrame:
    """(id, vector as whole numbers) of the usable vectors."""
    x = F.col(vector)
    # A component that is null compares to nothing, so it does not count as finite.
    finite = F.forall(x, lambda v: F.coalesce(F.abs(v.cast("double")) < float("inf"), F.lit(False)))
    limit = F.lit(float(_LIMIT))
    number = lambda v: F.greatest(-limit, F.least(F.floor(v.cast("double") * scale).cast("double"), limit)).cast("int")
    kept = df.where((F.size(x) == dimensions) & finite)
    # The product of a huge component may be infinite; as a double it is still clamped.
    return kept.select(F.col(id_column).alias("id"), F.transform(x, number).alias("vector"))


def starts(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    """k rows at most reach the driver."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    rows = vectors.select(digest.alias("digest"), "vector").orderBy("digest", "vector").limit(k).collect()
    return np.array([r["vector"] for r in rows], np.int64)


def moved(vectors: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Centroids at the exact floor of their vectors' means; k rows reach the driver."""
    parts = vectors.mapInArrow(_summing(centroids), "cluster int, n long, sums array<long>")
    wide = "decimal(38,0)"
    rows = parts.groupBy("cluster").agg(
        F.sum(F.col("n").cast(wide)).alias("n"),
        *[F.sum(F.get("sums", F.lit(d)).cast(wide)).alias(f"s{d}") for d in range(centroids.shape[1])]).collect()
    out = centroids.copy()
    for r in rows:
        out[r["cluster"]] = [int(r[f"s{d}"]) // int(r["n"]) for d in range(centroids.shape[1])]
    return out


def cluster(
    df: DataFrame, id_column: str = "vec_id", vector: str = "embedding", k: int = K, rounds: int = ROUNDS,
    dimensions: int = DIMENSIONS, scale: int = SCALE, seed: int = SEED,
) -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid_sha256, n_met): n_met centroids were measured exactly."""
    if k < 1 or k * dimensions > MOST_NUMBERS:
        raise ValueError(f"k * dimensions must lie in 1 to {MOST_NUMBERS}")
    spark = df.sparkSession
    vectors = written(whole_vectors(df, id_column, vector, dimensions, scale), "vectors")
    centroids = starts(vectors, k, seed)
    schema = "id {}, cluster int, distance long, n_met int".format(df.schema[id_column].dataType.simpleString())
    if not len(centroids):
        centroids = np.zeros((1, dimensions), np.int64)  # of no vector
        rounds = 0
    for _ in range(rounds):
        centroids = moved(vectors, centroids)
    assigned = written(vectors.mapInArrow(_assigning(centroids), schema), "assigned")
    # One row per cluster that has vectors, k at most.
    per_cluster = {r["cluster"]: r["s"] for r in assigned.groupBy("cluster").agg(
        F.sum(F.col("distance").cast("decimal(38,0)")).cast("long").alias("s")).collect()}
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    table = spark.createDataFrame(
        [(c, s, sum(per_cluster.values()), digests[c]) for c, s in per_cluster.items()],
        "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(table), "cluster").select(
        F.col("id").alias(id_column), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "n_met")
