"""Centroid clustering of vectors of whole numbers, exactly.

Distances of a block of vectors to all centroids are |x|^2 - 2 x.c + |c|^2, a product of matrices in float64. It is exact
where every partial sum stays below 2**53, which bounds on the block's and each centroid's largest component tell before;
centroids that fail the bound, and vectors of very large numbers, are measured in integers instead. Tasks hand on sums of
their vectors by centroid, added in a tree of tasks, so the driver holds a few centroids and the vectors never move.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motifold.llm.shared import tidied
from motifold.llm.whole_vectors import LONG, as_long, below, finite, floors, matrix, tree_sums

CENTROIDS = 16
SIZE = 64
FACTOR = 64
ROUNDS = 3
#: float64 holds all whole numbers below.
EXACT = 1 << 53
#: Rows of a block.
BLOCK = 4096
#: Largest component of vectors held in int64: a block's sums of these stay below EXACT.
MOST = 1 << 40


def _gaps(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances in integers: int64 where it holds them, else Python ints."""
    reach = int(np.abs(x).max(initial=0)) + int(np.abs(centroids).max(initial=0))
    kind = np.int64 if x.shape[1] * reach**2 <= LONG else object
    x, centroids = x.astype(kind), centroids.astype(kind)
    return np.stack([((x - c) ** 2).sum(1) for c in centroids], 1)


def distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances, vectors x centroids, all exact. x: int64, or Python ints; centroids: Python ints."""
    size = x.shape[1]
    reach = np.abs(centroids).max(1) + int(np.abs(x).max(initial=0))
    fine = (size * reach**2 < EXACT).astype(bool) & (x.dtype != object)
    out = np.empty((len(x), len(centroids)), np.int64 if fine.all() else object)
    if fine.any():
        a, c = x.astype(np.float64), centroids[fine].astype(np.float64)
        out[:, fine] = ((a**2).sum(1)[:, None] - 2 * (a @ c.T) + (c**2).sum(1)).astype(np.int64)
    if not fine.all():
        out[:, ~fine] = _gaps(x, centroids[~fine])
    return out


def assigned(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each vector's nearest centroid (ties: the first) and squared distance, in blocks."""
    near, gaps = np.zeros(len(x), np.int64), np.zeros(len(x), object)
    for a in range(0, len(x), BLOCK):
        found = distances(x[a : a + BLOCK], centroids)
        near[a : a + BLOCK] = found.argmin(1)
        gaps[a : a + BLOCK] = found[np.arange(len(found)), near[a : a + BLOCK]]
    return near, gaps


def _sums(x: np.ndarray, near: np.ndarray, k: int) -> np.ndarray:
    """Sums of vectors by centroid, as Python ints."""
    out = np.zeros((k, x.shape[1]), object)
    for a in range(0, len(x), BLOCK):
        own, at = x[a : a + BLOCK], near[a : a + BLOCK]
        hot = at == np.arange(k)[:, None]
        out += (hot.astype(np.float64) @ own.astype(np.float64)).astype(np.int64).astype(object) if own.dtype != object else hot.astype(object) @ own
    return out


def _digest(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, centroid.tolist())).encode()).hexdigest()


def clustered(vectors: DataFrame, k: int = CENTROIDS, size: int = SIZE, factor: int = FACTOR, rounds: int = ROUNDS, salt: str = "1:") -> DataFrame:
    """Per row of vectors (vec_id, embedding) that is kept: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    Kept are vectors of `size` components without nulls or non-finite ones; x becomes floor(factor * x), factor being a power
    of two. Centroids start as the k vectors with the smallest sha256 of salt and vec_id (null ids last; of equal ones the
    smaller vector first), or as all, if there are fewer. Repeated rows count as often as they occur. Distances and inertias
    beyond a long are null. A table without kept vectors gives no rows; other columns are ignored.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"))
    rows = rows.where(F.coalesce(F.size("vector") == size, F.lit(False)) & finite(F.col("vector")))
    digest = F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")), 256)
    first = rows.orderBy(digest.asc_nulls_last(), "vector").limit(k).select("vector").collect()
    schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not first:
        return spark.createDataFrame([], schema)
    centroids = np.concatenate([w.values.astype(object) for x in first for w in floors(np.array([x["vector"]]), factor, MOST) if len(w.rows)])

    def summed(centroids: np.ndarray) -> list[np.ndarray]:
        """Counts, sums and squared distances by centroid, over all vectors."""
        shared = spark.sparkContext.broadcast(centroids)

        def part(batch: pa.RecordBatch) -> list[np.ndarray]:
            n = len(shared.value)
            out = [np.zeros(n, object), np.zeros((n, size), object), np.zeros(n, object)]
            for _, x in floors(matrix(batch.column(1), size), factor, MOST):
                near, gaps = assigned(x, shared.value)
                np.add.at(out[2], near, gaps)
                out[0] += np.bincount(near, minlength=n).astype(object)
                out[1] += _sums(x, near, n)
            return out

        found = tree_sums(rows, part)
        shared.unpersist()
        return found

    for _ in range(rounds):
        counts, sums, _ = summed(centroids)
        centroids = below(sums, counts, centroids)
    inertia = summed(centroids)[2]
    shared = spark.sparkContext.broadcast((centroids, [as_long(v) for v in inertia], as_long(inertia.sum()), [_digest(c) for c in centroids]))

    def told(batches):
        centroids, own, total, digests = shared.value
        for batch in batches:
            near, gaps = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, object)
            for at, x in floors(matrix(batch.column(1), size), factor, MOST):
                near[at], gaps[at] = assigned(x, centroids)
            names = [x.split()[0] for x in schema.split(", ")]
            columns = [pa.array(near, pa.int32()), pa.array([as_long(v) for v in gaps], pa.int64())]
            columns += [pa.array(v, t).take(pa.array(near)) for v, t in ((own, pa.int64()), ([total] * len(own), pa.int64()), (digests, pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=names)

    return rows.mapInArrow(tidied(told), schema)
