"""Nearest neighbours by several shifted Hilbert curves over projected vectors.

Each curve projects vectors onto a few random directions, shifts them, and orders them by their Hilbert key. A curve is
range-partitioned into cells of equal row counts at quantiles of its keys; a query looks at the cells in a window around
its own key, on every curve, and the best of all windows are kept by true distance. The number of curves, and the share of a curve
that a window covers, are those of least work that reach `TARGET` recall among a bounded sample, so near-isotropic vectors
get wide windows and clustered ones narrow windows. Cells side by side make runs, of which a query takes all that its window
touches. Runs are cut into blocks of bounded bytes by a hash, whatever their keys, so many equal vectors never meet in one
task, and queries come in such blocks too; both are so large that hardly a row or query is copied for another block.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from motifold.llm.shared import hashed_share, stored, tidied

#: Curves at most, and at least.
CURVES = 4
LEAST_CURVES = 3
DIRECTIONS = 8
BITS = 7
#: Rows that scales and windows are fitted on: those of the smallest hashes. Fewer if they'd exceed SAMPLE_VALUES.
SAMPLE_ROWS = 4000
SAMPLE_VALUES = 1 << 24
SAMPLE_QUERIES = 200
TARGET = 0.95
#: Rows of a cell, if there aren't MOST_CELLS of them.
CELL_ROWS = 4096
MOST_CELLS = 1024
#: Bytes of vectors, of rows and of queries each, that a task compares at once.
BLOCK_BYTES = 32 << 20
#: Runs that a window has at least, if it has as many cells: it covers so much more than asked at both ends, at most.
RUNS = 8


def hilbert_keys(points: np.ndarray, bits: int) -> np.ndarray:
    """Positions on the Hilbert curve of points (rows of coordinates below 2**bits), after Skilling's transposed form."""
    x = [points[:, i].astype(np.int64) for i in range(points.shape[1])]
    for level in range(bits - 1, 0, -1):
        below = (1 << level) - 1
        for i in range(len(x)):
            high = (x[i] >> level & 1).astype(bool)
            swap = np.where(high, 0, (x[0] ^ x[i]) & below)
            x[i] ^= swap
            x[0] ^= np.where(high, below, swap)
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        turn ^= np.where(x[-1] >> level & 1, (1 << level) - 1, 0)
    key = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for one in x:
            key = key << 1 | ((one ^ turn) >> level & 1)
    return key


class Curves(NamedTuple):
    directions: np.ndarray  #: curves x dimensions x DIRECTIONS
    middle: np.ndarray
    scale: np.ndarray
    shift: np.ndarray
    share: float  #: of each curve, in a window

    def keys(self, vectors: np.ndarray) -> np.ndarray:
        """vectors x curves."""
        out = []
        for directions, middle, scale, shift in zip(*self[:4], strict=True):
            z = (vectors @ directions - middle) / scale
            even = 1 / (1 + np.exp(-1.702 * np.clip(z, -20, 20)))  # nearly the normal distribution's quantile
            out.append(hilbert_keys(np.minimum((even + shift) / 2 * (1 << BITS), (1 << BITS) - 1), BITS))
        return np.stack(out, 1)


def fit_curves(sample: np.ndarray, curves: int = CURVES, target: float = TARGET, k: int = 10) -> Curves:
    """Random directions and shifts, scales from the sample; of LEAST_CURVES to `curves` curves, so many, with the window that
    finds `target` of the sample's neighbours, that windows cover least in all."""
    random = np.random.default_rng(7)
    n, d = sample.shape
    directions = random.standard_normal((curves, d, DIRECTIONS))
    directions /= np.linalg.norm(directions, axis=1, keepdims=True)
    projected = np.einsum("nd,cdp->cnp", sample, directions)
    out = Curves(directions, projected.mean(1), np.maximum(projected.std(1), 1e-12), random.random((curves, DIRECTIONS)), 1.0)
    asked = min(n, SAMPLE_QUERIES)
    if n <= 4 * k:
        return out
    squares = (sample**2).sum(1)
    away = squares[:asked, None] + squares[None] - 2 * sample[:asked] @ sample.T
    away[np.arange(asked), np.arange(asked)] = np.inf
    nearest = np.argpartition(away, k, axis=1)[:, :k]
    keys = out.keys(sample)
    places = np.empty((n, curves))
    for c in range(curves):
        places[np.argsort(keys[:, c], kind="stable"), c] = (np.arange(n) + 0.5) / n
    gaps = np.abs(places[:asked, None] - places[nearest])
    share_of = lambda c: next((2 * x for x in (np.arange(1, 65) / 128) if (gaps[:, :, :c].min(2) <= x).mean() >= target), 1.0)
    best = min(range(min(LEAST_CURVES, curves), curves + 1), key=lambda c: (c * share_of(c), c))
    return Curves(*(x[:best] for x in out[:4]), min(1.0, share_of(best)))


def valid_vector(vector: Column, size: Column | int) -> Column:
    """Of the given size, no null or non-finite component, and not zero."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(vector) == size) & fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _search(k: int):
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def run(rows: pa.Table, queries: pa.Table) -> pa.Table:
        if not rows.num_rows or not queries.num_rows:
            return schema.empty_table()
        x, q = _matrix(rows.column("vector")), _matrix(queries.column("vector"))
        ids, asked = rows.column("vec_id").to_numpy(), queries.column("query_id").to_numpy()
        squares, slack = (x**2).sum(1), 1e-9 * (1 + (q**2).sum(1))
        found: list[list[np.ndarray]] = [[], [], []]
        for i, own in enumerate(asked.tolist()):
            near = squares - 2 * (x @ q[i])
            near[ids == own] = np.inf
            limit = near[np.argpartition(near, k)[: k + 1]].max() if len(near) > k else np.inf
            some = np.flatnonzero((near <= limit + slack[i]) & (ids != own))
            true = np.sqrt(((x[some] - q[i]) ** 2).sum(1))
            best = np.lexsort((ids[some], true))[:k]
            for column, values in zip(found, (np.full(len(best), own), ids[some][best], true[best]), strict=True):
                column.append(values)
        return pa.Table.from_arrays([pa.array(np.concatenate(x)) for x in found], schema=schema)

    return run


def nearest(vectors: DataFrame, queries: Column, k: int = 10, curves: int = CURVES, target: float = TARGET, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per query row (those of vectors for which `queries` holds) its k nearest others: query_id, rank, vec_id, score.

    vectors: vec_id, embedding. score is the Euclidean distance in double precision, ties go to the smaller vec_id.
    Null, zero and non-finite vectors, null ids, and vectors of another than the commonest size (ties: the larger) take no
    part, as queries or candidates. Rows that repeat an id count once, by their nearest vector; a query never finds its own
    id. Fewer than k others: all of them. An empty table, or one without queries, gives no rows. A target above 1 makes
    windows whole, so that all candidates are measured.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"), queries.alias("asks"))
    sizes = rows.groupBy(F.size("vector").alias("size")).count().where("size > 0").orderBy(F.desc("count"), F.desc("size")).first()
    none = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if sizes is None:
        return none
    size = sizes["size"]
    rows = rows.where(valid_vector(F.col("vector"), size) & F.col("vec_id").isNotNull())
    most = max(100, min(SAMPLE_ROWS, SAMPLE_VALUES // size))
    some = hashed_share(rows.select("vec_id", "vector"), 2 * most).orderBy(F.xxhash64("vec_id", "vector")).limit(most).select("vector").collect()
    if not some:
        return none
    model = fit_curves(np.array([x["vector"] for x in some]), curves, target, k)
    curves = len(model.shift)
    shared = spark.sparkContext.broadcast(model)

    def key(batches):
        for batch in batches:
            keys = shared.value.keys(_matrix(batch.column(1))) if batch.num_rows else np.zeros((0, curves), np.int64)
            listed = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * curves), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, listed], names=["vec_id", "vector", "asks", "keys"])

    keyed = stored(rows.mapInArrow(tidied(key), "vec_id long, vector array<double>, asks boolean, keys array<long>"))
    total = keyed.count()
    share = max(model.share, min(1.0, 4 * k / total))
    cells = max(16, min(MOST_CELLS, math.ceil(total / CELL_ROWS)))
    at = [i / cells for i in range(1, cells)]
    bounds = keyed.agg(*(F.percentile_approx(F.col("keys")[c], at, 20 * cells).alias(f"c{c}") for c in range(curves))).first()
    edges = [np.array(bounds[c], np.int64) for c in range(curves)]
    reach = max(1, math.ceil(share * cells))
    block = max(CELL_ROWS, block_bytes // (8 * size))
    wide = max(1, min(reach // RUNS, block * cells // total))

    def place(batches):
        for batch in batches:
            keys = batch.column("keys").flatten().to_numpy().reshape(batch.num_rows, curves)
            found = np.stack([np.searchsorted(edges[c], keys[:, c]) for c in range(curves)], 1).astype(np.int32)
            listed = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * curves), pa.array(found.ravel()))
            kept = [i for i, x in enumerate(batch.schema.names) if x != "keys"]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), listed], names=[*(batch.schema.names[i] for i in kept), "cells"])

    def placed(rows: DataFrame, *columns: str) -> DataFrame:
        """columns, curve and cell (the number of edges below the key), for each curve."""
        kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in columns)
        return rows.select(*columns, "keys").mapInArrow(place, f"{kinds}, cells array<int>").select(*columns, F.posexplode("cells").alias("curve", "cell"))

    run = F.floor(F.col("cell") / wide).cast("int").alias("run")
    first = F.greatest(F.lit(0), F.least(F.col("cell") - reach // 2, F.lit(cells - reach)))
    runs = F.explode(F.sequence(F.floor(first / wide).cast("int"), F.floor((first + (reach - 1)) / wide).cast("int"))).alias("run")
    asks = keyed.where("asks")
    # Blocks of each run: of rows, and of queries. A bounded table: a row for each run.
    blocks_of = lambda df, name: df.groupBy("curve", "run").agg(F.ceil(F.count("*") / block).cast("int").alias(name))
    row_blocks = blocks_of(placed(keyed, "vec_id").select("curve", run), "row_blocks")
    blocks = F.broadcast(stored(row_blocks.join(blocks_of(placed(asks, "vec_id").select("curve", runs), "query_blocks"), ["curve", "run"])))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    hashed = lambda x, n: F.pmod(F.xxhash64(x), F.col(n)).cast("int")
    left = placed(keyed, "vec_id", "vector").select("curve", run, "vec_id", "vector").join(blocks, ["curve", "run"])
    left = left.select("curve", "run", hashed("vec_id", "row_blocks").alias("r"), every("query_blocks").alias("q"), "vec_id", "vector")
    right = placed(asks, "vec_id", "vector").select("curve", runs, F.col("vec_id").alias("query_id"), "vector").join(blocks, ["curve", "run"])
    right = right.select("curve", "run", every("row_blocks").alias("r"), hashed("query_id", "query_blocks").alias("q"), "query_id", "vector")
    by = ["curve", "run", "r", "q"]
    found = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(_search(k), "query_id long, vec_id long, score double")
    best = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
