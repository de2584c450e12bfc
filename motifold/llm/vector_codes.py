"""Vectors as codes of parts, each part's nearest codebook entry found by annular pruning of norms.

Entries of a codebook are sorted by norm. By the triangle inequality an entry that is as near as the best so far has a norm
within that distance of the part's own, so binary search gives an annulus of entries, and only those are measured, exactly,
both edges included, from the part's own norm outwards; the annulus narrows as nearer ones are found. Norms are rounded, so the annulus is widened by more than their error.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, bisect_right
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motifold.llm.shared import free_name, spread_join, stored, tidied
from motifold.llm.whole_vectors import as_long, below, finite, floors, matrix, tree_sums

PARTS = 16
ENTRIES = 64
FACTOR = 256
ROUNDS = 2
#: Entries, half of them on either side, that are measured before the annulus is narrowed.
STRIP = 24
#: Share by which an annulus is wider than its distances tell.
SLACK = 1e-9
#: Parts measured at once.
BLOCK = 2048


def most(width: int, entries: int) -> int:
    """Largest component of parts in int64: squared distances times the number of entries stay below 2**62."""
    return isqrt((1 << 62) // (4 * width * entries))


class Codebook:
    """Entries (rows of Python ints) by norm, of equal norms by index."""

    def __init__(self, entries: np.ndarray) -> None:
        squares = [sum(int(x) ** 2 for x in e) for e in entries]
        self.order = np.array(sorted(range(len(entries)), key=lambda i: (squares[i], i)), np.int64)
        self.exact = [[int(x) for x in entries[i]] for i in self.order]
        self.roots = [isqrt(squares[i]) for i in self.order]
        self.limit = most(entries.shape[1], len(entries))
        self.large = np.array([max(map(abs, e)) > self.limit for e in self.exact])
        self.values = np.array([[min(max(x, -self.limit), self.limit) for x in e] for e in self.exact], np.int64)
        self.norms = np.sqrt((self.values.astype(float) ** 2).sum(1))
        self.norms[self.large] = np.inf  # such entries are measured one by one

    def _one(self, part: list[int]) -> tuple[int, int]:
        """Index and squared distance of the nearest entry, in Python ints."""
        away = lambda k: sum((a - b) ** 2 for a, b in zip(part, self.exact[k], strict=True))
        root = isqrt(sum(x * x for x in part))
        reach = isqrt(away(min(bisect_left(self.roots, root), len(self.roots) - 1))) + 2
        found = min((away(k), int(self.order[k])) for k in range(bisect_left(self.roots, root - reach), bisect_right(self.roots, root + reach)))
        return found[1], found[0]

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Indices (ties: the lowest) and squared distances, as Python ints."""
        index, gaps = np.zeros(len(parts), np.int64), np.zeros(len(parts), object)
        for a in range(0, len(parts), BLOCK):
            own = parts[a : a + BLOCK]
            if own.dtype == object:
                found = [self._one(x) for x in own.tolist()]
                index[a : a + BLOCK], gaps[a : a + BLOCK] = [x for x, _ in found], [y for _, y in found]
            else:
                index[a : a + BLOCK], gaps[a : a + BLOCK] = self._block(own)
        return index, gaps

    def _away(self, parts: np.ndarray, at: np.ndarray) -> np.ndarray:
        return sum((parts[..., j] - self.values[at, j]) ** 2 for j in range(parts.shape[-1]))

    def _block(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        fine = int((~self.large).sum())  # large ones come last
        index, gaps = np.zeros(len(parts), np.int64), np.zeros(len(parts), object)
        norm = np.sqrt((parts.astype(float) ** 2).sum(1))
        key = np.full(len(parts), (1 << 63) - 1)  # distance * entries + index of the best so far
        left = np.searchsorted(self.norms[:fine], norm)  # entries from left to right are measured
        right, active = left.copy(), np.arange(len(parts))
        while len(active) and fine:
            best = np.where(key[active] < (1 << 63) - 1, np.sqrt((key[active] // len(self.order)).astype(float)), np.inf)
            slack = SLACK * (norm[active] + best) + SLACK
            low = np.searchsorted(self.norms[:fine], norm[active] - best - slack, "left")
            high = np.searchsorted(self.norms[:fine], norm[active] + best + slack, "right")
            some = np.arange(STRIP // 2)
            at = np.concatenate([left[active, None] - 1 - some, right[active, None] + some], 1)
            inside = (at >= low[:, None]) & (at < high[:, None])
            keys = np.full(at.shape, (1 << 63) - 1)
            keys[inside] = self._away(parts[np.repeat(active, inside.sum(1))], at[inside]) * len(self.order) + self.order[at[inside]]
            key[active] = np.minimum(key[active], keys.min(1))
            left[active], right[active] = np.maximum(left[active] - STRIP // 2, 0), np.minimum(right[active] + STRIP // 2, fine)
            active = active[inside.any(1)]
        index[:], gaps[:] = key % len(self.order), key // len(self.order)
        if fine < len(self.norms):  # a large entry is over the limit in a component, so it may be as near only to some
            reach = np.where(key < (1 << 63) - 1, norm + np.sqrt((key // len(self.order)).astype(float)), np.inf)
            for i in np.flatnonzero(reach * (1 + SLACK) + SLACK >= self.limit).tolist():
                index[i], gaps[i] = self._one(parts[i].tolist())
        return index, gaps


def coded(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, factor: int = FACTOR, rounds: int = ROUNDS) -> DataFrame:
    """Per row of vectors (vec_id, embedding, label) that is kept: vec_id, code, error, label_error, codebooks_sha256.

    Dropped are vectors that are null, or hold null or non-finite components, or can't be cut into `parts` equal parts, or
    are of another than the commonest size of the rest (ties: the larger). x becomes floor(factor * x), factor being a
    power of two. Codebooks start as parts of the rows of the smallest ids (null ids last, of equal ones the smaller vector
    first); of fewer rows than `entries`, there are fewer. Repeated rows count as often as they occur. error and
    label_error beyond a long are null. A table without kept vectors gives no rows; further columns are ignored.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label"), F.col("embedding").cast("array<double>").alias("vector"))
    rows = rows.where((F.coalesce(F.size("vector"), F.lit(0)) > 0) & (F.size("vector") % parts == 0) & finite(F.col("vector")))
    sizes = rows.groupBy(F.size("vector").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    kind = vectors.schema["label"].dataType.simpleString()
    if sizes is None:
        return spark.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    total, size = sizes["count"], sizes["size"]
    width = size // parts
    rows = rows.where(F.size("vector") == size)
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(entries).select("vector").collect()
    limit = most(width, len(first))
    starts = np.concatenate([w.values.astype(object) for x in first for w in floors(np.array([x["vector"]]), factor, limit) if len(w.rows)])
    books = starts.reshape(len(first), parts, width).transpose(1, 0, 2)

    def shared_books(books: np.ndarray):
        return spark.sparkContext.broadcast([Codebook(b) for b in books])

    for _ in range(rounds):
        shared = shared_books(books)

        def part(batch: pa.RecordBatch, shared=shared) -> list[np.ndarray]:
            n = len(shared.value[0].order)
            counts, sums = np.zeros((parts, n), object), np.zeros((parts, n, width), object)
            for _, x in floors(matrix(batch.column(0), size), factor, limit):
                for p, book in enumerate(shared.value):
                    own = x[:, p * width : (p + 1) * width]
                    index, _ = book.nearest(own)
                    np.add.at(counts[p], index, 1)
                    np.add.at(sums[p], index, own.astype(object))
            return [counts, sums]

        counts, sums = tree_sums(rows.select("vector"), part)
        shared.unpersist()
        books = below(sums, counts, books)
    shared = shared_books(books)
    digest = hashlib.sha256(",".join(str(x) for x in books.ravel()).encode()).hexdigest()

    def told(batches):
        for batch in batches:
            codes = np.zeros((batch.num_rows, parts), np.uint8 if entries <= 256 else np.uint16)
            gaps = np.zeros(batch.num_rows, object)
            for at, x in floors(matrix(batch.column(2), size), factor, limit):
                for p, book in enumerate(shared.value):
                    codes[at, p], own = book.nearest(x[:, p * width : (p + 1) * width])
                    gaps[at] += own
            text = ["".join(f"{v:02x}" for v in row) for row in codes.tolist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text, pa.string()), pa.array([as_long(v) for v in gaps], pa.int64())], names=["vec_id", "label", "code", "error"])

    found = stored(rows.mapInArrow(tidied(told), f"vec_id long, label {kind}, code string, error long"))
    group = free_name(found, "group")
    grouped = found.withColumn(group, F.struct("label"))  # nulls are equal within
    whole = F.count("error") == F.count("*")
    sums = grouped.groupBy(group).agg(F.when(whole, F.try_sum("error")).alias("label_error"), F.count("*").alias("_n"))
    out = spread_join(grouped, sums, [group], total)
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
