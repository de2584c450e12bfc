"""Vectors as whole numbers, exactly, for tasks; and exact sums over all tasks."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motifold.llm.shared import tidied

#: Greatest long.
LONG = (1 << 63) - 1


class Whole(NamedTuple):
    rows: np.ndarray  #: places in the batch
    values: np.ndarray  #: rows x components: int64, or Python ints (object) of rows that have larger numbers


def finite(vector: Column) -> Column:
    """Whether a list of doubles is there and has no null or non-finite component. An empty one has none."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(fine, F.lit(False))


def floors(values: np.ndarray, factor: int, most: int) -> list[Whole]:
    """floor(factor * x) of each x (rows x components of finite doubles; factor is a power of two, so products are exact):
    of rows whose numbers are all at most `most` in size, in int64, and, if there are others, of those as Python ints."""
    with np.errstate(over="ignore"):
        down = np.floor(values * factor)
    small = (np.abs(down) <= most).all(1)
    out = [Whole(np.flatnonzero(small), down[small].astype(np.int64))]
    if not small.all():
        # A double of 2**53 or more is whole, so its product is too.
        exact = lambda x: int(x) * factor if abs(x) >= 1 << 53 else int(np.floor(x * factor))
        large = np.empty((int((~small).sum()), values.shape[1]), object)
        large[:] = [[exact(x) for x in row] for row in values[~small].tolist()]
        out.append(Whole(np.flatnonzero(~small), large))
    return out


def matrix(column: pa.Array, size: int) -> np.ndarray:
    """Rows x size of a list column without nulls, all of the same size."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), size)


def as_long(value: int) -> int | None:
    """The value, or None where no long holds it."""
    return int(value) if abs(int(value)) <= LONG else None


def added(a: list[np.ndarray] | None, b: list[np.ndarray] | None) -> list[np.ndarray] | None:
    if a is None or b is None:
        return b if a is None else a
    return [x + y for x, y in zip(a, b, strict=True)]


def tree_sums(rows: DataFrame, part: Callable[[pa.RecordBatch], list[np.ndarray]]) -> list[np.ndarray] | None:
    """The sum over all batches of what part makes of each: arrays of Python ints, so exact. None of an empty table.

    A task adds up its batches and hands on one row; rows are combined in a tree of tasks (RDD.treeAggregate), so the
    driver gets only as many as the root of the number of tasks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                total = added(total, [x.astype(object) for x in part(batch)])
        yield pa.RecordBatch.from_pydict({"part": pa.array([pickle.dumps(total)], pa.binary())})

    parts = rows.mapInArrow(tidied(run), "part binary").rdd.map(lambda row: pickle.loads(bytes(row[0])))
    return parts.treeAggregate(None, added, added)


def below(sums: np.ndarray, counts: np.ndarray, old: np.ndarray) -> np.ndarray:
    """floor(sum / count) by component, and old where the count is 0. All of Python ints; sums and old have one axis more."""
    some = np.where(counts == 0, 1, counts)[..., None]
    return np.where((counts == 0)[..., None], old, sums // some)
