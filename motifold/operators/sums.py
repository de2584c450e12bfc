"""Sums over all rows of what tasks make of their batches, added in a tree of tasks."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import RDD
from pyspark.sql import DataFrame
from pyspark.storagelevel import StorageLevel

Sums = dict[str, np.ndarray]
#: Numbers that the tasks of a job send straight to the driver, all together (16 MB); more meet in a tree of tasks.
MOST_SENT = 1 << 21


def plus(a: Sums | None, b: Sums | None) -> Sums | None:
    if a is None or b is None:
        return b if a is None else a
    return {k: a[k] + b[k] if k in a and k in b else a.get(k, b.get(k)) for k in {**a, **b}}


def added(total: Sums, own: Sums) -> Sums:
    """total, to which own is added in place; its numbers are in double precision, whatever own's are."""
    for k, v in own.items():
        if k in total:
            total[k] += v
        else:
            total[k] = np.array(v, np.float64)
    return total


def tree_sums(rows: DataFrame, part: Callable[[pa.RecordBatch], Sums]) -> Sums:
    """The sum, by name, of what part makes of each batch that has rows; nothing of an empty table.

    A task hands on one row, and rows meet in a tree of tasks (RDD.treeAggregate), so neither the driver nor a task gets as
    many sums as there are tasks.
    """

    def run(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                total = plus(total, part(batch))
        yield pa.RecordBatch.from_pydict({"part": pa.array([pickle.dumps(total)], pa.binary())})

    found = rows.mapInArrow(run, "part binary").rdd.map(lambda row: pickle.loads(bytes(row[0]))).treeAggregate(None, plus, plus)
    return found or {}


def packed(rows: DataFrame, cut: Callable[[pa.RecordBatch], Iterator[tuple[str, Any]]]) -> RDD:
    """Blocks (tag, bytes) of what cut makes of each batch, kept on disk, for jobs that read the same rows many times."""

    def run(batches):
        for batch in batches:
            for tag, block in cut(batch):
                yield pa.RecordBatch.from_pydict({"tag": [tag], "block": pa.array([pickle.dumps(block)], pa.binary())})

    blocks = rows.mapInArrow(run, "tag string, block binary").rdd.map(lambda row: (row[0], bytes(row[1]))).persist(StorageLevel.DISK_ONLY)
    blocks.foreachPartition(lambda own: None)  # made in a task a partition: a task of several would start Python for each
    return blocks


def block_sums(blocks: RDD, part: Callable[[Any], Sums], numbers: int, tags: tuple[str, ...] | None = None) -> Sums:
    """The sum, by name, of what part makes of each block, or of those with the tags: so many numbers a task. One short job of as
    many tasks as there are slots."""
    slots = blocks.context.defaultParallelism

    def run(own):
        total: Sums = {}
        for tag, block in own:
            if tags is None or tag in tags:
                total = added(total, part(pickle.loads(block)))
        if total:
            yield total

    made = blocks.coalesce(slots).mapPartitions(run)
    if min(slots, blocks.getNumPartitions()) * numbers > MOST_SENT:
        return made.treeAggregate(None, plus, plus) or {}
    total = None
    for own in made.collect():
        total = plus(total, own)
    return total or {}


def exact(x: np.ndarray) -> np.ndarray:
    """x in half the bytes, where that loses nothing."""
    small = x.astype(np.float32)
    return small if np.array_equal(small, x) else x
