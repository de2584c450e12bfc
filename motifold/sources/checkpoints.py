"""Numbered versions of a training state in a folder that driver and executors share.

A version is a table of arrays (weights, moments of the optimiser, the best weights so far) and one row of a manifest table,
which is appended last: a version without its row, left by a run that was killed, doesn't count and is overwritten.
"""

from __future__ import annotations

import hashlib
import json
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Arrays = dict[str, np.ndarray]
_ROWS = "name string, shape array<int>, data array<double>"
_MANIFEST = "version long, numbers string, digest string"


def array_rows(spark: SparkSession, arrays: Arrays) -> DataFrame:
    return spark.createDataFrame([(name, list(x.shape), x.astype(float).ravel().tolist()) for name, x in sorted(arrays.items())], _ROWS)


def arrays_of(rows: DataFrame) -> Arrays:
    return {x["name"]: np.array(x["data"], float).reshape(x["shape"]) for x in rows.collect()}


def _digest(arrays: Arrays) -> str:
    told = hashlib.sha256()
    for name, x in sorted(arrays.items()):
        told.update(f"{name}{x.shape}".encode() + x.astype("<f8").tobytes())
    return told.hexdigest()


class Store:
    """Versions in a folder. numbers: what else belongs to a state, as JSON."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _weights(self, version: int) -> str:
        return f"{self.path}/weights/version={version}"

    def manifest(self) -> DataFrame:
        """(version, numbers, digest) of all committed versions; empty if there is none."""
        from pyspark.errors import AnalysisException

        try:
            return self.spark.read.schema(_MANIFEST).parquet(f"{self.path}/manifest")
        except AnalysisException:  # nothing has been written
            return self.spark.createDataFrame([], _MANIFEST)

    def save(self, version: int, arrays: Arrays, numbers: dict[str, Any]) -> None:
        """ValueError if the version is committed already."""
        if not self.manifest().where(F.col("version") == version).isEmpty():
            raise ValueError(f"version {version} is there")
        array_rows(self.spark, arrays).coalesce(1).write.mode("overwrite").parquet(self._weights(version))
        row = [(version, json.dumps(numbers, sort_keys=True), _digest(arrays))]
        self.spark.createDataFrame(row, _MANIFEST).coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")

    def load(self, version: int | None = None) -> tuple[int, Arrays, dict[str, Any]] | None:
        """A version, or the last one; None if there is none. ValueError if its table isn't what was committed."""
        rows = self.manifest() if version is None else self.manifest().where(F.col("version") == version)
        last = rows.orderBy(F.desc("version")).first()
        if last is None:
            return None
        arrays = arrays_of(self.spark.read.parquet(self._weights(last["version"])))
        if _digest(arrays) != last["digest"]:
            raise ValueError(f"version {last['version']} differs from its manifest")
        return last["version"], arrays, json.loads(last["numbers"])
