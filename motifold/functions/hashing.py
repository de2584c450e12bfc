"""Random decisions as pure functions of a seed and a key: the same for any partitioning, and in SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit values spread evenly (splitmix64's finish), for draws within tasks."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def draw(seed: int | str, *keys: str | Column) -> Column:
    """A whole number from 0 to 2**32 - 1."""
    text = F.concat_ws("|", F.lit(str(seed)), *(F.col(k).cast("string") if isinstance(k, str) else k for k in keys))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def unit(seed: int | str, *keys: str | Column) -> Column:
    """A number from 0 to 1."""
    return draw(seed, *keys) / float(1 << 32)


def ranked(df: DataFrame, seed: int | str, key: str, within: str | None = None, name: str = "rank", ties: tuple[str, ...] = ()) -> DataFrame:
    """A random order from 1, of all rows or within each group (null being one). ties: columns that order rows of one key.

    No task sorts all rows, or a whole group: rows are counted by ranges of their draws, and each range of each group is
    ranked by itself, after the ranges before it.
    """
    drawn = df.withColumns({"_draw": draw(seed, key), "_group": F.struct(within) if within else F.lit(0)})
    drawn = drawn.withColumn("_range", F.shiftright("_draw", 16).cast("int"))  # 65,536 ranges of equal width
    counts = drawn.groupBy("_group", "_range").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy("_group").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("_group", "_range", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_group", "_range").orderBy("_draw", key, *ties))
    out = drawn.withColumn("_own", own).join(before if within else F.broadcast(before), ["_group", "_range"])
    return out.withColumn(name, (F.col("_own") + F.col("_before")).cast("long")).drop("_group", "_draw", "_range", "_own", "_before")
