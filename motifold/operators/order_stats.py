"""Exact medians of groups of any size, without a group's values in one task.

Values of a large group are narrowed from both sides: quantiles of a summary that tasks combine give a bracket around the
wanted rank, an exact count tells in which part of it the rank lies, and so on until few values, or equal ones, are left.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Values of a group, or of a bracket, up to which one task sorts them.
MOST_VALUES = 1 << 20
#: Brackets of one round; the summary's error is far less than a bracket.
BRACKETS = 128
ACCURACY = 10_000


def _next(x: float, up: bool) -> float:
    """The double next to x; NaN counts as the greatest."""
    if math.isnan(x):
        return x if up else math.inf
    return math.nan if up and x == math.inf else math.nextafter(x, math.inf if up else -math.inf)


def large_groups(rows: DataFrame, by: list[str], value: str, most: int) -> list[tuple[tuple, int]]:
    """Groups of more than `most` values, with their number; fewer than rows / most."""
    counts = rows.groupBy(*by).agg(F.count(value).alias("_n")).where(F.col("_n") > most)
    return [(tuple(r[c] for c in by), r["_n"]) for r in counts.collect()]


def ranked_values(rows: DataFrame, by: list[str], value: str, wanted: list[tuple[tuple, int, int]], most: int = MOST_VALUES) -> dict[tuple[tuple, int], float]:
    """The value of each wanted (group, rank from 1, number of the group's values). Nulls have no rank, NaN the greatest."""
    spark = rows.sparkSession
    values = rows.select(*by, F.col(value).cast("double").alias("_v")).where("_v is not null")
    kinds = [f for f in rows.schema.fields if f.name in by]
    schema = T.StructType([*kinds, *(T.StructField(n, T.DoubleType()) for n in ("_low", "_high", "_a", "_b")), T.StructField("_task", T.IntegerType())])
    # Of each task: the group, the rank within what is left, and the bounds of that, both included.
    left = {i: (group, rank, n, -math.inf, math.nan) for i, (group, rank, n) in enumerate(wanted)}
    found: dict[int, float] = {}
    stalled: set[int] = set()  # brackets that left more than half of the values

    def met(cuts: dict[int, tuple[float, float]]) -> DataFrame:
        told = spark.createDataFrame([(*left[i][0], left[i][3], left[i][4], *cuts.get(i, (0.0, 0.0)), i) for i in left], schema)
        key = lambda df: F.struct(*(df[c] for c in by)) if by else F.lit(1)  # noqa: E731  nulls are equal within
        told = F.broadcast(told.select(key(told).alias("_key"), "_low", "_high", "_a", "_b", "_task"))  # two rows a group
        return values.withColumn("_key", key(values)).join(told, "_key").where("_v between _low and _high")

    while left:
        few = {i for i, t in left.items() if t[2] <= most}
        if few:
            lists = met({}).where(F.col("_task").isin([*few])).groupBy("_task").agg(F.sort_array(F.collect_list("_v")).alias("_vs"))
            rank = reduce(lambda rest, i: F.when(F.col("_task") == i, left[i][1]).otherwise(rest), few, F.lit(1))
            for r in lists.select("_task", F.element_at("_vs", rank.cast("int")).alias("_v")).collect():
                found[r["_task"]] = r["_v"]
            left = {i: t for i, t in left.items() if i not in few}
            continue
        shares = [i / BRACKETS for i in range(BRACKETS + 1)]
        quantiles = met({}).groupBy("_task").agg(F.percentile_approx("_v", shares, ACCURACY).alias("_q")).collect()
        cuts = {}
        for r in quantiles:
            _, rank, n, _, _ = left[r["_task"]]
            at = min(int(rank / n * BRACKETS), BRACKETS - 1)
            wide = r["_task"] not in stalled  # else one value, which is found or goes with all on one side of it
            cuts[r["_task"]] = (r["_q"][max(0, at - 1) if wide else at], r["_q"][min(BRACKETS, at + 2) if wide else at])
        counts = met(cuts).groupBy("_task").agg(F.count_if(F.col("_v") < F.col("_a")).alias("below"), F.count_if(F.col("_v") <= F.col("_b")).alias("upto")).collect()
        for r in counts:
            i, (group, rank, n, low, high), (a, b) = r["_task"], left[r["_task"]], cuts[r["_task"]]
            if rank <= r["below"]:
                left[i] = group, rank, r["below"], low, _next(a, False)
            elif rank > r["upto"]:
                left[i] = group, rank - r["upto"], n - r["upto"], _next(b, True), high
            else:
                left[i] = group, rank - r["below"], r["upto"] - r["below"], a, b
                if a == b or math.isnan(a):
                    found[i] = a
            stalled = stalled | {i} if 2 * left[i][2] > n else stalled - {i}
        left = {i: t for i, t in left.items() if i not in found}
    return {(group, rank): found[i] for i, (group, rank, _) in enumerate(wanted)}


def medians(rows: DataFrame, by: list[str], value: str, most: int = MOST_VALUES, name: str = "median") -> DataFrame:
    """(by, median) of every group: the middle value, or the mean of both. A group without values has null.

    Groups of up to `most` values are sorted by a task each, larger ones by ranked_values, all together; both are exact.
    """
    large = large_groups(rows, by, value, most)
    if not large:
        return rows.groupBy(*by).agg(F.median(value).alias(name))
    wanted = [(group, rank, n) for group, n in large for rank in sorted({(n + 1) // 2, n // 2 + 1})]
    found = ranked_values(rows, by, value, wanted, most)
    own: dict[tuple, list[float]] = {}
    for group, rank, _ in wanted:
        own.setdefault(group, []).append(found[group, rank])
    kinds = [f for f in rows.schema.fields if f.name in by]
    told = rows.sparkSession.createDataFrame([(*g, sum(v) / len(v)) for g, v in own.items()], T.StructType([*kinds, T.StructField(name, T.DoubleType())]))
    if not by:
        return told
    key: Column = F.struct(*by).alias("_key")
    small = rows.withColumn("_key", key).join(F.broadcast(told.select(key)), "_key", "left_anti").groupBy(*by).agg(F.median(value).alias(name))
    return small.unionByName(told)
