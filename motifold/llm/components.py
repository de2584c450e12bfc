"""Connected components of an edge table, by alternating large-star and small-star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motifold.llm.shared import FEW_ROWS, cut, spread_join


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (a, b), component being the smallest node that is reachable.

    Each round joins edges with the smallest neighbour of each node and drops repeats; the edges become stars. A node with
    a large share of all edges is joined by broadcast, so no task gets its edges. Only a count and a checksum of each
    round reach the driver. Self-loops and nulls are left out; no edges give no rows.
    """
    now = cut(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct())
    seen = _mark(now)
    while seen[0]:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"), F.count_if(F.col("b") > F.col("a")).alias("_n"))
        # Every larger neighbour moves to the smallest node around.
        large = spread_join(now, least, ["a"], seen[0]).select(F.col("m").alias("a"), "b").where("a < b")
        large = large if seen[0] <= FEW_ROWS else cut(large)  # it is read several times
        least = large.groupBy("b").agg(F.min("a").alias("m"), F.count("*").alias("_n"))
        # Every smaller neighbour moves to the smallest among them.
        joined = spread_join(large, least, ["b"], seen[0])
        small = joined.select(F.col("m").alias("a"), "b").union(joined.where("a > m").select(F.col("m").alias("a"), F.col("a").alias("b")))
        now = cut(small.where("a < b").distinct())
        before, seen = seen, _mark(now)
        if seen == before:
            break
    return now.select(F.col("b").alias("node"), F.col("a").alias("component")).union(now.select(F.col("a"), F.col("a")).distinct())


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("x")).first()
    return row["n"], row["x"]
