"""Statistics over tokens, and how they are applied."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motifold.functions.flexibility import feature_names, kmer_frame
from motifold.functions.sequences import kmers


def kmer_counts(seqs: DataFrame, k: int = 6) -> DataFrame:
    """(kmer, n) over all sequences; tasks combine before the shuffle, so at most 4 ** k rows leave each."""
    return kmers(seqs.select("seq"), k).groupBy("kmer").agg(F.count("*").alias("n"))


def weighted_moments(rows: DataFrame, value: Column, weight: str, by: str) -> DataFrame:
    """(by, n, mean, std): of values that count `weight` times; std is the population's. Centred first, so large offsets do no harm."""
    first = rows.groupBy(by).agg(F.sum(weight).alias("n"), (F.sum(value * F.col(weight)) / F.sum(weight)).alias("mean"))
    away = rows.join(F.broadcast(first), by).groupBy(by, "n", "mean").agg(F.sum(F.col(weight) * (value - F.col("mean")) ** 2).alias("squares"))
    return away.select(by, "n", "mean", F.sqrt(F.col("squares") / F.col("n")).alias("std"))


def first_lines(lines: DataFrame, most: int | None, order: str = "line") -> DataFrame:
    """The first lines by their number from 0 (see text.numbered_lines), blank ones counted; all without a bound."""
    return lines if most is None else lines.where(F.col(order) < most)


def flexibility_stats(seqs: DataFrame, k: int = 6) -> DataFrame:
    """(feature, n_tokens, mean, std) of all valid k-mers, from the counts of distinct ones; a deviation of 0 becomes 1."""
    spark = seqs.sparkSession
    counted = kmer_counts(seqs, k).join(F.broadcast(kmer_frame(spark, k)), "kmer")
    names = F.array(*map(F.lit, feature_names()))
    listed = counted.select("n", F.posexplode("flex").alias("i", "value")).select(F.get(names, F.col("i")).alias("feature"), F.col("n").alias("times"), "value")
    out = weighted_moments(listed, F.col("value"), "times", "feature")
    return out.select("feature", F.col("n").alias("n_tokens"), "mean", F.when(F.col("std") == 0, 1.0).otherwise(F.col("std")).alias("std"))


def normalized(values: Column, mean: list[float], std: list[float]) -> Column:
    """(x - mean) / std by place; a null stays."""
    m, s = F.array(*map(F.lit, mean)), F.array(*(F.lit(1.0 if x == 0 else x) for x in std))
    return F.transform(values, lambda x, i: (x - F.get(m, i)) / F.get(s, i))


def train_moments(rows: DataFrame, values: str, train: Column) -> DataFrame:
    """(place, mean, std) over the rows for which train holds; population deviation, as it is."""
    listed = rows.where(train).select(F.posexplode(values).alias("place", "value"))
    return listed.groupBy("place").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))


def standardized(rows: DataFrame, values: str, train: Column, first: int = 0, drop: bool = False, least: float = 1e-8) -> DataFrame:
    """rows with `values` scaled by what the training rows have.

    Places before `first` stay as they are. A deviation under `least` becomes 1, or with drop its place goes. The moments
    are a row for each place, and come to the driver.
    """
    moments = {x["place"]: x for x in train_moments(rows, values, train).collect()}
    keep = [i for i in sorted(moments) if not drop or i < first or moments[i]["std"] > least]
    m = F.array(*(F.lit(0.0 if i < first else moments[i]["mean"]) for i in keep))
    s = F.array(*(F.lit(1.0 if i < first or moments[i]["std"] < least else moments[i]["std"]) for i in keep))
    chosen = F.transform(F.array(*map(F.lit, keep)), lambda i: F.get(values, i)) if len(keep) < len(moments) else F.col(values)
    return rows.withColumn(values, F.transform(chosen, lambda x, i: (x.cast("double") - F.get(m, i)) / F.get(s, i)))


def merged_moments(parts: DataFrame, by: str) -> DataFrame:
    """Moments (by, n, mean, m2) of disjoint parts, merged into one row each: sums about zero, centred on the largest part's mean."""
    about = parts.groupBy(by).agg(F.max_by("mean", "n").alias("centre"))
    moved = parts.join(about, by).withColumn("d", F.col("mean") - F.col("centre"))
    sums = moved.groupBy(by, "centre").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("d")).alias("s"), F.sum(F.col("m2") + F.col("n") * F.col("d") ** 2).alias("q"))
    return sums.select(by, "n", (F.col("centre") + F.col("s") / F.col("n")).alias("mean"), (F.col("q") - F.col("s") ** 2 / F.col("n")).alias("m2"))
