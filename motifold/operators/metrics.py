"""Regression metrics from sums, with each policy for constant columns spelled out; calibration; losses; summaries."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from motifold.functions.sequences import resolve_column
from motifold.operators import order_stats

#: What R2 is where the observed values don't vary: by a least sum of squares, by a small addend, null, or as common libraries do.
R2_POLICIES = ("clamp", "add", "null", "exact")


def squares_left(y: str, p: str) -> Column:
    return F.sum((F.col(y) - F.col(p)) ** 2)


def r2(y: str, p: str, policy: str = "clamp") -> Column:
    """1 - squares left / squares about the mean. Not the squared correlation."""
    total = F.var_pop(y) * F.count(F.lit(1))
    left = squares_left(y, p)
    if policy == "clamp":
        return 1 - left / F.greatest(total, F.lit(1e-12))
    if policy == "add":
        return 1 - left / (total + 1e-12)
    if policy == "null":
        return F.when(total >= 1e-12, 1 - left / F.nullif(total, F.lit(0.0)))
    if policy == "exact":
        return F.when(total > 0, 1 - left / F.nullif(total, F.lit(0.0))).when(left == 0, 1.0).otherwise(0.0)
    raise ValueError(f"R2 policy {policy!r}; there are {R2_POLICIES}")


def pearson(y: str, p: str, constant: float | None = 0.0) -> Column:
    """Correlation; `constant` (or null) where a column doesn't vary."""
    spread = F.stddev_pop(y) * F.stddev_pop(p)
    return F.when(spread > 0, F.covar_pop(y, p) / F.nullif(spread, F.lit(0.0))).otherwise(F.lit(constant).cast("double"))


def pearson_added(y: str, p: str, addend: float = 1e-12) -> Column:
    return F.covar_pop(y, p) / (F.stddev_pop(y) * F.stddev_pop(p) + addend)


def rmse(y: str, p: str) -> Column:
    return F.sqrt(F.avg((F.col(y) - F.col(p)) ** 2))


def calibration(y: str, p: str, identity: bool = False) -> tuple[Column, Column]:
    """(slope, intercept) of y by p. Where p doesn't vary: slope 0 through the mean, or with identity slope 1 through both means."""
    varies = F.var_pop(p) >= 1e-12
    flat = 1.0 if identity else 0.0
    slope = F.when(varies, F.covar_pop(p, y) / F.nullif(F.var_pop(p), F.lit(0.0))).otherwise(flat)
    return slope, F.avg(y) - slope * F.avg(p)


def calibrated(rows: DataFrame, by: list[str], y: str, p: str, fitted: Column, identity: bool = True) -> DataFrame:
    """rows with a column calibrated: p after the line that fits y on the rows for which `fitted` holds, in each group.

    Fitted on validation rows, it is applied to all, so to test rows as well. A group without such rows has nulls.
    """
    some = rows.where(fitted).select(*by, F.col(y).cast("double").alias("_y"), F.col(p).cast("double").alias("_p"))
    slope, intercept = calibration("_y", "_p", identity)
    lines = some.groupBy(*by).agg(slope.alias("_slope"), intercept.alias("_intercept"))
    out = rows.join(lines, by, "left") if by else rows.crossJoin(F.broadcast(lines))
    return out.withColumn("calibrated", F.col("_slope") * F.col(p) + F.col("_intercept")).drop("_slope", "_intercept")


def weighted_total(parts: dict[str, tuple[float, Column]]) -> Column:
    """Sum of losses times weights. A loss of weight 0 is inactive: it may be null or NaN."""
    return reduce(lambda a, b: a + b, (w * loss for w, loss in parts.values() if w), F.lit(0.0))


def huber(left: Column, delta: float = 1.0) -> Column:
    return F.when(F.abs(left) <= delta, 0.5 * left**2).otherwise(delta * (F.abs(left) - 0.5 * delta))


def masked_loss(loss: Column, mask: Column) -> Column:
    """Mean over rows whose mask is not 0; 0 without any."""
    return F.coalesce(F.avg(F.when(mask != 0, loss)), F.lit(0.0))


def cross_entropy(logits: Column, label: Column) -> Column:
    """Of an array of logits and a label from 0, null where the label is (an ignored token)."""
    top = F.array_max(logits)
    total = F.aggregate(logits, F.lit(0.0), lambda s, x: s + F.exp(x - top))
    return F.when(label.isNotNull(), F.ln(total) + top - F.get(logits, label))


def summary(rows: DataFrame, by: list[str], value: str, sample: bool = True, fill: float | None = None, accuracy: int | None = None, most: int = order_stats.MOST_VALUES) -> DataFrame:
    """count, mean, median, std, min and max of each group; std of a sample or of a population, a missing one as fill.

    The median is exact, a large group's too (see order_stats.medians, whose `most` this is); with accuracy, it is one of
    the values, of a rank that is off by at most n / accuracy, from summaries that tasks combine.
    """
    deviation = (F.stddev_samp if sample else F.stddev_pop)(value)
    if fill is not None:
        deviation = F.coalesce(deviation, F.lit(fill))
    parts = {"n": F.count(value), "mean": F.avg(value), "median": F.percentile_approx(value, 0.5, accuracy) if accuracy else F.median(value), "std": deviation, "min": F.min(value), "max": F.max(value)}
    columns = [c.alias(n) for n, c in parts.items()]
    if accuracy or not order_stats.large_groups(rows, by, value, most):
        return rows.groupBy(*by).agg(*columns)
    rest = rows.groupBy(*by).agg(*(c.alias(n) for n, c in parts.items() if n != "median"))
    middle = order_stats.medians(rows, by, value, most)
    if not by:
        return rest.crossJoin(F.broadcast(middle)).select(*parts)  # a row each
    key = lambda df: F.struct(*(df[c] for c in by))  # noqa: E731  nulls are equal within
    told = rest.withColumn("_key", key(rest)).join(middle.select(key(middle).alias("_key"), "median"), "_key")
    return told.select(*by, *parts)


def mean_over(rows: DataFrame, by: list[str], value: str, mean: str) -> DataFrame:
    """(by, mean): the mean of value over all that `by` leaves out; rows that come with their mean already are passed through."""
    if value in rows.columns:
        return rows.groupBy(*by).agg(F.avg(value).alias(mean))
    return rows.select(*by, resolve_column(rows, [mean, f"mean_{value}", f"{value}_mean"])).toDF(*by, mean)


def in_order(summed: DataFrame, by: str, order: list[str]) -> DataFrame:
    """A row for each name of an order, with nulls for those that are missing; others go."""
    names = summed.sparkSession.createDataFrame(list(enumerate(order)), f"turn int, {by} string")
    return names.join(summed, by, "left")


def labelled_union(parts: dict[str, DataFrame], label: str) -> DataFrame:
    return reduce(DataFrame.unionByName, [df.withColumn(label, F.lit(name)) for name, df in parts.items()])


def best_choice(scores: DataFrame, by: list[str], score: str, turn: str) -> DataFrame:
    """The row of the highest score of each group, of equal ones the first by turn; null scores lose."""
    rest = [c for c in scores.columns if c not in by]
    best = F.max_by(F.struct(*rest), F.struct(F.coalesce(F.col(score), F.lit(float("-inf"))), -F.col(turn)))
    return scores.groupBy(*by).agg(best.alias("best")).select(*by, "best.*")


def unfinished(keys: DataFrame, results: DataFrame, key: str, value: str) -> DataFrame:
    """Keys without a result: a missing row, a null, an empty text or a NaN is none."""
    done = results.where(F.col(value).isNotNull() & ~F.lower(F.trim(F.col(value).cast("string"))).isin("", "nan")).select(key).distinct()
    return keys.join(done, key, "left_anti")


def with_metric(rows: DataFrame, metric: DataFrame, key: str) -> DataFrame:
    """rows with the further columns of metric (one row a key); rows without one have nulls."""
    return rows.join(metric, key, "left")


def resumed(keys: DataFrame, results: DataFrame | None, key: str, value: str, work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Results for all keys: those that are complete stay, `work` makes the others', and incomplete ones are replaced."""
    if results is None:
        return work(keys)
    left = unfinished(keys, results, key, value)
    return results.join(left, key, "left_anti").unionByName(work(left))


def save_resumed(spark: SparkSession, keys: DataFrame, path: str, key: str, value: str, work: Callable[[DataFrame], DataFrame]) -> None:
    """resumed() over the parts of a result table at path, `run=0` and so on: each run adds a part with what was unfinished.

    Earlier parts are never rewritten, so a run that dies leaves them whole; read_resumed() takes each key's last part.
    """
    before = read_resumed(spark, path, key)
    left = keys if before is None else unfinished(keys, before, key, value)
    number = 0 if before is None else spark.read.parquet(path).agg(F.max("run")).first()[0] + 1
    work(left).write.mode("overwrite").parquet(f"{path}/run={number}")


def read_resumed(spark: SparkSession, path: str, key: str) -> DataFrame | None:
    """Each key's row of the last run that has it; None before the first run."""
    try:
        rows = spark.read.parquet(path)
    except AnalysisException:
        return None
    rest = [c for c in rows.columns if c not in (key, "run")]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), "run").alias("_last")).select(key, "_last.*")


def grid(*axes: DataFrame) -> DataFrame:
    """Every combination of a few small tables of choices."""
    return reduce(lambda a, b: a.crossJoin(F.broadcast(b)), axes)
