"""Splits, folds, caps, nested subsets and masks: all by hashed order, with exact sizes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from motifold.functions.hashing import draw, ranked, unit


def split_by_share(df: DataFrame, key: str, seed: int = 42, train: float = 0.8, val: float = 0.1, rounding: str = "floor") -> DataFrame:
    """df with a column split (train, val, test). rounding of both sizes: floor, or bankers (half to even)."""
    total = df.count()
    size = {"floor": lambda x: int(total * x), "bankers": lambda x: round(total * x)}[rounding]
    first = min(size(train), total)
    second = min(first + size(val), total)
    rank = F.col("_rank")
    return ranked(df, seed, key, name="_rank").withColumn("split", F.when(rank <= first, "train").when(rank <= second, "val").otherwise("test")).drop("_rank")


def folds(df: DataFrame, key: str, k: int, seed: int = 42, within: str | None = None, ties: tuple[str, ...] = ()) -> DataFrame:
    """df with a column fold from 0; sizes differ by one at most, earlier folds being larger. ties: see ranked."""
    return ranked(df, seed, key, within, "_rank", ties).withColumn("fold", ((F.col("_rank") - 1) % k).cast("int")).drop("_rank")


#: Up to so many rows a group, tasks keep only those of the smallest draws before anything is shuffled.
FEW = 1000


def capped(df: DataFrame, key: str, most: int, within: str, seed: int = 42) -> DataFrame:
    """At most so many rows of each group, a random choice without replacement."""
    if most > FEW:
        return ranked(df, seed, key, within, "_rank").where(F.col("_rank") <= most).drop("_rank")
    order = Window.partitionBy(within).orderBy("_draw", key)
    return df.withColumn("_draw", draw(seed, key)).withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= most).drop("_draw", "_rank")


def subset(df: DataFrame, key: str, size: int, seed: int = 42) -> DataFrame:
    """`size` rows of df at random, all of them if size isn't between 0 and their number. Other sizes are other draws, not more of one."""
    if not 0 < size < df.count():
        return df
    return ranked(df, f"{seed}n{size}", key, name="_rank").where(F.col("_rank") <= size).drop("_rank")


def nested_subsets(df: DataFrame, key: str, percents: list[int] | list[float], seed: int = 42, least: int = 16) -> DataFrame:
    """(percent, all columns of df): subsets of one order, each a prefix of the next; of ceil(n percent / 100) rows, `least` at least."""
    total = df.count()
    sizes = [(p, min(total, max(least, int(-(-total * p // 100))))) for p in percents]
    at = F.explode(F.array(*(F.struct(F.lit(p).alias("percent"), F.lit(n).alias("size")) for p, n in sizes)))
    rows = ranked(df, seed, key, name="_rank").withColumn("_at", at).where("_rank <= _at.size")
    return rows.select(F.col("_at.percent").alias("percent"), *df.columns)


def subset_bands(df: DataFrame, key: str, percents: list[int] | list[float], seed: int = 42, least: int = 16) -> DataFrame:
    """df with a column band: the place in `percents` (ascending) of the smallest of nested_subsets that a row is in; null if none."""
    total = df.count()
    sizes = [min(total, max(least, int(-(-total * p // 100)))) for p in percents]
    band = reduce(lambda rest, x: F.when(F.col("_rank") <= x[1], x[0]).otherwise(rest), reversed(list(enumerate(sizes))), F.lit(None).cast("int"))
    return ranked(df, seed, key, name="_rank").withColumn("band", band).drop("_rank")


def inner_folds(df: DataFrame, key: str, outer: int, inner: int, seed: int = 42, within: str | None = None) -> DataFrame:
    """df with columns outer, a row's fold, and inner, an array with its inner fold in each outer fold.

    Inner folds are drawn anew for each outer fold (seed + 1 + fold) among the rows that it doesn't hold out, in equal sizes;
    it is -1 where the row is held out. within: folds are of each group by itself.
    """
    rows = folds(df, key, outer, seed, within).withColumnRenamed("fold", "outer")
    at = F.explode(F.sequence(F.lit(0), F.lit(outer - 1))).alias("_at")
    group = F.struct(*(F.col(c) for c in ([within] if within else [])), F.col("_at"))
    training = rows.select(key, *([within] if within else []), "outer", at).where("_at <> outer").withColumn("_cell", group)
    # One ranking for all outer folds: by a draw that is salted by the fold.
    salted = training.withColumn("_salted", F.concat_ws("|", (F.col("_at") + seed + 1).cast("string"), F.col(key).cast("string")))
    placed = ranked(salted, seed, "_salted", "_cell", "_rank").select(key, "_at", ((F.col("_rank") - 1) % inner).cast("int").alias("_inner"))
    listed = placed.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("_at", "_inner"))).alias("_map"))
    inner_at = F.transform(F.sequence(F.lit(0), F.lit(outer - 1)), lambda o: F.coalesce(F.try_element_at("_map", o), F.lit(-1)))
    return rows.join(listed, key).withColumn("inner", inner_at).drop("_map")


def forced_position(by: str, count: Column, share: float = 0.15, seed: int = 42) -> Column:
    """Of positions 0 to count - 1 of a row with key `by`, the one that is masked although its draw doesn't say so: that with
    the smallest draw, if no draw does; else null. Looking ends at the first position that is masked by its draw."""
    at = F.when(count > 0, F.sequence(F.lit(0), count - 1))
    drawn = F.exists(at, lambda i: unit(seed, F.col(by), i) < share)
    least = F.array_min(F.transform(at, lambda i: F.struct(draw(seed, F.col(by), i).alias("draw"), i.alias("pos"))))
    return F.when(~drawn, least["pos"])


def masked(by: str, forced: str, pos: str = "pos", share: float = 0.15, seed: int = 42) -> Column:
    """Whether a position is masked: each by itself with the given chance, and one of its row if none is.

    forced: a column with forced_position of the row, made before positions become rows; so nothing is shuffled or joined.
    """
    return (unit(seed, by, pos) < share) | F.coalesce(F.col(pos) == F.col(forced), F.lit(False))


def fixed_position(count: Column, at: int = 2) -> Column:
    """The one position that is masked where masks mustn't vary: `at`, or the last of fewer; null without any."""
    return F.when(count > 0, F.least(F.lit(at), count - 1))


#: Tries for each window that is wanted, at most.
TRIES = 500
#: Tries that are sent to all tasks, a few numbers each.
FEW_TRIES = 1 << 17


def sampled_windows(chunks: DataFrame, count: int, width: int, seed: int = 42, tries: int = TRIES) -> DataFrame:
    """(draw, chrom, start, seq): the first `count` windows of four-base letters only, or as many as `tries` * count tries give.

    chunks: chrom, start, seq, without gaps; they may overlap, and a window must lie within one. Each try picks a chromosome, then a place in it, both
    evenly; duplicates may come. Tries are rows of a range, as many as turn out to be needed; chromosomes are numbered by a
    hashed order, so that neither is in one task.
    """
    spark = chunks.sparkSession
    sizes = chunks.groupBy("chrom").agg(F.max(F.col("start") + F.length("seq")).alias("size"))
    names = ranked(sizes, seed, "chrom", name="_at").withColumn("_at", F.col("_at") - 1).persist()
    total = names.count()

    def accepted(first: int, last: int) -> DataFrame:
        drawn = spark.range(first, last).withColumn("_at", (unit(f"{seed}c", "id") * total).cast("long"))
        picked = drawn.join(names, "_at").where(F.col("size") >= width)
        picked = picked.select("id", "chrom", (unit(f"{seed}s", "id") * (F.col("size") - width + 1)).cast("long").alias("at"))
        picked = F.broadcast(picked) if last - first <= FEW_TRIES else picked  # so that chunks stay where they are
        met = chunks.join(picked, "chrom").where(F.col("at").between(F.col("start"), F.col("start") + F.length("seq") - width))
        windows = met.select(F.col("id").alias("draw"), "chrom", F.col("at").alias("start"), F.substring(F.col("seq"), (F.col("at") - F.col("start") + 1).cast("int"), F.lit(width)).alias("seq"))
        return windows.where(F.col("seq").rlike("^[ACGT]*$")).dropDuplicates(["draw"]).persist()

    made, found, parts = 0, 0, []
    while found < count and made < tries * count:
        more = min(tries * count - made, max(4 * count, int(1.2 * made * (count - found) / found) if found else 4 * made))
        parts.append(accepted(made, made + more))  # kept, so chunks are read once for them
        found += parts[-1].count()
        made += more
    names.unpersist()
    if not parts:
        parts = [accepted(0, 0)]
    return reduce(DataFrame.unionByName, parts).orderBy("draw").limit(count)


def dominant_length(rows: DataFrame, by: str, seq: str, order: str) -> DataFrame:
    """(by, length, n): the commonest length of each group; of equal counts that which comes first by `order`."""
    counts = rows.groupBy(by, F.length(seq).alias("length")).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    best = Window.partitionBy(by).orderBy(F.desc("n"), "first")
    return counts.withColumn("turn", F.row_number().over(best)).where("turn = 1").select(by, "length", "n")


def of_dominant_length(rows: DataFrame, by: str, seq: str, order: str) -> DataFrame:
    found = dominant_length(rows, by, seq, order).select(by, F.col("length").alias("_length"))
    return rows.join(found, by).where(F.length(seq) == F.col("_length")).drop("_length")


def large_groups(rows: DataFrame, by: str, outer_folds: int, per_fold: int = 5, least: int = 100) -> DataFrame:
    """(by, n, enough): whether a group has rows for its folds."""
    return rows.groupBy(by).agg(F.count("*").alias("n")).withColumn("enough", F.col("n") >= max(outer_folds * per_fold, least))
