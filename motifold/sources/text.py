"""Readers of sequence files, each with its own strictness, and sinks."""

from __future__ import annotations

import warnings
from pathlib import PurePosixPath
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from motifold.functions.flexibility import feature_names
from motifold.functions.sequences import stripped

#: Names of the pre-split files, the second one's spelling included.
SPLIT_FILES = {"train": "train_set.txt", "val": "vaild_set.txt", "test": "test_set.txt"}


def lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, value): physical lines with the name of their file."""
    return spark.read.text(path).select(F.element_at(F.split("_metadata.file_name", "/"), -1).alias("file"), "value")


def numbered_lines(spark: SparkSession, path: str | list[str], most: int | None = None) -> DataFrame:
    """(file, line, value): physical lines, numbered from 0 in the order of file paths and, within a file, of bytes; with most,
    the first so many of all files together.

    A task knows the order of the lines of its block alone; a count for each block, added up over the blocks before it, gives
    the rest. So no task gets all lines, and no lines are shuffled for `most`: only few blocks have a line below it.
    """
    text = spark.read.text(path)
    raw = text.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("_id"), "value")
    counts = raw.groupBy("path", "block").agg(F.count("*").alias("_n"), F.min("_id").alias("_first"))  # a row for each block
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    files = counts.groupBy("path").agg(F.sum("_n").alias("_lines"))  # a row for each file
    files = files.select("path", F.coalesce(F.sum("_lines").over(earlier(Window.orderBy("path"))), F.lit(0)).alias("_base"))
    before = F.col("_base") + F.coalesce(F.sum("_n").over(earlier(Window.partitionBy("path").orderBy("block"))), F.lit(0))
    blocks = counts.join(files, "path").withColumn("_before", before).select("path", "block", "_first", "_before")
    if most is not None:
        blocks = F.broadcast(blocks.where(F.col("_before") < most))  # a block has a line at least, so `most` rows at most
    numbered = raw.join(blocks, ["path", "block"]).withColumn("line", F.col("_before") + F.col("_id") - F.col("_first"))
    if most is not None:
        numbered = numbered.where(F.col("line") < most)
    return numbered.select(F.element_at(F.split("path", "/"), -1).alias("file"), "line", "value")


def one_per_line(raw: DataFrame) -> DataFrame:
    """raw (file, value and more: of lines, or of numbered_lines, blank lines being counted there) with seq for value: stripped and
    upper-cased. Blank lines are no rows."""
    seq = F.upper(stripped(F.col("value"))).alias("seq")
    return raw.select(*(c for c in raw.columns if c != "value"), seq).where("seq <> ''")


def strict_pairs(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(seq, score) from lines of exactly two tab-separated fields. Any other line, or a score that is no number, is an error when read."""
    raw = lines(spark, path).where(stripped(F.col("value")) != "")
    parts = F.split("value", "\t")
    seq = F.when(F.size(parts) == 2, F.upper(stripped(parts[0]))).otherwise(F.raise_error(F.concat(F.lit("not two fields: "), "value")))
    return raw.select("file", seq.alias("seq"), F.get(parts, F.lit(1)).cast("double").alias("score"))


def _fields(raw: DataFrame) -> DataFrame:
    """raw with seq, told, third and fields. A line is split once: what a generator gives isn't worked out again by its users."""
    split = F.explode(F.array(F.split(stripped(F.col("value")), r"\s+"))).alias("_parts")
    part = lambda i: F.get("_parts", F.lit(i))
    return raw.select("*", split).select(*raw.columns, F.upper(part(0)).alias("seq"), part(1).alias("told"), part(2).alias("third"), F.when(part(0) == "", 0).otherwise(F.size("_parts")).alias("fields"))


def number(text: Column) -> Column:
    """A finite number, or null."""
    value = text.try_cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)


def half_strict_pairs(raw: DataFrame) -> DataFrame:
    """(file, seq, score) from white-space separated lines: fewer than two fields are no row, a bad score is an error."""
    return _fields(raw).where("fields >= 2").select("file", "seq", F.col("told").cast("double").alias("score"))


def judged_pairs(raw: DataFrame, k: int = 6) -> DataFrame:
    """Each line with what a lenient reader makes of it: file, seq, score, count, grp and reason (null: a row).

    Further columns of raw come after these. Reasons, the first that holds: blank, fields (fewer than two), score (no finite number), short (fewer than k letters).
    """
    more = [c for c in raw.columns if c not in ("file", "value")]
    found = _fields(raw).select("file", "seq", "fields", "third", *more, F.inline(F.array(F.struct(number(F.col("told")).alias("score"), number(F.col("third")).alias("count")))))
    reason = F.when(F.col("fields") == 0, "blank").when(F.col("fields") < 2, "fields").when(F.col("score").isNull(), "score").when(F.length("seq") < k, "short")
    return found.select("file", "seq", "score", "count", F.col("third").alias("grp"), reason.alias("reason"), *more)


def lenient_pairs(raw: DataFrame, k: int = 6) -> DataFrame:
    """(file, seq, score, count, grp) of the lines without a reason against them."""
    return judged_pairs(raw, k).where("reason is null").drop("reason")


def whole_pairs(raw: DataFrame, k: int = 6) -> DataFrame:
    """lenient_pairs, for a source that mustn't be empty: ValueError at once if no line is a row."""
    out = lenient_pairs(raw, k)
    if out.isEmpty():
        raise ValueError("no line is a row")
    return out


def split_directory(spark: SparkSession, folder: str) -> DataFrame:
    """(split, seq, score, grp) from the three pre-split files; no length is asked for here."""
    parts = [lenient_pairs(lines(spark, f"{folder}/{name}"), 0).select(F.lit(split).alias("split"), "seq", "score", "grp") for split, name in SPLIT_FILES.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def fasta(spark: SparkSession, path: str, chromosomes: list[str] | None = None) -> DataFrame:
    """(chrom, start, seq) a row for each line of a FASTA file, upper-cased, start counted from 0 within its record.

    Records needn't fit a row or a block: a line belongs to the last header before it in its file, and starts count on from
    block to block. ValueError at once if none of the chromosomes is there.
    """
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
    head = F.when(F.col("value").startswith(">"), F.split(F.substring("value", F.lit(2), F.length("value")), r"\s+")[0])
    rows = raw.select("file", "block", F.monotonically_increasing_id().alias("line"), head.alias("head"), F.upper(stripped(F.col("value"))).alias("seq"))
    # Lines of a block keep their order; what a block begins with comes from the blocks before it: a row for each block.
    last = F.max_by("head", F.when(F.col("head").isNotNull(), F.col("line"))).alias("last")
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = rows.groupBy("file", "block").agg(last).select("file", "block", F.last("last", True).over(earlier).alias("before"))
    own = Window.partitionBy("file", "block").orderBy("line")
    placed = rows.join(F.broadcast(carried), ["file", "block"]).withColumn("chrom", F.coalesce(F.last("head", True).over(own), "before"))
    body = placed.where("head is null and seq <> '' and chrom is not null")
    if chromosomes is not None:
        body = body.where(F.col("chrom").isin(chromosomes))
        if body.isEmpty():
            raise ValueError(f"none of {chromosomes} in {path}")
    sums = body.groupBy("file", "chrom", "block").agg(F.sum(F.length("seq")).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file", "chrom").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inner = F.coalesce(F.sum(F.length("seq")).over(Window.partitionBy("file", "chrom", "block").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return body.join(sums.withColumn("base", before).drop("n"), ["file", "chrom", "block"]).select("chrom", (F.col("base") + inner).cast("long").alias("start"), "seq")


def file_profile(raw: DataFrame) -> DataFrame:
    """A row for each file: usable and bad rows, the commonest length, the length histogram, ranges of score and third column.

    One pass and one aggregation by file and length; the rest is about those few rows.
    """
    rows = judged_pairs(raw, 1).where("reason is null or reason <> 'blank'")
    length = F.when(F.col("reason").isNull(), F.length("seq"))
    of_usable = lambda c: F.when(F.col("reason").isNull(), F.col(c))
    ranges = [f(of_usable(c)).alias(f"{name}_{end}") for c, name in (("score", "score"), ("count", "third_col")) for end, f in (("min", F.min), ("max", F.max))]
    parts = rows.groupBy("file", length.alias("length")).agg(F.count("*").alias("n"), F.count(of_usable("count")).alias("present"), *ranges)
    usable = F.when(F.col("length").isNotNull(), F.struct("length", "n"))
    listed = F.array_sort(F.array_compact(F.collect_list(usable)))
    told = F.array_join(F.transform(listed, lambda x: F.concat(x["length"].cast("string"), F.lit(":"), x["n"].cast("string"))), ",")
    count = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    out = parts.groupBy("file").agg(
        count(F.col("length").isNotNull()).alias("usable_rows"),
        count(F.col("length").isNull()).alias("bad_rows"),
        F.min("score_min").alias("score_min"),
        F.max("score_max").alias("score_max"),
        F.sum("present").alias("third_col_present_rows"),
        F.min("third_col_min").alias("third_col_min"),
        F.max("third_col_max").alias("third_col_max"),
        F.max_by("length", F.when(F.col("length").isNotNull(), F.struct("n", -F.col("length")))).alias("top_length"),
        told.alias("length_counts"),
    )
    return out.withColumn("length_counts", F.when(F.col("usable_rows") > 0, F.col("length_counts")))


def first_files(spark: SparkSession, folder: str, pattern: str = "*.txt", most: int | None = None) -> list[str]:
    """Paths of a folder's files in order of their names, at most so many; only names are listed."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path").orderBy("path")
    return [x["path"] for x in (found.limit(most) if most else found).collect()]


class NormStats(NamedTuple):
    names: list[str] | None
    mean: list[float]
    std: list[float]


def parsed_stats(content: dict, names: list[str] | None = None, least: float = 1e-8) -> NormStats | None:
    """Statistics of a parsed stats file in any of its three layouts; None if it is none of them.

    Layouts: lists mean and std; lists means and stds; or {feature: {mean, std}} in the order of names. A deviation under
    `least` becomes 1. ValueError if the file's own feature names differ from names.
    """
    content = content.get("flex_norm_stats", content)
    own = content.get("feature_names")
    if own and names and list(own) != list(names):
        raise ValueError("the statistics are of other features, or in another order")
    for mean, std in (("mean", "std"), ("means", "stds")):
        if isinstance(content.get(mean), list) and isinstance(content.get(std), list):
            return NormStats(own or names, [float(x) for x in content[mean]], [1.0 if float(x) < least else float(x) for x in content[std]])
    if names and all(isinstance(content.get(x), dict) for x in names):
        return NormStats(names, [float(content[x]["mean"]) for x in names], [1.0 if float(content[x]["std"]) < least else float(content[x]["std"]) for x in names])
    return None


def told_stats(stats: DataFrame, most_windows: int | None = None) -> dict:
    """Statistics (feature, n_tokens, mean, std; of twelve features a few rows) in the flat layout that parsed_stats reads."""
    rows = {x["feature"]: x for x in stats.collect()}
    names = [n for n in feature_names() if n in rows] + sorted(rows.keys() - set(feature_names()))
    return {"feature_names": names, "mean": [rows[n]["mean"] for n in names], "std": [rows[n]["std"] for n in names], "n_tokens": rows[names[0]]["n_tokens"] if names else 0, "max_windows_used": most_windows}


def write_stats(stats: DataFrame, path: str, most_windows: int | None = None) -> None:
    """told_stats as a YAML text file, through Spark's own writer."""
    import yaml

    spark = stats.sparkSession
    text = yaml.safe_dump(told_stats(stats, most_windows), sort_keys=False)
    spark.createDataFrame([(text.rstrip("\n"),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_stats(spark: SparkSession, path: str, names: list[str] | None = None) -> NormStats | None:
    """Statistics of a file in any of the layouts; of another content a warning, and None."""
    found = parsed_stats(read_yaml(spark, path), names)
    if found is None:
        warnings.warn(f"{path} has no statistics; they are not used", stacklevel=2)
    return found


def read_yaml(spark: SparkSession, path: str) -> dict:
    """A small YAML file, through Spark's own reader."""
    import yaml

    return yaml.safe_load("\n".join(x["value"] for x in spark.read.option("wholetext", True).text(path).collect()))


def write_lines(df: DataFrame, path: str, column: str = "seq", by: str | None = None) -> None:
    """A line for each row; with by (a split, say) in a folder for each of its values."""
    if by is None:
        df.select(F.col(column).cast("string").alias("value")).write.mode("overwrite").text(path)
    else:
        df.select(by, F.col(column).cast("string").alias("value")).write.mode("overwrite").partitionBy(by).text(path)


def write_csv(df: DataFrame, path: str) -> None:
    """A small result table, in one file with a header."""
    df.coalesce(1).write.mode("overwrite").csv(path, header=True)


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def file_name(path: str) -> str:
    return PurePosixPath(path).name
