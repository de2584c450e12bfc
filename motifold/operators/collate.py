"""Batches of sequences of like length, over a whole table, and their padding.

Lengths fall in buckets whose longest is less than 1 + 1 / STEPS times the shortest, so less than 1 / (STEPS + 1) of a batch
is padding, however lengths are spread. A bucket's rows are put in a random order by ranges of their draws, so no task holds
a bucket, and cut into batches of at most so many padded tokens.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motifold.functions.hashing import ranked

#: Buckets from a power of two to the next.
STEPS = 8
#: Padded tokens of a batch.
MOST_TOKENS = 1 << 14


def length_bucket(length: Column, steps: int = STEPS) -> Column:
    """The number of a length's bucket: each range from a power of two to the next has `steps` even parts. Null below 1."""
    power = F.length(F.bin(length)) - 1
    whole = F.pow(F.lit(2), power)
    return F.when(length > 0, power * steps + F.floor((length - whole) * steps / whole)).cast("int")


def longest_of(bucket: Column, steps: int = STEPS) -> Column:
    """The greatest length that a bucket has."""
    part = F.pmod(bucket, F.lit(steps))
    whole = F.pow(F.lit(2), (bucket - part) / steps)
    return (F.ceil(whole * (part + steps + 1) / steps) - 1).cast("long")


def length_batches(rows: DataFrame, length: str, key: str, most_tokens: int = MOST_TOKENS, steps: int = STEPS, seed: int = 42) -> DataFrame:
    """rows with bucket and batch (a number within the bucket): no batch has more than most_tokens tokens with its padding,
    unless it is a single row. Another seed gives other batches.

    Rows without tokens (length null or under 1) are in no batch, and have null. Rows of one key keep the order that the
    shuffle gives them, so keys should be unique.
    """
    marked = rows.withColumn("bucket", length_bucket(F.col(length), steps))
    most = longest_of(F.col("bucket"), steps)
    room = F.greatest(F.lit(1), F.floor(F.lit(most_tokens) / most))
    order = ranked(marked, seed, key, "bucket", "_rank").withColumn("batch", F.when(F.col("bucket").isNotNull(), F.floor((F.col("_rank") - 1) / room)))
    return order.drop("_rank")


def collated(batches: DataFrame, length: str, key: str, padding: dict[str, Column]) -> DataFrame:
    """A row for each batch of length_batches: bucket, batch, n, longest, keys, lengths, mask, and the columns of `padding`.

    padding: by array column (one value for each token) what fills it up to the batch's longest row. keys and lengths are
    arrays of rows in the order of their keys, the others arrays of such arrays; mask is 1 for a token and 0 for padding.
    A row whose array has another size than its length is filled or cut to the longest as well.
    """
    own = F.struct(F.col(key).alias("key"), F.col(length).cast("int").alias("length"), *(F.col(c) for c in padding))
    held = batches.where("batch IS NOT NULL").groupBy("bucket", "batch").agg(F.sort_array(F.collect_list(own)).alias("_rows"), F.max(length).cast("int").alias("longest"))
    longest = F.col("longest")
    filled = lambda values, value: F.slice(F.concat(values, F.array_repeat(value, longest)), F.lit(1), longest)
    column = lambda c, value: F.transform("_rows", lambda r: filled(F.coalesce(r[c], F.array()), value)).alias(c)
    return held.select(
        "bucket",
        "batch",
        F.size("_rows").alias("n"),
        "longest",
        F.col("_rows.key").alias("keys"),
        F.col("_rows.length").alias("lengths"),
        F.transform("_rows", lambda r: filled(F.array_repeat(F.lit(1), r["length"]), F.lit(0))).alias("mask"),
        *(column(c, value) for c, value in padding.items()),
    )
