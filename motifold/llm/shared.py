"""Shared folder handling: every cut in a lineage lands where all executors can read it."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """A new path under spark.checkpoint.dir. Where that is unset: a temporary folder on one machine (tests), an error on a cluster."""
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not base:
        base = getattr(context, "_motifold_scratch", None)
        if base is None:
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            base = context._motifold_scratch = tempfile.mkdtemp(prefix="spark-motifold-")
    return f"{base.rstrip('/')}/motifold/{context.applicationId}/{uuid.uuid4().hex}"


def free_name(df: DataFrame, wanted: str) -> str:
    """A column name that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def stored(df: DataFrame) -> DataFrame:
    """df written once as Parquet in the shared folder and read back, so that a lost executor costs one reread."""
    spark = df.sparkSession
    path = shared_folder(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint, for the small tables of iterative jobs; Spark removes it with the DataFrame."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def hashed_share(df: DataFrame, rows: int) -> DataFrame:
    """All rows, or, of a larger table, about `rows` of them: those whose content has the smallest hashes. For fitting only.

    Tasks filter by a fixed threshold, so what they hand on is bounded in total, however many they are. Where few
    different rows make up a table, a share by hash may miss them all, or be many; then each different row comes as often
    as its share of the table tells, a fraction being decided by its hash. So the choice is the same for any partitioning.
    """
    count = df.count()
    if count <= rows:
        return df
    some = df.where(F.pmod(F.xxhash64(*df.columns), F.lit(1 << 40)) < F.lit(int((1 << 40) * rows / count)))
    if rows / 2 <= some.count() <= 2 * rows:
        return some
    kept, mark, n = (F.struct(*df.columns).alias("row"), F.xxhash64(*df.columns).alias("mark"), F.count("*").alias("n"))
    different = df.select(kept, mark).groupBy("mark").agg(F.first("row").alias("row"), n)
    copies = F.floor(F.col("n") * (rows / count) + F.pmod("mark", F.lit(1 << 40)) / float(1 << 40)).cast("int")
    return different.where(copies > 0).withColumn("copy", F.explode(F.sequence(F.lit(1), copies))).select("row.*")


#: Keys with more than one in so many of a table's rows are joined by broadcast; there are fewer than that many.
HOT_KEYS = 256
#: Rows of a table up to which all its keys are (some 10 MB).
FEW_ROWS = 200_000


def spread_join(rows: DataFrame, keyed: DataFrame, by: list[str], total: int, few: int | None = None) -> DataFrame:
    """rows joined with keyed on `by`, wherever rows' keys gather. keyed has a row for each key, and in `_n` how many of rows it has.

    total is the number of rows. Of up to few (if not given, FEW_ROWS) rows, all keys are broadcast, as they aren't more. Else keys with over
    total / HOT_KEYS of them, so fewer than HOT_KEYS keys, are broadcast and their rows stay where they are; all others meet
    in a shuffle, no task of which gets much more than its share.
    """
    if total <= (FEW_ROWS if few is None else few):
        return rows.join(F.broadcast(keyed.drop("_n")), by)
    hot = keyed.where(F.col("_n") > total // HOT_KEYS).drop("_n")
    cold = keyed.where(F.col("_n") <= total // HOT_KEYS).drop("_n")
    rest = rows.join(F.broadcast(hot.select(by)), by, "left_anti")
    return rows.join(F.broadcast(hot), by).unionByName(rest.join(cold, by))


#: Rows of a batch that a task works on at once.
BATCH_ROWS = 1000


def tidied(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, for mapInArrow, on batches of BATCH_ROWS rows at most, whatever the session's size is: texts may be long.

    What a task has freed goes back to the system at its end: workers live on, and would keep it.
    """

    def small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, max(1, batch.num_rows), BATCH_ROWS):
                yield batch.slice(first, BATCH_ROWS)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(small(batches))
        gc.collect()
        pa.default_memory_pool().release_unused()
        if hasattr(system := ctypes.CDLL(None), "malloc_trim"):
            system.malloc_trim(0)

    return whole
