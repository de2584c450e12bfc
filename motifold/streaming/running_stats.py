"""Running statistics over a stream: mergeable moments, late rows bounded by a watermark, results that a batch agrees with."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from motifold.operators.normalization import merged_moments


def windowed_stats(events: DataFrame, late: str = "10 minutes", width: str = "1 day", value: str = "value") -> DataFrame:
    """(starts, event_type, n, mean, std) for windows of event time; works on streams and tables alike."""
    grouped = events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type")
    out = grouped.agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))
    return out.select(F.col("w.start").alias("starts"), "event_type", "n", "mean", "std")


def batch_moments(rows: DataFrame, by: str, value: str) -> DataFrame:
    """(by, n, mean, m2) of one batch."""
    return rows.groupBy(by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), (F.var_pop(value) * F.count(value)).alias("m2")).where("n > 0")


def run_moments(stream: DataFrame, path: str, checkpoint: str, by: str = "event_type", value: str = "value") -> None:
    """Write each micro-batch's moments under its number, all that is there at once; a repeated batch replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch_moments(batch, by, value).write.mode("overwrite").parquet(f"{path}/batch={number}")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def read_moments(spark: SparkSession, path: str, by: str = "event_type") -> DataFrame:
    """(by, n, mean, std) over all batches so far."""
    merged = merged_moments(spark.read.parquet(path), by)
    return merged.select(by, "n", "mean", F.sqrt(F.col("m2") / F.col("n")).alias("std"))


#: What a window's state is, and what goes out when its time is over.
_STATE = "n long, mean double, m2 double"
MOMENTS = "starts timestamp, event_type string, n long, mean double, std double"


class WindowMoments(StatefulProcessor):
    """Count, mean and sum of squares about it of one (event type, window): batches are merged into the state, and a timer at
    the window's end sends the result and drops the state. Rows of a window that is over are late and have been dropped."""

    def __init__(self, width_ms: int) -> None:
        self.width_ms = width_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("moments", _STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        n, mean, m2 = self.state.get() if self.state.exists() else (0, 0.0, 0.0)
        fresh = n == 0
        for batch in rows:
            own = batch["value"].to_numpy(float)
            own = own[~np.isnan(own)]
            if not len(own):
                continue
            # Two sets of values from their counts, means and squares alone.
            middle, total = own.mean(), n + len(own)
            m2 += ((own - middle) ** 2).sum() + (middle - mean) ** 2 * n * len(own) / total
            mean += (middle - mean) * len(own) / total
            n = total
        self.state.update((n, float(mean), float(m2)))
        if fresh:
            self.handle.registerTimer(self._end(key))
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        n, mean, m2 = self.state.get()
        self.state.clear()
        if n:
            yield pd.DataFrame({"starts": [pd.Timestamp(self._end(key) - self.width_ms, unit="ms")], "event_type": [key[0]], "n": [n], "mean": [mean], "std": [float(np.sqrt(m2 / n))]})
        else:
            yield pd.DataFrame()

    def _end(self, key) -> int:
        return (int(key[1]) + 1) * self.width_ms

    def close(self) -> None:
        pass


def stateful_moments(events: DataFrame, late: str = "10 minutes", width_ms: int = 86_400_000) -> DataFrame:
    """(starts, event_type, n, mean, std) of windows of a stream (ts, event_type, value), each once, when the watermark has passed its end.

    The state of an open window is three numbers; the session's state store has to be ROCKSDB (see run_stateful).
    A null value counts as no row; a window without values gives none. A null event type is a type of its own.
    """
    number = F.floor(F.unix_millis("ts") / width_ms).cast("long")
    keyed = events.select(F.col("ts").cast("timestamp").alias("ts"), "event_type", F.col("value").cast("double").alias("value")).withWatermark("ts", late).withColumn("window", number)
    return keyed.groupBy("event_type", "window").transformWithStateInPandas(statefulProcessor=WindowMoments(width_ms), outputStructType=MOMENTS, outputMode="Append", timeMode="EventTime")


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


STORE = "spark.sql.streaming.stateStore.providerClass"


def run_stateful(stream: DataFrame, path: str, checkpoint: str, **options) -> None:
    """Append what stateful_moments gives of all that is there to a table; called again with more, it goes on from its checkpoint.

    The session's state store is ROCKSDB meanwhile.
    """
    conf = stream.sparkSession.conf
    before = conf.get(STORE, None)
    conf.set(STORE, ROCKSDB)
    try:
        query = stateful_moments(stream, **options).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
        query.trigger(availableNow=True).start().awaitTermination()
    finally:
        conf.unset(STORE) if before is None else conf.set(STORE, before)
