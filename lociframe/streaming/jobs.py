"""Structured Streaming forms of batch behaviours: de-duplication, with and without timers, window counts, co-moments.

These are additions for a Spark user; the batch operators give the same results on landed data.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lociframe.operators.correlate import pearson_from_sums
from lociframe.session import shared_path


def dedup_stream(df: DataFrame, key: Column, ts: str, delay: str = "7 days") -> DataFrame:
    """First record of each key; repeats that arrive within the delay are dropped and old state is freed."""
    return df.withColumn("dedup_key", key).withWatermark(ts, delay).dropDuplicatesWithinWatermark(["dedup_key"])


class FirstRecords(StatefulProcessor):
    """Emits a key's first record, and again the first one after its state was freed by its timer."""

    def __init__(self, keep_ms: int):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.first = handle.getValueState("first", "at long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        least = min((int(at.min()) for part in rows if len(at := part["at"][part["at"] >= mark])), default=None)
        if least is not None and not self.first.exists():
            self.first.update((least,))
            self.handle.registerTimer(least + self.keep_ms)
            yield pd.DataFrame({"dedup_key": [key[0]], "at": [least]})

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        self.first.clear()
        return iter([])

    def close(self) -> None:
        pass


def first_records(df: DataFrame, key: Column, ts: str, delay: str = "7 days", keep_days: int = 30) -> DataFrame:
    """First record of each key (dedup_key, at in milliseconds), with a timer for each key's state.

    Records older than the watermark are late and dropped. A key's state is freed when the watermark has passed
    ``keep_days`` after its first record, so what is held follows the keys of that time and not all keys ever seen; a
    record after that is a first one again. Needs the RocksDB state store.
    """
    rows = df.withWatermark(ts, delay).select(key.alias("dedup_key"), F.unix_millis(ts).alias("at"), ts)
    return rows.groupBy("dedup_key").transformWithStateInPandas(
        FirstRecords(keep_days * 86_400_000), "dedup_key string, at long", "append", "EventTime")


def window_counts(df: DataFrame, ts: str, width: str = "7 days", delay: str = "1 day", keys: tuple[str, ...] = ()) -> DataFrame:
    """Rows per time window (and keys), emitted once when the watermark has passed the window."""
    out = df.withWatermark(ts, delay).groupBy(F.window(ts, width), *keys).agg(F.count(F.lit(1)).alias("count"))
    return out.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *keys, "count")


def comoment_stream(df: DataFrame, feature: str, x: str, y: str) -> DataFrame:
    """Running co-moments per feature with the correlation they give (update or complete mode)."""
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    sums = df.where(a.isNotNull() & b.isNotNull()).groupBy(feature).agg(
        F.count(F.lit(1)).alias("n"), F.sum(a).alias("sx"), F.sum(b).alias("sy"), F.sum(a * b).alias("sxy"),
        F.sum(a * a).alias("sxx"), F.sum(b * b).alias("syy"))
    return sums.withColumn("r", pearson_from_sums(*[F.col(c) for c in ("n", "sx", "sy", "sxy", "sxx", "syy")]))


def run_available(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Process what is there and return it as a table in the shared checkpoint folder.

    Append results go to a parquet sink. Complete results are rewritten by each batch, so the last one stays.
    """
    spark = stream.sparkSession
    base = shared_path(spark, "stream")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    writer = stream.writeStream.option("checkpointLocation", f"{base}/state").trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").option("path", f"{base}/out").outputMode("append").start()
    else:
        query = writer.outputMode(mode).foreachBatch(
            lambda batch, _: batch.write.mode("overwrite").parquet(f"{base}/out")).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")
