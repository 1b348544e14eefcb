"""Keeping a graph fresh: file events debounced by session windows, and changed files merged a micro-batch at a time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def debounced(events: DataFrame, key: str, ts: str = "ts", gap: str = "2 seconds", watermark: str | None = None) -> DataFrame:
    """(key, start, end, events): bursts of events of a key no further apart than ``gap``; batch or stream."""
    if watermark:
        events = events.withWatermark(ts, watermark)
    out = events.groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count("*").alias("events"))
    return out.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events")


def watch(spark: SparkSession, root: str, schema: str, on_change: Callable[[DataFrame, int], None], checkpoint: str, trigger: str = "2 seconds"):
    """Run ``on_change`` for each micro-batch of new rows below ``root``; batches are single-flight by construction."""
    stream = spark.readStream.schema(schema).parquet(root)
    return stream.writeStream.foreachBatch(on_change).option("checkpointLocation", checkpoint).trigger(processingTime=trigger).start()
