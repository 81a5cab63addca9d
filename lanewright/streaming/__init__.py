"""Structured Streaming: incremental sources and event-time windows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def drain(spark: SparkSession, path: str, schema: str, checkpoint: str, each: Callable[[DataFrame, int], None], source: str = "parquet", **options: str) -> int:
    """Feeds what is new below a path to a function, then stops; returns the batches seen.

    The checkpoint remembers what was read, so a second call sees only new files.
    """
    reader = spark.readStream.format(source).schema(schema).options(**options)
    query = reader.load(path).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return len(query.recentProgress)


def tumbling(events: DataFrame, every: str, keys: list[str], time: str = "ts", late: str | None = None) -> DataFrame:
    """Counts and sums of value for each window and keys; late sets a watermark."""
    stamped = events.withColumn(time, F.col(time).cast("timestamp"))
    stamped = stamped.withWatermark(time, late) if late else stamped
    grouped = stamped.groupBy(F.window(time, every), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("value"))
    return grouped.select(F.col("window.start").alias("start"), *keys, "n", "value")


def sessions(events: DataFrame, gap: str, keys: list[str], time: str = "ts") -> DataFrame:
    """Sessions of each key: runs of events with no longer pause than the gap."""
    stamped = events.withColumn(time, F.col(time).cast("timestamp"))
    grouped = stamped.groupBy(F.session_window(time, gap), *keys).agg(F.count("*").alias("n"))
    return grouped.select(F.col("session_window.start").alias("start"), *keys, "n")
