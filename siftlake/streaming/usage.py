"""Streams: the usage log by day, and files as they arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlake.operators.usage import LOG_SCHEMA


def stream_log(spark: SparkSession, path: str) -> DataFrame:
    """The log as a stream with an event time."""
    rows = spark.readStream.schema(LOG_SCHEMA).option("mode", "DROPMALFORMED").json(path)
    return rows.withColumn("at", F.timestamp_micros((F.col("ts") * 1_000_000).cast("bigint")))


def daily_usage(events: DataFrame, time: str = "at", late: str = "2 days") -> DataFrame:
    """Calls and characters per day and call type; later records than ``late`` are dropped.

    The same plan serves a table and a stream.
    """
    saved = F.greatest(F.lit(0), F.col("file_chars") - F.col("snippet_chars"))
    marked = events.withWatermark(time, late) if events.isStreaming else events
    grouped = marked.groupBy(F.window(time, "1 day").alias("w"), "call")
    out = grouped.agg(F.count("*").alias("calls"), F.sum("snippet_chars").alias("snippet_chars"), F.sum("file_chars").alias("file_chars"), F.sum(saved).alias("saved_chars"))
    return out.select(F.col("w.start").alias("day"), "call", "calls", "snippet_chars", "file_chars", "saved_chars")


def keep_index(files: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str):
    """Hand every batch of arriving chunk rows to ``apply`` (see operators.index.update_index)."""
    return files.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
