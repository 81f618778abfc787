"""Structured Streaming over the events table: an extension, with the semantics of the batch queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, path: str, files_each: int = 16) -> DataFrame:
    """A folder of event files as a stream."""
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_each).parquet(path)


def windowed_counts(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(begin, event_type, n, total) by tumbling window; rows later than ``late`` are dropped by the watermark. Works on batches, too."""
    timely = events.withWatermark("ts", late) if events.isStreaming else events
    sums = timely.groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(20,2)")).cast("decimal(30,2)").alias("total"))
    return sums.select(F.col("window.start").alias("begin"), "event_type", "n", "total")


def first_seen(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """Events without repeats of an id within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"]) if events.isStreaming else events.dropDuplicates(["event_id"])
