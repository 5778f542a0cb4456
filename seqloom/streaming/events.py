"""Streaming over an events table: an addition, the reference has no streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def windowed(events: DataFrame, size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events, users and values for each window and type; works on streams and on tables."""
    marked = events.withWatermark("ts", late) if events.isStreaming else events
    grouped = marked.groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.approx_count_distinct("user_id").alias("users"), F.sum("value").alias("value"))
    return grouped.select(F.col("window.start").alias("start"), "event_type", "n", "users", "value")


def read(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)
