"""An extension: moves as a stream, appended to a table by micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def event_counts(spark: SparkSession, path: str, late: str = "1 hour", window: str = "1 day") -> DataFrame:
    """Events by window and type from files as they arrive; rows over `late` behind are dropped."""
    events = spark.readStream.schema(EVENTS).parquet(path)
    return events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")
