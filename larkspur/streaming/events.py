"""Hourly counts by type, the same plan for batch and stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def hourly(events: DataFrame, late: str | None = None) -> DataFrame:
    """hour, event_type, n. ``late``: watermark for a stream; later rows are dropped and closed hours emitted."""
    df = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if late:
        df = df.withWatermark("ts", late)
    return df.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("hour"), "event_type", "n")


def read(spark: SparkSession, folder: str, pattern: str, schema) -> DataFrame:
    """A stream over the Parquet files of a folder that match the pattern."""
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(folder)
