"""Table functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def generate_series(spark: SparkSession, start: int, stop: int, step: int = 1, name: str = "value") -> DataFrame:
    """Both ends included; empty where the step leads away; a step of 0 is an error. Generated on the executors."""
    if step == 0:
        raise ValueError("step must not be 0")
    return spark.range(start, stop + (1 if step > 0 else -1), step).toDF(name) if (stop - start) * step >= 0 else spark.range(0).toDF(name)


def series(start: Column, stop: Column, step: int = 1) -> Column:
    """The series of each row as an array."""
    if step == 0:
        raise ValueError("step must not be 0")
    empty = (stop < start) if step > 0 else (stop > start)
    safe = F.when(empty, start).otherwise(stop)
    return F.when(empty, F.array().cast("array<bigint>")).otherwise(F.sequence(start.cast("long"), safe.cast("long"), F.lit(step).cast("long")))


def unnest(df: DataFrame, column: str, name: str) -> DataFrame:
    """One row an element, null elements kept, rows with empty or null arrays dropped."""
    return df.withColumn(name, F.explode(column)).drop(column) if name != column else df.withColumn(name, F.explode(column))
