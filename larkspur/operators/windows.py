"""Window helpers, with GROUPS frames rewritten to RANGE over a dense rank."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from larkspur.operators.ordering import keys


def over(by: list[str], *order: str) -> WindowSpec:
    """Partition and order with PostgreSQL's placement of nulls."""
    w = Window.partitionBy(*by)
    return w.orderBy(*keys(*order)) if order else w


def groups_frame(df: DataFrame, aggregate: Column, by: list[str], order: list[str], start: int, end: int, name: str) -> DataFrame:
    """``aggregate OVER (... GROUPS BETWEEN start AND end)``; offsets count peer groups, negative before the current one.

    ``Window.unboundedPreceding`` and ``Window.unboundedFollowing`` may be given. Peers share a dense rank, so a RANGE frame
    over the rank is the GROUPS frame. Both windows use one shuffle and sort by the same partition keys.
    """
    ranked = df.withColumn("_group", F.dense_rank().over(over(by, *order)).cast("long"))
    frame = Window.partitionBy(*by).orderBy("_group").rangeBetween(start, end)
    return ranked.withColumn(name, aggregate.over(frame)).drop("_group")
