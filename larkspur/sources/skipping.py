"""Data skipping in place of index structures: clustered Parquet with statistics by row group, and Bloom filters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_clustered(df: DataFrame, path: str, order: list[str], bloom: list[str] = (), partitions: int | None = None, **options: str) -> None:
    """Write ranges of the ordered columns to files of their own, sorted inside, so that row groups hold narrow ranges.

    Equality on a ``bloom`` column skips row groups whose filter lacks the value. Without ordered columns rows stay as they are.
    """
    if order:
        keys = [F.col(c).asc_nulls_last() for c in order]
        df = (df.repartitionByRange(partitions, *keys) if partitions else df.repartitionByRange(*keys)).sortWithinPartitions(*keys)
    writer = df.write.mode("overwrite").options(**options)
    for c in bloom:
        writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true")
    writer.parquet(path)


def rows_read(df: DataFrame) -> int:
    """Rows that the scans of a query have read from storage once it has run: what skipping left."""
    plan = df._jdf.queryExecution().executedPlan()
    total, todo = 0, [plan]
    while todo:
        node = todo.pop()
        if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
            continue
        if node.getClass().getSimpleName() == "FileSourceScanExec":
            total += node.metrics().apply("numOutputRows").value()
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return total
