"""Column statistics and histograms, each in one distributed pass."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.session import checkpointed


def analyze(df: DataFrame, columns: list[str], exact: bool = True) -> DataFrame:
    """A row a column: rows, nulls, distinct values (exact, or by HyperLogLog), least and greatest value as text."""
    distinct = F.count_distinct if exact else F.approx_count_distinct
    aggregates = [F.count("*").alias("n_rows")]
    for i, c in enumerate(columns):
        aggregates += [F.count(c).alias(f"k{i}"), distinct(F.col(c)).alias(f"d{i}"), F.min(c).cast("string").alias(f"a{i}"), F.max(c).cast("string").alias(f"b{i}")]
    one = df.agg(*aggregates)
    rows = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col("n_rows"), (F.col("n_rows") - F.col(f"k{i}")).alias("n_null"), F.col(f"d{i}").alias("n_distinct"), F.col(f"a{i}").alias("low"), F.col(f"b{i}").alias("high")) for i, c in enumerate(columns)])
    return one.select(F.explode(rows).alias("s")).select("s.*")


def common_values(df: DataFrame, column: str, n: int = 10) -> DataFrame:
    return df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), F.col("value").asc_nulls_last()).limit(n)


def equi_depth(df: DataFrame, column: str, buckets: int = 10) -> DataFrame:
    """Buckets of (nearly) equal size: bucket, low, high, n.

    Rows are range-partitioned and numbered by partition offsets, so no single task sorts them all; values are unique or ties
    fall into either of two neighbouring buckets.
    """
    values = df.select(F.col(column).alias("v")).where("v IS NOT NULL")
    parts = max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    placed = checkpointed(values.repartitionByRange(parts, "v").sortWithinPartitions("v").withColumn("p", F.spark_partition_id()).withColumn("i", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)))  # places must not move between the two uses
    sizes = {p: n for p, n in placed.groupBy("p").count().collect()}  # a row a partition
    total, before, offset = sum(sizes.values()), {}, 0
    for p in sorted(sizes):
        before[p] = offset
        offset += sizes[p]
    start = F.create_map(*[x for p, o in before.items() for x in (F.lit(p), F.lit(o).cast("long"))]) if before else F.lit(None).cast("map<int,bigint>")
    bucket = F.expr("cast(((x + i) * {b}L) div {t}L as bigint)".format(b=buckets, t=max(total, 1)))
    return placed.withColumn("x", F.element_at(start, F.col("p"))).select(bucket.alias("bucket"), "v").groupBy("bucket").agg(F.min("v").alias("low"), F.max("v").alias("high"), F.count("*").alias("n"))
