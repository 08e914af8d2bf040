"""Joins, semi- and anti-joins, quantified comparisons, lateral top-n, and range joins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sides estimated below this many bytes may be broadcast by request.
BROADCAST_BYTES = 64 << 20
#: Values that agree but for this many low bits share a bin of ``pairs_below``.
BIN_BITS = 12


def join(left: DataFrame, right: DataFrame, on: Column | list[str] | str, how: str = "inner", hint: str | None = None) -> DataFrame:
    """Equi- or theta-join. hint: merge, shuffle_hash or broadcast; broadcast applies only while the plan's size estimate allows."""
    if hint == "broadcast" and estimated_bytes(right) > BROADCAST_BYTES:
        hint = None
    return left.join(right.hint(hint) if hint else right, on, how)


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of a plan's output."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().__str__())


def exists(outer: DataFrame, inner: DataFrame, on: Column) -> DataFrame:
    return outer.join(inner, on, "left_semi")


def not_exists(outer: DataFrame, inner: DataFrame, on: Column) -> DataFrame:
    return outer.join(inner, on, "left_anti")


def in_subquery(outer: DataFrame, column: str, inner: DataFrame) -> DataFrame:
    return outer.join(inner.select(F.col(inner.columns[0]).alias("_in")).distinct(), F.col(column) == F.col("_in"), "left_semi")


def not_in_subquery(outer: DataFrame, column: str, inner: DataFrame) -> DataFrame:
    """NOT IN with SQL nulls: a null in the list excludes every row, a null on the left all but when the list is empty."""
    name = inner.columns[0]
    return outer.sparkSession.sql(f"SELECT * FROM {{o}} WHERE `{column}` NOT IN (SELECT `{name}` FROM {{i}})", o=outer, i=inner)


Compare = Callable[[Column, Column], Column]


def _summary(inner: DataFrame) -> DataFrame:
    x = F.col(inner.columns[0])
    return inner.agg(F.min(x).alias("_min"), F.max(x).alias("_max"), F.count("*").alias("_n"), F.count(x).alias("_known"))


def any_of(outer: DataFrame, column: str, operator: str, inner: DataFrame) -> DataFrame:
    """Rows for which ``column operator ANY (inner)`` is true. Equality is a semi-join; orderings need one extreme of the list."""
    if operator == "=":
        return in_subquery(outer, column, inner)
    return _with_extremes(outer, column, operator, inner, True)


def all_of(outer: DataFrame, column: str, operator: str, inner: DataFrame) -> DataFrame:
    """Rows for which ``column operator ALL (inner)`` is true; every row for an empty list."""
    if operator in ("<>", "!="):
        return not_in_subquery(outer, column, inner)
    return _with_extremes(outer, column, operator, inner, False)


def _with_extremes(outer: DataFrame, column: str, operator: str, inner: DataFrame, some: bool) -> DataFrame:
    """Compare with the list's least and greatest value: one aggregated row, joined to the outer side."""
    x, low, high = F.col(column), F.col("_min"), F.col("_max")
    tests: dict[str, tuple[Column, Column]] = {  # operator -> (true for some, true for all)
        "<": (x < high, x < low),
        "<=": (x <= high, x <= low),
        ">": (x > low, x > high),
        ">=": (x >= low, x >= high),
        "=": ((x >= low) & (x <= high), (x == low) & (x == high)),
        "<>": ((x != low) | (x != high), F.lit(None).cast("boolean")),
    }
    one, every = tests[operator]
    true = one if some else (F.col("_n") == 0) | (every & (F.col("_n") == F.col("_known")))
    joined = outer.crossJoin(F.broadcast(_summary(inner)))  # one row by construction
    return joined.where(true).select(*[F.col(f"`{c}`") for c in outer.columns])


def lateral_top_n(outer: DataFrame, inner: DataFrame, on: tuple[str, str], n: int, order: list[Column]) -> DataFrame:
    """For each outer row its n first inner rows: the inner side is ranked by key once, then joined."""
    from pyspark.sql.window import Window

    key = on[1]
    ranked = inner.withColumn("_place", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("_place") <= n)
    return outer.join(ranked.drop("_place"), F.col(on[0]) == F.col(on[1]))


def range_join(points: DataFrame, ranges: DataFrame, value: str, low: str, high: str, bin_size: int) -> DataFrame:
    """Points within [low, high): ranges are cut into bins, points meet the ranges of their own bin by an equi-join."""
    bins = ranges.where(F.col(low) < F.col(high)).withColumn("_bin", F.explode(F.sequence(F.floor(F.col(low) / bin_size), F.floor((F.col(high) - 1) / bin_size))))
    binned = points.withColumn("_bin", F.floor(F.col(value) / bin_size))
    return binned.join(bins, "_bin").where((F.col(value) >= F.col(low)) & (F.col(value) < F.col(high))).drop("_bin")


def pairs_below(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Of the self-join on equal keys and a whole-number value below the other's: per group with pairs, their number _n and the sum _apart
    of their differences, without making a pair. Values are summed up by bins, then bins by group, so no task reads a group's rows."""
    at, low = F.col("_at"), F.shiftleft(F.col("_bin"), BIN_BITS)
    for name in (*keys, value):  # nulls meet nothing
        df = df.where(F.col(name).isNotNull())
    each = df.groupBy(*keys, F.col(value).cast("long").alias("_at")).agg(F.count("*").alias("_rows"))
    zero = F.lit(0).cast("long")
    each = each.select("*", zero.alias("_n"), zero.alias("_apart"), zero.alias("_over"), F.shiftright(at, BIN_BITS).alias("_bin"))
    bins = _summed_pairs(each, [*keys, "_bin"], low).withColumn("_at", low)
    return _summed_pairs(bins, keys, zero).where("_n > 0").select(*keys, "_n", "_apart")


def _summed_pairs(parts: DataFrame, keys: list[str], base: Column) -> DataFrame:
    """Parts that begin at _at, each with its _rows, its own pairs (_n, _apart) and its rows' distances _over from _at, as one part that
    begins at base. No sum on the way is larger than the result, but for distances within a bin."""
    from pyspark.sql.window import Window

    upwards = Window.partitionBy(*keys).orderBy("_at")
    below, step = F.sum("_rows").over(upwards.rowsBetween(Window.unboundedPreceding, -1)), F.col("_at") - F.lag("_at").over(upwards)
    parts = parts.withColumn("_below", F.coalesce(below, F.lit(0)))
    parts = parts.withColumn("_step", F.coalesce(F.col("_below") * step - F.lag("_over").over(upwards), F.lit(0)))
    parts = parts.withColumn("_far", F.sum("_step").over(upwards.rowsBetween(Window.unboundedPreceding, 0)))  # of all rows below, from _at
    rows, lower = F.col("_rows"), F.col("_below")
    return parts.groupBy(*keys).agg(
        F.sum(rows).alias("_rows"),
        F.sum(F.col("_n") + rows * lower).alias("_n"),
        F.sum(F.col("_apart") + rows * F.col("_far") + lower * F.col("_over")).alias("_apart"),
        F.sum(F.col("_over") + rows * (F.col("_at") - base)).alias("_over"),
    )
