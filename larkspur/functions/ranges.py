"""Ranges as structs (lower, upper, lower_inc, upper_inc); a null bound is unbounded.

Integer and date ranges are discrete: they are brought to the form [lower, upper) before they are compared.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def make(lower: Column, upper: Column, bounds: str = "[)") -> Column:
    return F.struct(lower.alias("lower"), upper.alias("upper"), F.lit(bounds[0] == "[").alias("lower_inc"), F.lit(bounds[1] == "]").alias("upper_inc"))


def canonical(r: Column) -> Column:
    """The same discrete range as [lower, upper)."""
    low = F.when(r["lower_inc"], r["lower"]).otherwise(r["lower"] + 1)
    high = F.when(r["upper_inc"], r["upper"] + 1).otherwise(r["upper"])
    return F.struct(low.alias("lower"), high.alias("upper"), F.lit(True).alias("lower_inc"), F.lit(False).alias("upper_inc"))


def is_empty(r: Column) -> Column:
    c = canonical(r)
    return F.coalesce(c["lower"] >= c["upper"], F.lit(False))


def contains(r: Column, x: Column) -> Column:
    """r @> x."""
    c = canonical(r)
    return (c["lower"].isNull() | (c["lower"] <= x)) & (c["upper"].isNull() | (x < c["upper"]))


def _before(low: Column, high: Column) -> Column:
    return low.isNull() | high.isNull() | (low < high)


def overlaps(a: Column, b: Column) -> Column:
    """a && b."""
    x, y = canonical(a), canonical(b)
    return ~is_empty(a) & ~is_empty(b) & _before(x["lower"], y["upper"]) & _before(y["lower"], x["upper"])


def left_of(a: Column, b: Column) -> Column:
    """a << b."""
    return ~is_empty(a) & ~is_empty(b) & F.coalesce(canonical(a)["upper"] <= canonical(b)["lower"], F.lit(False))


def right_of(a: Column, b: Column) -> Column:
    """a >> b."""
    return left_of(b, a)


def adjacent(a: Column, b: Column) -> Column:
    """a -|- b."""
    x, y = canonical(a), canonical(b)
    return ~is_empty(a) & ~is_empty(b) & F.coalesce((x["upper"] == y["lower"]) | (y["upper"] == x["lower"]), F.lit(False))


def continuous_overlaps(a: Column, b: Column) -> Column:
    """Overlap of ranges over a continuous type: a shared bound counts if both sides include it."""

    def reach(x: Column, y: Column) -> Column:
        return x["lower"].isNull() | y["upper"].isNull() | (x["lower"] < y["upper"]) | ((x["lower"] == y["upper"]) & x["lower_inc"] & y["upper_inc"])

    return reach(a, b) & reach(b, a)


def text(r: Column) -> Column:
    """``[1,10)``."""
    return F.concat(F.when(r["lower_inc"], "[").otherwise("("), F.coalesce(r["lower"].cast("string"), F.lit("")), F.lit(","), F.coalesce(r["upper"].cast("string"), F.lit("")), F.when(r["upper_inc"], "]").otherwise(")"))
