"""Tables split by RANGE, LIST or HASH into children, with routing and pruning.

A partitioned table is stored with a partition column, so Spark prunes directories from a predicate on it; ``Partitioned`` keeps
children of its own (attached and detached one by one) and reads those whose bounds a predicate can meet.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def range_child(column: str, bounds: list[tuple[str, object, object]], default: str | None = None) -> Column:
    """Name of the child whose [low, high) holds the value; a None bound is open."""
    out = F.lit(default)
    for name, low, high in reversed(bounds):
        c = F.col(column)
        inside = (F.lit(True) if low is None else c >= F.lit(low)) & (F.lit(True) if high is None else c < F.lit(high))
        out = F.when(inside, name).otherwise(out)
    return out


def list_child(column: str, values: dict[str, list], default: str | None = None) -> Column:
    out = F.lit(default)
    for name, members in values.items():
        out = F.when(F.col(column).isin(members), name).otherwise(out)
    return out


def hash_child(column: str, modulus: int) -> Column:
    """Remainder of a whole-number key."""
    return F.pmod(F.col(column), F.lit(modulus)).cast("long")


@dataclass
class Partitioned:
    """Children by name: RANGE bounds (low, high), LIST values, or HASH remainders {"modulus": m, "remainder": r}; a default child (None) takes the rest.

    Rows inserted into the parent stay one DataFrame with the name of their child, so a scan reads their source once, whatever
    the number of children; rows that came with an attached child are read only if a predicate can meet its bound.
    """

    column: str
    children: dict[str, DataFrame] = field(default_factory=dict)
    bounds: dict[str, tuple | list | dict | None] = field(default_factory=dict)
    routed: list[DataFrame] = field(default_factory=list)

    def attach(self, name: str, child: DataFrame, bound: tuple | list | dict | None) -> None:
        """bound: (low, high), a list of values, {"modulus", "remainder"}, or None for the default child."""
        for other, b in self.bounds.items():
            if isinstance(bound, tuple) and isinstance(b, tuple) and not (_reaches(bound[1], b[0]) or _reaches(b[1], bound[0])):
                raise ValueError(f"{name} overlaps {other}")
            if isinstance(bound, list) and isinstance(b, list) and set(bound) & set(b):
                raise ValueError(f"{name} overlaps {other}")
            if isinstance(bound, dict) and isinstance(b, dict) and (bound["remainder"] - b["remainder"]) % math.gcd(bound["modulus"], b["modulus"]) == 0:
                raise ValueError(f"{name} overlaps {other}")
            if bound is None and b is None:
                raise ValueError(f"{other} is the default already")
        self.children[name], self.bounds[name] = child, bound

    def detach(self, name: str) -> DataFrame:
        """The child with all its rows, no longer part of the parent."""
        out = self.child(name)
        del self.bounds[name], self.children[name]
        self.routed = [r.where(F.col("_child") != name) for r in self.routed]
        return out

    def child(self, name: str) -> DataFrame:
        return reduce(DataFrame.unionByName, [self.children[name], *(r.where(F.col("_child") == name).drop("_child") for r in self.routed)])

    def child_of(self) -> Column:
        """Name of the child that holds a row; null where none does."""
        out = F.lit(next((n for n, b in self.bounds.items() if b is None), None))
        c = F.col(self.column)
        for name, b in self.bounds.items():
            if isinstance(b, tuple):
                out = F.when((F.lit(True) if b[0] is None else c >= F.lit(b[0])) & (F.lit(True) if b[1] is None else c < F.lit(b[1])), name).otherwise(out)
            elif isinstance(b, list):
                out = F.when(c.isin(b), name).otherwise(out)
            elif isinstance(b, dict):
                out = F.when(hash_child(self.column, b["modulus"]) == b["remainder"], name).otherwise(out)
        return out

    def route(self, rows: DataFrame) -> None:
        """Insert into the parent: each row goes to its child; a row that fits none is an error."""
        routed = rows.withColumn("_child", self.child_of())
        if None not in self.bounds.values() and not routed.where(F.col("_child").isNull()).isEmpty():
            raise ValueError("no partition for a row")
        self.routed.append(routed)

    def pruned(self, low: object = None, high: object = None) -> list[str]:
        """Children that can hold values in [low, high]; the default child always can."""
        out = []
        for n, b in self.bounds.items():
            if b is None:
                out.append(n)
            elif isinstance(b, list):
                if any((low is None or v >= low) and (high is None or v <= high) for v in b):
                    out.append(n)
            elif isinstance(b, dict):
                if low is None or low != high or low % b["modulus"] == b["remainder"]:
                    out.append(n)
            elif (high is None or b[0] is None or b[0] <= high) and (low is None or b[1] is None or low < b[1]):
                out.append(n)
        return out

    def scan(self, low: object = None, high: object = None, names: bool = False) -> DataFrame:
        """Rows with values in [low, high] from the children that can hold them; with ``names``, their child as ``_child``."""
        wanted = self.pruned(low, high)
        frames = [self.children[n].withColumn("_child", F.lit(n)) for n in wanted if not _empty(self.children[n])]
        frames += [r if len(wanted) == len(self.bounds) else r.where(F.col("_child").isin(wanted)) for r in self.routed]
        if not frames:
            frames = [next(iter(self.children.values())).limit(0).withColumn("_child", F.lit(""))]
        out = reduce(DataFrame.unionByName, frames)
        if low is not None:
            out = out.where(F.col(self.column) >= F.lit(low))
        out = out if high is None else out.where(F.col(self.column) <= F.lit(high))
        return out if names else out.drop("_child")

    def write(self, path: str) -> None:
        """One write with a folder a child; Spark then prunes folders by ``_child``."""
        self.scan(names=True).write.mode("overwrite").partitionBy("_child").parquet(path)


def _empty(df: DataFrame) -> bool:
    """Whether the plan says that there are no rows, without running it."""
    return df._jdf.queryExecution().optimizedPlan().getClass().getSimpleName() == "LocalRelation" and df.isEmpty()


def _reaches(high: object, low: object) -> bool:
    """Whether a range that ends at high lies below one that begins at low."""
    return high is not None and low is not None and high <= low
