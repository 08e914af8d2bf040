"""Aggregates beyond the built-in ones: truncating average, user-defined folds."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Most values of a group that a fold with a merge function gathers at once.
PIECE = 4096
#: Initial state by type name where an aggregate names none.
INITIAL = {"int": 0, "bigint": 0, "double": 0.0, "string": "", "boolean": False}


def int_avg(column: str) -> Column:
    """Average of integers, cut towards zero; null without values."""
    return F.expr(f"sum(cast({column} as bigint)) div nullif(count({column}), 0)")


@dataclass
class Fold:
    """A user-defined aggregate: state type, step(state, value), optional finish(state), initial state.

    Values are folded in ascending order (nulls are skipped unless ``keep_nulls``), so the result does not depend on how rows
    are spread. A fold that is given ``merge`` as well (associative and commutative, with the initial state as its neutral
    element) is computed over pieces of at most ``PIECE`` rows of a partition, these are merged by partition and the partitions'
    states in the end, so no more than ``PIECE`` values, or a state a partition, of a group are gathered, however large it is. A
    fold without ``merge`` is a sequence by its definition: its group must fit a task. ``built_in`` names an aggregate of Spark's own
    that gives the same result, which then replaces the fold.
    """

    state: str
    step: Callable[[Column, Column], Column]
    finish: Callable[[Column], Column] | None = None
    initial: object = None
    merge: Callable[[Column, Column], Column] | None = None
    keep_nulls: bool = False
    built_in: Callable[[Column], Column] | None = None

    def _start(self) -> Column:
        return F.lit(INITIAL.get(self.state) if self.initial is None else self.initial).cast(self.state)

    def _fold(self, values: Column, step: Callable[[Column, Column], Column]) -> Column:
        return F.aggregate(values, self._start(), lambda a, x: step(a, x).cast(self.state))

    def apply(self, df: DataFrame, by: list[str], column: str, name: str) -> DataFrame:
        value = F.struct(F.col(column).alias("v")) if self.keep_nulls else F.col(column)
        step = (lambda a, x: self.step(a, x["v"])) if self.keep_nulls else self.step
        end = self.finish or (lambda s: s)
        if self.built_in is not None:
            return df.groupBy(*by).agg(end(F.coalesce(self.built_in(F.col(column)).cast(self.state), self._start())).alias(name))
        if self.merge is None:
            return df.groupBy(*by).agg(end(self._fold(F.array_sort(F.collect_list(value)), step)).alias(name))
        merge = self.merge
        merged = lambda: F.aggregate(F.array_sort(F.collect_list("_part")), self._start(), lambda a, x: merge(a, x).cast(self.state))
        row = F.monotonically_increasing_id()
        pieces = df.select(*by, column, F.shiftright(row, 33).alias("_from"), F.floor(row.bitwiseAND((1 << 33) - 1) / PIECE).alias("_piece"))
        parts = pieces.groupBy(*by, "_from", "_piece").agg(self._fold(F.array_sort(F.collect_list(value)), step).alias("_part"))
        return parts.groupBy(*by, "_from").agg(merged().alias("_part")).groupBy(*by).agg(end(merged()).alias(name))
