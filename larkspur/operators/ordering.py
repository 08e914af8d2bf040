"""Ordering with PostgreSQL's placement of nulls, limits, top-k and cursors."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from larkspur.session import checkpointed


def keys(*names: str) -> list[Column]:
    """Sort keys; a leading minus sorts down. Nulls come last going up and first going down."""
    return [F.col(n[1:]).desc_nulls_first() if n.startswith("-") else F.col(n).asc_nulls_last() for n in names]


def sort(df: DataFrame, *names: str) -> DataFrame:
    return df.orderBy(*keys(*names))


def top_k(df: DataFrame, k: int, *names: str, offset: int = 0) -> DataFrame:
    """The k first rows; Spark plans a bounded heap per task (TakeOrderedAndProject), not a full sort."""
    out = df.orderBy(*keys(*names))
    return out.offset(offset).limit(k) if offset else out.limit(k)


def top_k_per_group(df: DataFrame, k: int, by: list[str], *names: str) -> DataFrame:
    """The k first rows of each group; Spark limits groups before the shuffle (WindowGroupLimit)."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*keys(*names)))
    return df.withColumn("_place", place).where(F.col("_place") <= k).drop("_place")


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Rows with their place (from 1) in an order, as a column ``name``: a range-partitioned sort, then each partition's offset.

    Ties are broken by the order in which the sort leaves them; the sorted rows are checkpointed, so places stay the same.
    """
    ids = "_row"
    rows = checkpointed(df.orderBy(*order).withColumn(ids, F.monotonically_increasing_id()))
    part, at = F.shiftright(ids, 33), F.col(ids).bitwiseAND((1 << 33) - 1)
    offsets, total = [], 0
    for p, n in sorted((r[0], r[1]) for r in rows.groupBy(part.alias("p")).count().collect()):  # a row a partition
        offsets += [F.lit(p), F.lit(total)]
        total += n
    offset = F.create_map(*offsets)[part] if offsets else F.lit(0)
    return rows.withColumn(name, (offset + at + 1).cast("long")).drop(ids)


class Cursor:
    """A scrollable cursor over an ordered result.

    Rows are numbered once by partition offsets, without Python and without moving them to the driver, and are kept in the
    checkpoint folder; each fetch reads just the rows asked for. Position 0 is before the first row; going past an end leaves
    the cursor there.
    """

    def __init__(self, df: DataFrame, *names: str):
        self.rows = numbered(df, keys(*(names or tuple(df.columns))), "_place")
        self.size, self.at, self.is_open = self.rows.count(), 0, True

    def _move(self, to: int) -> Row | None:
        if not self.is_open:
            raise ValueError("the cursor is closed")
        self.at = min(max(to, 0), self.size + 1)
        got = self.rows.where(F.col("_place") == self.at).drop("_place").take(1)
        return got[0] if got else None

    def next(self) -> Row | None:
        return self._move(self.at + 1)

    def prior(self) -> Row | None:
        return self._move(self.at - 1)

    def first(self) -> Row | None:
        return self._move(1)

    def last(self) -> Row | None:
        return self._move(self.size)

    def absolute(self, n: int) -> Row | None:
        """Row n; negative counts from the end."""
        return self._move(n if n >= 0 else self.size + 1 + n)

    def relative(self, n: int) -> Row | None:
        return self._move(self.at + n)

    def fetch(self, n: int) -> DataFrame:
        """The next n rows (n < 0: the previous ones, backwards) as a DataFrame."""
        if not self.is_open:
            raise ValueError("the cursor is closed")
        low, high = (self.at + 1, self.at + n) if n >= 0 else (self.at + n, self.at - 1)
        self.at = min(max(self.at + n, 0), self.size + 1)
        order = F.col("_place").asc() if n >= 0 else F.col("_place").desc()
        return self.rows.where(F.col("_place").between(low, high)).orderBy(order).drop("_place")

    def close(self) -> None:
        self.is_open = False


def local_iterator(df: DataFrame) -> Iterator[Row]:
    """Rows one partition at a time on the driver."""
    return df.toLocalIterator()
