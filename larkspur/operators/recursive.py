"""Recursive queries with set semantics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from larkspur.session import checkpointed


def recursive_union(seed: DataFrame, step: Callable[[DataFrame], DataFrame], limit: int = 1000) -> DataFrame:
    """``WITH RECURSIVE r AS (seed UNION step(r))``: rows are distinct, so cycles end.

    Semi-naive: each round applies the step to the rows that were new in the last one and takes away those seen before. Each
    round is checkpointed in the session's checkpoint folder; the driver only learns whether a round had rows.
    """
    fresh = checkpointed(seed.distinct())
    seen = fresh
    for _ in range(limit):
        if fresh.isEmpty():
            return seen
        out = step(fresh).toDF(*seed.columns)  # by position, with the seed's names and types
        fresh = checkpointed(out.select(*[out[n].cast(t) for n, t in seed.dtypes]).distinct().subtract(seen))
        seen = seen.union(fresh)
    raise RuntimeError(f"recursion did not end within {limit} rounds")
