"""A collection of named queries with their DuckDB counterparts."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from larkspur.session import sql

Query = Callable[[SparkSession, str], DataFrame]


class Book:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.oracles: dict[str, str] = {}

    def add(self, name: str, run: Query, oracle: str | None = None) -> None:
        if name in self.queries:
            raise ValueError(f"{name} is there already")
        self.queries[name] = run
        if oracle:
            self.oracles[name] = oracle

    def query(self, name: str, oracle: str | None = None) -> Callable[[Query], Query]:
        def keep(run: Query) -> Query:
            self.add(name, run, oracle)
            return run

        return keep

    def both(self, name: str, text: str, duck: str | None = None) -> None:
        """A text for Spark, with tables in braces; DuckDB gets it without braces, or its own."""
        self.add(name, lambda spark, d: sql(spark, d, text), duck or re.sub(r"\{(\w+)\}", r"\1", text))
