"""A registry of named queries, each with the SQL it is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class QueryBook:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        def keep(fn: Query) -> Query:
            if name in self.queries:
                raise ValueError(f"two queries are named {name}")
            self.queries[name] = fn
            if sql:
                self.sql[name] = sql
            return fn

        return keep
