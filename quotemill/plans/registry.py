"""Named queries of the library and the SQL each one is checked against."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

MODULES = ("relational", "joins", "fairvalue", "statistics", "models", "messages", "feeds", "live")


def _books() -> list:
    return [import_module(f"quotemill.plans.{m}").book for m in MODULES]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: fn for book in _books() for name, fn in book.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for book in _books() for name, sql in book.sql.items()}
