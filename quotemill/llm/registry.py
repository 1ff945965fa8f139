"""Queries of this subpackage, one module each, and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from quotemill.llm.scratch import prepare

#: Query modules in ``quotemill.llm.queries``; each has NAME, run(spark, sf_dir) and ORACLE_SQL (None: not expressible).
MODULES = ("op1", "op2", "op3", "op4", "op5", "op6", "op7", "op8", "op9", "op10", "op11", "op12", "op13")


def _prepared(run: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: run(prepare(spark), sf_dir)


def _modules() -> list:
    return [import_module(f"quotemill.llm.queries.{m}") for m in MODULES]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {m.NAME: m.run for m in _modules()} | {"pipeline": import_module("corpus_pipeline").run}
    return {name: _prepared(run) for name, run in found.items()}


def oracle_sql() -> dict[str, str]:
    found = {m.NAME: m.ORACLE_SQL for m in _modules()} | {"pipeline": import_module("corpus_pipeline").ORACLE_SQL}
    return {name: sql for name, sql in found.items() if sql}
