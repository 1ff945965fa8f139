"""Removal of word runs that repeat across documents."""

from pyspark.sql import DataFrame, SparkSession

from quotemill.llm.recompress import remove_repeats
from quotemill.session import load

NAME = "op4_substring_dedup"
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(load(spark, sf_dir, "documents"), window=50).drop("text")
