"""Homomorphic fingerprints of all documents and of their edited texts."""

from pyspark.sql import DataFrame, SparkSession

from quotemill.llm.multiset import edit_likeness
from quotemill.session import load

NAME = "op6_document_fingerprints"
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_likeness(load(spark, sf_dir, "documents"))
