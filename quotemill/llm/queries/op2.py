"""Fuzzy line dedup over all documents."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quotemill.llm.lines import dedup_lines
from quotemill.session import load

NAME = "op2_line_dedup"
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = dedup_lines(load(spark, sf_dir, "documents"))
    return kept.select("doc_id", F.col("n_lines").cast("long"), F.col("n_removed").cast("long"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
