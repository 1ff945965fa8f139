"""SimHash near-duplicates over all documents."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quotemill.llm.simhash import near_duplicate_classes
from quotemill.session import load

NAME = "op10_simhash_near_dedup"
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = near_duplicate_classes(load(spark, sf_dir, "documents"), words=3, radius=2)
    return classes.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
