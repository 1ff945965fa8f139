"""Periodic runs of all documents, a tenth of which are made periodic first."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quotemill.llm.quality_rules import words_of
from quotemill.llm.runs import periodic_runs
from quotemill.session import load

NAME = "op11_periodic_runs"
ORACLE_SQL = None  # comparing all periods of a text in SQL takes time in the square of its length


def planted(doc_id: Column, text: Column) -> Column:
    """The text; where crc32 of the id ends in 0, from some word on its words repeat with some period."""
    h = F.crc32(doc_id.cast("string"))
    g, words = F.floor(h / 10), words_of(text)
    n = F.size(words).cast("long")
    a, times = g % n, 3 + g % 8
    p = 1 + F.floor((n - a) / times)
    cycle = F.flatten(F.array_repeat(F.slice(words, a.cast("int") + 1, p.cast("int")), (times + 1).cast("int")))
    periodic = F.concat(F.slice(words, F.lit(1), a.cast("int")), F.slice(cycle, F.lit(1), (n - a).cast("int")))
    return F.when((h % 10 == 0) & (n > 0), F.array_join(periodic, " ")).otherwise(text)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").withColumn("text", planted(F.col("doc_id"), F.col("text")))
    return periodic_runs(docs).select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
