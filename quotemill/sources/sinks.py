"""Sinks: capture tables by event date, and plain files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_KEY, _OWN = "spark.checkpoint.dir", "/tmp/checkpoints/quotemill"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local one only where none is set and the master is local."""
    found = spark.sparkContext.getConf().get(_KEY, None) or spark.conf.get(_KEY, None) or spark.sparkContext.getCheckpointDir()
    if not found and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {_KEY} to a folder that all executors share")
    return (found or _OWN).rstrip("/")


def with_event_date(df: DataFrame, time: str = "timestamp_ms") -> DataFrame:
    return df.withColumn("date", F.to_date(F.timestamp_millis(time)))


def write_daily(df: DataFrame, path: str, time: str = "timestamp_ms") -> None:
    """Append partitioned by the UTC date of the event."""
    with_event_date(df, time).write.mode("append").partitionBy("date").parquet(path)


def capture_writer(folder: str):
    """A ``foreachBatch`` function that writes updates, venue_states and basis_states.

    A micro-batch is the unit of commit: each goes to its own folder, so a repeated
    batch overwrites itself and nothing is written twice.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            parts = {"updates": batch.select("id", "timestamp_ms", "price", "stddev", "is_live")}
            for name, column in (("venue_states", "states"), ("basis_states", "bases")):
                if column in batch.columns:
                    parts[name] = batch.select("id", "timestamp_ms", F.explode(column).alias("s")).select(F.col("id").alias("update_id"), "timestamp_ms", "s.*")
            for name, df in parts.items():
                with_event_date(df).write.mode("overwrite").parquet(f"{folder}/{name}/batch={batch_id}")
        finally:
            batch.unpersist()

    return write


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)
