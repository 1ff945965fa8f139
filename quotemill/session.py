"""Session helpers shared by the whole library."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

PACKAGE_ROOT = str(Path(__file__).resolve().parents[1])


def build_session(app: str = "quotemill", cores: int | str = "*", partitions: int | None = None) -> SparkSession:
    """A local session with the settings that the library expects (UTC, adaptive execution)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
    )
    if partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def with_worker_path(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package wherever the driver was started.

    On a cluster the package is expected on the executors' path or shipped with
    ``--py-files``; the extra entry is harmless there.
    """
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(":") if p]
    if PACKAGE_ROOT not in paths:
        env["PYTHONPATH"] = ":".join([PACKAGE_ROOT, *paths])
    return spark


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One Parquet table of a data directory; works on any store Spark can read."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")
