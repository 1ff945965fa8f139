"""Tables written to the folder that the driver and all executors share.

Lineage is cut by writing Parquet there, never by a local checkpoint: a written
table outlives any executor. The folder is the session's
``spark.checkpoint.dir``; one of our own is set only where that is unset and the
master is local, as in tests.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_KEY = "spark.checkpoint.dir"
_OWN = "/tmp/checkpoints/quotemill"
_scopes: list[list[str]] = []
_finished: dict[tuple[str, str], list[tuple[float, list[str]]]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The shared folder; raises on a cluster that names none."""
    found = spark.sparkContext.getConf().get(_KEY, None) or spark.conf.get(_KEY, None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {_KEY} to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(_OWN)
    return _OWN


def prepare(spark: SparkSession) -> SparkSession:
    """Bound what a Python worker holds at once: batches of at most 1000 rows, as texts can be long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    return spark


def new_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].append(path)
    return path


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back."""
    spark = prepare(df.sparkSession)
    path = new_path(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def drop(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def discard(*tables: DataFrame) -> None:
    """Delete materialized tables that nothing will read again."""
    for df in tables:
        if path := getattr(df, "_scratch_path", None):
            drop(df.sparkSession, path)


@contextmanager
def scope() -> Iterator[list[str]]:
    """The paths of all tables written inside; whoever stores the result may ``drop`` them after that."""
    paths: list[str] = []
    _scopes.append(paths)
    try:
        yield paths
    finally:
        _scopes.pop()


def served(spark: SparkSession, name: str, paths: list[str]) -> None:
    """Note that a result called ``name``, returned now, reads these tables."""
    _finished.setdefault((spark.sparkContext.applicationId, name), []).append((time.time(), paths))


def release_stored(spark: SparkSession, name: str, stored: float) -> None:
    """Delete the tables of results of that name that were returned before ``stored`` (seconds), when a table was written from them."""
    key = (spark.sparkContext.applicationId, name)
    held = _finished.pop(key, [])
    _finished[key] = [(at, paths) for at, paths in held if at >= stored]
    for at, paths in held:
        if at < stored:
            for path in paths:
                drop(spark, path)


def written_at(df: DataFrame) -> float:
    """When the newest file that ``df`` reads was written; 0 if it reads none."""
    spark = df.sparkSession
    conf, path = spark.sparkContext._jsc.hadoopConfiguration(), spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    newest = 0
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        at = path(folder)
        newest = max(newest, at.getFileSystem(conf).getFileStatus(at).getModificationTime())
    return newest / 1000.0
