"""Relational capture files (SQLite): written by tasks, scanned by ranges of rowid.

A capture is one file, so a scan of it is cut into ranges of its rowid, each read by a
task of its own; a condition and the columns asked for go into the query that a task
runs. The condition is an argument: filters that Spark pushes into a Python source stay
with the table, so another query on the same DataFrame would be filtered too (seen on
4.1). Files must be on a folder that the executors share.
"""

from __future__ import annotations

import os
import sqlite3
import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

RANGE_ROWS = 100_000
_BATCH = 10_000
_KINDS = {"long": "INTEGER", "bigint": "INTEGER", "int": "INTEGER", "double": "REAL", "string": "TEXT"}


def local_path(path: str) -> str:
    return path.removeprefix("file://").removeprefix("file:")


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


class RowidRange(InputPartition):
    def __init__(self, file: str, low: int, high: int):
        self.file, self.low, self.high = file, low, high


class CaptureReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.schema, self.table = schema, options["table"]
        self.folder, self.rows = local_path(options["path"]), int(options.get("rangerows", RANGE_ROWS))
        self.where = options.get("where", "1")

    def partitions(self) -> list[RowidRange]:
        """Ranges of rowid of every file; a file without the table, or with an empty one, has none."""
        files = sorted(os.path.join(self.folder, f) for f in os.listdir(self.folder) if f.endswith(".sqlite")) if os.path.isdir(self.folder) else [self.folder]
        out = []
        for file in files:
            with sqlite3.connect(f"file:{file}?mode=ro", uri=True) as con:
                known = con.execute("SELECT 1 FROM sqlite_master WHERE name = ?", (self.table,)).fetchone()
                low, high = con.execute(f"SELECT min(rowid), max(rowid) FROM {_quoted(self.table)}").fetchone() if known else (None, None)
            con.close()
            if low is not None:
                out += [RowidRange(file, a, min(a + self.rows - 1, high)) for a in range(low, high + 1, self.rows)]
        return out

    def read(self, partition: RowidRange) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no range at all
            return
        columns = ", ".join(_quoted(c) for c in self.schema.names) or "1"
        kinds = pa.schema([(f.name, {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string()}[f.dataType.simpleString()]) for f in self.schema])
        con = sqlite3.connect(f"file:{partition.file}?mode=ro", uri=True)
        try:
            found = con.execute(f"SELECT {columns} FROM {_quoted(self.table)} WHERE rowid BETWEEN ? AND ? AND ({self.where})", [partition.low, partition.high])
            while rows := found.fetchmany(_BATCH):
                yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(zip(*rows), kinds.types)], schema=kinds)
        finally:
            con.close()


class CaptureSource(DataSource):
    """Format ``capture``: options path (a file, or a folder of .sqlite files), table, rangeRows, where (SQLite condition)."""

    @classmethod
    def name(cls) -> str:
        return "capture"

    def schema(self) -> str:
        raise ValueError("give the schema: nothing is inferred from data")

    def reader(self, schema: StructType) -> CaptureReader:
        return CaptureReader(schema, {k.lower(): v for k, v in self.options.items()})


def read_capture(spark: SparkSession, path: str, table: str, schema: str, *, where: str = "1", range_rows: int = RANGE_ROWS) -> DataFrame:
    """A table of one capture file or of a folder of them, by ranges of ``range_rows`` rowids; ``where`` is tested by the file."""
    spark.dataSource.register(CaptureSource)
    return spark.read.format("capture").schema(schema).option("table", table).option("rangeRows", str(range_rows)).option("where", where).load(path)


def write_captures(df: DataFrame, folder: str, table: str) -> list[str]:
    """One capture file per partition, in ``folder``; a file takes its name only when it is whole, so a lost task leaves none.

    Columns: long, int, double and string. Returns the names of the files.
    """
    at, columns = local_path(folder), df.columns
    kinds = ", ".join(f"{_quoted(f.name)} {_KINDS[f.dataType.simpleString()]}" for f in df.schema)

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        os.makedirs(at, exist_ok=True)
        name = f"{uuid.uuid4().hex}.sqlite"
        con = sqlite3.connect(f"{at}/.{name}.tmp")
        con.execute(f"CREATE TABLE {_quoted(table)} ({kinds})")
        for d in batches:
            rows = d.astype(object).where(d.notna(), None).itertuples(index=False, name=None)
            con.executemany(f"INSERT INTO {_quoted(table)} VALUES ({', '.join('?' * len(columns))})", rows)
        con.commit()
        con.close()
        os.rename(f"{at}/.{name}.tmp", f"{at}/{name}")
        yield pd.DataFrame({"file": [name]})

    return [r["file"] for r in df.mapInPandas(write, "file string").collect()]  # a name for each partition
