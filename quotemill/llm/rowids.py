"""Ids on their way through Python.

A null turns a whole column of ids into floating-point numbers there, which do not
hold ids above 2**53. So Python gets ids without nulls, and a mark.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MARK = "no_id"


def apart(name: str = "doc_id") -> list[Column]:
    """The id, 0 for none, and the mark of rows without one."""
    return [F.coalesce(F.col(name).cast("long"), F.lit(0).cast("long")).alias(name), F.col(name).isNull().alias(MARK)]


def together(name: str = "doc_id") -> Column:
    return F.when(~F.col(MARK), F.col(name)).alias(name)
