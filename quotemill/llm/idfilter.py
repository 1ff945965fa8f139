"""A filter of fixed size for joins that few rows of the large side need.

Ids are hashed into a bitmap of ``bits`` bits, whatever their number; rows whose bit
is clear certainly have no partner and need no shuffle. Rows that pass are joined as
ever, so a full bitmap costs time and changes nothing.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

BITS = 1 << 23  # 1 MB to broadcast
_CELL = 1 << 15  # bits in one of Spark's bitmaps


def may_contain(ids: DataFrame, column: str, bits: int = BITS):
    """A function of a column: true for every id in ``ids``, false for most others, nulls false."""
    place = F.pmod(F.xxhash64(column), F.lit(bits))
    rows = (
        ids.where(F.col(column).isNotNull())
        .select(place.alias("at"))
        .groupBy(F.expr(f"cast(at div {_CELL} as int)").alias("cell"))
        .agg(F.bitmap_construct_agg(F.col("at") % _CELL).alias("bitmap"))
        .collect()  # at most bits / 2**15 rows of 4 KB
    )
    table = np.zeros((bits // _CELL, _CELL), dtype=bool)
    for r in rows:
        table[r["cell"]] = np.unpackbits(np.frombuffer(bytes(r["bitmap"]), dtype=np.uint8), bitorder="little")
    packed = ids.sparkSession.sparkContext.broadcast(np.packbits(table.ravel(), bitorder="little"))

    @pandas_udf("boolean")
    def test(at: pd.Series) -> pd.Series:
        at = at.to_numpy(np.int64)
        return pd.Series((packed.value[at >> 3] >> (at & 7)) & 1 == 1)

    def check(value: Column) -> Column:
        return value.isNotNull() & test(F.coalesce(F.pmod(F.xxhash64(value), F.lit(bits)), F.lit(0)))

    return check
