"""Running counts, row numbers, neighbours and linear recurrences over keys of any size.

A key's rows are cut into ranges of their first order column. Each range is summed up
in one row, the sums are carried over these rows, and every range then finishes on its
own from what was carried into it. So a task holds one range, or one row per range of
one key, never a key's whole history. The first order column must be numeric and not
null; ``width`` is the length of a range on it. Null keys are keys like any other.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WIDTH = 50_000


def _ranged(df: DataFrame, order: list[str], width: int) -> DataFrame:
    return df.withColumn("_range", F.floor(F.col(order[0]) / width))


def _joined(df: DataFrame, other: DataFrame, by: list[str]) -> DataFrame:
    """``df`` with the columns of its row in ``other``; nulls in keys are equal."""
    other = other.withColumnsRenamed({c: f"_of_{c}" for c in by})
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in by])
    return df.join(other, same).drop(*[f"_of_{c}" for c in by])


def running_sum(df: DataFrame, keys: list[str], order: list[str], value: Column, name: str, *, width: int = WIDTH, total: str | None = None) -> DataFrame:
    """``df`` with the sum of ``value`` over the key's rows up to and with this one; ``total``: a column for the sum of all."""
    df = _ranged(df, order, width).withColumn("_value", value)
    by = [*keys, "_range"]
    sums = df.groupBy(*by).agg(F.sum("_value").alias("_sum"))
    key = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))  # one row per range
    before = F.coalesce(F.sum("_sum").over(key.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select(*by, before.alias("_before"), F.sum("_sum").over(key).alias("_total"))
    inside = F.sum("_value").over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    out = _joined(df, sums, by).withColumn(name, F.col("_before") + F.coalesce(inside, F.lit(0)))
    if total:
        out = out.withColumn(total, F.col("_total"))
    return out.drop("_range", "_value", "_before", "_total")


def numbered(df: DataFrame, keys: list[str], order: list[str], name: str = "row_no", *, width: int = WIDTH, total: str | None = None) -> DataFrame:
    """``df`` with row numbers from 1 in each key; ``total``: a column for the key's number of rows."""
    return running_sum(df, keys, order, F.lit(1).cast("long"), name, width=width, total=total)


def top_share(df: DataFrame, keys: list[str], value: str, ties: list[str], share: float, *, width: float) -> DataFrame:
    """Each key's ``share`` of rows (rounded down, one at least) of highest ``value``, then lowest ``ties``.

    Rows are counted by ranges of the value, ``width`` long; only the range that the share
    ends in is sorted, those above it are whole. Nulls come last, NaN first.
    """
    x = F.col(value)
    df = df.withColumn("_range", F.when(F.isnan(x.cast("double")), F.lit(2**63 - 1)).otherwise(F.floor(x / width).cast("long")))
    by = [*keys, "_range"]
    key = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))  # one row per range
    sums = df.groupBy(*by).agg(F.count("*").alias("_rows"))
    before = F.coalesce(F.sum("_rows").over(key.orderBy(F.desc("_range")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    most = F.greatest(F.lit(1), F.floor(F.sum("_rows").over(key) * share))
    sums = sums.select(*by, (most - before).alias("_left"), "_rows").where("_left > 0")
    found = _joined(df, F.broadcast(sums.where("_left >= _rows").select(*by)), by).drop("_range")  # a row for each range
    last = _joined(df, F.broadcast(sums.where("_left < _rows").select(*by, "_left")), by)  # a row for each key
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(value), *ties))
    return found.unionByName(last.withColumn("_place", place).where("_place <= _left").drop("_place", "_left", "_range"))


def previous(df: DataFrame, keys: list[str], order: list[str], value: str, name: str, *, width: int = WIDTH) -> DataFrame:
    """``df`` with ``value`` of the key's row before this one; a range takes that of its first row from the ranges before."""
    df = _ranged(df, order, width)
    by = [*keys, "_range"]
    key = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))  # one row per range
    ends = df.groupBy(*by).agg(F.max_by(F.struct(F.col(value).alias("v")), F.struct(*order)).alias("_end"))
    seeds = ends.select(*by, F.lag("_end").over(key.orderBy("_range")).alias("_seed"))
    inside = F.lag(F.struct(F.col(value).alias("v"))).over(Window.partitionBy(*by).orderBy(*order))
    return _joined(df, seeds, by).withColumn(name, F.coalesce(inside, "_seed").getField("v")).drop("_range", "_seed")


def neighbours(df: DataFrame, row_no: str, values: dict[str, tuple[str, int]], *, rows: int = WIDTH) -> DataFrame:
    """``df`` with, for each (name: column, offset), the column of the row so many rows on (back, if negative).

    ``row_no`` numbers all rows without gaps. Rows within the largest offset of an
    edge are copied to the next range, where they only serve as neighbours.
    """
    reach = max(abs(k) for _, k in values.values())
    if reach > rows:
        raise ValueError("offsets must not exceed the rows of a range")
    own = F.floor(F.col(row_no) / rows)
    edges = F.array_distinct(F.array(F.floor((F.col(row_no) - reach) / rows), own, F.floor((F.col(row_no) + reach) / rows)))
    df = df.withColumn("_own", own).withColumn("_range", F.explode(edges))
    by = Window.partitionBy("_range").orderBy(row_no)
    found = [(F.lead(c, k) if k >= 0 else F.lag(c, -k)).over(by).alias(name) for name, (c, k) in values.items()]
    return df.select("*", *found).where("_range = _own").drop("_range", "_own")


def linear_recurrence(df: DataFrame, keys: list[str], order: list[str], *, gain: Column, offset: Column, initial: Column, name: str, width: int = WIDTH) -> DataFrame:
    """``df`` with x, where x = gain * (x of the row before) + offset, and x = initial in a key's first row.

    A range is an affine map of what comes into it: its rows' maps composed. Maps are
    composed over one row per range, and ranges applied to what arrives. A null gain,
    offset or initial gives null from there on.
    """
    df = _ranged(df, order, width).withColumns({"_gain": gain.cast("double"), "_offset": offset.cast("double"), "_initial": initial.cast("double")})
    by = [*keys, "_range"]
    nan = float("nan")

    def walk(g: pd.DataFrame, x: float, seeded: bool) -> tuple[float, float, list[float]]:
        slope, out = 1.0, []
        for k, (a, b, c) in enumerate(zip(g["_gain"].tolist(), g["_offset"].tolist(), g["_initial"].tolist())):
            x = c if k == 0 and not seeded else a * x + b
            slope *= a
            out.append(x)
        return slope, x, out

    def compose(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(order, kind="stable")
        slope, shift, _ = walk(g, 0.0, True)
        first = g[by].iloc[:1].reset_index(drop=True)
        return first.assign(_slope=slope, _shift=shift, _alone=walk(g, nan, False)[1])

    kinds = "".join(f"{c} {df.schema[c].dataType.simpleString()}, " for c in by)
    maps = df.select(*by, *[c for c in order if c not in by], "_gain", "_offset", "_initial").groupBy(*by).applyInPandas(compose, kinds + "_slope double, _shift double, _alone double")

    def carry(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("_range")
        seeds, x = [], nan
        for k, (slope, shift, alone) in enumerate(zip(g["_slope"], g["_shift"], g["_alone"])):
            seeds.append(x)
            x = alone if k == 0 else slope * x + shift
        return g[by].assign(_seed=seeds, _seeded=np.arange(len(g)) > 0)

    seeds = (maps.groupBy(*keys) if keys else maps.groupBy(F.lit(0))).applyInPandas(carry, kinds + "_seed double, _seeded boolean")
    kept = df.drop("_gain", "_offset", "_initial").columns
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in kept if c != "_range") + f", `{name}` double"

    def apply(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(order, kind="stable").reset_index(drop=True)
        _, _, out = walk(g, g["_seed"].iloc[0], bool(g["_seeded"].iloc[0]))
        return g[[c for c in kept if c != "_range"]].assign(**{name: out})

    done = _joined(df, seeds, by).groupBy(*by).applyInPandas(apply, schema)
    return done.withColumn(name, F.when(~F.isnan(name), F.col(name)))
