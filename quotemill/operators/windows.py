"""Trailing windows with exact treatment of rows that share a time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from quotemill.operators import ranges


def trailing_sums(df: DataFrame, keys: list[str], time: str, seq: str, span: int, values: dict[str, Column], *, peers: bool = False, oldest: dict[str, Column] | None = None) -> DataFrame:
    """``df`` with the sum of each of ``values`` over [t - span, this row], null where none is there.

    Rows of the same time that come later count only with ``peers``. ``oldest``: columns for
    values of the window's first row. A key's time is cut into stretches of ``span``: a window
    is the end of one and the beginning of the next, so it is a running sum from the back of
    the one, whose rows are copied on by ``span``, and a running sum from the front of the
    other. Nothing is taken off again, a row costs the same however many its window holds,
    and a task holds two stretches.
    """
    oldest = oldest or {}
    kept, width = df.columns, max(span, 1)
    inputs = {f"_v{i}": v for i, v in enumerate(values.values())} | {f"_o{i}": F.struct(v.alias("v")) for i, v in enumerate(oldest.values())}
    past, at = F.col("_past") == 1, F.col(time)
    df = df.withColumns(inputs).withColumn("_past", F.explode(F.array(F.lit(0), F.lit(1)))).where((F.col("_past") == 0) | at.isNotNull())
    df = df.withColumns({"_at": at + F.col("_past") * span, "_stretch": F.floor(at / width) + F.col("_past")})
    df = df.withColumns({c: F.when(~past, F.col(c)) for c in kept if c not in (*keys, seq)})
    front = Window.partitionBy(*keys, "_stretch").orderBy("_at", "_past", seq).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = Window.partitionBy(*keys, "_stretch").orderBy("_at").rangeBetween(Window.unboundedPreceding, Window.currentRow) if peers else front
    back = Window.partitionBy(*keys, "_stretch").orderBy(F.col("_at").desc(), F.col("_past").desc(), F.col(seq).desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    backs = {f"_b{i}": F.sum(F.when(past, F.col(f"_v{i}"))).over(back) for i in range(len(values))}
    backs |= {f"_p{i}": F.last(F.when(past, F.col(f"_o{i}")), ignorenulls=True).over(back) for i in range(len(oldest))}
    fronts = {f"_f{i}": F.sum(F.when(~past, F.col(f"_v{i}"))).over(summed) for i in range(len(values))}
    fronts |= {f"_q{i}": F.first(F.when(~past, F.col(f"_o{i}")), ignorenulls=True).over(front) for i in range(len(oldest))}
    df = df.withColumns(backs).withColumns(fronts).where(~past)
    total = {name: F.coalesce(F.col(f"_b{i}") + F.col(f"_f{i}"), f"_b{i}", f"_f{i}") for i, name in enumerate(values)}
    first = {name: F.coalesce(f"_p{i}", f"_q{i}").getField("v") for i, name in enumerate(oldest)}
    return df.select(*kept, *[c.alias(name) for name, c in (total | first).items()])


def trailing_moments(df: DataFrame, value: str, keys: list[str], time: str, seq: str, span: int, peers: bool = False) -> DataFrame:
    """roll_n, roll_mean, roll_std (population) of ``value`` over the trailing window of each row; ``peers``: see ``trailing_sums``."""
    shift = df.groupBy(*keys).agg(F.avg(value).alias("_shift"))
    x = F.col(value) - F.col("_shift")
    df = df.join(shift, keys)
    df = trailing_sums(df, keys, time, seq, span, {"roll_n": F.when(F.col(value).isNotNull(), 1).otherwise(0), "_m": x, "_q": x * x}, peers=peers)
    df = df.withColumns({c: F.try_divide(F.coalesce(c, F.lit(0.0)), "roll_n") for c in ("_m", "_q")})
    return df.withColumn("roll_mean", F.col("_m") + F.col("_shift")).withColumn("roll_std", F.sqrt(F.greatest(F.col("_q") - F.col("_m") * F.col("_m"), F.lit(0.0)))).drop("_m", "_q", "_shift")


def return_volatility(df: DataFrame, price: str, keys: list[str], time: str, seq: str, span: int, name: str) -> DataFrame:
    """Population deviation, in bps, of simple returns between consecutive points of the trailing window.

    The return into the window's first point belongs to no window point pair and is
    taken off. No return: null; one: its size. Zero prices give no return.
    """
    df = ranges.previous(df, keys, [time, seq], price, "_before", width=span)
    df = df.withColumn("_r", F.try_divide(F.col(price), F.when(F.col("_before") != 0, F.col("_before"))) - 1)
    r = F.col("_r")
    df = trailing_sums(df, keys, time, seq, span, {"_n": F.when(r.isNotNull(), 1).otherwise(0), "_s": r, "_q": r * r}, peers=True, oldest={"_first": r})
    first = F.coalesce("_first", F.lit(0.0))
    df = df.withColumns({"_n": F.col("_n") - F.when(F.col("_first").isNotNull(), 1).otherwise(0), "_s": F.col("_s") - first, "_q": F.col("_q") - first * first})
    var = F.col("_q") / F.col("_n") - F.pow(F.col("_s") / F.col("_n"), F.lit(2))
    vol = F.when(F.col("_n") < 1, F.lit(None).cast("double")).when(F.col("_n") == 1, F.abs(F.col("_s"))).otherwise(F.sqrt(F.greatest(var, F.lit(0.0))))
    return df.withColumn(name, vol * 10_000.0).drop("_before", "_r", "_n", "_s", "_q", "_first")


def pre_event_volatility(df: DataFrame, price: str, keys: list[str], time: str, seq: str, span: int, name: str) -> DataFrame:
    """Root of the summed squared log returns between consecutive earlier rows no older than ``span``; null under three of them."""
    df = ranges.previous(df, keys, [time, seq], price, "_before", width=span)
    df = df.withColumn("_r", F.coalesce(F.pow(F.log(F.col(price) / F.col("_before")), F.lit(2.0)), F.lit(0.0)))
    # the return into the window's first row starts outside of it, that into this row ends it
    df = trailing_sums(df, keys, time, seq, span, {"_q": F.col("_r"), "_k": F.lit(1)}, oldest={"_first": F.col("_r")})
    total = F.col("_q") - F.col("_r") - F.when(F.col("_k") > 1, F.col("_first")).otherwise(0.0)
    return df.withColumn(name, F.when(F.col("_k") > 3, F.sqrt(F.greatest(total, F.lit(0.0))))).drop("_before", "_r", "_q", "_k", "_first")


def rolling_mean_carried(df: DataFrame, value: str, keys: list[str], order: list[str], rows: int, name: str) -> DataFrame:
    """Mean of the last ``rows`` non-null values up to each row; carried over null rows."""
    by = Window.partitionBy(*keys).orderBy(*order)
    df = df.withColumn("_k", F.count(value).over(by))
    some = df.where(F.col(value).isNotNull()).select(*keys, "_k", F.avg(value).over(by.rowsBetween(-(rows - 1), 0)).alias(name))
    return df.join(some, [*keys, "_k"], "left").drop("_k")


def previous_rows(keys: list[str], order: list[str], rows: int) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(*order).rowsBetween(-rows, -1)


def fill_buckets(df: DataFrame, keys: list[str], bucket: str, values: dict[str, float]) -> DataFrame:
    """A row for every bucket from a key's first to its last; absent ones take ``values``."""
    bounds = df.groupBy(*keys).agg(F.min(bucket).alias("_lo"), F.max(bucket).alias("_hi"))
    grid = bounds.select(*keys, F.explode(F.sequence("_lo", "_hi")).alias(bucket))
    return grid.join(df, [*keys, bucket], "left").fillna(values)


def downsample(df: DataFrame, keys: list[str], order: list[str], most: int) -> DataFrame:
    """At most ``most`` rows of each key, evenly spaced by position."""
    by = Window.partitionBy(*keys).orderBy(*order)
    df = df.withColumn("_i", F.row_number().over(by) - 1).withColumn("_n", F.count("*").over(Window.partitionBy(*keys)))
    nth = F.ceil(F.col("_i") * most / F.col("_n"))
    wanted = F.floor(nth * F.col("_n") / most) == F.col("_i")
    return df.where((F.col("_n") <= most) | (wanted & (nth < most))).drop("_i", "_n")


def skip_first(df: DataFrame, keys: list[str], order: list[str], k: int) -> DataFrame:
    return df.withColumn("_i", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_i") > k).drop("_i")
