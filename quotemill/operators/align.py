"""As-of, nearest and tolerance joins over event time without cross products.

Both sides are stacked and one window per key carries the matching row across, so a
join costs one shuffle and one sort on the key whatever the number of matches. Frames
always end at the current row, which Spark keeps running: rows after it are reached
by the reversed order. For a key too large for one task give ``bucket_ms``: it becomes
(key, time bucket), and each bucket is seeded with the last right row of the earlier
buckets and the first one of the later, found from one row per bucket. Without keys
the buckets are all that rows are dealt by.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def _stack(left: DataFrame, right: DataFrame, keys: list[str], time: str, seq: str, values: list[str], shift: int) -> DataFrame:
    """Both sides as (keys, _t, _side, _seq, _left, _right); side 1 is the left."""
    a = left.select(*keys, (F.col(time) + shift).alias("_t"), F.lit(1).alias("_side"), F.col(seq).alias("_seq"), F.struct(*left.columns).alias("_left"))
    b = right.select(*keys, F.col(time).alias("_t"), F.lit(0).alias("_side"), F.col(seq).alias("_seq"), F.struct(F.col(time).alias("_rt"), F.col(seq).alias("_rs"), *values).alias("_right"))
    return a.unionByName(b, allowMissingColumns=True)


def _by_bucket(stacked: DataFrame, keys: list[str], bucket_ms: int | None, back: bool, ahead: bool) -> tuple[DataFrame, list[str]]:
    """The rows, with the seeds of their buckets, and what they are dealt by."""
    if not bucket_ms:
        return stacked, keys
    stacked = stacked.withColumn("_b", F.floor(F.col("_t") / bucket_ms))
    row = F.when(F.col("_side") == 0, F.struct("_t", "_seq", "_right"))
    ends = stacked.groupBy(*keys, "_b").agg(F.max(row).alias("_hi"), F.min(row).alias("_lo"))
    over = Window.partitionBy(*(keys or [F.lit(0)]))  # one row per bucket
    out = stacked
    for end, order, wanted in (("_hi", F.col("_b").asc(), back), ("_lo", F.col("_b").desc(), ahead)):
        if wanted:
            seed = F.last(end, ignorenulls=True).over(over.orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
            seeds = ends.withColumn("_e", seed).where("_e is not null")
            seeds = seeds.select(*keys, "_b", F.col("_e._t").alias("_t"), F.lit(0).alias("_side"), F.col("_e._seq").alias("_seq"), F.col("_e._right").alias("_right"))
            out = out.unionByName(seeds, allowMissingColumns=True)
    return out, [*keys, "_b"]


def _running(by: list[str], *order: Column | str) -> WindowSpec:
    return Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def _previous(by: list[str]) -> Column:
    """The last right row at or before this row."""
    return F.last("_right", ignorenulls=True).over(_running(by, "_t", "_side", "_seq"))


def _next(by: list[str]) -> Column:
    """The first right row at or after this row."""
    return F.last("_right", ignorenulls=True).over(_running(by, F.col("_t").desc(), "_side", F.col("_seq").desc()))


def _out(df: DataFrame, found: Column, left: DataFrame, values: list[str], prefix: str, time: str, tolerance: int | None) -> DataFrame:
    df = df.withColumn("_m", found).where("_side = 1")
    if tolerance is not None:
        df = df.withColumn("_m", F.when(F.abs(F.col("_m._rt") - F.col("_t")) <= tolerance, F.col("_m")))
    return df.select(*[F.col(f"_left.{c}").alias(c) for c in left.columns], F.col("_m._rt").alias(f"{prefix}{time}"), *[F.col(f"_m.{v}").alias(f"{prefix}{v}") for v in values])


def asof_backward(left: DataFrame, right: DataFrame, *, keys: list[str], time: str, seq: str, values: list[str], prefix: str = "r_", lag: int = 0, tolerance: int | None = None, bucket_ms: int | None = None) -> DataFrame:
    """Each left row with the last right row at or before its time minus ``lag``.

    Among right rows of one time the largest ``seq`` counts. Matches further than
    ``tolerance`` away are null. Rows are never lost or doubled.
    """
    rows, by = _by_bucket(_stack(left, right, keys, time, seq, values, -lag), keys, bucket_ms, back=True, ahead=False)
    return _out(rows, _previous(by), left, values, prefix, time, tolerance)


def asof_forward(left: DataFrame, right: DataFrame, *, keys: list[str], time: str, seq: str, values: list[str], prefix: str = "r_", ahead: int = 0, tolerance: int | None = None, clip: bool = False, bucket_ms: int | None = None) -> DataFrame:
    """Each left row with the first right row at or after its time plus ``ahead``.

    Among right rows of one time the smallest ``seq`` counts. ``clip``: after the end
    of the right side its last row counts.
    """
    rows, by = _by_bucket(_stack(left, right, keys, time, seq, values, ahead), keys, bucket_ms, back=clip, ahead=True)
    found = F.coalesce(_next(by), _previous(by)) if clip else _next(by)
    return _out(rows, found, left, values, prefix, time, tolerance)


def nearest(left: DataFrame, right: DataFrame, *, keys: list[str], time: str, seq: str, values: list[str], prefix: str = "r_", tolerance: int | None = None, bucket_ms: int | None = None) -> DataFrame:
    """Each left row with the right row nearest in time; ties go to the earlier one."""
    rows, by = _by_bucket(_stack(left, right, keys, time, seq, values, 0), keys, bucket_ms, back=True, ahead=True)
    both = rows.withColumn("_p", _previous(by)).withColumn("_n", _next(by))
    pick = F.when(F.col("_n").isNull(), F.col("_p")).when(F.col("_p").isNull(), F.col("_n")).when(F.col("_t") - F.col("_p._rt") <= F.col("_n._rt") - F.col("_t"), F.col("_p")).otherwise(F.col("_n"))
    return _out(both, pick, left, values, prefix, time, tolerance)


def asof_many(left: DataFrame, right: DataFrame, *, time: str, seq: str, who: str, others: list[str], value: str, bucket_ms: int, by_seq: bool = False) -> DataFrame:
    """Each left row with the last value of every series in ``others``, in one pass over one sort.

    Rows are dealt by time bucket; a bucket is seeded with the last values before it,
    carried over a table of one row per bucket. Of the right rows of a left row's time all
    count; with ``by_seq`` those of a larger ``seq`` do not.
    """
    bucket = F.floor(F.col(time) / bucket_ms).alias("_b")
    a = left.select(bucket, F.col(time).alias("_t"), F.lit(1).alias("_side"), F.col(seq).alias("_seq"), F.struct(*left.columns).alias("_left"))
    b = right.select(bucket, F.col(time).alias("_t"), F.lit(0).alias("_side"), F.col(seq).alias("_seq"), F.col(who).alias("_who"), F.col(value).alias("_v"))
    at = F.struct("_t", "_seq")
    own = lambda o: (F.col("_who") == o) & F.col("_v").isNotNull()
    ends = b.groupBy("_b").agg(*[F.max_by("_v", F.when(own(o), at)).alias(f"_e{i}") for i, o in enumerate(others)])
    days = a.select("_b").distinct().join(ends, "_b", "full")
    before = Window.partitionBy(F.lit(0)).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # one row per bucket
    seeds = days.select("_b", *[F.last(f"_e{i}", ignorenulls=True).over(before).alias(f"_s{i}") for i in range(len(others))])
    w = Window.partitionBy("_b").orderBy(*(("_t", "_seq", "_side") if by_seq else ("_t", "_side", "_seq"))).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = a.unionByName(b, allowMissingColumns=True)
    cols = [F.last(F.when(own(o), F.col("_v")), ignorenulls=True).over(w).alias(f"_w{i}") for i, o in enumerate(others)]
    found = both.select("_b", "_side", "_left", *cols).where("_side = 1").join(seeds, "_b", "left")
    return found.select("_left.*", *[F.coalesce(f"_w{i}", f"_s{i}").alias(f"{o}_{value}") for i, o in enumerate(others)])
