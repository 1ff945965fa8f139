"""Capped inverse-variance fusion of venue states into a composite."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def capped_weights(df: DataFrame, group: list[str], weight: str, tie: str, cap: float, name: str = "capped_weight") -> DataFrame:
    """Weights that sum to one with none above ``cap``: the excess is spread over the rest in proportion.

    Closed form of the iterative rule: with weights in descending order and tails S_m,
    the least m with w_m (1 - m cap) / S_m <= cap tells how many are capped. Unchanged
    where one venue, a cap below 1/n, or a total of zero leaves nothing to spread.
    """
    by = Window.partitionBy(*group)
    order = by.orderBy(F.col(weight).desc(), tie)
    df = df.withColumn("_n", F.count("*").over(by)).withColumn("_t", F.sum(weight).over(by)).withColumn("_m", F.row_number().over(order) - 1)
    df = df.withColumn("_w", F.try_divide(F.col(weight), F.col("_t")))
    df = df.withColumn("_tail", F.sum("_w").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    scaled = F.try_divide(F.col("_w") * (1 - F.col("_m") * cap), F.col("_tail"))
    df = df.withColumn("_ok", F.when(scaled <= cap + 1e-15, F.struct(F.col("_m"), F.col("_tail"))))
    df = df.withColumn("_s", F.min("_ok").over(by))
    plain = (F.col("_n") <= 1) | (F.col("_n") * cap < 1) | (F.col("_t") <= 0) | F.col("_s").isNull()
    spread = F.when(F.col("_m") < F.col("_s._m"), F.lit(cap)).otherwise(F.try_divide(F.col("_w") * (1 - F.col("_s._m") * cap), F.col("_s._tail")))
    return df.withColumn(name, F.when(plain, F.col("_w")).otherwise(spread)).drop("_n", "_t", "_m", "_w", "_tail", "_ok", "_s")


def live_states(states: DataFrame, now: str, stale_ms: int, penalty: float) -> DataFrame:
    """States no older than ``stale_ms`` with their age and their variance inflated by it."""
    df = states.withColumn("age_ms", F.greatest(F.col(now) - F.col("state_ts_ms"), F.lit(0)))
    df = df.where(F.col("age_ms") <= stale_ms).withColumn("effective_variance", F.col("variance") * (1 + penalty * F.col("age_ms") / 1000.0))
    return df.where("effective_variance > 0")


def composite(live: DataFrame, group: list[str], cap: float = 0.75, disagreement: float = 1.0, floor: float = 0.01) -> DataFrame:
    """fair_value, variance and the sorted names of contributing venues, one row per group."""
    df = capped_weights(live.withColumn("_iv", 1 / F.col("effective_variance")), group, "_iv", "exchange", cap, "w")
    df = df.withColumn("_fv", F.sum(F.col("w") * F.col("fair_value")).over(Window.partitionBy(*group)))
    return df.groupBy(*group).agg(
        F.max("_fv").alias("fair_value"),
        F.greatest(F.lit(floor), F.sum(F.col("w") * F.col("w") * F.col("effective_variance")) + disagreement * F.sum(F.col("w") * F.pow(F.col("fair_value") - F.col("_fv"), F.lit(2)))).alias("variance"),
        F.array_sort(F.collect_list("exchange")).alias("venues"),
    )


def latest_states(events: DataFrame, venues: list[str], order: list[str], width: int = 5_000) -> DataFrame:
    """After each event the last state of every venue in ``venues``: one row per event and venue seen so far.

    Rows are dealt by market and range of the first order column, ``width`` long; a
    range starts from the last states before it, carried over one row per range.
    """
    events = events.withColumn("_range", F.floor(F.col(order[0]) / width))
    state = F.struct("exchange", F.col("ts_ms").alias("state_ts_ms"), "fair_value", "variance")
    own = [F.when(F.col("exchange") == v, state) for v in venues]
    ends = events.groupBy("market", "_range").agg(*[F.max_by(s, F.when(s.isNotNull(), F.struct(*order))).alias(f"_e{i}") for i, s in enumerate(own)])
    before = Window.partitionBy("market").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    seeds = ends.select("market", "_range", *[F.last(f"_e{i}", ignorenulls=True).over(before).alias(f"_s{i}") for i in range(len(venues))])
    inside = Window.partitionBy("market", "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = events.join(seeds, ["market", "_range"])
    held = [F.coalesce(F.last(s, ignorenulls=True).over(inside), F.col(f"_s{i}")) for i, s in enumerate(own)]
    rows = rows.select("market", F.col("seq").alias("event_seq"), F.col("ts_ms").alias("now_ms"), F.array(*held).alias("held"))
    return rows.select("market", "event_seq", "now_ms", F.explode(F.filter("held", lambda s: s.isNotNull())).alias("s")).select("market", "event_seq", "now_ms", "s.*")
