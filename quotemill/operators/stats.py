"""Aggregate expressions for evaluation, trading and spread statistics."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quotemill.operators import ranges


def mae(x: Column) -> Column:
    return F.avg(F.abs(x))


def rmse(x: Column) -> Column:
    return F.sqrt(F.avg(x * x))


def correlation(x: Column, y: Column) -> Column:
    """Pearson correlation; null where either side does not vary."""
    return F.when((F.var_pop(x) > 0) & (F.var_pop(y) > 0), F.corr(x, y))


def hit_rate(signal: Column, outcome: Column) -> Column:
    """Share of equal signs among rows where neither is zero."""
    return F.avg(F.when((signal != 0) & (outcome != 0), (F.signum(signal) == F.signum(outcome)).cast("double")))


def share(condition: Column) -> Column:
    return F.avg(condition.cast("double"))


def inverse_variance_mean(x: Column, var: Column) -> Column:
    good = (var > 0) & ~F.isnan(var) & ~F.isnan(x)
    return F.try_divide(F.sum(F.when(good, x / var)), F.sum(F.when(good, 1 / var)))


def sharpe(x: Column, periods: float = 1.0) -> Column:
    return F.avg(x) / (F.stddev_pop(x) + 1e-12) * math.sqrt(periods)


def paired_difference(diff: Column) -> dict[str, Column]:
    sem = F.stddev_samp(diff) / F.sqrt(F.count(diff))
    return {"mean": F.avg(diff), "sem": sem, "t": F.try_divide(F.avg(diff), sem), "win": share(diff < 0), "tie": share(diff == 0)}


def quartile_bucket(x: Column, q1: Column, q2: Column, q3: Column) -> Column:
    return F.when(x <= q1, 1).when(x <= q2, 2).when(x <= q3, 3).otherwise(4)


def ar1_half_life(df: DataFrame, keys: list[str], value: str, order: list[str], least: int = 10) -> DataFrame:
    """half_life = ln 0.5 / ln rho of the demeaned series; null unless 0 < rho < 1 and there are enough points."""
    by = Window.partitionBy(*keys)
    df = df.withColumn("_x", F.col(value) - F.avg(value).over(by)).withColumn("_p", F.lag("_x").over(by.orderBy(*order)))
    out = df.groupBy(*keys).agg(F.count("*").alias("n"), F.try_divide(F.sum(F.col("_x") * F.col("_p")), F.sum(F.when(F.col("_p").isNotNull(), F.col("_p") * F.col("_p")))).alias("rho"))
    return out.withColumn("half_life", F.when((F.col("n") >= least) & (F.col("rho") > 0) & (F.col("rho") < 1), math.log(0.5) / F.log("rho")))


def concentration(df: DataFrame, keys: list[str], loss: str, order: list[str], shares: tuple[float, ...]) -> DataFrame:
    """Share of the total that the largest ``p`` of rows hold, for each p."""
    by = Window.partitionBy(*keys)
    ranked = by.orderBy(F.col(loss).desc(), *order)
    df = df.withColumn("_i", F.row_number().over(ranked) - 1).withColumn("_c", F.sum(loss).over(ranked.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_n", F.count("*").over(by))
    last = {p: F.greatest(F.lit(0), F.floor(F.col("_n") * p).cast("int") - 1) for p in shares}
    return df.groupBy(*keys).agg(*[F.try_divide(F.max(F.when(F.col("_i") == at, F.col("_c"))), F.sum(loss)).alias(f"top_{int(p * 100)}") for p, at in last.items()])


def lagged_correlations(df: DataFrame, x: str, y: str, order: list[str], lags: range, least: int, width: int = ranges.WIDTH) -> DataFrame:
    """corr(x at t, y at t + lag) over complete pairs, one row for each lag; rows are dealt by ranges of their numbers."""
    rows = ranges.numbered(df.select(x, y, *order), [], order, "_no", width=width)
    shifted = ranges.neighbours(rows, "_no", {f"_y{i}": (y, k) for i, k in enumerate(lags)})
    cols = []
    for i in range(len(lags)):
        both = F.col(x).isNotNull() & F.col(f"_y{i}").isNotNull()
        cols.append(F.struct(F.lit(list(lags)[i]).alias("lag"), F.count_if(both).alias("n"), F.corr(F.when(both, F.col(x)), F.when(both, F.col(f"_y{i}"))).alias("c")))
    out = shifted.agg(F.array(*cols).alias("a")).select(F.explode("a").alias("e"))
    return out.select("e.lag", "e.n", F.when(F.col("e.n") >= least, F.col("e.c")).alias("correlation"))
