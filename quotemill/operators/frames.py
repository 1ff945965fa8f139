"""Feature frames across venues and lags, from one sort of the events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotemill.operators import align


def lagged_names(venues: list[str], features: list[str], lagged: list[str], lags: list[int]) -> list[str]:
    """Columns of ``lagged_frame``: features by venue, then lagged differences by venue, feature and lag."""
    return [f"{v}_{f}" for v in venues for f in features] + [f"{v}_{f}_lag{i}" for v in venues for f in lagged for i in range(len(lags))]


def lagged_frame(events: DataFrame, *, time: str, seq: str, who: str, venues: list[str], features: list[str], lagged: list[str], lags: list[int], bucket_ms: int, complete: bool = True, of: str | None = None) -> DataFrame:
    """Per event every venue's latest features, and their changes since each lag, as (seq, columns of ``lagged_names``).

    An event is stacked once for each lag, its time shifted back by it, so one sort and
    one pass carry all venues' rows to all lags; a second grouping puts an event
    together again. A row counts for lag w if it is the venue's last at or before t - w
    and at most 2w before t; events that lack such a row are left out, with ``complete``
    those that lack any value, too. ``of``: the one series whose events are wanted; the
    others then only serve as its past, and are not stacked.
    """
    own = events.select(seq, time, who, F.struct(F.col(time).alias("at"), *features).alias("row"))
    shifts = [0, *lags]
    wanted = own if of is None else own.where(F.col(who) == of)
    stacked = wanted.select(seq, F.explode(F.array(*[F.struct(F.lit(i).alias("lag"), (F.col(time) - w).alias(time)) for i, w in enumerate(shifts)])).alias("_x")).select(seq, "_x.*")
    found = align.asof_many(stacked, own, time=time, seq=seq, who=who, others=venues, value="row", bucket_ms=bucket_ms)
    late = [F.when((F.col("lag") == 0) | (F.col(time) + F.element_at(F.array(*[F.lit(w) for w in shifts]), F.col("lag") + 1) - F.col(f"{v}_row.at") <= 2 * F.element_at(F.array(*[F.lit(w) for w in shifts]), F.col("lag") + 1)), F.col(f"{v}_row")).alias(f"{v}_row") for v in venues]
    found = found.select(seq, "lag", *late)
    rows = found.groupBy(seq).agg(*[F.first(F.when(F.col("lag") == i, F.col(f"{v}_row")), ignorenulls=True).alias(f"{v}_{i}") for v in venues for i in range(len(shifts))])
    cols = [F.col(f"{v}_0.{f}").alias(f"{v}_{f}") for v in venues for f in features]
    cols += [(F.col(f"{v}_0.{f}") - F.col(f"{v}_{i + 1}.{f}")).alias(f"{v}_{f}_lag{i}") for v in venues for f in lagged for i in range(len(lags))]
    found = rows.dropna(subset=[f"{v}_{i}" for v in venues for i in range(len(shifts))]).select(seq, *cols)
    return found.dropna() if complete else found
