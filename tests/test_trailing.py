"""Trailing windows whose cost does not depend on what they hold, and folds fed batch by batch."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quotemill.operators import align, frames, simulators, windows


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("peers", [False, True])
def test_sums_over_stretches(spark, peers):
    rng = np.random.default_rng(5)
    df = pd.DataFrame({"k": rng.integers(0, 2, 300), "t": rng.integers(-50, 200, 300), "seq": np.arange(300), "x": rng.normal(0, 1, 300)})
    got = windows.trailing_sums(spark.createDataFrame(df), ["k"], "t", "seq", 10, {"s": F.col("x"), "n": F.lit(1)}, peers=peers, oldest={"o": F.col("x")})
    assert "RangeFrame, -" not in _plan(got)
    for r in got.toPandas().itertuples():
        own = df[(df.k == r.k) & (df.t >= r.t - 10) & ((df.t < r.t) | ((df.t == r.t) & (peers | (df.seq <= r.seq))))].sort_values(["t", "seq"])
        assert (r.n, r.o) == (len(own), own.x.iloc[0])
        assert r.s == pytest.approx(own.x.sum())


def test_volatility_without_sliding_frames(spark):
    df = spark.createDataFrame(pd.DataFrame({"k": 1, "t": [0, 1, 1, 30, 31, 32], "seq": range(6), "p": [1.0, 2.0, 1.0, 4.0, 2.0, 0.5]}))
    vol = windows.return_volatility(df, "p", ["k"], "t", "seq", 10, "vol")
    pre = windows.pre_event_volatility(df, "p", ["k"], "t", "seq", 10, "vol")
    assert "RangeFrame, -" not in _plan(vol) and "RangeFrame, -" not in _plan(pre)
    want = [None, 10_000 * np.std([1, -0.5]), 10_000 * np.std([1, -0.5]), None, 5_000.0, 10_000 * np.std([-0.5, -0.75])]
    assert [r.vol for r in vol.orderBy("seq").collect()] == [None if w is None else pytest.approx(w) for w in want]
    assert {r.vol for r in pre.collect()} == {None}


def test_simulators_keep_their_state_across_batches(spark):
    rng = np.random.default_rng(1)
    n = 400
    df = pd.DataFrame({"exchange": rng.choice(["a", "b"], n), "seq": np.arange(n), "ts_ms": np.sort(rng.integers(0, 3_000, n)), "price": 100 + rng.normal(0, 1, n)})
    df = df.assign(half_spread=0.1, z=rng.normal(0, 2, n), dislocation=rng.normal(0, 2, n), fair_value=df.price, drift=0.1, bid=df.price - 0.2, ask=df.price + 0.2, bid_size=1.0, ask_size=1.0, buy_flow=rng.random(n), sell_flow=rng.random(n))
    rows = spark.createDataFrame(df)

    def every():
        return [simulators.maker(rows, ["exchange"], ["half_spread"]), simulators.taker(rows, "exchange", threshold=1.5, horizon_ms=40, fee=0.0), simulators.mean_reversion(rows, "exchange", hold_ms=50)]

    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    whole = [x.orderBy("exchange", "seq").collect() for x in every()]
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
        parts = every()
        assert all("FlatMapGroupsInPandas" not in _plan(x) for x in parts)
        assert [x.orderBy("exchange", "seq").collect() for x in parts] == whole
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)
    assert all(len(x) > 5 for x in whole)
    taken = {(r.seq, r.exit_seq) for r in whole[1]}
    for k, g in df.groupby("exchange"):  # the plain rule
        free = -1
        for i in g.index:
            late = g.index[g.ts_ms >= g.ts_ms[i] + 40]
            if abs(g.dislocation[i]) > 1.5 and g.ts_ms[i] >= free and len(late):
                assert (i, late[0]) in taken
                taken.remove((i, late[0]))
                free = g.ts_ms[late[0]] + 1
    assert not taken


def test_latest_of_all_series_by_seq(spark):
    rows = spark.createDataFrame([(1, 5, "a", 1.0), (2, 5, "b", 2.0), (3, 5, "a", 3.0), (4, 9, "b", 4.0)], "seq long, t long, who string, x double")
    found = align.asof_many(rows, rows, time="t", seq="seq", who="who", others=["a", "b"], value="x", bucket_ms=8, by_seq=True)
    assert [(r.a_x, r.b_x) for r in found.orderBy("seq").collect()] == [(1.0, None), (1.0, 2.0), (3.0, 2.0), (3.0, 4.0)]


def test_frames_keep_null_values_of_rows_that_are_there(spark):
    rows = spark.createDataFrame([(1, 0, "a", 1.0), (2, 5, "a", None), (3, 12, "a", 4.0)], "seq long, t long, who string, x double")
    make = lambda complete: frames.lagged_frame(rows, time="t", seq="seq", who="who", venues=["a"], features=["x"], lagged=["x"], lags=[5], bucket_ms=8, complete=complete)
    assert [tuple(r) for r in make(False).orderBy("seq").collect()] == [(2, None, None), (3, 4.0, None)]
    assert make(True).count() == 0
