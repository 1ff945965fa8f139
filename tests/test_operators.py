import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quotemill.functions import quotes as q
from quotemill.operators import align, fusion, learning, normalize, windows
from quotemill.plans import live


def test_asof_matches_searchsorted(spark):
    rng = np.random.default_rng(1)
    left = pd.DataFrame({"k": 1, "t": np.sort(rng.integers(0, 300, 80)), "seq": np.arange(80)})
    right = pd.DataFrame({"k": 1, "t": np.sort(rng.integers(0, 300, 60)), "seq": np.arange(60), "v": np.arange(60)})
    l, r = spark.createDataFrame(left), spark.createDataFrame(right)
    for bucket in (None, 50):
        got = align.asof_backward(l, r, keys=["k"], time="t", seq="seq", values=["v"], bucket_ms=bucket).toPandas().sort_values("seq")
        at = np.searchsorted(right["t"], left["t"], side="right") - 1
        assert got["r_v"].fillna(-1).astype(int).tolist() == at.tolist()
    at = np.searchsorted(right["t"], left["t"] + 7, side="left")
    near = [min(((abs(t - u), u > t, u) for u in right["t"])) for t in left["t"]]
    for keys, bucket in ((["k"], None), (["k"], 50), ([], 20)):
        got = align.asof_forward(l, r, keys=keys, time="t", seq="seq", values=["v"], ahead=7, bucket_ms=bucket).toPandas().sort_values("seq")
        assert got["r_v"].fillna(60).astype(int).tolist() == at.tolist()
        clipped = align.asof_forward(l, r, keys=keys, time="t", seq="seq", values=["v"], ahead=7, clip=True, bucket_ms=bucket).toPandas().sort_values("seq")
        assert clipped["r_v"].astype(int).tolist() == np.minimum(at, 59).tolist()
        got = align.nearest(l, r, keys=keys, time="t", seq="seq", values=["v"], bucket_ms=bucket).toPandas().sort_values("seq")
        assert got["r_t"].astype(int).tolist() == [n[2] for n in near]


def test_filters_carry_their_state_through_batches(spark):
    from quotemill.operators import adapters, kernels

    rng = np.random.default_rng(5)
    rows = [(m, e, 1000 * e, x, 100.0 + rng.normal(), 1.0 + (x == "b"), 0.0) for m in ("m0", "m1") for e in range(40) for x in ("a", "b")]
    df = spark.createDataFrame(rows, "market string, event_seq long, now_ms long, exchange string, fair_value double, variance double, age_ms double")
    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # events are cut by batches
    try:
        got = {(r.market, r.event_seq): r.price for r in adapters.fused_kalman(df, "market").collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)
    want = {}
    for m in ("m0", "m1"):
        k = kernels.FusedKalman()
        for e in range(40):
            want[m, e] = k.step(float(e), [kernels.Observation(x, v, s) for mm, ee, _, x, v, s, _ in rows if (mm, ee) == (m, e)])["price"]
    assert got == pytest.approx(want)


def test_trailing_window_ties(spark):
    rng = np.random.default_rng(2)
    df = pd.DataFrame({"k": 1, "t": np.sort(rng.integers(0, 40, 120)), "seq": np.arange(120), "x": rng.normal(76_000, 1, 120)})
    got = windows.trailing_moments(spark.createDataFrame(df), "x", ["k"], "t", "seq", 10).toPandas().sort_values("seq")
    want = [df.x[(df.seq <= i) & (df.t >= df.t[i] - 10)] for i in df.seq]
    assert np.allclose(got["roll_mean"], [w.mean() for w in want])
    assert np.allclose(got["roll_std"], [w.std(ddof=0) for w in want], atol=1e-6)


def test_fair_value_goldens(spark):
    row = spark.range(1).select(
        q.mid(F.lit(100.0), F.lit(101.0)).alias("mid"),
        q.microprice(F.lit(100.0), F.lit(2.0), F.lit(101.0), F.lit(3.0)).alias("micro"),
        q.spread_bps(F.lit(100.0), F.lit(101.0)).alias("spread"),
        q.imbalance(F.lit(2.0), F.lit(3.0)).alias("imb"),
        q.measurement_variance(F.lit(60000.0), F.lit(0.05), F.lit(0.0), F.lit(0.0), F.lit(10.0), F.lit(0)).alias("tight"),
        q.measurement_variance(F.lit(60000.0), F.lit(5.0), F.lit(0.0), F.lit(0.0), F.lit(10.0), F.lit(0)).alias("wide"),
    ).first()
    assert (row.mid, round(row.micro, 9), round(row.imb, 9)) == (100.5, 100.4, -0.2)
    assert row.spread == pytest.approx(99.50248756)
    assert (row.tight, row.wide) == (pytest.approx(81), pytest.approx(900))


def test_composite_golden(spark):
    rows = [(1, "a", 100.0, 1.0), (1, "b", 102.0, 4.0), (2, "a", 100.0, 0.01), (2, "b", 102.0, 100.0)]
    live = spark.createDataFrame(rows, "g int, exchange string, fair_value double, effective_variance double")
    one = fusion.composite(live.where("g = 1"), ["g"], cap=1.0).first()
    assert one.fair_value == pytest.approx(100.4) and one.variance == pytest.approx(1.44) and one.venues == ["a", "b"]
    assert fusion.composite(live.where("g = 2"), ["g"]).first().fair_value == pytest.approx(100.5)


def test_ridge_matches_normal_equations(spark):
    rng = np.random.default_rng(4)
    X = rng.normal(size=(200, 3))
    y = X @ [1.0, -2.0, 0.5] + 3 + rng.normal(size=200)
    df = pd.DataFrame(X, columns=["a", "b", "c"]).assign(y=y, g=1, is_test=False)
    m = learning.ridge(spark.createDataFrame(df), ["g"], ["a", "b", "c"], "y", 1.0).first()
    Xc, yc = X - X.mean(0), y - y.mean()
    assert m.coefficients == pytest.approx(np.linalg.solve(Xc.T @ Xc + np.eye(3), Xc.T @ yc))


def test_normalisers(spark):
    raw = [
        '{"channel":"ticker","timestamp":"2031-02-03T04:05:06.78912345Z","events":["skip",1,{"type":"x","tickers":[{"product_id":"BTC-USD","best_bid":"512.25","best_bid_quantity":"3.125","best_ask":"512.5","best_ask_quantity":"1"}]}]}',
        '{"channel":"trades","data":[{"coin":"BTC","side":"B","time":1,"px":"1.5","sz":"2","hash":"h"},{"coin":"BTC","side":"X","time":1,"px":"1","sz":"2","hash":"i"}]}',
        '{"channel":"trade","type":"update","data":[{"symbol":"BTC/USD","side":"sell","price":1.10,"qty":2,"trade_id":98127,"timestamp":"2031-02-03T04:05:06.789Z"}]}',
        '{"arg":{"channel":"books5","instId":"BTC-USDT"},"data":[{"ts":"1927857906789","bids":[["1","2","0"],["bad"]],"asks":[["3","4"]]}]}',
        '{"channel":"bbo","data":{"coin":"BTC","time":5,"levels":[[],[{"px":"1","sz":"1"}]]}}',
    ]
    df = spark.createDataFrame([(i, 0, r) for i, r in enumerate(raw)], "seq long, received_ts_ms long, raw string")
    trade = normalize.hyperliquid_trades(df).collect()
    assert [(t.side, float(t.price), t.trade_id) for t in trade] == [("buy", 1.5, "h")]
    assert normalize.kraken_trades(df).first().trade_id == "98127"
    book = normalize.okx_books(df).first()
    assert book.market == "BTC-USDT" and book.source_ts_ms == 1927857906789 and len(book.levels) == 2
    assert normalize.hyperliquid_bbo(df).count() == 0
    assert normalize.quarantine(df, normalize.hyperliquid_trades(df)).count() == 4


def test_coinbase_drops_events_that_are_no_objects(spark):
    raw = '{"channel":"ticker","timestamp":"2031-02-03T04:05:06.78912345Z","events":[{"type":"x","tickers":[{"product_id":"BTC-USD","best_bid":"512.25","best_bid_quantity":"3.125","best_ask":"512.5","best_ask_quantity":"1"}]}]}'
    df = spark.createDataFrame([(1, 0, raw)], "seq long, received_ts_ms long, raw string")
    r = normalize.coinbase_ticker(df).first()
    assert r.source_ts_ms == 1927857906789 and str(r.bid_size) == "3.125000000000000000"


def test_feature_frame_rounds_as_its_sql(spark, monkeypatch):
    """A last bit below a half goes up where the product with the power of ten is that half."""
    values = [0.049216499999999996, 0.028514499999999998, -0.049216499999999996, 0.0492164, 12.0, None]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "seq long, v double").select("seq", *[F.col("v").alias(c) for c in live.NAMES])
    monkeypatch.setattr(live, "_frame", lambda s, d, **options: rows)
    got = live.book.queries["ml6_feature_frame"](spark, "").orderBy("seq").collect()
    assert [r[1] for r in got] == [r[len(live.NAMES)] for r in got] == [0.049217, 0.028515, -0.049217, 0.049216, 12.0, None]
