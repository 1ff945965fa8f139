"""Ranges, recurrences, blocks, folds and streams against brute force."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quotemill.operators import adapters, fusion, learning, ranges, stats
from quotemill.operators.kernels import BasisKalman, DelayedBeta, Ema, FusedKalman, calibrate
from quotemill.streaming.drift import live_drift
from quotemill.streaming.features import Ring, assemble, live_features


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(1)
    n = 600
    return pd.DataFrame({"k": rng.choice(np.array(["a", "b", None], dtype=object), n), "seq": np.sort(rng.choice(5000, n, replace=False)), "x": rng.normal(size=n), "y": rng.normal(size=n)})


def test_row_numbers_and_sums(spark, rows):
    df = ranges.numbered(spark.createDataFrame(rows), ["k"], ["seq"], "i", width=70, total="n")
    got = ranges.running_sum(df, [], ["seq"], F.when(F.col("k") == "a", 1).otherwise(0), "s", width=130).toPandas().sort_values("seq")
    rows = rows.assign(i=rows.groupby("k", dropna=False).cumcount() + 1, n=rows.groupby("k", dropna=False)["seq"].transform("size"), s=(rows["k"] == "a").cumsum())
    assert got[["i", "n", "s"]].to_numpy().tolist() == rows[["i", "n", "s"]].to_numpy().tolist()
    assert ranges.numbered(spark.createDataFrame(rows).where("false"), ["k"], ["seq"]).count() == 0


@pytest.mark.parametrize("size", [4, 50, 10_000])
def test_neighbours_and_correlations(spark, rows, size):
    df = spark.createDataFrame(rows.assign(no=np.arange(1, len(rows) + 1)))
    got = ranges.neighbours(df, "no", {"up": ("x", 4), "down": ("x", -3)}, rows=size).toPandas().sort_values("no")
    for name, k in (("up", -4), ("down", 3)):
        assert np.allclose(got[name].to_numpy(float), rows["x"].shift(k), equal_nan=True)
    c = {r.lag: r.correlation for r in stats.lagged_correlations(df, "x", "y", ["seq"], range(-2, 3), 10, width=90).collect()}
    assert all(c[k] == pytest.approx(rows["x"].corr(rows["y"].shift(-k))) for k in range(-2, 3))


@pytest.mark.parametrize("width", [3, 90, 100_000])
def test_average_by_ranges(spark, rows, width):
    got = adapters.ema(spark.createDataFrame(rows), ["k"], ["seq"], "x", 0.3, width=width).toPandas().sort_values("seq")
    kernels = {k: Ema(0.3) for k in ("a", "b", None)}
    assert np.allclose(got["ema"], [kernels[k].step(x) for k, x in zip(rows["k"], rows["x"])], rtol=1e-12)


def states(spark, n=900):
    rng = np.random.default_rng(2)
    prices = 100 + np.cumsum(rng.normal(size=n))
    rows = [("m", i, i * 250, v, float(prices[i] + (k - 1) + rng.normal()), float(0.5 + rng.random()), float(rng.integers(0, 900))) for i in range(n) for k, v in enumerate(("a", "b", "z")) if rng.random() < 0.8]
    return spark.createDataFrame(rows, "market string, event_seq long, now_ms long, exchange string, fair_value double, variance double, age_ms double")


@pytest.mark.parametrize("run,make,config", [(adapters.fused_kalman, FusedKalman, {}), (adapters.basis_kalman, BasisKalman, {"anchor": "a"})])
def test_blocks_equal_one_run(spark, run, make, config):
    df = states(spark)
    whole, last, want = make(**config), None, {}
    for event, at, obs in adapters._observed(df.toPandas()):
        if (found := whole.step(at, obs)) or (last and make is BasisKalman):
            last = found or last
            want[event] = last["price"]
    for width, overlap in ((150, 30), (300, 300), (5000, 10)):  # a short overlap leaves blocks to be run again
        got = {r.event_seq: r.price for r in run(df, "market", width=width, overlap=overlap, **config).collect()}
        assert got.keys() == want.keys() and all(got[e] == pytest.approx(want[e], rel=1e-9) for e in want)


def test_latest_states_by_ranges(spark):
    rng = np.random.default_rng(3)
    rows = [(f"m{rng.integers(2)}", i, i * 10, str(rng.choice(["a", "b", "c"])), float(i), 1.0) for i in range(200)]
    df = spark.createDataFrame(rows, "market string, seq long, ts_ms long, exchange string, fair_value double, variance double")
    got = {(r.market, r.event_seq, r.exchange): r.fair_value for r in fusion.latest_states(df, ["a", "b", "c"], ["seq"], width=17).collect()}
    want, held = {}, {}
    for m, i, _, v, x, _ in rows:
        held.setdefault(m, {})[v] = x
        want |= {(m, i, k): y for k, y in held[m].items()}
    assert got == want


@pytest.mark.parametrize("k", [2, 12])
def test_ridge_with_few_and_many_features(spark, k):
    rng = np.random.default_rng(4)
    X, g = rng.normal(size=(300, k)), rng.integers(0, 3, 300)
    y = X @ np.arange(1, k + 1) + 5 + rng.normal(size=300)
    names = [f"f{i}" for i in range(k)]
    df = spark.createDataFrame(pd.DataFrame(X, columns=names).assign(g=g, y=y, is_test=rng.random(300) < 0.2)).repartition(3)
    data = df.toPandas()
    for alpha in (0.0, 1.0):
        for r in learning.ridge(df, ["g"], names, "y", alpha).collect():
            own = data[(data["g"] == r.g) & ~data["is_test"]]
            Z = np.column_stack([np.ones(len(own)), own[names]])
            P = np.eye(k + 1) * alpha
            P[0, 0] = 0
            w = np.linalg.solve(Z.T @ Z + P, Z.T @ own["y"])
            assert np.allclose([r.intercept, *r.coefficients], w)
            if alpha == 0:
                e = own["y"] - Z @ w
                se = np.sqrt(e @ e / (len(own) - k - 1) * np.diag(np.linalg.inv(Z.T @ Z)))
                assert np.allclose(r.t_values, w / se)
            else:
                assert r.t_values is None
    m = learning.regression_metrics(F.col("y"), F.col("p"), F.abs("p") >= 2)
    row = spark.createDataFrame([(1.0, 1.0), (-1.0, 2.0), (3.0, 3.0), (-2.0, -1.0)], "y double, p double").agg(*[c.alias(n) for n, c in m.items()]).first()
    assert (row.direction, row.confident_direction, row.n) == (0.75, 0.5, 4) and row.r2 == pytest.approx(1 - 10 / 14.75)


def test_ring_lookups():
    ring = Ring()
    for t in (0, 10, 20, 20, 35):
        ring.push(t, [float(t)], 30)
    assert ring.times == [10, 20, 20, 35]
    assert ring.as_of(9, 100) is None and ring.as_of(34, 14) == [20.0] and ring.as_of(34, 13) is None
    assert assemble({"a": ring}, ["a"], [0], [10], 35) == [35.0, 15.0] and assemble({"a": ring}, ["a", "b"], [0], [10], 35) is None


def landed(spark, tmp_path, df, cuts):
    edges = [-1, *cuts, 10**15]
    for lo, hi in zip(edges, edges[1:]):
        df.where((F.col("ts_ms") > lo) & (F.col("ts_ms") <= hi)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")


def drained(spark, tmp_path, out):
    query = out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    query.awaitTermination(180)
    return spark.read.schema(out.schema).parquet(f"{tmp_path}/out").toPandas()


@pytest.mark.parametrize("cuts", [[], [300, 1700]])
def test_streamed_drift_equals_replay(spark, tmp_path, cuts):
    rng = np.random.default_rng(5)
    n = 240
    mid = 100 + np.cumsum(rng.normal(size=n))
    df = pd.DataFrame({"exchange": rng.choice(["a", "b"], n), "seq": np.arange(n), "ts_ms": np.sort(rng.integers(0, 2400, n)), "mid": mid, "f": rng.normal(size=n), "g": rng.normal(size=n), "drift": rng.normal(size=n)})
    rows = spark.createDataFrame(df)
    models = adapters.calibrated(rows, "exchange", ["seq"], ["f", "g"], "drift", warm=0.3, time="ts_ms")
    want = {}
    for v, own in df.groupby("exchange"):
        k = int(len(own) * 0.3)
        kernel = DelayedBeta(*calibrate(own[["f", "g"]].to_numpy()[:k], own["drift"].to_numpy()[:k]), 120)
        late = own[own["ts_ms"] > own["ts_ms"].iloc[k - 1]].sort_values(["ts_ms", "seq"])
        for r in late.itertuples():
            want[r.seq] = kernel.step(r.ts_ms, r.mid, [r.f, r.g])
    batch = adapters.delayed_beta(rows, "exchange", ["ts_ms", "seq"], ["f", "g"], "mid", models, horizon_ms=120, time="ts_ms").toPandas()
    stream = drained(spark, tmp_path, live_drift(landed(spark, tmp_path, rows, cuts), "exchange", models, features=["f", "g"], price="mid", horizon_ms=120))
    for got in (batch, stream):
        assert sorted(got["seq"]) == sorted(want) and np.allclose(got.set_index("seq")["predicted"].loc[sorted(want)], [want[s] for s in sorted(want)])


def test_streamed_features_equal_replay(spark, tmp_path):
    rng = np.random.default_rng(6)
    n = 150
    df = pd.DataFrame({"market": "m", "exchange": rng.choice(["a", "b"], n), "seq": np.arange(n), "ts_ms": np.sort(rng.integers(0, 3000, n)), "x": rng.normal(size=n)})
    names = ["a_x", "b_x", "a_l", "b_l"]
    out = live_features(landed(spark, tmp_path, spark.createDataFrame(df), [900, 901, 2000]), "market", venues=["a", "b"], features=["x"], lagged=["x"], lags=[50], names=names)
    got = {r.seq: (r.a_x, r.b_x, r.a_l, r.b_l) for r in drained(spark, tmp_path, out).itertuples()}
    rings, want = {"a": [], "b": []}, {}
    for r in df.sort_values(["ts_ms", "seq"]).itertuples():
        rings[r.exchange].append((r.ts_ms, r.x))
        past = {v: [p for p in rings[v] if p[0] <= r.ts_ms - 50][-1:] for v in rings}
        if r.exchange == "a" and all(rings.values()) and all(p and r.ts_ms - 50 - p[0][0] <= 100 for p in past.values()):
            want[r.seq] = (rings["a"][-1][1], rings["b"][-1][1], rings["a"][-1][1] - past["a"][0][1], rings["b"][-1][1] - past["b"][0][1])
    assert len(want) > 20 and got.keys() == want.keys() and all(got[s] == pytest.approx(want[s]) for s in want)
