"""Work that grows with the rows, and no faster: what is fed batch by batch, read once or sorted in part."""

import inspect

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quotemill.operators import adapters, frames, kernels, learning, ranges
from quotemill.plans import live, models


def test_filters_forget_within_the_overlap():
    """One of three markets has a third of the events; blocks that start there agree with those before them at once."""
    rng = np.random.default_rng(3)
    overlap = inspect.signature(adapters.fused_kalman).parameters["overlap"].default // 3
    whole, block = kernels.FusedKalman(cutoff_ms=1e6), kernels.FusedKalman(cutoff_ms=1e6)
    for i in range(overlap + 2_000):
        seen = [kernels.Observation(v, 100 + 40 * rng.normal(), 0.01 + rng.random(), 1e5 * rng.random()) for v in "abcde"]
        for k in (whole, block) if i >= 2_000 else (whole,):
            k.step(25.0 * i, seen)
    view = lambda k: {"x": k.x, "p": k.p, "fused": k.fused, "move": k.move} | k.surprise
    assert adapters.agree(view(whole), view(block), 1e-11)


def test_coefficient_filters_hold_no_whole_group(spark):
    rng = np.random.default_rng(4)
    n = 300
    df = pd.DataFrame({"exchange": rng.choice(["a", "b"], n), "seq": np.arange(n), "ts_ms": np.arange(n) * 10, "mid": rng.normal(size=n), "f": rng.normal(size=n), "drift": rng.normal(size=n)})
    df = pd.concat([df, df.iloc[:3].assign(exchange="few", seq=[n, n + 1, n + 2])])
    rows = spark.createDataFrame(df)
    fitted = adapters.calibrated(rows, "exchange", ["seq"], ["f"], "drift", warm=0.3, time="ts_ms")
    late = adapters.delayed_beta(rows, "exchange", ["ts_ms", "seq"], ["f"], "mid", fitted, horizon_ms=50, time="ts_ms")
    now = adapters.beta_kalman(rows, "exchange", ["seq"], ["f"], "drift")
    for out in (fitted, late, now):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "FlatMapGroups" not in plan and "FlatMapCoGroups" not in plan
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)  # a key comes in many batches
    try:
        got, learned = late.toPandas(), now.toPandas().set_index("seq")
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    want, direct = {}, {}
    for v, own in df[df["exchange"] != "few"].groupby("exchange"):
        k = int(len(own) * 0.3)
        model = kernels.calibrate(own[["f"]].to_numpy()[:k], own["drift"].to_numpy()[:k])
        step = kernels.DelayedBeta(*model, 50)
        for r in own.iloc[k:].itertuples():
            want[r.seq] = step.step(r.ts_ms, r.mid, [r.f])
        beta, mean, scale = kernels.calibrate(own[["f"]].to_numpy()[:k], own["drift"].to_numpy()[:k])
        for r in own.iloc[k:].itertuples():
            x = np.array([1.0, *((np.array([r.f]) - mean) / scale)])
            direct[r.seq] = beta.predict(x)
            beta.learn(x, r.drift)
    assert dict(zip(got["seq"], got["predicted"])) == pytest.approx(want)
    assert len(learned) == len(df) and learned["predicted"].dropna().to_dict() == pytest.approx(direct)


def test_calibration_sums_up_a_long_path_in_parts(monkeypatch):
    rng = np.random.default_rng(8)
    X, y = rng.normal(size=(900, 2)), rng.normal(size=900)
    whole = kernels.calibrate(X, y)
    for chunk in (1, 7, 200, 201):
        monkeypatch.setattr(kernels, "_CHUNK", chunk)
        assert np.allclose(kernels.calibrate(X, y)[0].q, whole[0].q, rtol=1e-10)


@pytest.mark.parametrize("times", [list(range(80)), [5] * 80, [1] * 30 + [9] * 50, []])
def test_slices_land_from_one_pass(spark, monkeypatch, times):
    monkeypatch.setattr(live, "SLICE_ROWS", 10)
    passes = spark.sparkContext.accumulator(0)

    @F.pandas_udf("long")
    def counted(x: pd.Series) -> pd.Series:
        passes.add(len(x))
        return x

    rows = spark.createDataFrame([(i, t) for i, t in enumerate(times)], "seq long, ts_ms long")
    stream, at = live._landed(spark, rows.select("seq", counted("ts_ms").alias("ts_ms")))
    landed = spark.read.schema(rows.schema).parquet(f"{at}/landed")
    assert stream.isStreaming and sorted(r.seq for r in landed.collect()) == list(range(len(times)))
    assert passes.value <= 3 * len(times)


def test_top_share_equals_row_numbers(spark):
    rng = np.random.default_rng(9)
    rows = [(str(rng.choice(["a", "b"])), None if i % 11 == 0 else float("nan") if i % 97 == 0 else float(rng.integers(-40, 40)), i) for i in range(400)] + [(None, 1.0, 900), ("c", None, 901)]
    df = spark.createDataFrame(rows, "k string, x double, i long")
    df.createOrReplaceTempView("top_rows")
    want = spark.sql("select k, i from (select *, row_number() over (partition by k order by x desc nulls last, i) r, count(*) over (partition by k) n from top_rows) where r <= greatest(1, floor(n * 0.3))")
    for width in (1.0, 7.0, 1000.0):
        got = ranges.top_share(df, ["k"], "x", ["i"], 0.3, width=width)
        assert sorted(map(str, got.select("k", "i").collect())) == sorted(map(str, want.collect()))


def test_fits_read_stored_rows(spark):
    """An as-of join is not made again for every pass of a fit."""
    plan = models.book.queries["ml14_logistic"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Join" not in plan


def test_books_replay_without_a_group_for_each_segment(spark):
    level = lambda p, z: {"side": "buy", "price": float(p), "size": float(z), "price_text": "0", "size_text": "0"}
    kinds = ["snapshot" if i % 9 == 2 else "delta" for i in range(60)]
    rows = [("x" if i % 2 else "y", "m", i, k, [level(i % 5 + 1, i % 4)]) for i, k in enumerate(kinds)]
    df = spark.createDataFrame(rows, "exchange string, market string, seq long, kind string, levels array<struct<side:string,price:double,size:double,price_text:string,size_text:string>>")
    out = adapters.replay_books(df)
    assert "FlatMapGroups" not in out._jdf.queryExecution().executedPlan().toString()
    want = {}
    books = {"x": kernels.Book(), "y": kernels.Book()}
    for v, _, i, k, levels in rows:
        status = books[v].step(k, [tuple(x.values()) for x in levels])
        want[i] = (status, *(books[v].best()[:2] if status == "ok" else (None, None)))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 5)  # segments go on from batch to batch
    try:
        assert {r.seq: (r.status, r.bid, r.bid_size) for r in out.collect()} == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_frame_of_one_series_is_part_of_the_whole(spark):
    rng = np.random.default_rng(2)
    df = spark.createDataFrame(pd.DataFrame({"seq": np.arange(200), "t": np.sort(rng.integers(0, 900, 200)), "v": rng.choice(["a", "b"], 200), "x": rng.normal(size=200)}))
    made = lambda **k: frames.lagged_frame(df, time="t", seq="seq", who="v", venues=["a", "b"], features=["x"], lagged=["x"], lags=[20], bucket_ms=100, **k)
    want = made().join(df.where("v = 'a'").select("seq"), "seq", "left_semi").toPandas().sort_values("seq", ignore_index=True)
    got = made(of="a").toPandas().sort_values("seq", ignore_index=True)
    assert len(want) > 30 and got.equals(want)


def test_boosting_runs_until_it_stops_gaining(spark, monkeypatch):
    """A first tree of full weight and four at a tenth leave 0.04 of this variance; all rounds leave next to none."""
    rng = np.random.default_rng(6)
    n = 6_000
    df = pd.DataFrame({"exchange": rng.choice(["a", "b"], n), "seq": np.arange(n), "ts_ms": np.arange(n) * 10, "lean": rng.normal(size=n), "imb": rng.normal(size=n), "size": rng.integers(0, 100, n).astype(float)})
    df["drift"] = 20.0 * (df["size"] > 50) + 10.0 * (df["lean"] > 0) * (df["imb"] > 0)
    monkeypatch.setattr(models, "_labelled", lambda s, d: spark.createDataFrame(df))
    got = models.book.queries["ml13_boosted_trees"](spark, "").toPandas()
    assert sorted(got["seq"]) == sorted(i for _, g in df.groupby("exchange") for i in g["seq"].iloc[int(len(g) * 0.7) :])
    assert 1 - ((got["drift"] - got["predicted"]) ** 2).sum() / ((got["drift"] - got["drift"].mean()) ** 2).sum() > 0.998


def test_boosting_over_cells_is_boosting_over_rows():
    rng = np.random.default_rng(7)
    rows = pd.DataFrame(rng.integers(0, 6, (3_000, 3)), columns=list("abc"))
    y = rows["a"] * rows["b"] + rng.normal(size=len(rows))
    late = (np.arange(len(rows)) >= 2_500).astype(float)
    rows = rows.assign(n=1 - late, y=y * (1 - late), m=late, my=y * late, myy=y * y * late)
    options = {"rounds": 500, "patience": 30, "rate": 0.05, "leaves": 8, "least": 50, "l2": 1.0}

    def fitted(d):
        n, y, *held_out = (d[c].to_numpy(float) for c in ("n", "y", "m", "my", "myy"))
        return learning._rounds([d[c].to_numpy() for c in "abc"], n, y, tuple(held_out), **options)

    def error(trees, values, base):
        at = np.full(len(rows), base)
        for tree, v in zip(trees, values):
            leaf = np.zeros(len(rows), dtype=int)
            for k, (of, f, t) in enumerate(tree):
                leaf[(leaf == of) & (rows["abc"[f]] > t)] = k + 1
            at += np.array(v)[leaf]
        return (late * (y - at) ** 2).sum()

    splits, values, gains, base = fitted(rows)
    cells = fitted(rows.groupby(list("abc"), as_index=False).sum())
    assert cells[0] == splits and np.allclose(np.concatenate(cells[1]), np.concatenate(values)) and np.allclose(cells[2], gains)
    assert 5 < len(splits) < 500
    assert error(splits, values, base) < min(error(splits[:k], values[:k], base) for k in range(len(splits)))


def test_boosting_keeps_rows_without_values(spark):
    rows = [(i, i < 900, None if i % 50 == 0 else float("nan") if i % 50 == 1 else float(i % 7), None if i % 90 == 5 else float(i % 7 > 3)) for i in range(1_200)]
    df = spark.createDataFrame(rows, "i long, fitted boolean, x double, y double").withColumn("is_test", ~F.col("fitted"))
    out, gains = learning.boosted(df, ["x"], "y", ["i"], width=100)
    got = out.toPandas().set_index("i")["predicted"]
    assert len(got) == 1_200 and got.notna().all() and gains[0] > 0
    assert all(abs(got[i] - (i % 7 > 3)) < 0.15 for i in range(1_200) if i % 50 > 1)
    none, gains = learning.boosted(df.withColumn("is_test", F.lit(True)), ["x"], "y", ["i"])
    assert none.where("predicted is null").count() == 1_200 and gains == [0.0]
