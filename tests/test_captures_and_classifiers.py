import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quotemill.operators import learning
from quotemill.sources import captures


def test_capture_files_by_ranges(spark, tmp_path):
    rows = [(i, None if i % 7 == 0 else f"v'{i % 3}", i / 4 if i % 5 else None) for i in range(1000)]
    df = spark.createDataFrame(rows, 'id long, name string, `odd "x` double').repartition(3)
    assert len(captures.write_captures(df, f"file://{tmp_path}", "t")) == 3
    back = captures.read_capture(spark, f"file://{tmp_path}", "t", 'id long, name string, `odd "x` double', range_rows=100)
    assert back.rdd.getNumPartitions() >= 10 and sorted(map(tuple, back.collect())) == rows
    some = captures.read_capture(spark, f"{tmp_path}", "t", "name string, id long", where="id >= 500 AND name = 'v''1'")
    assert sorted((r.id, r.name) for r in some.collect()) == [(i, n) for i, n, _ in rows if i >= 500 and n == "v'1"]
    assert back.select("name").distinct().count() == 4 and back.where("id < 0").count() == 0
    assert captures.read_capture(spark, f"file://{tmp_path}", "other", "id long").count() == 0


def newton(X, y, weight, penalty):
    """L2 logistic by Newton's steps, the intercept free."""
    Z, w = np.column_stack([np.ones(len(y)), X]), np.zeros(X.shape[1] + 1)
    P = np.eye(len(w)) * penalty
    P[0, 0] = 0
    for _ in range(50):
        p = 1 / (1 + np.exp(-Z @ w))
        w = w - np.linalg.solve((Z * (weight * p * (1 - p))[:, None]).T @ Z + P, Z.T @ (weight * (p - y)) + P @ w)
    return 1 / (1 + np.exp(-Z @ w))


@pytest.mark.parametrize("balanced", [False, True])
def test_logistic_matches_newton(spark, balanced):
    rng = np.random.default_rng(9)
    X = rng.normal(size=(400, 3))
    y = (X @ [1.0, -2.0, 0.5] + rng.logistic(size=400) > 1.5).astype(int)
    df = pd.DataFrame(X, columns=list("abc")).assign(y=y, i=np.arange(400), is_test=np.arange(400) >= 300)
    got = learning.logistic(spark.createDataFrame(df), list("abc"), "y", balanced=balanced).toPandas().sort_values("i")["probability"]
    train = ~df["is_test"].to_numpy()
    n = np.bincount(y[train])
    weight = (train.sum() / (2.0 * n))[y[train]] if balanced else np.ones(train.sum())
    Z, w = np.column_stack([np.ones(400), X]), None
    fitted = newton(X[train], y[train], weight, 1.0)
    w = np.linalg.lstsq(Z[train], np.log(fitted / (1 - fitted)), rcond=None)[0]
    assert np.allclose(got, 1 / (1 + np.exp(-Z @ w)), atol=2e-4)
