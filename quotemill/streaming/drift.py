"""Live drift predictions: coefficients and the queue of outcomes still to come, both in state.

State of a key: the predictor (coefficients, their uncertainty) as one value, and a
list of what waits for its horizon, so that a micro-batch rewrites numbers and appends
to a list and never unpickles a history. Outcomes are released by event time.
"""

from __future__ import annotations

import pickle
from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quotemill.operators.kernels import BetaKalman, DelayedBeta


class DriftProcessor(StatefulProcessor):
    """``models``: per key a calibrated (coefficients, mean, scale) and the time that calibration ended; a row per venue."""

    def __init__(self, models: dict[str, tuple[bytes, int]], features: list[str], price: str, horizon_ms: int):
        self._models, self._features, self._price, self._horizon = models, features, price, horizon_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._beta = handle.getValueState("beta", "beta array<double>, p array<double>")
        self._waiting = handle.getListState("waiting", "due bigint, x array<double>, price double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows))
        if key[0] not in self._models:
            return
        payload, after = self._models[key[0]]
        fitted, mean, scale = pickle.loads(payload)
        if self._beta.exists():
            beta, p = self._beta.get()
            fitted = BetaKalman(fitted.n, fitted.q, fitted.r, np.array(beta), np.array(p).reshape(fitted.n, fitted.n))
        waiting = deque((int(due), np.array(x), float(price)) for due, x, price in self._waiting.get())
        kernel = DelayedBeta(fitted, mean, scale, self._horizon, waiting)
        batch = batch[batch["ts_ms"] > after].sort_values(["ts_ms", "seq"], kind="stable")
        out = [(*key, int(t), int(s), kernel.step(int(t), float(p), list(x))) for t, s, p, *x in batch[["ts_ms", "seq", self._price, *self._features]].itertuples(index=False)]
        self._beta.update((kernel.beta.beta.tolist(), kernel.beta.P.ravel().tolist()))
        self._waiting.clear()  # an empty list cannot be put
        if kernel.waiting:
            self._waiting.put([(due, x.tolist(), price) for due, x, price in kernel.waiting])
        if out:
            yield pd.DataFrame(out)

    def close(self) -> None:
        pass


def live_drift(stream: DataFrame, key: str, models: DataFrame, *, features: list[str], price: str, horizon_ms: int) -> DataFrame:
    """(key, ts_ms, seq, predicted) of a stream; ``models`` as from ``calibrated``, one row for each venue of a fixed list."""
    known = {r[key]: (bytes(r["payload"]), int(r["after"])) for r in models.collect()}
    processor = DriftProcessor(known, features, price, horizon_ms)
    schema = f"{key} string, ts_ms bigint, seq bigint, predicted double"
    return stream.groupBy(key).transformWithStateInPandas(processor, outputStructType=schema, outputMode="Append", timeMode="None").toDF(key, "ts_ms", "seq", "predicted")
