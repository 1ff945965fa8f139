"""Streaming adapters: the batch kernels behind ``transformWithStateInPandas``.

Rows of a micro-batch are sorted by (time, seq) before the kernel sees them, as their
arrival order within a batch is not defined; across batches order is that of arrival.
State is the kernel pickled in the state store, one per key.
"""

from __future__ import annotations

import pickle
from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


class KernelProcessor(StatefulProcessor):
    """Runs ``step(kernel, row)`` over a key's rows; a None result emits nothing."""

    def __init__(self, make: Callable[[], object], step: Callable[[object, object], dict | None], order: tuple[str, ...], columns: tuple[str, ...]):
        self._make, self._step, self._order, self._columns = make, step, order, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._state = handle.getValueState("kernel", "payload binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        kernel = pickle.loads(bytes(self._state.get()[0])) if self._state.exists() else self._make()
        out = []
        for r in pd.concat(list(rows)).sort_values(list(self._order), kind="stable").itertuples():
            if (found := self._step(kernel, r)) is not None:
                out.append((*key, *(found[c] for c in self._columns)))
        self._state.update((pickle.dumps(kernel),))
        if out:
            yield pd.DataFrame(out)

    def close(self) -> None:
        pass


def stream_kernel(df: DataFrame, keys: list[str], order: tuple[str, ...], make, step, schema: str) -> DataFrame:
    """``schema``: the key columns, then the columns that ``step`` returns by name."""
    names = [c.strip().split()[0] for c in schema.split(",")]
    processor = KernelProcessor(make, step, order, tuple(names[len(keys) :]))
    out = df.groupBy(*keys).transformWithStateInPandas(processor, outputStructType=schema, outputMode="Append", timeMode="None")
    return out.toDF(*names)


def latest_per_key(df: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """Of a backlog only the newest message of each key."""
    return df.groupBy(*keys).agg(F.max_by(F.struct(*df.columns), seq).alias("r")).select("r.*")


class _Flow:
    """Signed sizes of the trailing span, with their sum kept up to date."""

    def __init__(self) -> None:
        self.held: deque[tuple[int, float]] = deque()
        self.net = 0.0


def rolling_flow(trades: DataFrame, span_ms: int):
    """A step for ``stream_kernel``: trade flow over the trailing span, one row per trade."""

    def step(flow: _Flow, r) -> dict:
        signed = r.size if r.side == "buy" else -r.size
        flow.held.append((r.ts_ms, signed))
        flow.net += signed
        while flow.held[0][0] < r.ts_ms - span_ms:
            flow.net -= flow.held.popleft()[1]
        return {"seq": r.seq, "net": flow.net, "n": len(flow.held)}

    return _Flow, step
