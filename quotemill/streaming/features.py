"""Live features: every venue's recent rows held in state, looked up as of a lag.

State of a key: a map from venue to its ring buffer (times, features), each entry of
its own so that an event rewrites one venue's buffer only. Rows older than the
retention go as newer ones come; an idle key's state expires by its time to live.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


class Ring:
    """A venue's rows of the retained span, in order of time."""

    def __init__(self, times: list[int] | None = None, rows: list[list[float]] | None = None):
        self.times, self.rows = times or [], rows or []

    def push(self, at: int, row: list[float], retain_ms: int) -> None:
        self.times.append(at)
        self.rows.append(row)
        gone = bisect_left(self.times, at - retain_ms)
        if gone:
            del self.times[:gone], self.rows[:gone]

    def as_of(self, at: int, max_gap_ms: int) -> list[float] | None:
        """The last row at or before ``at``, if at most so far before it."""
        k = bisect_right(self.times, at) - 1
        return self.rows[k] if k >= 0 and at - self.times[k] <= max_gap_ms else None


def assemble(rings: dict[str, Ring], venues: list[str], lagged: list[int], lags: list[int], now: int) -> list[float] | None:
    """Latest rows of all venues, then changes of the ``lagged`` features since each lag; None if any is missing.

    A past row may lie up to two lags before the moment it stands for.
    """
    if any(v not in rings or not rings[v].rows for v in venues):
        return None
    out = [x for v in venues for x in rings[v].rows[-1]]
    for v in venues:
        past = [rings[v].as_of(now - w, 2 * w) for w in lags]
        if any(p is None for p in past):
            return None
        out += [rings[v].rows[-1][f] - p[f] for f in lagged for p in past]
    return out


class LiveFeatures(StatefulProcessor):
    """Emits the assembled features at every event of the predicted venue, ``venues[0]``."""

    def __init__(self, venues: list[str], features: list[str], lagged: list[int], lags: list[int], ttl_ms: int | None):
        self._venues, self._features, self._lagged, self._lags, self._ttl = venues, features, lagged, lags, ttl_ms
        self._retain = 3 * max(lags) + 1

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._rings = handle.getMapState("rings", "venue string", "times array<bigint>, cells array<double>", ttlDurationMs=self._ttl)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n, rings = len(self._features), {}
        for v in self._venues:
            if self._rings.containsKey((v,)):
                times, cells = self._rings.getValue((v,))
                rings[v] = Ring(list(times), [list(cells[i : i + n]) for i in range(0, len(cells), n)])
        changed, out = set(), []
        batch = pd.concat(list(rows)).sort_values(["ts_ms", "seq"], kind="stable")
        for venue, at, seq, *row in batch[["exchange", "ts_ms", "seq", *self._features]].itertuples(index=False):
            if venue not in self._venues:
                continue
            rings.setdefault(venue, Ring()).push(int(at), [float(x) for x in row], self._retain)
            changed.add(venue)
            if venue == self._venues[0] and (found := assemble(rings, self._venues, self._lagged, self._lags, int(at))) is not None:
                out.append((*key, int(seq), *found))
        for v in changed:
            self._rings.updateValue((v,), (rings[v].times, [x for r in rings[v].rows for x in r]))
        if out:
            yield pd.DataFrame(out)

    def close(self) -> None:
        pass


def live_features(stream: DataFrame, key: str, *, venues: list[str], features: list[str], lagged: list[str], lags: list[int], names: list[str], ttl_ms: int | None = None) -> DataFrame:
    """(key, seq, ``names``) for each event of ``venues[0]`` in a stream of (key, exchange, ts_ms, seq, features).

    Within a micro-batch rows are taken by time, then seq; micro-batches by arrival.
    ``ttl_ms``: how long an idle key's state is kept by the clock. It is for streams
    that run on: with it a stream has always one more batch to run, so a stream over
    what is available now would not end.
    """
    schema = f"{key} string, seq bigint, " + ", ".join(f"{c} double" for c in names)
    processor = LiveFeatures(venues, features, [features.index(f) for f in lagged], lags, ttl_ms)
    return stream.groupBy(key).transformWithStateInPandas(processor, outputStructType=schema, outputMode="Append", timeMode="ProcessingTime" if ttl_ms else "None").toDF(key, "seq", *names)
