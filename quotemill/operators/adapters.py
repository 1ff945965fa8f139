"""Batch adapters: run state kernels over ordered groups with ``applyInPandas``.

Parallelism comes from the keys (asset, market, day, grid cell) and, within a key, from
what a kernel allows: averages are composed by ranges, filters run in overlapping
blocks until these agree, books replay by segments between snapshots. A group is one
ordered fold and must fit a task.
"""

from __future__ import annotations

import json
import pickle
import uuid
from collections.abc import Callable, Iterator
from functools import partial, reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quotemill.operators import ranges
from quotemill.operators.kernels import BasisKalman, Book, DelayedBeta, Ema, FusedKalman, Observation, calibrate
from quotemill.sources import sinks


def spread(df: DataFrame, keys: list[str]) -> DataFrame:
    """Groups dealt over all cores: folds are heavy for their bytes, so their partitions must not be merged."""
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return df.repartition(n, *keys)


def fold(df: DataFrame, keys: list[str], order: list[str], schema: str, fn: Callable[[pd.DataFrame], pd.DataFrame]) -> DataFrame:
    """``fn`` on every group's rows in order."""
    return spread(df, keys).groupBy(*keys).applyInPandas(lambda g: fn(g.sort_values(order, kind="stable").reset_index(drop=True)), schema)


def stream_fold(df: DataFrame, keys: list[str], order: list[str], schema: str, start: Callable[[tuple], Callable[[pd.DataFrame], pd.DataFrame]]) -> DataFrame:
    """A fold whose groups need not fit a task: ``start(key)`` gives a function with a group's state, called with its rows in order, batch by batch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, step = None, None
        for rows in batches:
            for key, g in rows.groupby(keys, sort=False, dropna=False):
                key = tuple(None if pd.isna(k) else k for k in key)
                if step is None or key != at:
                    at, step = key, start(key)
                yield step(g.reset_index(drop=True))

    return spread(df, keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)


def ema(df: DataFrame, keys: list[str], order: list[str], value: str, alpha: float, width: int = ranges.WIDTH) -> DataFrame:
    """keys, order columns and ``ema``, the exponential average over the key's rows, by ranges of the first order column."""
    Ema(alpha)  # the same bounds
    rows = df.select(*keys, *[c for c in order if c not in keys], F.col(value).alias("_x"))
    x = F.col("_x")
    out = ranges.linear_recurrence(rows, keys, order, gain=F.lit(1 - alpha), offset=alpha * x, initial=x, name="ema", width=width)
    return out.drop("_x")


def _observed(g: pd.DataFrame) -> list[tuple[int, float, list[Observation]]]:
    """Rows (event_seq, now_ms, exchange, fair_value, variance, age_ms) as one list of observations per event."""
    g = g.sort_values(["event_seq", "exchange"], kind="stable")
    events = g["event_seq"].to_numpy()
    cuts = [0, *(np.flatnonzero(np.diff(events)) + 1).tolist(), len(g)]
    names = g["exchange"].tolist()
    perp = g["exchange"].str.endswith("_perp").tolist()
    rows = list(zip(names, g["fair_value"].tolist(), g["variance"].tolist(), g["age_ms"].tolist(), perp))
    seen = [Observation(n, v, s, a, True, p) for n, v, s, a, p in rows]
    now = (g["now_ms"] / 1000.0).tolist()
    return [(int(events[i]), now[i], seen[i:j]) for i, j in zip(cuts, cuts[1:]) if j > i]


def agree(a: dict[str, float], b: dict[str, float], tolerance: float) -> bool:
    """Whether two states hold the same names, and values that differ by the tolerance times their size at most."""
    return a.keys() == b.keys() and all(abs(a[k] - b[k]) <= tolerance * max(1.0, abs(a[k]), abs(b[k])) for k in a)


def in_blocks(states: DataFrame, key: str, schema: str, make: Callable[[], object], rows_of: Callable[[object, str, list], list[tuple]], view: Callable[[object], dict[str, float]], *, width: int, overlap: int, tolerance: float = 1e-11) -> DataFrame:
    """A filter over each key's history, in blocks of event_seq that run at the same time.

    A block begins ``overlap`` before its own events with a new filter, which forgets
    how it began. Where the state at its first own event disagrees with the state that
    the block before it ends in (``view``: a state as numbers by name), it is run again
    from that one, until all blocks agree with those before them. So rows are those of
    one run through the whole history, to the tolerance; a task holds one block. Blocks
    are written to the shared folder as they settle.
    """
    spark = states.sparkSession
    folder = f"{sinks.shared_folder(spark)}/blocks-{uuid.uuid4().hex}"
    kind = states.schema[key].dataType.simpleString()
    names = [c.split()[0] for c in schema.split(", ")]
    block = F.floor(F.col("event_seq") / width)
    dealt = states.withColumn("_own", block).withColumn("_block", F.explode(F.sequence(block, F.floor((F.col("event_seq") + overlap) / width))))
    result = schema + ", _block long, _round int, _entry binary, _exit binary"

    def run(_, rows: pd.DataFrame, seed: pd.DataFrame | None = None, turn: int = 0) -> pd.DataFrame:
        k, at = rows[key].iloc[0], int(rows["_block"].iloc[0])
        own = rows["_own"] == at
        if not own.any():
            return pd.DataFrame(columns=[*names, "_block", "_round", "_entry", "_exit"])
        kernel = make()
        if seed is not None:
            kernel = pickle.loads(bytes(seed["_exit"].iloc[0]))
        elif (~own).any():
            rows_of(kernel, k, _observed(rows[~own]))
        entry = pickle.dumps(view(kernel))
        out = pd.DataFrame(rows_of(kernel, k, _observed(rows[own])), columns=names)
        ends = pd.DataFrame([{key: k}], columns=names).assign(_entry=entry, _exit=pickle.dumps(kernel))
        return pd.concat([out, ends], ignore_index=True).assign(_block=at, _round=turn)  # the last row has the states alone

    def store(df: DataFrame, turn: int) -> DataFrame:
        df.write.parquet(f"{folder}/{turn}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{turn}")

    def again_from(turn: int) -> Callable:
        return lambda k, rows, seed: run(k, rows, seed, turn)

    rounds = [store(spread(dealt, [key, "_block"]).groupBy(key, "_block").applyInPandas(lambda k, g: run(k, g), result), 0)]
    by = Window.partitionBy(key).orderBy("_block")

    @F.pandas_udf("boolean")
    def differs(entry: pd.Series, before: pd.Series) -> pd.Series:
        return pd.Series([b is not None and not agree(pickle.loads(bytes(a)), view(pickle.loads(bytes(b))), tolerance) for a, b in zip(entry, before)])

    while True:
        every = reduce(DataFrame.unionByName, rounds)
        ends = every.where("_exit is not null").groupBy(key, "_block").agg(F.max_by(F.struct("_entry", "_exit"), "_round").alias("e"), F.max("_round").alias("_round")).select(key, "_block", "_round", "e.*")
        chained = ends.withColumn("_before", F.lag("_exit").over(by))  # one row per block
        again = chained.where(differs("_entry", "_before")).select(key, "_block", F.col("_before").alias("_exit"))
        again = store(again, -len(rounds))
        if again.isEmpty():
            break
        turn = len(rounds)
        rows = dealt.where("_own = _block").join(again.select(key, "_block"), [key, "_block"], "left_semi")
        done = rows.groupBy(key, "_block").cogroup(again.groupBy(key, "_block")).applyInPandas(again_from(turn), result)
        rounds.append(store(done, turn))
    last = ends.select(F.col(key), "_block", "_round")
    return every.where("_exit is null").join(last, [key, "_block", "_round"], "left_semi").select(F.col(key).cast(kind).alias(key), *[c for c in names if c != key])


_JSON = json.JSONEncoder(sort_keys=True).encode
FUSED = "{k}, event_seq long, price double, fused double, gain double, q double, r double, p double, innovation double, weights string"


def fused_kalman(states: DataFrame, key: str, *, width: int = 40_000, overlap: int = 6_000, **config) -> DataFrame:
    """The fused filter after each event, with its diagnostics; one filter per key, by blocks (see ``in_blocks``).

    price, fused (the fused observation), gain, q, r, p (variances), innovation (fused
    less what was expected), weights (JSON by venue).
    """

    def rows_of(kernel, k, events):
        rows = []
        for event, at, obs in events:
            prior = kernel.x
            if (f := kernel.step(at, obs)) is not None:
                rows.append((k, event, *(f[c] for c in ("price", "fused", "gain", "q", "r", "p")), f["fused"] - (f["fused"] if prior is None else prior), _JSON(f["weights"])))
        return rows

    def view(kernel):
        if kernel.x is None:
            return {}
        return {"x": kernel.x, "p": kernel.p, "at": kernel.at, "fused": kernel.fused, "move": kernel.move} | {f"s_{v}": s for v, s in kernel.surprise.items()}

    return in_blocks(states, key, FUSED.format(k=f"{key} {states.schema[key].dataType.simpleString()}"), partial(FusedKalman, **config), rows_of, view, width=width, overlap=overlap)


class _Held:
    """A basis filter and its last result."""

    def __init__(self, **config):
        self.kernel, self.last = BasisKalman(**config), None


def basis_kalman(states: DataFrame, key: str, hold: bool = True, *, width: int = 40_000, overlap: int = 6_000, **config) -> DataFrame:
    """One row per event: price, stddev, trace, basis and innovations (JSON by venue), and whether it is live or held; by blocks as in ``fused_kalman``."""

    def rows_of(held, k, events):
        rows = []
        for event, at, obs in events:
            found = held.kernel.step(at, obs)
            if found is not None or (hold and held.last is not None):
                held.last = found or held.last
                x = held.last
                rows.append((k, event, x["price"], x["stddev"], x["trace"], _JSON(x["basis"]), _JSON(x["innovations"]), found is not None))
        return rows

    def view(held):
        kernel = held.kernel
        if kernel.x is None:
            return {}
        at = {"common": 0} | kernel.index
        return {"at": kernel.at} | {f"x_{v}": float(kernel.x[i]) for v, i in at.items()} | {f"p_{v}_{u}": float(kernel.P[i, j]) for v, i in at.items() for u, j in at.items()}

    kind = states.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, event_seq long, price double, stddev double, trace double, basis string, innovations string, is_live boolean"
    return in_blocks(states, key, schema, partial(_Held, **config), rows_of, view, width=width, overlap=overlap)


def _with_model(df: DataFrame, models: DataFrame, key: str) -> DataFrame:
    """``df`` and, as each key's first row by ``_later``, its model with ``payload`` and ``after``; its other columns are filled."""
    zero = [F.lit(0).cast(f.dataType).alias(f.name) for f in df.schema if f.name != key]
    first = models.select(key, *zero, F.lit(0).alias("_later"), "payload", "after")
    return df.select("*", F.lit(1).alias("_later"), F.lit(None).cast("binary").alias("payload"), F.lit(0).cast("long").alias("after")).unionByName(first)


def beta_kalman(df: DataFrame, key: str, order: list[str], features: list[str], target: str, *, warm: float = 0.3) -> DataFrame:
    """Online predictions after calibration on the first ``warm`` share of each key: predict, then learn the outcome at once.

    Nothing is predicted (null) for the calibration rows and for keys with too few. Rows are fed batch by batch.
    """

    def start(_) -> Callable[[pd.DataFrame], pd.DataFrame]:
        found = []

        def step(g: pd.DataFrame) -> pd.DataFrame:
            if len(g) and g["_later"].iloc[0] == 0:
                found[:] = pickle.loads(bytes(g["payload"].iloc[0]))
                g = g.iloc[1:].reset_index(drop=True)
            out = g[[key, *order]].assign(predicted=np.nan, actual=g[target])
            later = g["_test"].to_numpy(bool)
            if not found or not later.any():
                return out
            kernel, mean, scale = found
            X, y, guesses = g.loc[later, features].to_numpy(float), g.loc[later, target].to_numpy(float), []
            for x, v in zip(np.column_stack([np.ones(len(y)), (X - mean) / scale]), y):
                guesses.append(kernel.predict(x))
                kernel.learn(x, v)
            out.loc[later, "predicted"] = guesses
            return out

        return step

    kinds = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in [key, *order])
    models = calibrated(df, key, order, features, target, warm=warm, time=None)
    rows = ranges.numbered(df.select(*dict.fromkeys([key, *order, *features, target])), [key], order, "_i", total="_n")
    rows = rows.withColumn("_test", F.col("_i") > F.floor(F.col("_n") * warm)).drop("_i", "_n")
    return stream_fold(_with_model(rows, models, key), [key], ["_later", *order], kinds + ", predicted double, actual double", start)


def calibrated(df: DataFrame, key: str, order: list[str], features: list[str], target: str, *, warm: float, time: str | None) -> DataFrame:
    """(key, ``payload``: a calibrated predictor, ``after``: the time of its last row) from the first ``warm`` share of each key.

    Of a key only the numbers of that share are held, 8 bytes each. Keys with fewer rows than coefficients need have none.
    """
    names = [*features, target]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, held, after = None, [], 0

        def done() -> pd.DataFrame:
            rows = np.concatenate(held)
            held.clear()
            if len(rows) <= len(features) + 5:
                return pd.DataFrame(columns=[key, "payload", "after"])
            return pd.DataFrame([(at, pickle.dumps(calibrate(rows[:, :-1], rows[:, -1])), after)], columns=[key, "payload", "after"])

        for d in batches:
            for k, g in d.groupby(key, sort=False, dropna=False):
                k = None if pd.isna(k) else k
                if held and k != at:
                    yield done()
                held.append(g[names].to_numpy(float))
                at, after = k, int(g["_time"].iloc[-1])
        if held:
            yield done()

    rows = ranges.numbered(df.select(*dict.fromkeys([key, *order, *names]), (F.col(time) if time else F.lit(0)).cast("long").alias("_time")), [key], order, "_i", total="_n")
    rows = rows.where(F.col("_i") <= F.floor(F.col("_n") * warm)).drop("_i", "_n")
    return spread(rows, [key]).sortWithinPartitions(key, *order).mapInPandas(run, f"{key} {df.schema[key].dataType.simpleString()}, payload binary, after long")


def delayed_beta(df: DataFrame, key: str, order: list[str], features: list[str], price: str, models: DataFrame, *, horizon_ms: int, time: str) -> DataFrame:
    """(key, order columns, predicted) for rows after each key's calibration; outcomes are learned once ``horizon_ms`` has passed. Rows are fed batch by batch."""

    def start(_) -> Callable[[pd.DataFrame], pd.DataFrame]:
        found = []

        def step(g: pd.DataFrame) -> pd.DataFrame:
            if len(g) and g["_later"].iloc[0] == 0:
                found[:] = DelayedBeta(*pickle.loads(bytes(g["payload"].iloc[0])), horizon_ms), int(g["after"].iloc[0])
                g = g.iloc[1:]
            if not found or not len(g):
                return pd.DataFrame(columns=[key, *order, "predicted"])
            kernel, after = found
            g = g[g[time] > after]
            return g[[key, *order]].assign(predicted=[kernel.step(int(t), p, x) for t, p, x in zip(g[time], g[price], g[features].to_numpy(float).tolist())])

        return step

    kinds = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in [key, *order])
    rows = df.select(*dict.fromkeys([key, *order, time, price, *features]))
    return stream_fold(_with_model(rows, models, key), [key], ["_later", *order], kinds + ", predicted double", start)


BOOKS = "exchange string, market string, seq long, status string, bid double, bid_size double, ask double, ask_size double"


def replay_books(observations: DataFrame, *, depth: int | None = None, sequenced: bool = False, checked: bool = False, width: int = ranges.WIDTH) -> DataFrame:
    """Best levels after every book message; keyed by exchange, market and, if there, connection_epoch.

    A snapshot replaces all that a book held, so what lies between two of them is a
    segment that replays on its own: a key's history is dealt over tasks by segment.
    Messages before a key's first snapshot are dropped ones. After a gap in the
    sequence or a wrong checksum (status resync) a book is invalid, and messages are
    dropped, up to the next snapshot. Segments are fed batch by batch; ``width`` is the range
    of seq by which snapshots are counted.
    """
    keys = ["exchange", "market", *(["connection_epoch"] if "connection_epoch" in observations.columns else [])]
    rows = ranges.running_sum(observations, keys, ["seq"], (F.col("kind") == "snapshot").cast("long"), "_segment", width=width)
    none = F.lit(None).cast("double")
    early = rows.where("_segment = 0").select("exchange", "market", "seq", F.lit("dropped").alias("status"), *[none.alias(c) for c in ("bid", "bid_size", "ask", "ask_size")])

    names, by = [c.split()[0] for c in BOOKS.split(", ")], [*keys, "_segment"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, book = None, None
        for rows in batches:  # segments are short: a batch holds many, and a long one comes in several
            none, out = [None] * len(rows), []
            given = lambda c: [None if pd.isna(x) else int(x) for x in rows[c].tolist()] if c in rows.columns else none  # noqa: E731, B023
            own = zip(*[[None if pd.isna(x) else x for x in rows[c].tolist()] for c in by])
            for key, kind, seq, changes, sequence, checksum in zip(own, rows["kind"].tolist(), rows["seq"].tolist(), rows["levels"].tolist(), given("sequence"), given("checksum")):
                if book is None or key != at:
                    at, book = key, Book(depth, sequenced, checked)
                status = book.step(kind, [(x["side"], x["price"], x["size"], x["price_text"], x["size_text"]) for x in changes], sequence, checksum)
                best = book.best() if status == "ok" else (None,) * 4
                out.append((*key[:2], seq, status, *(None if b is None else float(b) for b in best)))
            yield pd.DataFrame(out, columns=names)

    later = spread(rows.where("_segment > 0"), by).sortWithinPartitions(*by, "seq").mapInPandas(run, BOOKS)
    return early.unionByName(later)
