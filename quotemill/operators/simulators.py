"""Trading simulators.

Order-dependent ones are ordered folds per key and parameter cell, fed batch by batch, so
that a task holds a batch and an open position, not a key's history;
those without a recurrence (carry, passive liquidity, gate flips) are pure windows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quotemill.operators.adapters import fold, stream_fold


def with_grid(df: DataFrame, grid: list[dict[str, float]]) -> DataFrame:
    """Every row once for each parameter cell; the grid is a short literal list."""
    cells = df.sparkSession.createDataFrame(pd.DataFrame([{"cell": i, **g} for i, g in enumerate(grid)]))
    return df.crossJoin(F.broadcast(cells))


@dataclass
class Maker:
    """Two-sided quoting around fair value with queue position, latency and inventory skew."""

    half_spread: float
    skew: float = 0.0
    drift_coef: float = 0.0
    repost: float = 0.0
    queue_scale: float = 1.0
    latency_ms: int = 0
    size: float = 1.0
    max_inventory: float = 5.0
    fee: float = 0.0
    incremental_flow: bool = False

    def __post_init__(self) -> None:
        self.inventory, self.cash = 0.0, 0.0
        self.orders: dict[str, list] = {}  # side: [price, queue ahead, live from]
        self.seen = {"buy": 0.0, "sell": 0.0}

    def run(self, g: pd.DataFrame) -> list[tuple]:
        """Fills of the rows ``g``, which follow those of earlier calls."""
        inventory, cash, orders, seen, fills = self.inventory, self.cash, self.orders, self.seen, []
        leans = (self.drift_coef * np.clip(g["drift"].to_numpy(float), -self.half_spread, self.half_spread)).tolist()
        for lean, r in zip(leans, g.itertuples()):
            center = r.fair_value + lean - inventory * self.skew
            for side, sign in (("buy", -1), ("sell", 1)):
                room = inventory < self.max_inventory if side == "buy" else inventory > -self.max_inventory
                target = center + sign * self.half_spread
                order = orders.get(side)
                if not room:
                    orders.pop(side, None)
                elif order is None or abs(order[0] - target) > self.repost:
                    best, depth = (r.bid, r.bid_size) if side == "buy" else (r.ask, r.ask_size)
                    inside = target > best if side == "buy" else target < best
                    orders[side] = [target, 0.0 if inside else depth * self.queue_scale, r.ts_ms + self.latency_ms]
                order = orders.get(side)
                if order is None or r.ts_ms < order[2]:
                    continue
                hit = r.sell_flow if side == "buy" else r.buy_flow
                if self.incremental_flow:
                    hit, seen[side] = max(0.0, hit - seen[side]), hit
                crossed = r.ask <= order[0] if side == "buy" else r.bid >= order[0]
                order[1] -= hit
                if crossed or order[1] < 0:
                    inventory -= sign * self.size
                    cash += sign * order[0] * self.size - self.fee * order[0] * self.size
                    fills.append((r.seq, r.ts_ms, side, order[0], inventory, cash, cash + inventory * r.fair_value))
                    orders.pop(side)
        self.inventory, self.cash = inventory, cash
        return fills


#: What a maker looks at.
SEEN = ["seq", "ts_ms", "fair_value", "drift", "bid", "bid_size", "ask", "ask_size", "buy_flow", "sell_flow"]


def maker(quotes: DataFrame, keys: list[str], params: list[str], **fixed) -> DataFrame:
    """Fills of the maker for every key and parameter cell (``params``: columns named as its options)."""
    by = [*keys, *params]
    schema = ", ".join(f"{c} {quotes.schema[c].dataType.simpleString()}" for c in by) + ", seq long, ts_ms long, side string, price double, inventory double, cash double, equity double"

    def start(key: tuple) -> Callable[[pd.DataFrame], pd.DataFrame]:
        own = Maker(**dict(zip(params, map(float, key[len(keys) :]))), **fixed)
        return lambda g: pd.DataFrame([(*key, *r) for r in own.run(g)], columns=[*by, "seq", "ts_ms", "side", "price", "inventory", "cash", "equity"])

    return stream_fold(quotes.select(*by, *SEEN), by, ["ts_ms", "seq"], schema, start)


def maker_summary(fills: DataFrame, keys: list[str]) -> DataFrame:
    return fills.groupBy(*keys).agg(F.count("*").alias("fills"), F.max_by("equity", F.struct("ts_ms", "seq")).alias("equity"), F.max(F.abs("inventory")).alias("max_inventory"))


def taker(df: DataFrame, key: str, *, threshold: float, horizon_ms: int, fee: float) -> DataFrame:
    """Trades against a dislocation, left at the first row after the horizon, never overlapping."""

    def start(at: tuple) -> Callable[[pd.DataFrame], pd.DataFrame]:
        entry, free = None, -1  # entry: (time, seq, side, price) of the open trade

        def step(g: pd.DataFrame) -> pd.DataFrame:
            nonlocal entry, free
            t, x, p, seq = g["ts_ms"].to_numpy(), g["dislocation"].to_numpy(float), g["price"].to_numpy(float), g["seq"].to_numpy()
            rows, wanted, i = [], np.flatnonzero(np.abs(x) > threshold), 0
            while i < len(t):
                if entry is None:
                    k = np.searchsorted(wanted, max(i, int(np.searchsorted(t, free))))
                    if k == len(wanted):
                        break
                    i = int(wanted[k])
                    entry = (int(t[i]), int(seq[i]), -np.sign(x[i]), p[i])
                j = int(np.searchsorted(t, entry[0] + horizon_ms))
                if j == len(t):
                    break
                gross = entry[2] * (p[j] - entry[3])
                rows.append((*at, entry[1], int(seq[j]), float(entry[2]), float(gross), float(gross - fee * (entry[3] + p[j]))))
                entry, free, i = None, int(t[j]) + 1, j
            return pd.DataFrame(rows, columns=[key, "seq", "exit_seq", "side", "gross", "net"])

        return step

    return stream_fold(df.select(key, "seq", "ts_ms", "dislocation", "price"), [key], ["ts_ms", "seq"], f"{key} string, seq long, exit_seq long, side double, gross double, net double", start)


def mean_reversion(df: DataFrame, key: str, *, enter: float = 2.0, leave: float = 0.5, stop: float = 5.0, hold_ms: int = 600_000, warm_ms: int = 0, fees: float = 0.0) -> DataFrame:
    """Enter at |z| >= enter, leave at |z| <= leave, |z| >= stop or after hold_ms; an open trade at the end is dropped."""

    def start(at: tuple) -> Callable[[pd.DataFrame], pd.DataFrame]:
        open_, begin = None, None

        def step(g: pd.DataFrame) -> pd.DataFrame:
            nonlocal open_, begin
            rows = []
            begin = g["ts_ms"].iloc[0] + warm_ms if begin is None else begin
            for r in g.itertuples():
                if open_ is not None:
                    if abs(r.z) <= leave or abs(r.z) >= stop or r.ts_ms - open_.ts_ms >= hold_ms:
                        side = -np.sign(open_.z)
                        gross = side * (r.price - open_.price)
                        rows.append((*at, open_.seq, r.seq, float(side), int(r.ts_ms - open_.ts_ms), float(gross), float(gross - fees)))
                        open_ = None
                elif r.ts_ms >= begin and enter <= abs(r.z) < stop:
                    open_ = r
            return pd.DataFrame(rows, columns=[key, "seq", "exit_seq", "side", "hold_ms", "gross", "net"])

        return step

    return stream_fold(df.select(key, "seq", "ts_ms", "z", "price"), [key], ["ts_ms", "seq"], f"{key} string, seq long, exit_seq long, side double, hold_ms long, gross double, net double", start)


def carry(hours: DataFrame, key: str, hold: int, cost: float) -> DataFrame:
    """Funding collected over the ``hold`` hours after each entry hour, against the basis change; entries overlap."""
    by = Window.partitionBy(key).orderBy("hour")
    ahead = by.rowsBetween(1, hold)
    df = hours.withColumn("funding_sum", F.sum("funding").over(ahead)).withColumn("_k", F.count("*").over(ahead)).withColumn("exit_basis", F.lead("basis", hold).over(by))
    df = df.where(F.col("_k") == hold)
    return df.select(key, "hour", "funding_sum", (F.col("funding_sum") + F.col("basis") - F.col("exit_basis") - cost).alias("net"))


def gate_flips(df: DataFrame, key: str, order: list[str], gate: str, value: str, gas: float) -> DataFrame:
    """Value while the gate is open, less gas for each flip; the gate starts closed."""
    by = Window.partitionBy(key).orderBy(*order)
    df = df.withColumn("_was", F.coalesce(F.lag(gate).over(by), F.lit(False)))
    flip = (F.col(gate) != F.col("_was")).cast("long")
    return df.groupBy(key).agg(F.sum(F.when(F.col(gate), F.col(value)).otherwise(0.0)).alias("gross"), F.sum(flip).alias("flips"), (F.sum(F.when(F.col(gate), F.col(value)).otherwise(0.0)) - gas * F.sum(flip)).alias("net"))


def passive_liquidity(swaps: DataFrame, key: str, order: list[str], *, low: float, high: float, liquidity: float, fee: float) -> DataFrame:
    """Per swap: whether it is in range, the position's fee share, and loss against the outside price.

    ``swaps``: pool price after (``pool``), outside price (``ext``), amount_usd, and the
    pool's active liquidity. Only the previous row matters, so it is one window.
    """
    before = F.lag("pool").over(Window.partitionBy(key).orderBy(*order))
    df = swaps.withColumn("pool_before", F.coalesce(before, F.col("pool")))
    inside = F.col("pool_before").between(low, high)
    clip = lambda c: F.sqrt(F.least(F.greatest(c, F.lit(low)), F.lit(high)))
    a, b = clip(F.col("pool_before")), clip(F.col("pool"))
    zero, one = liquidity * (1 / b - 1 / a), liquidity * (b - a)
    df = df.withColumn("in_range", inside).withColumn("fee_usd", F.when(inside, F.col("amount_usd") * fee * F.try_divide(F.lit(liquidity), F.col("active") + liquidity)).otherwise(0.0))
    return df.withColumn("dv_ext", zero * F.col("ext") + one).withColumn("toxic", F.col("dv_ext") < 0)


def active_liquidity(swaps: DataFrame, key: str, *, width: float, trigger: float, grace: int, capital: float, fee: float, gas: float) -> DataFrame:
    """A range around the price that is moved when the price drifts too far or stays outside too long."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        rows = []
        center, outside, moves, fees, value, out_rows = float(g["pool"].iloc[0]), 0, 0, 0.0, capital, 0

        def place(price: float, money: float) -> tuple[float, float, float]:
            lo, hi = price * np.exp(-width), price * np.exp(width)
            s = np.sqrt(price)
            return money / (s * s * (1 / s - 1 / np.sqrt(hi)) + s - np.sqrt(lo)), np.sqrt(lo), np.sqrt(hi)

        L, a, b = place(center, value)
        for r in g.itertuples():
            s = np.sqrt(r.pool)
            at = min(max(s, a), b)
            value = L * ((1 / at - 1 / b) * r.pool + at - a)
            inside = a <= s <= b
            outside = 0 if inside else outside + 1
            out_rows += not inside
            if inside:
                fees += r.amount_usd * fee * L / (L + r.active)
            if abs(np.log(r.pool / center)) > trigger or outside > grace:
                moves, outside, center = moves + 1, 0, float(r.pool)
                value = max(value - gas, 0.0)
                L, a, b = place(center, value)
        rows.append((g[key].iloc[0], moves, float(fees), float(value), out_rows, float(fees + value - capital)))
        return pd.DataFrame(rows, columns=[key, "moves", "fees", "value", "rows_outside", "net"])

    return fold(swaps, [key], ["ts_ms", "seq"], f"{key} string, moves long, fees double, value double, rows_outside long, net double", run)
