"""Venue feeds: what to subscribe to, and landed messages as a stream.

Sockets are held by a collector outside Spark that lands one JSON message per line
with the receive time; the stream reads what has landed, so it restarts from a
checkpoint and tests run without a network.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

LANDED = "exchange string, seq long, connection_epoch long, received_ts_ms long, raw string"


@dataclass(frozen=True)
class Feed:
    exchange: str
    url: str
    channels: tuple[str, ...]
    max_bytes: int = 8 << 20
    ping_s: float = 20.0
    options: dict = field(default_factory=dict)

    def subscriptions(self, market: str) -> list[str]:
        """The messages to send after connecting."""
        if self.exchange == "coinbase":
            return [json.dumps({"type": "subscribe", "product_ids": [market], "channel": c}) for c in self.channels]
        if self.exchange == "kraken":
            extra = {"book": {"depth": 10}, "ticker": {"event_trigger": "bbo"}}
            return [json.dumps({"method": "subscribe", "params": {"channel": c, "symbol": [market], **extra.get(c, {})}}) for c in self.channels]
        if self.exchange == "okx":
            return [json.dumps({"op": "subscribe", "args": [{"channel": c, "instId": market} for c in self.channels]})]
        extra = {"candle": {"interval": "1m"}}
        return [json.dumps({"method": "subscribe", "subscription": {"type": c, "coin": market, **extra.get(c, {})}}) for c in self.channels]


# Public feed addresses and channel names.
FEEDS = {
    "coinbase": Feed("coinbase", "wss://advanced-trade-ws.coinbase.com", ("ticker", "heartbeats", "level2", "market_trades")),
    "kraken": Feed("kraken", "wss://ws.kraken.com/v2", ("ticker", "book", "trade")),
    "okx": Feed("okx", "wss://ws.okx.com:8443/ws/v5/public", ("tickers", "books5", "trades")),
    "hyperliquid": Feed("hyperliquid", "wss://api.hyperliquid.xyz/ws", ("trades", "l2Book", "bbo", "activeAssetCtx", "candle")),
}


def backoff(attempt: int, first_s: float = 1.0, most_s: float = 30.0) -> float:
    """Seconds to wait before reconnecting; attempts count from 0 and restart on success."""
    return min(first_s * 2.0**attempt, most_s)


def landed(spark: SparkSession, folder: str, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(LANDED)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.json(folder)


def landed_batch(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(LANDED).json(folder)
