"""Venue messages (JSON text) to typed observations, one function per channel.

Numbers are read as text and cast to DECIMAL(38,18), never through DOUBLE. A message
that misses a required key gives no row; ``quarantine`` returns those messages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EXACT = "decimal(38,18)"


def exact(value: Column) -> Column:
    return value.try_cast(EXACT)


def timestamp_ms(text: Column) -> Column:
    """Epoch milliseconds from digits or ISO-8601 text (fractions truncated); else null."""
    iso = F.try_to_timestamp(text)
    return F.when(text.rlike(r"^\d+$"), text.try_cast("long")).when(text.rlike(r"^\d+\.\d+$"), F.floor(text.try_cast("double")).cast("long")).otherwise(F.floor(F.unix_micros(iso) / 1000).cast("long"))


def _once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """A generator hands a value on as a column: it is computed once for a row, however often it is read."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def _parse(raw: DataFrame, schema: str) -> DataFrame:
    return _once(raw, "m", F.from_json("raw", schema))


def _typed(df: DataFrame, need: list[str], **cols: Column) -> DataFrame:
    out = df.select("seq", "received_ts_ms", *[c.alias(n) for n, c in cols.items()])
    return out.dropna(subset=need)


def _side(text: Column, buy: str, sell: str) -> Column:
    return F.when(text == buy, "buy").when(text == sell, "sell")


QUOTE = ["bid_price", "bid_size", "ask_price", "ask_size"]


def hyperliquid_bbo(raw: DataFrame) -> DataFrame:
    df = _parse(raw, "channel string, data struct<coin:string,time:string,levels:array<array<struct<px:string,sz:string>>>>").where("m.channel = 'bbo' and size(m.data.levels) = 2")
    b, a = (F.try_element_at(F.col("m.data.levels")[i], F.lit(1)) for i in (0, 1))
    return _typed(df, QUOTE, exchange=F.lit("hyperliquid"), market=F.col("m.data.coin"), source_ts_ms=timestamp_ms(F.col("m.data.time")), bid_price=exact(b["px"]), bid_size=exact(b["sz"]), ask_price=exact(a["px"]), ask_size=exact(a["sz"]))


def hyperliquid_trades(raw: DataFrame) -> DataFrame:
    df = _parse(raw, "channel string, data array<struct<coin:string,side:string,time:string,px:string,sz:string,hash:string>>").where("m.channel = 'trades'").select("seq", "received_ts_ms", F.explode("m.data").alias("t"))
    return _typed(df, ["side", "price", "size"], exchange=F.lit("hyperliquid"), market=F.col("t.coin"), source_ts_ms=timestamp_ms(F.col("t.time")), trade_id=F.col("t.hash"), side=_side(F.col("t.side"), "B", "A"), price=exact(F.col("t.px")), size=exact(F.col("t.sz")))


def hyperliquid_candles(raw: DataFrame) -> DataFrame:
    df = _parse(raw, "channel string, data array<map<string,string>>").where("m.channel = 'candle'").select("seq", "received_ts_ms", F.explode("m.data").alias("t"))  # a map, as its keys t and T differ in case only
    at = lambda k: F.try_element_at(F.col("t"), F.lit(k))
    ohlc = {n: exact(at(k)) for n, k in (("open", "o"), ("high", "h"), ("low", "l"), ("close", "c"), ("volume", "v"))}
    return _typed(df, ["open", "close"], exchange=F.lit("hyperliquid"), market=at("s"), interval=at("i"), open_ts=timestamp_ms(at("t")), close_ts=timestamp_ms(at("T")), trade_count=at("n").try_cast("int"), **ohlc)


def _levels(levels: Column, side: str, px: str = "px", sz: str = "sz") -> Column:
    made = F.transform(levels, lambda x: F.struct(F.lit(side).alias("side"), exact(x[px]).alias("price"), exact(x[sz]).alias("size"), x[px].alias("price_text"), x[sz].alias("size_text")))
    return F.filter(made, lambda x: x["price"].isNotNull() & x["size"].isNotNull())


def hyperliquid_books(raw: DataFrame) -> DataFrame:
    df = _parse(raw, "channel string, data struct<coin:string,time:string,levels:array<array<struct<px:string,sz:string>>>>").where("m.channel = 'l2Book' and size(m.data.levels) = 2")
    both = F.concat(_levels(F.col("m.data.levels")[0], "buy"), _levels(F.col("m.data.levels")[1], "sell"))
    return _typed(_once(df, "both", both), ["levels"], exchange=F.lit("hyperliquid"), market=F.col("m.data.coin"), source_ts_ms=timestamp_ms(F.col("m.data.time")), kind=F.lit("snapshot"), levels=F.col("both"))


def _coinbase(raw: DataFrame, channels: tuple[str, ...], item: str) -> DataFrame:
    df = _parse(raw, f"channel string, timestamp string, time string, events array<{item}>").where(F.col("m.channel").isin(*channels))
    return df.withColumn("ts", timestamp_ms(F.coalesce("m.timestamp", "m.time"))).withColumn("e", F.explode("m.events")).where("e is not null")


def coinbase_ticker(raw: DataFrame) -> DataFrame:
    item = "struct<type:string,tickers:array<struct<product_id:string,best_bid:string,best_bid_quantity:string,best_ask:string,best_ask_quantity:string>>>"
    df = _coinbase(raw, ("ticker", "ticker_batch"), item).withColumn("t", F.explode("e.tickers"))
    return _typed(df, QUOTE, exchange=F.lit("coinbase"), market=F.col("t.product_id"), source_ts_ms=F.col("ts"), bid_price=exact(F.col("t.best_bid")), bid_size=exact(F.col("t.best_bid_quantity")), ask_price=exact(F.col("t.best_ask")), ask_size=exact(F.col("t.best_ask_quantity")))


def coinbase_trades(raw: DataFrame) -> DataFrame:
    df = _coinbase(raw, ("market_trades",), "struct<trades:array<struct<trade_id:string,product_id:string,price:string,size:string,side:string,time:string>>>").withColumn("t", F.explode("e.trades"))
    return _typed(df, ["side", "price", "size"], exchange=F.lit("coinbase"), market=F.col("t.product_id"), source_ts_ms=timestamp_ms(F.col("t.time")), trade_id=F.col("t.trade_id"), side=_side(F.col("t.side"), "BUY", "SELL"), price=exact(F.col("t.price")), size=exact(F.col("t.size")))


def coinbase_candles(raw: DataFrame) -> DataFrame:
    df = _coinbase(raw, ("candles",), "struct<candles:array<struct<start:string,product_id:string,open:string,high:string,low:string,close:string,volume:string>>>").withColumn("t", F.explode("e.candles"))
    at = F.col("t.start").try_cast("long") * 1000
    return _typed(df, ["open", "close"], exchange=F.lit("coinbase"), market=F.col("t.product_id"), interval=F.lit(None).cast("string"), open_ts=at, close_ts=at, trade_count=F.lit(None).cast("int"), **{n: exact(F.col(f"t.{n}")) for n in ("open", "high", "low", "close", "volume")})


def coinbase_books(raw: DataFrame) -> DataFrame:
    item = "struct<type:string,product_id:string,sequence_num:long,updates:array<struct<side:string,price_level:string,new_quantity:string>>>"
    df = _coinbase(raw, ("level2", "l2_data"), item)
    kind = F.when(F.col("e.type") == "snapshot", "snapshot").when(F.col("e.type").isin("update", "l2update"), "delta")
    made = F.transform("e.updates", lambda x: F.struct(_side(x["side"], "bid", "offer").alias("side"), exact(x["price_level"]).alias("price"), exact(x["new_quantity"]).alias("size"), x["price_level"].alias("price_text"), x["new_quantity"].alias("size_text")))
    good = F.filter(made, lambda x: x["side"].isNotNull() & x["price"].isNotNull() & x["size"].isNotNull())
    return _typed(_once(df, "good", good), ["kind"], exchange=F.lit("coinbase"), market=F.col("e.product_id"), source_ts_ms=F.col("ts"), kind=kind, levels=F.col("good"))


_KRAKEN = "channel string, type string, data array<struct<symbol:string,bid:string,bid_qty:string,ask:string,ask_qty:string,side:string,price:string,qty:string,trade_id:string,timestamp:string,checksum:long,bids:array<struct<price:string,qty:string>>,asks:array<struct<price:string,qty:string>>>>"


def kraken_ticker(raw: DataFrame) -> DataFrame:
    df = _parse(raw, _KRAKEN).where("m.channel = 'ticker'").withColumn("t", F.explode("m.data"))
    return _typed(df, [*QUOTE, "market"], exchange=F.lit("kraken"), market=F.col("t.symbol"), source_ts_ms=timestamp_ms(F.col("t.timestamp")), bid_price=exact(F.col("t.bid")), bid_size=exact(F.col("t.bid_qty")), ask_price=exact(F.col("t.ask")), ask_size=exact(F.col("t.ask_qty")))


def kraken_trades(raw: DataFrame) -> DataFrame:
    df = _parse(raw, _KRAKEN).where("m.channel = 'trade'").withColumn("t", F.explode("m.data"))
    return _typed(df, ["side", "price", "size"], exchange=F.lit("kraken"), market=F.col("t.symbol"), source_ts_ms=timestamp_ms(F.col("t.timestamp")), trade_id=F.col("t.trade_id"), side=_side(F.col("t.side"), "buy", "sell"), price=exact(F.col("t.price")), size=exact(F.col("t.qty")))


def kraken_books(raw: DataFrame) -> DataFrame:
    df = _parse(raw, _KRAKEN).where("m.channel = 'book' and size(m.data) = 1").withColumn("t", F.col("m.data")[0])
    kind = F.when(F.col("m.type") == "snapshot", "snapshot").when(F.col("m.type") == "update", "delta")
    none = F.expr("cast(array() as array<struct<price: string, qty: string>>)")
    both = F.concat(_levels(F.coalesce("t.bids", none), "buy", "price", "qty"), _levels(F.coalesce("t.asks", none), "sell", "price", "qty"))
    return _typed(_once(df, "both", both), ["kind"], exchange=F.lit("kraken"), market=F.col("t.symbol"), source_ts_ms=timestamp_ms(F.col("t.timestamp")), kind=kind, checksum=F.col("t.checksum"), levels=F.col("both"))


_OKX = "arg struct<channel:string,instId:string>, data array<struct<instId:string,bidPx:string,bidSz:string,askPx:string,askSz:string,tradeId:string,side:string,px:string,sz:string,ts:string,bids:array<array<string>>,asks:array<array<string>>>>"


def _okx(raw: DataFrame, channel: str) -> DataFrame:
    return _parse(raw, _OKX).where(F.col("m.arg.channel") == channel).withColumn("t", F.explode("m.data"))


def okx_tickers(raw: DataFrame) -> DataFrame:
    return _typed(_okx(raw, "tickers"), QUOTE, exchange=F.lit("okx"), market=F.col("t.instId"), source_ts_ms=timestamp_ms(F.col("t.ts")), bid_price=exact(F.col("t.bidPx")), bid_size=exact(F.col("t.bidSz")), ask_price=exact(F.col("t.askPx")), ask_size=exact(F.col("t.askSz")))


def okx_trades(raw: DataFrame) -> DataFrame:
    return _typed(_okx(raw, "trades"), ["side", "price", "size"], exchange=F.lit("okx"), market=F.col("t.instId"), source_ts_ms=timestamp_ms(F.col("t.ts")), trade_id=F.col("t.tradeId"), side=_side(F.col("t.side"), "buy", "sell"), price=exact(F.col("t.px")), size=exact(F.col("t.sz")))


def okx_books(raw: DataFrame) -> DataFrame:
    def side(levels: Column, name: str) -> Column:
        made = F.transform(F.filter(levels, lambda x: F.size(x) >= 2), lambda x: F.struct(F.lit(name).alias("side"), exact(x[0]).alias("price"), exact(x[1]).alias("size"), x[0].alias("price_text"), x[1].alias("size_text")))
        return F.filter(made, lambda x: x["price"].isNotNull() & x["size"].isNotNull())

    both = F.concat(side(F.col("t.bids"), "buy"), side(F.col("t.asks"), "sell"))
    return _typed(_once(_okx(raw, "books5"), "both", both), ["levels"], exchange=F.lit("okx"), market=F.coalesce("t.instId", "m.arg.instId"), source_ts_ms=timestamp_ms(F.col("t.ts")), kind=F.lit("snapshot"), levels=F.col("both"))


CHANNELS = {
    "hyperliquid": (hyperliquid_bbo, hyperliquid_trades, hyperliquid_candles, hyperliquid_books),
    "coinbase": (coinbase_ticker, coinbase_trades, coinbase_candles, coinbase_books),
    "kraken": (kraken_ticker, kraken_trades, kraken_books),
    "okx": (okx_tickers, okx_trades, okx_books),
}


def normalize(raw: DataFrame, venue: str) -> dict[str, DataFrame]:
    """All channels of a venue: quotes, trades, candles, books; unknown channels give no rows."""
    kinds = {"bbo": "quotes", "ticker": "quotes", "tickers": "quotes", "trades": "trades", "candles": "candles", "books": "books"}
    return {kinds[f.__name__.split("_")[1]]: f(raw) for f in CHANNELS[venue]}


def quarantine(raw: DataFrame, typed: DataFrame) -> DataFrame:
    """Messages that gave no row."""
    return raw.join(typed.select("seq").distinct(), "seq", "left_anti")


def renamed(df: DataFrame, exchange: str | None = None, market: str | None = None) -> DataFrame:
    """The observations under another exchange or market, as for perpetual feeds."""
    if exchange is not None:
        df = df.withColumn("exchange", F.lit(exchange))
    return df.withColumn("market", F.lit(market)) if market is not None else df
