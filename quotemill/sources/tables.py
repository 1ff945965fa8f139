"""File sources with explicit schemas; nothing is inferred from data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SWAPS = "id string, timestamp string, sender string, origin string, amount0 string, amount1 string, amountUSD string, sqrtPriceX96 string, tick string, logIndex string"
CANDLES = "ts_s long, low double, high double, open double, close double, volume double"
TICKER_POLL = "ts double, venue string, symbol string, bid double, ask double"
FUNDING = "coin string, fundingRate string, premium string, time long"
PREDICTIONS = "timestamp_ms long, drift_hat double"
UPDATES = "id long, timestamp_ms long, event_exchange string, event_market string, anchor_exchange string, anchor_present int, basis_is_live int, composite_price double, composite_variance double, kalman_filtered_price double, kalman_raw_fused_price double, basis_common_price double, basis_common_stddev double"
VENUE_STATES = "update_id long, exchange string, venue_kind string, fair_value double, variance double, age_ms double, bid_price double, ask_price double, microprice double, depth_imbalance double, top_bid_depth double, top_ask_depth double, mid_volatility_bps double, trade_net_flow double, trade_buy_size double, trade_sell_size double, trade_count int"
BASIS_STATES = "update_id long, exchange string, basis_estimate double, basis_stddev double"


def captures(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Several captures as one; ids restart per capture, so the file becomes part of the key."""
    return spark.read.parquet(*paths).withColumn("capture", F.input_file_name())


def jdbc(spark: SparkSession, url: str, query: str, **options: str) -> DataFrame:
    """A parameterised scan of a relational store over JDBC."""
    reader = spark.read.format("jdbc").option("url", url).option("query", query)
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.load()


def with_columns_or(df: DataFrame, wanted: dict[str, str], default: float | None = None) -> DataFrame:
    """The wanted columns (name: type); absent ones are a literal."""
    return df.select(*[(F.col(c) if c in df.columns else F.lit(default)).cast(t).alias(c) for c, t in wanted.items()])


def swaps(spark: SparkSession, path: str, partitions: int | None = None) -> DataFrame:
    """Pool swaps from (gzipped) JSON lines: text leaves cast to numbers, ordered keys in front.

    A gzip file is read by one task; ``partitions`` deals its rows out afterwards.
    """
    df = spark.read.schema(SWAPS).json(path)
    if partitions:
        df = df.repartition(partitions)
    numbers = {c: "double" for c in ("amount0", "amount1", "amountUSD", "sqrtPriceX96")}
    return df.select(F.col("timestamp").cast("long").alias("ts"), F.col("logIndex").cast("long").alias("log_index"), "id", "sender", "origin", *[F.col(c).cast(t).alias(c) for c, t in numbers.items()], F.col("tick").cast("int").alias("tick"))


def candles(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CANDLES).json(path)


def ticker_poll(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TICKER_POLL).json(path)


def funding(spark: SparkSession, path: str) -> DataFrame:
    """Funding history from JSON arrays; the last row of a time wins."""
    df = spark.read.schema(FUNDING).option("multiLine", True).json(path)
    return df.groupBy("coin", "time").agg(F.max(F.struct("fundingRate", "premium")).alias("x")).select("coin", "time", F.col("x.fundingRate").cast("double").alias("funding_rate"), F.col("x.premium").cast("double").alias("premium"))


def csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header; values that are no finite numbers become NaN in double columns."""
    return spark.read.option("header", True).option("nanValue", "nan").option("mode", "PERMISSIVE").schema(schema).csv(path)


def spot_markets(meta: DataFrame, aliases: dict[str, str]) -> DataFrame:
    """Spot pair names from a universe of pairs of token indices and a token list, aliases applied."""
    tokens = meta.select(F.explode("tokens").alias("t")).select("t.index", "t.name")
    pairs = meta.select(F.explode("universe").alias("u")).select("u.name", F.col("u.tokens")[0].alias("base"), F.col("u.tokens")[1].alias("quote"))
    named = pairs.join(tokens.select(F.col("index").alias("base"), F.col("name").alias("base_name")), "base").join(tokens.select(F.col("index").alias("quote"), F.col("name").alias("quote_name")), "quote")
    alias = F.create_map(*[x for k, v in aliases.items() for x in (F.lit(v), F.lit(k))]) if aliases else None
    asset = F.coalesce(F.try_element_at(alias, F.col("base_name")), F.col("base_name")) if aliases else F.col("base_name")
    return named.select("name", asset.alias("asset"), "quote_name")


def market_symbols(assets: DataFrame, asset: str = "asset") -> DataFrame:
    """Each asset's market name on every venue."""
    a = F.col(asset)
    rows = [("coinbase", F.concat(a, F.lit("-USD"))), ("kraken", F.concat(a, F.lit("/USD"))), ("okx", F.concat(a, F.lit("-USDT"))), ("hyperliquid", F.concat(a, F.lit("/USDC"))), ("hyperliquid_perp", a)]
    return assets.select(a.alias("asset"), F.explode(F.array(*[F.struct(F.lit(v).alias("exchange"), m.alias("market")) for v, m in rows])).alias("x")).select("asset", "x.*")


def product_list(products: DataFrame, quotes: dict[str, int]) -> DataFrame:
    """Online products by base, the best quote by priority first; XBT and XDG take their usual names."""
    base = F.when(F.col("base") == "XBT", "BTC").when(F.col("base") == "XDG", "DOGE").otherwise(F.col("base"))
    rank = F.create_map(*[x for k, v in quotes.items() for x in (F.lit(k), F.lit(v))])
    df = products.where(F.col("status").isin("online", "live")).withColumn("base", base).withColumn("rank", F.try_element_at(rank, F.col("quote"))).where("rank is not null")
    return df.groupBy("base").agg(F.min_by("symbol", F.struct("rank", "symbol")).alias("symbol"))


def top_pools(pools: DataFrame, n: int, staked: list[str]) -> DataFrame:
    """The largest pools without liquid-staking tokens."""
    return pools.where(~F.col("token0").isin(staked) & ~F.col("token1").isin(staked)).orderBy(F.col("tvl_usd").desc(), "id").limit(n)


def hourly_closes(bars: DataFrame, volume_column: str = "volume") -> DataFrame:
    """hour, close and dollar volume per symbol; the last bar of an hour wins."""
    hour = F.floor(F.col("ts_s") / 3600).cast("long").alias("hour")
    return bars.groupBy("symbol", hour).agg(F.max_by("close", "ts_s").alias("close"), F.max_by(F.col("close") * F.col(volume_column), "ts_s").alias("dollar_volume"))
