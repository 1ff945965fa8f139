"""Files written and read back, books, pre-event windows, gates and filters' parts over the tape."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from quotemill.operators import learning
from quotemill.operators import windows as w
from quotemill.plans import domain, models
from quotemill.plans.book import QueryBook
from quotemill.plans.domain import DAY, FAIR, HOUR, TAPE
from quotemill.session import load
from quotemill.sources import sinks, tables

book = QueryBook()
add = book.add


def _folder(s) -> str:
    return f"{sinks.shared_folder(s)}/feeds-{uuid.uuid4().hex}"


@add("src7_spot_markets", "SELECT * FROM (VALUES ('@1', 'BTC', 'USDC'), ('PURR/USDC', 'PURR', 'USDC')) v(name, asset, quote_name)")
def _(s, d):
    meta = s.createDataFrame([([(0, "USDC"), (1, "PURR"), (7, "UBTC")], [("PURR/USDC", [1, 0]), ("@1", [7, 0]), ("@9", [8, 0])])], "tokens array<struct<index: int, name: string>>, universe array<struct<name: string, tokens: array<int>>>")
    return tables.spot_markets(meta, {"BTC": "UBTC"})


@add("src8_market_symbols", f"WITH {TAPE}, a AS (SELECT DISTINCT upper(exchange) AS asset FROM tape) SELECT asset, 'coinbase' AS exchange, asset || '-USD' AS market FROM a UNION ALL SELECT asset, 'kraken', asset || '/USD' FROM a UNION ALL SELECT asset, 'okx', asset || '-USDT' FROM a UNION ALL SELECT asset, 'hyperliquid', asset || '/USDC' FROM a UNION ALL SELECT asset, 'hyperliquid_perp', asset FROM a")
def _(s, d):
    return tables.market_symbols(domain.tape(s, d).select(F.upper("exchange").alias("asset")).distinct())


@add("src10_multi_file_scan", f"WITH {TAPE} SELECT seq % 2 AS half, exchange, count(*) AS n, sum(size) AS size FROM tape GROUP BY ALL")
def _(s, d):
    at, t = _folder(s), domain.tape(s, d)
    for half in (0, 1):
        t.where(F.col("seq") % 2 == half).write.parquet(f"{at}/half{half}")
    both = tables.captures(s, [f"{at}/half0", f"{at}/half1"]).withColumn("half", F.regexp_extract("capture", r"/half(\d)/", 1).cast("long"))
    return both.groupBy("half", "exchange").agg(F.count("*").alias("n"), F.sum("size").alias("size"))


@add("src11_absent_columns", f"WITH {TAPE} SELECT seq, price, 0.5::DOUBLE AS basis_stddev FROM tape")
def _(s, d):
    return tables.with_columns_or(domain.tape(s, d), {"seq": "long", "price": "double", "basis_stddev": "double"}, 0.5)


@add("src12_gzip_swaps", f"WITH {TAPE} SELECT seq AS log_index, ts_ms // 1000 AS ts, exchange AS sender, size AS \"amountUSD\", CAST(seq % 100 AS INTEGER) AS tick FROM tape")
def _(s, d):
    at, text = _folder(s), lambda c: F.col(c).cast("string")
    t = domain.tape(s, d).select(text("seq").alias("id"), F.expr("string(ts_ms div 1000)").alias("timestamp"), F.col("exchange").alias("sender"), F.col("side").alias("origin"), text("price").alias("amount0"), text("size").alias("amount1"), text("size").alias("amountUSD"), text("seq").alias("sqrtPriceX96"), F.expr("string(seq % 100)").alias("tick"), text("seq").alias("logIndex"))
    t.write.option("compression", "gzip").json(at)
    return tables.swaps(s, at, 8).select("log_index", "ts", "sender", "amountUSD", "tick")


BARS = f"SELECT ts_ms // {HOUR} * 3600 AS ts_s, min(price) AS low, max(price) AS high, arg_min(price, seq) AS open, arg_max(price, seq) AS close, sum(size) AS volume FROM tape WHERE exchange = 'click' GROUP BY 1"


@add("src13_candle_scan", f"WITH {TAPE} {BARS}")
def _(s, d):
    at = _folder(s)
    t = domain.tape(s, d).where("exchange = 'click'").groupBy(F.expr(f"ts_ms div {HOUR} * 3600").alias("ts_s"))
    sinks.write_jsonl(t.agg(F.min("price").alias("low"), F.max("price").alias("high"), F.min_by("price", "seq").alias("open"), F.max_by("price", "seq").alias("close"), F.sum("size").alias("volume")), at)
    return tables.candles(s, at)


@add("src14_csv_scan", f"WITH {TAPE} SELECT seq, exchange, CASE WHEN seq % 7 <> 0 THEN price END AS price FROM tape")
def _(s, d):
    at = _folder(s)
    sinks.write_csv(domain.tape(s, d).select("seq", "exchange", F.when(F.col("seq") % 7 != 0, F.col("price")).alias("price")), at)
    return tables.csv(s, at, "seq long, exchange string, price double")


@add("src16_pool_discovery", "SELECT p_partkey AS id, p_brand AS token0, p_type AS token1, p_retailprice AS tvl_usd FROM part WHERE p_brand <> 'Brand#11' AND p_type <> 'Brand#11' ORDER BY tvl_usd DESC, id LIMIT 25")
def _(s, d):
    pools = load(s, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("token0"), F.col("p_type").alias("token1"), F.col("p_retailprice").alias("tvl_usd"))
    return tables.top_pools(pools, 25, ["Brand#11"])


@add("src18_funding_history", f"WITH {TAPE} SELECT exchange AS coin, ts_ms // {DAY} * {DAY} AS time, arg_max(size, seq) / 1000 AS funding_rate, arg_max(price, seq) AS premium FROM tape GROUP BY ALL")
def _(s, d):
    at = _folder(s)
    days = domain.tape(s, d).groupBy("exchange", F.expr(f"ts_ms div {DAY} * {DAY}").alias("time")).agg((F.max_by("size", "seq") / 1000).cast("string").alias("fundingRate"), F.max_by("price", "seq").cast("string").alias("premium"))
    rows = F.to_json(F.collect_list(F.struct(F.col("exchange").alias("coin"), "fundingRate", "premium", "time")))  # one reply holds a coin's days
    days.groupBy(F.col("exchange").alias("part")).agg(rows.alias("value")).write.partitionBy("part").text(at)
    return tables.funding(s, at).select("coin", "time", "funding_rate", "premium")


@add("src19_product_list", "WITH p AS (SELECT c_name AS symbol, CASE c_mktsegment WHEN 'BUILDING' THEN 'BTC' WHEN 'MACHINERY' THEN 'DOGE' ELSE c_mktsegment END AS base, CASE c_nationkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 0 END AS rank FROM customer WHERE c_custkey % 4 < 2) SELECT base, arg_min(symbol, (rank, symbol)) AS symbol FROM p WHERE rank IS NOT NULL GROUP BY 1")
def _(s, d):
    c = load(s, d, "customer")
    base = F.when(F.col("c_mktsegment") == "BUILDING", "XBT").when(F.col("c_mktsegment") == "MACHINERY", "XDG").otherwise(F.col("c_mktsegment"))
    quote = F.when(F.col("c_nationkey") % 3 == 0, "USDT").when(F.col("c_nationkey") % 3 == 1, "USD").otherwise("EUR")
    status = F.when(F.col("c_custkey") % 4 == 0, "online").when(F.col("c_custkey") % 4 == 1, "live").otherwise("halted")
    return tables.product_list(c.select(F.col("c_name").alias("symbol"), base.alias("base"), quote.alias("quote"), status.alias("status")), {"USD": 0, "USDT": 1})


@add("src20_ticker_poll", f"WITH {TAPE} SELECT ts_ms / 1000.0::DOUBLE AS ts, exchange AS venue, market AS symbol, price AS bid, price + 1 AS ask FROM tape")
def _(s, d):
    at = _folder(s)
    sinks.write_jsonl(domain.tape(s, d).select((F.col("ts_ms") / 1000.0).alias("ts"), F.col("exchange").alias("venue"), F.col("market").alias("symbol"), F.col("price").alias("bid"), (F.col("price") + 1).alias("ask")), at)
    return tables.ticker_poll(s, at)


@add("src25_hourly_closes", f"WITH {TAPE}, b AS (SELECT exchange, ts_ms // 1000 AS ts_s, arg_max(price, seq) AS close, sum(size) AS volume FROM tape GROUP BY ALL) SELECT exchange AS symbol, ts_s // 3600 AS hour, arg_max(close, ts_s) AS close, arg_max(close * volume, ts_s) AS dollar_volume FROM b GROUP BY ALL")
def _(s, d):
    bars = domain.tape(s, d).groupBy(F.col("exchange").alias("symbol"), F.expr("ts_ms div 1000").alias("ts_s")).agg(F.max_by("price", "seq").alias("close"), F.sum("size").alias("volume"))
    return tables.hourly_closes(bars)


@add("snk1_snapshot_writer", f"WITH {TAPE} SELECT seq AS id, ts_ms AS timestamp_ms, exchange, price + 1 AS fair_value, size AS basis_estimate FROM tape WHERE seq % 3 = 0")
def _(s, d):
    at = _folder(s)
    t = domain.tape(s, d).where("seq % 3 = 0").select(F.col("seq").alias("id"), F.col("ts_ms").alias("timestamp_ms"), "price", F.col("size").alias("stddev"), (F.col("size") > 50).alias("is_live"), F.array(F.struct("exchange", (F.col("price") + 1).alias("fair_value"))).alias("states"), F.array(F.struct("exchange", F.col("size").alias("basis_estimate"))).alias("bases"))
    write = sinks.capture_writer(at)
    write(t, 0)
    write(t, 0)  # a repeated batch writes nothing twice
    read = lambda name: s.read.parquet(f"{at}/{name}")
    states = read("venue_states").join(read("basis_states").select("update_id", "exchange", "basis_estimate"), ["update_id", "exchange"])
    return read("updates").select("id", "timestamp_ms").join(states.drop("timestamp_ms"), F.col("id") == F.col("update_id")).select("id", "timestamp_ms", "exchange", "fair_value", "basis_estimate")


@add("snk2_daily_rotation", f"WITH {TAPE} SELECT CAST(CAST(make_timestamp(ts_ms * 1000) AS DATE) AS VARCHAR) AS day, count(*) AS n, max(seq) AS last_seq FROM tape GROUP BY 1")
def _(s, d):
    at = _folder(s)
    sinks.write_daily(domain.tape(s, d), at, "ts_ms")
    return s.read.parquet(at).groupBy(F.date_format("date", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"), F.max("seq").alias("last_seq"))


@add("snk3_predictions_csv", f"WITH {TAPE} SELECT ts_ms AS timestamp_ms, max(price) AS drift_hat FROM tape GROUP BY 1")
def _(s, d):
    at = _folder(s)
    sinks.write_csv(domain.tape(s, d).groupBy(F.col("ts_ms").alias("timestamp_ms")).agg(F.max("price").alias("drift_hat")), at)
    return tables.csv(s, at, tables.PREDICTIONS)


@add("snk5_jsonl_append", f"WITH {TAPE} SELECT exchange, count(*) AS n, sum(size) AS size FROM tape GROUP BY 1")
def _(s, d):
    at, t = _folder(s), domain.tape(s, d)
    for half in (0, 1):
        sinks.write_jsonl(t.where(F.col("seq") % 2 == half).select("exchange", "size"), at)
    return s.read.schema("exchange string, size double").json(at).groupBy("exchange").agg(F.count("*").alias("n"), F.sum("size").alias("size"))


LEVELS = TAPE + ", lv AS (SELECT exchange, side, round(price) AS level, arg_max(CASE WHEN size < 10 THEN 0 ELSE size END, seq) AS size FROM tape WHERE price > 0 GROUP BY ALL)"


def _levels(s, d):
    size = F.when(F.col("size") < 10, 0.0).otherwise(F.col("size"))
    return domain.tape(s, d).where("price > 0").groupBy("exchange", "side", F.round("price").alias("level")).agg(F.max_by(size, "seq").alias("size")).where("size > 0")


@add("bk1_apply_levels", f"WITH {LEVELS} SELECT exchange, side, level, size FROM lv WHERE size > 0")
def _(s, d):
    return _levels(s, d)


def _best_first(df, depth):
    best = F.when(F.col("side") == "buy", -F.col("level")).otherwise(F.col("level"))
    return df.withColumn("place", F.row_number().over(Window.partitionBy("exchange", "side").orderBy(best))).where(F.col("place") <= depth)


@add("bk3_depth", f"WITH {LEVELS} SELECT exchange, side, CAST(row_number() OVER (PARTITION BY exchange, side ORDER BY CASE side WHEN 'buy' THEN -level ELSE level END) AS INTEGER) AS place, level FROM lv WHERE size > 0 QUALIFY place <= 10")
def _(s, d):
    return _best_first(_levels(s, d), 10).select("exchange", "side", "place", "level")


@add("bk7_checksum_text", f"WITH {LEVELS}, r AS (SELECT *, row_number() OVER (PARTITION BY exchange, side ORDER BY CASE side WHEN 'buy' THEN -level ELSE level END) AS place FROM lv WHERE size > 0) SELECT exchange, string_agg(ltrim(replace(CAST(CAST(level AS DECIMAL(20, 2)) AS VARCHAR), '.', ''), '0') || ltrim(replace(CAST(CAST(size AS DECIMAL(20, 4)) AS VARCHAR), '.', ''), '0'), '' ORDER BY side DESC, place) AS text FROM r WHERE place <= 10 GROUP BY 1")
def _(s, d):
    digits = lambda c, scale: F.ltrim(F.replace(F.col(c).cast(f"decimal(20,{scale})").cast("string"), F.lit("."), F.lit("")), F.lit("0"))
    rows = _best_first(_levels(s, d), 10).select("exchange", F.struct((F.col("side") == "buy").alias("bid"), "place", F.concat(digits("level", 2), digits("size", 4)).alias("t")).alias("r"))
    return rows.groupBy("exchange").agg(F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["t"]), "").alias("text"))


@add("kf2_base_variance", f"WITH {FAIR} SELECT seq, round(ln(greatest(variance, 1e-4) * (1 + 2 * pow(age_ms / 300.0::DOUBLE, 2))), 8) AS log_base FROM fair WHERE variance IS NOT NULL AND age_ms <= 300")
def _(s, d):
    base = F.greatest("variance", F.lit(1e-4)) * (1 + 2 * F.pow(F.col("age_ms") / 300.0, F.lit(2.0)))
    return domain.fair(s, d).where("variance is not null and age_ms <= 300").select("seq", F.round(F.log(base), 8).alias("log_base"))


EMA = "list_reduce(list({x}) OVER (PARTITION BY {k} ORDER BY seq ROWS UNBOUNDED PRECEDING), lambda a, b: 0.2 * b + 0.8 * a)"


@add("fv6_ema_of_prices", f"WITH {TAPE} SELECT seq, round({EMA.format(x='price', k='market')}, 6) AS ema FROM tape")
def _(s, d):
    from quotemill.operators import adapters

    return adapters.ema(domain.tape(s, d), ["market"], ["seq"], "price", 0.2).select("seq", F.round("ema", 6).alias("ema"))


PAST = 6 * HOUR


@add("wn9_pre_event_volatility", f"WITH {TAPE}, p AS (SELECT exchange, seq, ts_ms, lag(ts_ms) OVER k AS before_ms, pow(ln(price / lag(price) OVER k), 2) AS r2 FROM tape WHERE price > 0 WINDOW k AS (PARTITION BY exchange ORDER BY ts_ms, seq)), s AS (SELECT a.seq, sum(b.r2) AS q, count(*) AS n FROM p a JOIN p b ON a.exchange = b.exchange AND (b.ts_ms, b.seq) < (a.ts_ms, a.seq) AND b.before_ms >= a.ts_ms - {PAST} GROUP BY 1) SELECT p.seq, round(CASE WHEN n >= 2 THEN sqrt(q) END, 8) AS vol FROM p LEFT JOIN s USING (seq)")
def _(s, d):
    return w.pre_event_volatility(domain.tape(s, d).where("price > 0"), "price", ["exchange"], "ts_ms", "seq", PAST, "vol").select("seq", F.round("vol", 8).alias("vol"))


@add("ml8_dataset_with_times", f"WITH {models.FEAT} SELECT seq, ts_ms, round(lean, 8) AS lean, size, round(next_mid - mid, 6) AS drift FROM feats WHERE next_mid IS NOT NULL AND next_ts - ts_ms - {HOUR} <= {2 * HOUR}")
def _(s, d):
    rows = models._labelled(s, d).where(F.col("next_ts") - F.col("ts_ms") - HOUR <= 2 * HOUR)
    return rows.select("seq", "ts_ms", F.round("lean", 8).alias("lean"), "size", F.round("drift", 6).alias("drift"))


@add("ml26_toxic_gating", f"WITH {TAPE}, r AS (SELECT exchange, size * 0.05 AS fee, greatest(price - 80, 0) AS tox, row_number() OVER (PARTITION BY exchange ORDER BY size DESC, seq) AS i, row_number() OVER (PARTITION BY exchange ORDER BY greatest(price - 80, 0) DESC, seq) AS j, floor(count(*) OVER (PARTITION BY exchange) * 0.1) AS k FROM tape) SELECT exchange, round(sum(fee - tox), 4) AS passive, round(sum(CASE WHEN i > k THEN fee - tox ELSE 0 END), 4) AS gated, round(sum(CASE WHEN j > k THEN fee - tox ELSE 0 END), 4) AS oracle FROM r GROUP BY 1")
def _(s, d):
    rows = domain.tape(s, d).select("exchange", "seq", "size", (F.col("size") * 0.05).alias("fee"), F.greatest(F.col("price") - 80, F.lit(0.0)).alias("tox"))
    out = learning.gated_value(rows, ["exchange"], "size", "fee", "tox", ["seq"], 0.1)
    return out.select("exchange", *[F.round(c, 4).alias(c) for c in ("passive", "gated", "oracle")])


@add("ml29_frozen_ridge", f"WITH {models.FEAT}, lab AS (SELECT exchange, size AS x, next_mid - mid AS y, row_number() OVER (PARTITION BY exchange ORDER BY seq) <= floor(count(*) OVER (PARTITION BY exchange) * 0.7) AS t FROM feats WHERE next_mid IS NOT NULL), f AS (SELECT exchange, avg(x) AS mx, avg(y) AS my, regr_sxy(y, x) / (regr_sxx(y, x) + 1) AS b FROM lab WHERE t GROUP BY 1) SELECT exchange, round(b, 8) AS slope, round(my - b * mx, 6) AS intercept FROM f")
def _(s, d):
    rows = learning.temporal_split(models._labelled(s, d), "exchange", ["seq"], 0.7)
    return learning.ridge(rows, ["exchange"], ["size"], "drift", 1.0).select("exchange", F.round(F.col("coefficients")[0], 8).alias("slope"), F.round("intercept", 6).alias("intercept"))
