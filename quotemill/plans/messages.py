"""Message normalisation, scalar families and end-to-end pipelines over the tape."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from quotemill.functions import quotes as q
from quotemill.operators import adapters, align, fusion, learning, normalize, simulators, stats
from quotemill.operators import windows as w
from quotemill.plans import domain, models
from quotemill.plans.book import QueryBook
from quotemill.plans.domain import DAY, HOUR, MEASURES, QUOTES, TAPE
from quotemill.session import load

book = QueryBook()
add = book.add


def _iso() -> Column:
    return F.date_format(F.timestamp_millis("ts_ms"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def _text(c: str) -> Column:
    return F.col(c).cast("decimal(20,8)").cast("string")


def _raw(df, message):
    return df.select("seq", F.col("ts_ms").alias("received_ts_ms"), F.to_json(message).alias("raw"))


def _level(px: str, sz: str, names=("px", "sz")) -> Column:
    return F.struct(_text(px).alias(names[0]), _text(sz).alias(names[1]))


def _quote_messages(df, venue):
    b, a = _level("bid", "bid_size"), _level("ask", "ask_size")
    shapes = {
        "hyperliquid_bbo": F.struct(F.lit("bbo").alias("channel"), F.struct(F.col("market").alias("coin"), F.col("ts_ms").alias("time"), F.array(F.array(b), F.array(a)).alias("levels")).alias("data")),
        "kraken_ticker": F.struct(F.lit("ticker").alias("channel"), F.array(F.struct(F.col("market").alias("symbol"), _text("bid").alias("bid"), _text("bid_size").alias("bid_qty"), _text("ask").alias("ask"), _text("ask_size").alias("ask_qty"), _iso().alias("timestamp"))).alias("data")),
        "okx_tickers": F.struct(F.struct(F.lit("tickers").alias("channel")).alias("arg"), F.array(F.struct(F.col("market").alias("instId"), _text("bid").alias("bidPx"), _text("bid_size").alias("bidSz"), _text("ask").alias("askPx"), _text("ask_size").alias("askSz"), F.col("ts_ms").cast("string").alias("ts"))).alias("data")),
    }
    return _raw(df, shapes[venue])


for _id, _name in (("nrm1", "hyperliquid_bbo"), ("nrm9", "kraken_ticker"), ("nrm12", "okx_tickers")):

    @add(f"{_id}_{_name}", f"WITH {QUOTES} SELECT seq, market, ts_ms AS source_ts_ms, bid_size, ask_size, round(bid, 8) < round(ask, 8) AS open FROM quotes")
    def _(s, d, name=_name):
        df = getattr(normalize, name)(_quote_messages(domain.quotes(s, d), name))
        return df.select("seq", "market", "source_ts_ms", F.col("bid_size").cast("double").alias("bid_size"), F.col("ask_size").cast("double").alias("ask_size"), (F.col("bid_price") < F.col("ask_price")).alias("open"))


def _book_messages(df, venue):
    b, a = _level("bid", "bid_size"), _level("ask", "ask_size")
    kb, ka = _level("bid", "bid_size", ("price", "qty")), _level("ask", "ask_size", ("price", "qty"))
    kind = F.when(F.col("seq") % 5 == 0, "snapshot").otherwise("update")
    cb = [F.struct(F.lit(side).alias("side"), _text(p).alias("price_level"), _text(z).alias("new_quantity")) for side, p, z in (("bid", "bid", "bid_size"), ("offer", "ask", "ask_size"))]
    shapes = {
        "hyperliquid_books": F.struct(F.lit("l2Book").alias("channel"), F.struct(F.col("market").alias("coin"), F.col("ts_ms").alias("time"), F.array(F.array(b, b), F.array(a)).alias("levels")).alias("data")),
        "kraken_books": F.struct(F.lit("book").alias("channel"), kind.alias("type"), F.array(F.struct(F.col("market").alias("symbol"), F.array(kb, kb).alias("bids"), F.array(ka).alias("asks"), _iso().alias("timestamp"), F.lit(7).alias("checksum"))).alias("data")),
        "okx_books": F.struct(F.struct(F.lit("books5").alias("channel"), F.col("market").alias("instId")).alias("arg"), F.array(F.struct(F.array(F.array(_text("bid"), _text("bid_size")), F.array(_text("bid"), _text("bid_size"))).alias("bids"), F.array(F.array(_text("ask"), _text("ask_size"), F.lit("0"))).alias("asks"), F.col("ts_ms").cast("string").alias("ts"))).alias("data")),
        "coinbase_books": F.struct(F.lit("l2_data").alias("channel"), _iso().alias("timestamp"), F.array(F.struct(kind.alias("type"), F.col("market").alias("product_id"), F.array(cb[0], cb[0], cb[1]).alias("updates"))).alias("events")),
    }
    return _raw(df, shapes[venue])


for _id, _name in (("nrm4", "hyperliquid_books"), ("nrm8", "coinbase_books"), ("nrm11", "kraken_books"), ("nrm14", "okx_books")):
    _kind = "CASE WHEN seq % 5 = 0 THEN 'snapshot' ELSE 'delta' END" if _id in ("nrm8", "nrm11") else "'snapshot'"

    @add(f"{_id}_{_name}", f"WITH {QUOTES} SELECT seq, market, ts_ms AS source_ts_ms, {_kind} AS kind, 2 AS buys, 1 AS sells, 2 * bid_size + ask_size AS total FROM quotes")
    def _(s, d, name=_name):
        df = getattr(normalize, name)(_book_messages(domain.quotes(s, d), name))
        count = lambda side: F.size(F.filter("levels", lambda x: x["side"] == side))
        total = F.aggregate("levels", F.lit(0.0), lambda acc, x: acc + x["size"].cast("double"))
        return df.select("seq", "market", "source_ts_ms", "kind", count("buy").alias("buys"), count("sell").alias("sells"), total.alias("total"))


def _candles(s, d):
    t = domain.tape(s, d).groupBy("market", F.floor(F.col("ts_ms") / HOUR).cast("long").alias("h"))
    at = lambda f: f("price", "seq")
    return t.agg(at(F.min_by).alias("o"), F.max("price").alias("hi"), F.min("price").alias("lo"), at(F.max_by).alias("c"), F.sum("size").alias("v"), F.count("*").alias("n")).withColumn("ts_ms", F.col("h") * HOUR).withColumn("seq", F.col("h"))


CANDLES = f"WITH {TAPE} SELECT market, ts_ms // {HOUR} * {HOUR} AS open_ts, arg_min(price, seq) AS open, max(price) AS high, min(price) AS low, arg_max(price, seq) AS close, sum(size) AS volume FROM tape GROUP BY ALL"


@add("nrm3_hyperliquid_candles", CANDLES)
def _(s, d):
    c = _candles(s, d)
    item = F.struct(F.col("ts_ms").alias("t"), (F.col("ts_ms") + HOUR).alias("T"), F.col("market").alias("s"), F.lit("1h").alias("i"), *[_text(x).alias(k) for x, k in (("o", "o"), ("hi", "h"), ("lo", "l"), ("c", "c"), ("v", "v"))], F.col("n"))
    out = normalize.hyperliquid_candles(_raw(c, F.struct(F.lit("candle").alias("channel"), F.array(item).alias("data"))))
    return out.select("market", "open_ts", *[F.col(x).cast("double").alias(x) for x in ("open", "high", "low", "close", "volume")])


@add("nrm7_coinbase_candles", CANDLES)
def _(s, d):
    c = _candles(s, d)
    item = F.struct((F.col("ts_ms") / 1000).cast("long").cast("string").alias("start"), F.col("market").alias("product_id"), *[_text(x).alias(k) for x, k in (("o", "open"), ("hi", "high"), ("lo", "low"), ("c", "close"), ("v", "volume"))])
    out = normalize.coinbase_candles(_raw(c, F.struct(F.lit("candles").alias("channel"), F.array(F.struct(F.array(item).alias("candles"))).alias("events"))))
    return out.select("market", "open_ts", *[F.col(x).cast("double").alias(x) for x in ("open", "high", "low", "close", "volume")])


@add("nrm15_timestamps", f"WITH {TAPE} SELECT seq, ts_ms AS a, ts_ms AS b, ts_ms AS c FROM tape")
def _(s, d):
    ms = normalize.timestamp_ms
    return domain.tape(s, d).select("seq", ms(F.col("ts_ms").cast("string")).alias("a"), ms(F.concat(F.col("ts_ms").cast("string"), F.lit(".7"))).alias("b"), ms(_iso()).alias("c"))


@add("nrm16_rename_observations", f"WITH {TAPE} SELECT seq, exchange || '' AS was, 'click_perp' AS exchange, 'X' AS market FROM tape WHERE exchange = 'click'")
def _(s, d):
    t = domain.tape(s, d).where("exchange = 'click'").withColumn("was", F.col("exchange"))
    return normalize.renamed(t, "click_perp", "X").select("seq", "was", "exchange", "market")


@add("me8_measurement_at_clock", f"WITH {MEASURES}, g AS (SELECT DISTINCT exchange, ts_ms // {DAY} * {DAY} + {DAY} AS now FROM measures) SELECT g.exchange, g.now, round(m.mid, 8) AS mid, g.now - m.ts_ms AS age_ms FROM g ASOF JOIN measures m ON g.exchange = m.exchange AND g.now >= m.ts_ms")
def _(s, d):
    m = domain.measures(s, d)
    grid = m.select("exchange", (F.floor(F.col("ts_ms") / DAY) * DAY + DAY).cast("long").alias("ts_ms")).distinct().withColumn("seq", F.lit(0).cast("long"))
    df = align.asof_backward(grid, m, keys=["exchange"], time="ts_ms", seq="seq", values=["mid"], bucket_ms=DAY)
    return df.where("r_ts_ms is not null").select("exchange", F.col("ts_ms").alias("now"), F.round("r_mid", 8).alias("mid"), (F.col("ts_ms") - F.col("r_ts_ms")).alias("age_ms"))


@add("sc2_amm_price", f"WITH {TAPE} SELECT seq, round(ln(pow(size * 1e30 / pow(2.0::DOUBLE, 96), 2) * 1e12), 8) AS log_price FROM tape WHERE size > 0")
def _(s, d):
    return domain.tape(s, d).where("size > 0").select("seq", F.round(F.log(q.amm_price(F.col("size") * 1e30)), 8).alias("log_price"))


@add("sc5_strings", r"SELECT c_custkey, upper(c_mktsegment) AS up, split_part(c_name, '#', 1) AS head, regexp_replace(c_name, '^\D*0*', '') AS digits, c_mktsegment LIKE '%ING' AS ends, regexp_matches(c_name, '^[0-9]+$') AS is_digits FROM customer")
def _(s, d):
    n = F.col("c_name")
    return load(s, d, "customer").select("c_custkey", F.upper("c_mktsegment").alias("up"), F.split(n, "#")[0].alias("head"), F.regexp_replace(n, r"^\D*0*", "").alias("digits"), F.col("c_mktsegment").endswith("ING").alias("ends"), n.rlike("^[0-9]+$").alias("is_digits"))


@add("sc7_dates", f"WITH {TAPE} SELECT seq, CAST(make_timestamp(ts_ms * 1000) AS DATE)::VARCHAR AS day, ts_ms // {HOUR} % 24 AS hour_of_day FROM tape")
def _(s, d):
    return domain.tape(s, d).select("seq", F.date_format(F.timestamp_millis("ts_ms"), "yyyy-MM-dd").alias("day"), (F.floor(F.col("ts_ms") / HOUR) % 24).cast("long").alias("hour_of_day"))


@add("sc9_json_arrays", f"WITH {TAPE} SELECT seq, '[\"' || exchange || '\",\"' || side || '\"]' AS packed, side AS second FROM tape")
def _(s, d):
    packed = F.to_json(F.array("exchange", "side"))
    return domain.tape(s, d).select("seq", packed.alias("packed"), F.from_json(packed, "array<string>")[1].alias("second"))


@add("sc10_arrays", "SELECT l_orderkey, max(l_quantity) FILTER (l_linestatus = 'O') AS top, min(l_quantity) FILTER (l_linestatus = 'O') AS low, count(*) AS n FROM lineitem GROUP BY 1")
def _(s, d):
    g = load(s, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct("l_linestatus", "l_quantity")).alias("a"))
    mine = F.transform(F.filter("a", lambda x: x["l_linestatus"] == "O"), lambda x: x["l_quantity"])
    return g.select("l_orderkey", F.array_max(mine).alias("top"), F.array_min(mine).alias("low"), F.size("a").cast("long").alias("n"))


@add("sc11_map_default", f"WITH {TAPE} SELECT seq, CASE exchange WHEN 'click' THEN 0.98 WHEN 'view' THEN 0.95 ELSE 0.9 END::DOUBLE AS rho FROM tape")
def _(s, d):
    table = F.create_map(F.lit("click"), F.lit(0.98), F.lit("view"), F.lit(0.95))
    return domain.tape(s, d).select("seq", F.coalesce(F.try_element_at(table, F.col("exchange")), F.lit(0.9)).alias("rho"))


@add("sc12_finite", f"WITH {TAPE} SELECT seq, isfinite(CASE WHEN seq % 3 = 0 THEN 'nan'::DOUBLE WHEN seq % 3 = 1 THEN 'inf'::DOUBLE ELSE price END) AS ok FROM tape")
def _(s, d):
    x = F.when(F.col("seq") % 3 == 0, F.lit(float("nan"))).when(F.col("seq") % 3 == 1, F.lit(float("inf"))).otherwise(F.col("price"))
    return domain.tape(s, d).select("seq", q.finite(x).alias("ok"))


@add("sc24_freshness", f"WITH {QUOTES} SELECT seq, coalesce(nullif(age_ms, 7) <= 250, false) AS fresh FROM quotes")
def _(s, d):
    return domain.quotes(s, d).select("seq", q.fresh(F.nullif(F.col("age_ms"), F.lit(7)), 250).alias("fresh"))


@add("sc25_positive_mid", f"WITH {QUOTES} SELECT seq, CASE WHEN bid - 5 > 0 AND ask > 0 THEN round((bid - 5 + ask) / 2, 8) END AS mid FROM quotes")
def _(s, d):
    return domain.quotes(s, d).select("seq", F.round(q.positive_mid(F.col("bid") - 5, F.col("ask")), 8).alias("mid"))


@add("ml20_windowed_slope_variance", f"WITH {models.FEAT}, lab AS (SELECT exchange, size AS x, next_mid - mid AS y, (row_number() OVER (PARTITION BY exchange ORDER BY seq) - 1) // 100 AS win FROM feats WHERE next_mid IS NOT NULL), b AS (SELECT exchange, win, regr_slope(y, x) AS b FROM lab GROUP BY ALL), dd AS (SELECT exchange, b - lag(b) OVER (PARTITION BY exchange ORDER BY win) AS db FROM b) SELECT exchange, round(var_pop(db) / 100, 8) AS q, count(db) + 1 AS windows FROM dd GROUP BY 1 HAVING count(db) >= 2")
def _(s, d):
    by = Window.partitionBy("exchange")
    lab = models._labelled(s, d).withColumn("win", F.floor((F.row_number().over(by.orderBy("seq")) - 1) / 100))
    b = lab.groupBy("exchange", "win").agg(F.regr_slope("drift", "size").alias("b")).withColumn("db", F.col("b") - F.lag("b").over(by.orderBy("win")))
    return b.groupBy("exchange").agg(F.round(F.var_pop("db") / 100, 8).alias("q"), (F.count("db") + 1).alias("windows")).where("windows >= 3")


@add("ml21_out_of_sample_gate", f"WITH {models.RIDGE1}, p AS (SELECT k.*, my - b * mx + b * size AS pred FROM k JOIN fit USING (exchange, fold) WHERE is_test) SELECT exchange, count(*) AS n FROM p GROUP BY 1 HAVING avg((sign(drift) = sign(pred))::INT) > 0.45")
def _(s, d):
    rows, fitted = models._ridge1(s, d)
    test = learning.predicted(rows, fitted, ["exchange", "fold"], ["size"]).where("is_test")
    m = learning.regression_metrics(F.col("drift"), F.col("predicted"))
    return test.groupBy("exchange").agg(m["n"].alias("n"), m["direction"].alias("hit")).where("hit > 0.45").drop("hit")


@add("ml23_hourly_ridge")
def _(s, d):
    h = domain.tape(s, d).groupBy("exchange", F.floor(F.col("ts_ms") / (6 * HOUR)).cast("long").alias("hour")).agg(F.max_by("price", "seq").alias("p")).where("p > 0")
    by = Window.partitionBy("exchange").orderBy("hour")
    r = F.log("p") - F.log(F.lag("p").over(by))
    rows = h.withColumn("r", r).withColumns({"lag1": F.lag("r", 1).over(by), "lag2": F.lag("r", 2).over(by), "y": F.lead("r").over(by)}).dropna()
    rows = learning.walk_forward(rows, "exchange", ["hour"], 60, 20, 20)
    fitted = learning.ridge(rows, ["exchange", "fold"], ["lag1", "lag2"], "y", 1.0)
    return learning.predicted(rows, fitted, ["exchange", "fold"], ["lag1", "lag2"]).where("is_test").select("exchange", "fold", "hour", "y", "predicted")


@add("ml25_regime_gates", f"WITH {TAPE}, c AS (SELECT exchange, quantile_cont(size, 0.75) AS cut FROM tape GROUP BY 1), g AS (SELECT exchange, seq, price, size > cut AS on_ FROM tape JOIN c USING (exchange)), f AS (SELECT *, coalesce(lag(on_) OVER (PARTITION BY exchange ORDER BY seq), false) AS was FROM g) SELECT exchange, round(sum(CASE WHEN on_ THEN price ELSE 0 END) - 2 * sum((on_ <> was)::INT), 4) AS net FROM f GROUP BY 1")
def _(s, d):
    t = domain.tape(s, d)
    t = t.join(t.groupBy("exchange").agg(F.percentile("size", 0.75).alias("cut")), "exchange").withColumn("gate", F.col("size") > F.col("cut"))
    return simulators.gate_flips(t, "exchange", ["seq"], "gate", "price", 2.0).select("exchange", F.round("net", 4).alias("net"))


@add("sim8_fill_regimes")
def _(s, d):
    fills = simulators.maker(simulators.with_grid(models._maker_rows(s, d), [{"half_spread": 1.0, "skew": 0.05}]), ["exchange"], ["half_spread", "skew"])
    m = domain.measures(s, d)
    vol = w.return_volatility(m, "mid", ["exchange"], "ts_ms", "seq", 6 * HOUR, "vol")
    f = align.asof_forward(fills, m, keys=["exchange"], time="ts_ms", seq="seq", values=["mid"], ahead=HOUR, bucket_ms=DAY)
    f = align.asof_backward(f, vol, keys=["exchange"], time="ts_ms", seq="seq", values=["vol"], prefix="v_", bucket_ms=DAY).where("r_mid is not null and v_vol is not null")
    cuts = f.groupBy("exchange").agg(*[F.percentile("v_vol", p).alias(n) for n, p in (("a", 0.25), ("b", 0.5), ("c", 0.75))])
    move = F.col("r_mid") - F.col("price")
    pnl = F.when(F.col("side") == "buy", move).otherwise(-move)
    return f.join(cuts, "exchange").groupBy("exchange", stats.quartile_bucket(F.col("v_vol"), F.col("a"), F.col("b"), F.col("c")).alias("bucket")).agg(F.count("*").alias("fills"), F.sum(pnl).alias("pnl"))


@add("sim9_paper_trade")
def _(s, d):
    rows = simulators.with_grid(models._maker_rows(s, d).where("exchange = 'click'"), [{"half_spread": 1.0, "drift_coef": 1.0}])
    return simulators.maker(rows, ["exchange"], ["half_spread", "drift_coef"], latency_ms=1000).select("exchange", "seq", "side", "price", "inventory", "equity")


@add("pipe1_single_venue", models.EMA.format(with_=domain.FAIR + ", f AS (SELECT * FROM fair WHERE variance IS NOT NULL)", x="fair_value", src="f", k="exchange"))
def _(s, d):
    f = domain.fair(s, d).where("variance is not null")
    return adapters.ema(f, ["exchange"], ["seq"], "fair_value", 0.2, width=2_000).withColumn("ema", F.round("ema", 7))


@add("pipe2_composite_and_kalman")
def _(s, d):
    states = models._states(s, d)
    c = fusion.composite(fusion.live_states(states.drop("age_ms"), "now_ms", 6 * HOUR, 0.1), ["market", "event_seq"])
    k = adapters.fused_kalman(states, "market", cutoff_ms=6.0 * HOUR)
    return c.join(k, ["market", "event_seq"]).select("market", "event_seq", "fair_value", F.col("price").alias("kalman_price"))


@add("pipe3_composite_and_basis")
def _(s, d):
    states = models._states(s, d)
    c = fusion.composite(fusion.live_states(states.drop("age_ms"), "now_ms", 6 * HOUR, 0.1), ["market", "event_seq"])
    k = adapters.basis_kalman(states, "market", anchor="click", cutoff_ms=6.0 * HOUR)
    return c.join(k, ["market", "event_seq"]).select("market", "event_seq", "fair_value", F.col("price").alias("common_price"), "is_live")
