"""Quote scalars, measurements, fair value and fusion over the tape."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quotemill.functions import quotes as q
from quotemill.operators import fusion
from quotemill.operators import windows as w
from quotemill.plans import domain
from quotemill.plans.book import QueryBook
from quotemill.plans.domain import FAIR, HOUR, MEASURES, QUOTES, TAPE

book = QueryBook()
add = book.add


def _r(*names, digits=8):
    return [F.round(n, digits).alias(n) for n in names]


def _rs(*names, digits=8):
    return ", ".join(f"round({n}, {digits}) AS {n}" for n in names)


@add("qt1_midprice", f"WITH {MEASURES} SELECT seq, {_rs('mid')} FROM measures")
def _(s, d):
    return domain.measures(s, d).select("seq", *_r("mid"))


@add("qt2_spread_bps", f"WITH {MEASURES} SELECT seq, {_rs('spread_bps')}, round(ask - bid, 8) AS spread FROM measures")
def _(s, d):
    return domain.measures(s, d).select("seq", *_r("spread_bps"), F.round(F.col("ask") - F.col("bid"), 8).alias("spread"))


@add("qt3_microprice", f"WITH {MEASURES} SELECT seq, micro FROM measures")
def _(s, d):
    return domain.measures(s, d).select("seq", "micro")  # the same arithmetic on both sides: exact, where rounding would meet ties


@add("qt4_book_top_scalars", f"WITH {QUOTES}, b AS (SELECT ts_ms // {6 * HOUR} AS book, max(bid) AS best_bid, min(ask) AS best_ask, arg_max(bid_size, (bid, -seq)) AS bid_size, arg_min(ask_size, (ask, seq)) AS ask_size FROM quotes GROUP BY 1) SELECT book, round((best_bid + best_ask) / 2, 8) AS mid, round((best_ask * bid_size + best_bid * ask_size) / (bid_size + ask_size), 8) AS micro FROM b")
def _(s, d):
    levels = domain.quotes(s, d).groupBy(F.floor(F.col("ts_ms") / (6 * HOUR)).cast("long").alias("book")).agg(
        F.max(F.struct("bid", -F.col("seq"), "bid_size")).alias("b"), F.min(F.struct("ask", "seq", "ask_size")).alias("a")
    )
    bid, bs, ask, as_ = F.col("b.bid"), F.col("b.bid_size"), F.col("a.ask"), F.col("a.ask_size")
    return levels.select("book", F.round(q.mid(bid, ask), 8).alias("mid"), F.round(q.microprice(bid, bs, ask, as_), 8).alias("micro"))


LAST = f"""WITH {QUOTES}, e AS (SELECT *, CASE WHEN exchange IN ('click', 'view') THEN seq END AS qseq, CASE WHEN exchange IN ('click', 'view') THEN ts_ms END AS qts FROM quotes),
c AS (SELECT *, last_value(qseq IGNORE NULLS) OVER w AS last_q, last_value(qts IGNORE NULLS) OVER w AS last_t FROM e WINDOW w AS (PARTITION BY market ORDER BY ts_ms, seq ROWS UNBOUNDED PRECEDING))"""


@add("me1_carry_and_emit", f"{LAST} SELECT seq, last_q, ts_ms - last_t AS quote_age_ms FROM c WHERE last_q IS NOT NULL AND exchange <> 'signup'")
def _(s, d):
    is_quote = F.col("exchange").isin("click", "view")
    by = Window.partitionBy("market").orderBy("ts_ms", "seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    df = domain.quotes(s, d).withColumn("l", F.last(F.when(is_quote, F.struct("seq", "ts_ms")), ignorenulls=True).over(by))
    return df.where("l is not null and exchange <> 'signup'").select("seq", F.col("l.seq").alias("last_q"), (F.col("ts_ms") - F.col("l.ts_ms")).alias("quote_age_ms"))


@add("me4_depth_imbalance", f"WITH {MEASURES} SELECT seq, {_rs('imb')} FROM measures")
def _(s, d):
    return domain.measures(s, d).select("seq", *_r("imb"))


def _vol_sql(price, span):
    return f"""r AS (SELECT *, {price} / nullif(lag({price}) OVER o, 0) - 1 AS ret FROM measures WINDOW o AS (PARTITION BY exchange ORDER BY ts_ms, seq)),
  v AS (SELECT *, count(ret) OVER w AS n, sum(ret) OVER w AS sr, sum(ret * ret) OVER w AS sq, first_value(ret) OVER w AS fr FROM r WINDOW w AS (PARTITION BY exchange ORDER BY ts_ms RANGE BETWEEN {span} PRECEDING AND CURRENT ROW)),
  z AS (SELECT *, n - (fr IS NOT NULL)::INT AS k, sr - coalesce(fr, 0) AS s1, sq - coalesce(fr * fr, 0) AS s2 FROM v)"""


_VOL = "10000 * CASE WHEN k < 1 THEN NULL WHEN k = 1 THEN abs(s1) ELSE sqrt(greatest(s2 / k - pow(s1 / k, 2), 0)) END"


@add("me5_return_volatility", f"WITH {MEASURES}, {_vol_sql('mid', 6 * HOUR)} SELECT seq, round({_VOL}, 3) AS vol FROM z")
def _(s, d):
    return w.return_volatility(domain.measures(s, d), "mid", ["exchange"], "ts_ms", "seq", 6 * HOUR, "vol").select("seq", F.round("vol", 3).alias("vol"))


@add("me6_micro_volatility", f"WITH {MEASURES}, {_vol_sql('micro', 6 * HOUR)} SELECT seq, round({_VOL}, 3) AS vol FROM z")
def _(s, d):
    return w.return_volatility(domain.measures(s, d), "micro", ["exchange"], "ts_ms", "seq", 6 * HOUR, "vol").select("seq", F.round("vol", 3).alias("vol"))


@add("me9_top_of_book_either_shape", f"WITH {QUOTES} SELECT seq, round(coalesce(CASE WHEN side = 'buy' THEN bid END, price), 8) AS top_bid, coalesce(CASE WHEN side = 'buy' THEN bid_size END, size) AS top_depth FROM quotes")
def _(s, d):
    bbo = F.col("side") == "buy"
    return domain.quotes(s, d).select("seq", F.round(F.coalesce(F.when(bbo, F.col("bid")), "price"), 8).alias("top_bid"), F.coalesce(F.when(bbo, F.col("bid_size")), "size").alias("top_depth"))


@add("tf1_trade_flow", f"""WITH {TAPE} SELECT seq, round(sum(CASE side WHEN 'buy' THEN size ELSE -size END) OVER w, 6) AS net, round(coalesce(sum(size) FILTER (side = 'buy') OVER w, 0), 6) AS buy,
 round(coalesce(sum(size) FILTER (side = 'sell') OVER w, 0), 6) AS sell, count(*) OVER w AS n FROM tape WINDOW w AS (PARTITION BY exchange ORDER BY ts_ms RANGE BETWEEN {HOUR} PRECEDING AND CURRENT ROW)""")
def _(s, d):
    side = lambda name: F.when(F.col("side") == name, F.col("size"))
    df = w.trailing_sums(domain.tape(s, d), ["exchange"], "ts_ms", "seq", HOUR, {"buy": side("buy"), "sell": side("sell"), "n": F.lit(1).cast("long")}, peers=True).fillna(0.0, ["buy", "sell"])
    return df.select("seq", F.round(F.col("buy") - F.col("sell"), 6).alias("net"), F.round("buy", 6).alias("buy"), F.round("sell", 6).alias("sell"), "n")


@add("fv2_micro_alpha", f"WITH {FAIR} SELECT seq, {_rs('alpha')} FROM alphas")
def _(s, d):
    return domain.fair(s, d).select("seq", *_r("alpha"))


@add("fv3_raw_fair_value", f"WITH {FAIR} SELECT seq, CASE WHEN seq % 11 = 0 THEN mid WHEN seq % 11 = 1 THEN micro ELSE fair_value END AS fair_value FROM fair")
def _(s, d):
    df = domain.fair(s, d)
    gone = lambda k: F.when(F.col("seq") % 11 != k, F.lit(1.0))
    return df.select("seq", q.raw_fair_value(F.col("mid") * gone(1), F.col("micro") * gone(0), F.col("alpha")).alias("fair_value"))


@add("fv4_measurement_variance", f"WITH {FAIR} SELECT seq, round(ln(variance), 8) AS log_variance FROM fair")
def _(s, d):
    return domain.fair(s, d).select("seq", F.round(F.log("variance"), 8).alias("log_variance"))


@add("fv5_estimator", f"WITH {FAIR} SELECT seq, {_rs('fair_value')}, round(ln(variance), 8) AS log_variance FROM fair WHERE fair_value IS NOT NULL AND variance IS NOT NULL")
def _(s, d):
    return domain.fair(s, d).where("fair_value is not null and variance is not null").select("seq", *_r("fair_value"), F.round(F.log("variance"), 8).alias("log_variance"))


@add("fv8_venue_state", f"WITH {FAIR} SELECT seq, exchange, ts_ms - age_ms AS state_ts_ms, {_rs('fair_value')} FROM fair WHERE fair_value IS NOT NULL AND variance IS NOT NULL")
def _(s, d):
    return domain.fair(s, d).where("fair_value is not null and variance is not null").select("seq", "exchange", (F.col("ts_ms") - F.col("age_ms")).alias("state_ts_ms"), *_r("fair_value"))


@add("fv10_perp_predicate", f"WITH {TAPE} SELECT DISTINCT exchange || CASE WHEN exchange = 'click' THEN '_perp' ELSE '' END AS venue, exchange = 'click' AS is_perp FROM tape")
def _(s, d):
    v = domain.tape(s, d).select("exchange").distinct().select(F.concat("exchange", F.when(F.col("exchange") == "click", "_perp").otherwise("")).alias("venue"))
    return v.select("venue", q.is_perp(F.col("venue")).alias("is_perp"))


CAP = """{c} AS (SELECT *, count(*) OVER g AS n_, sum(iv) OVER g AS t_, row_number() OVER (PARTITION BY {g} ORDER BY iv DESC, exchange) - 1 AS m_ FROM {src} WINDOW g AS (PARTITION BY {g})),
{c}2 AS (SELECT *, iv / t_ AS w_, sum(iv / t_) OVER (PARTITION BY {g} ORDER BY m_ ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS tail_ FROM {c}),
{c}3 AS (SELECT *, min(m_) FILTER (w_ * (1 - m_ * {cap}) / tail_ <= {cap} + 1e-15) OVER (PARTITION BY {g}) AS s_ FROM {c}2),
{c}4 AS (SELECT *, max(tail_) FILTER (m_ = s_) OVER (PARTITION BY {g}) AS st_ FROM {c}3),
{c}w AS (SELECT *, CASE WHEN n_ <= 1 OR n_ * {cap} < 1 OR s_ IS NULL THEN w_ WHEN m_ < s_ THEN {cap} ELSE w_ * (1 - s_ * {cap}) / st_ END AS w FROM {c}4)"""


@add("fu1_cap_and_renormalise", f"WITH {TAPE}, a AS (SELECT ts_ms // {domain.DAY} AS day, exchange, sum(size * size) AS iv FROM tape GROUP BY 1, 2), {CAP.format(c='c', g='day', src='a', cap='0.3::DOUBLE')} SELECT day, exchange, round(w, 8) AS capped_weight FROM cw")
def _(s, d):
    a = domain.tape(s, d).groupBy(F.floor(F.col("ts_ms") / domain.DAY).cast("long").alias("day"), "exchange").agg(F.sum(F.col("size") * F.col("size")).alias("iv"))
    return fusion.capped_weights(a, ["day"], "iv", "exchange", 0.3).select("day", "exchange", F.round("capped_weight", 8).alias("capped_weight"))


STATES = f"""WITH {FAIR}, f AS (SELECT seq, ts_ms, exchange, fair_value, variance FROM fair WHERE variance IS NOT NULL), v AS (SELECT DISTINCT exchange FROM f),
 g AS (SELECT e.seq AS event_seq, e.ts_ms AS now_ms, v.exchange FROM f e CROSS JOIN v),
 st AS (SELECT g.event_seq, g.now_ms, g.exchange, f.ts_ms AS state_ts_ms, f.fair_value, f.variance FROM g ASOF JOIN f ON g.exchange = f.exchange AND g.event_seq >= f.seq),
 lv AS (SELECT *, greatest(now_ms - state_ts_ms, 0) AS age_ms, variance * (1 + 0.1::DOUBLE * greatest(now_ms - state_ts_ms, 0) / 1000.0) AS ev FROM st WHERE now_ms - state_ts_ms <= {6 * HOUR})"""


def _live(s, d):
    e = domain.fair(s, d).where("variance is not null").withColumn("market", (F.col("ts_ms") * 0).cast("string"))
    return fusion.live_states(fusion.latest_states(e, domain.VENUES, ["seq"]), "now_ms", 6 * HOUR, 0.1)


@add("fu2_live_set", f"{STATES} SELECT event_seq, exchange, age_ms, round(ln(ev), 7) AS log_effective FROM lv")
def _(s, d):
    return _live(s, d).select("event_seq", "exchange", "age_ms", F.round(F.log("effective_variance"), 7).alias("log_effective"))


@add("fu3_composite_fair_value", f"""{STATES}, a AS (SELECT *, 1 / ev AS iv FROM lv), {CAP.format(c='c', g='event_seq', src='a', cap='0.75::DOUBLE')}, z AS (SELECT *, sum(w * fair_value) OVER (PARTITION BY event_seq) AS f_ FROM cw)
SELECT event_seq, round(max(f_), 6) AS fair_value, round(ln(greatest(0.01, sum(w * w * ev) + sum(w * pow(fair_value - f_, 2)))), 6) AS log_variance, string_agg(exchange, ',' ORDER BY exchange) AS venues FROM z GROUP BY 1""")
def _(s, d):
    df = fusion.composite(_live(s, d), ["event_seq"])
    return df.select("event_seq", F.round("fair_value", 6).alias("fair_value"), F.round(F.log("variance"), 6).alias("log_variance"), F.array_join("venues", ",").alias("venues"))


@add("fu4_combiner_diagnostics", f"{STATES}, a AS (SELECT *, 1 / ev AS iv FROM lv), {CAP.format(c='c', g='event_seq', src='a', cap='0.75::DOUBLE')} SELECT event_seq, exchange, round(w_, 8) AS raw_weight, round(w, 8) AS capped_weight FROM cw")
def _(s, d):
    df = _live(s, d).withColumn("iv", 1 / F.col("effective_variance"))
    df = fusion.capped_weights(df, ["event_seq"], "iv", "exchange", 0.75)
    raw = F.col("iv") / F.sum("iv").over(Window.partitionBy("event_seq"))
    return df.select("event_seq", "exchange", F.round(raw, 8).alias("raw_weight"), F.round("capped_weight", 8).alias("capped_weight"))


@add("fu6_upsert_latest", f"{STATES} SELECT event_seq, count(*) AS venues, max(state_ts_ms) AS newest_ms FROM st GROUP BY 1")
def _(s, d):
    e = domain.fair(s, d).where("variance is not null").withColumn("market", (F.col("ts_ms") * 0).cast("string"))
    return fusion.latest_states(e, domain.VENUES, ["seq"]).groupBy("event_seq").agg(F.count("*").alias("venues"), F.max("state_ts_ms").alias("newest_ms"))
