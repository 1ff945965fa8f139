"""Labels, features, folds, models, filters, simulators and books over the tape."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from quotemill.functions import quotes as q
from quotemill.operators import adapters, align, fusion, learning, normalize, ranges, simulators, stats
from quotemill.operators import windows as w
from quotemill.plans import domain
from quotemill.plans.book import QueryBook
from quotemill.plans.domain import DAY, HOUR, MEASURES, TAPE

book = QueryBook()
add = book.add
FEATURES = ["lean", "imb", "size"]

FEAT = MEASURES + f", feats AS (SELECT m.seq, m.exchange, m.ts_ms, m.micro - m.mid AS lean, m.imb, m.size, m.mid, r.mid AS next_mid, r.ts_ms AS next_ts FROM (SELECT *, ts_ms + {HOUR} AS goal FROM measures) m ASOF LEFT JOIN measures r ON m.exchange = r.exchange AND m.goal <= r.ts_ms)"


def _features(s, d):
    m = domain.measures(s, d)
    f = align.asof_forward(m, m, keys=["exchange"], time="ts_ms", seq="seq", values=["mid"], ahead=HOUR, prefix="next_", bucket_ms=DAY)
    return f.select("seq", "exchange", "ts_ms", (F.col("micro") - F.col("mid")).alias("lean"), "imb", "size", "mid", "next_mid", F.col("next_ts_ms").alias("next_ts"))


def _labelled(s, d):
    return _features(s, d).where("next_mid is not null").withColumn("drift", F.col("next_mid") - F.col("mid"))


@add("ml1_own_features", f"WITH {FEAT} SELECT seq, round(lean, 8) AS lean, round(imb, 8) AS imb, size FROM feats")
def _(s, d):
    return _features(s, d).select("seq", F.round("lean", 8).alias("lean"), F.round("imb", 8).alias("imb"), "size")


@add("ml2_basis_dislocation", f"WITH {TAPE}, c AS (SELECT ts_ms // {DAY} AS day, avg(price) AS common FROM tape GROUP BY 1), b AS (SELECT exchange, avg(price - common) AS basis FROM tape JOIN c ON ts_ms // {DAY} = day GROUP BY 1) SELECT seq, round(price - (common + basis), 6) AS dislocation FROM tape JOIN c ON ts_ms // {DAY} = day JOIN b USING (exchange)")
def _(s, d):
    t = domain.tape(s, d).withColumn("day", F.floor(F.col("ts_ms") / DAY))
    t = t.join(t.groupBy("day").agg(F.avg("price").alias("common")), "day")
    b = t.groupBy("exchange").agg(F.avg(F.col("price") - F.col("common")).alias("basis"))
    return t.join(b, "exchange").select("seq", F.round(F.col("price") - (F.col("common") + F.col("basis")), 6).alias("dislocation"))


@add("ml3_drift_label", f"WITH {FEAT} SELECT seq, round(next_mid - mid, 6) AS drift FROM feats WHERE next_mid IS NOT NULL AND next_ts - ts_ms - {HOUR} <= {2 * HOUR}")
def _(s, d):
    return _labelled(s, d).where(F.col("next_ts") - F.col("ts_ms") - HOUR <= 2 * HOUR).select("seq", F.round("drift", 6).alias("drift"))


@add("ml4_magnitude_label", f"WITH {FEAT} SELECT seq, (abs((next_mid - mid) / mid) * 10000 > 1000)::INT AS large FROM feats WHERE next_mid IS NOT NULL AND mid > 0")
def _(s, d):
    return _labelled(s, d).where("mid > 0").select("seq", (F.abs(F.col("drift") / F.col("mid")) * 10000 > 1000).cast("int").alias("large"))


VENUES = ["click", "purchase", "view"]
CROSS = TAPE + ", c AS (SELECT *, " + ", ".join(f"last_value(CASE WHEN exchange = '{v}' THEN price END IGNORE NULLS) OVER w AS {v}_price" for v in VENUES) + " FROM tape WINDOW w AS (ORDER BY ts_ms, seq ROWS UNBOUNDED PRECEDING))"


@add("ml5_cross_venue_features", f"WITH {CROSS} SELECT seq, click_price, purchase_price, view_price FROM c WHERE click_price IS NOT NULL AND purchase_price IS NOT NULL AND view_price IS NOT NULL")
def _(s, d):
    t = domain.tape(s, d)
    df = align.asof_many(t, t, time="ts_ms", seq="seq", who="exchange", others=VENUES, value="price", bucket_ms=DAY, by_seq=True)
    cols = [f"{v}_price" for v in VENUES]
    return df.dropna(subset=cols).select("seq", *cols)


@add("ml6_lagged_feature_matrix", f"WITH {TAPE}, " + ", ".join(f"g{k} AS (SELECT l.seq, l.size - r.size AS d{k} FROM (SELECT *, ts_ms - {k * HOUR} AS goal FROM tape) l ASOF JOIN tape r ON l.exchange = r.exchange AND l.goal >= r.ts_ms WHERE l.ts_ms - r.ts_ms <= {2 * k * HOUR})" for k in (1, 3)) + " SELECT seq, d1, d3 FROM g1 JOIN g3 USING (seq)")
def _(s, d):
    t = domain.tape(s, d)
    out = t
    for k in (1, 3):
        out = align.asof_backward(out, t, keys=["exchange"], time="ts_ms", seq="seq", values=["size"], lag=k * HOUR, prefix=f"p{k}_", bucket_ms=DAY)
        out = out.where(F.col("ts_ms") - F.col(f"p{k}_ts_ms") <= 2 * k * HOUR)
    return out.select("seq", *[(F.col("size") - F.col(f"p{k}_size")).alias(f"d{k}") for k in (1, 3)])


LAGS = (1, 3)
LAGGED = ("price", "size")


def _venue_at(v, k):
    """SQL: every row with venue ``v``'s row at or before its time less ``k`` hours."""
    return f"x{k}{v} AS (SELECT l.seq, r.ts_ms AS at, r.price, r.size FROM (SELECT *, ts_ms - {k * HOUR} AS goal FROM tape) l ASOF JOIN (SELECT * FROM tape WHERE exchange = '{v}') r ON l.goal >= r.ts_ms)"


def _cross_lags_sql():
    parts = [_venue_at(v, k) for v in VENUES for k in (0, *LAGS)]
    joins = " ".join(f"JOIN x{k}{v} USING (seq)" for v in VENUES for k in (0, *LAGS))
    diffs = ", ".join(f"round(x0{v}.{c} - x{k}{v}.{c}, 6) AS {v}_{c}_{k}h" for v in VENUES for c in LAGGED for k in LAGS)
    fresh = " AND ".join(f"tape.ts_ms - x{k}{v}.at <= {2 * k * HOUR}" for v in VENUES for k in LAGS)
    return f"WITH {TAPE}, " + ", ".join(parts) + f" SELECT seq, {diffs} FROM tape {joins} WHERE {fresh}"


@add("ml6_cross_venue_lags", _cross_lags_sql())
def _(s, d):
    t = domain.tape(s, d).select("seq", "exchange", "ts_ms", F.struct("ts_ms", *LAGGED).alias("row"))
    out = t
    for k in (0, *LAGS):  # one pass over one sort for all venues of a lag
        back = out.withColumn("ts_ms", F.col("ts_ms") - k * HOUR)
        found = align.asof_many(back, t, time="ts_ms", seq="seq", who="exchange", others=VENUES, value="row", bucket_ms=DAY)
        out = found.withColumn("ts_ms", F.col("ts_ms") + k * HOUR).withColumnsRenamed({f"{v}_row": f"{v}_{k}" for v in VENUES})
    fresh = [F.col("ts_ms") - F.col(f"{v}_{k}.ts_ms") <= 2 * k * HOUR for v in VENUES for k in LAGS]
    for ok in fresh:
        out = out.where(ok)
    diffs = [F.round(F.col(f"{v}_0.{c}") - F.col(f"{v}_{k}.{c}"), 6).alias(f"{v}_{c}_{k}h") for v in VENUES for c in LAGGED for k in LAGS]
    return out.select("seq", *diffs)


@add("ml7_lead_feature_set", f"WITH {CROSS} SELECT seq, round(price - click_price, 6) AS own, round((purchase_price - view_price) / view_price * 10000, 4) AS spread_bps FROM c WHERE purchase_price IS NOT NULL AND click_price IS NOT NULL AND view_price > 0")
def _(s, d):
    t = domain.tape(s, d)
    df = align.asof_many(t, t, time="ts_ms", seq="seq", who="exchange", others=VENUES, value="price", bucket_ms=DAY, by_seq=True).where("purchase_price is not null and click_price is not null and view_price > 0")
    return df.select("seq", F.round(F.col("price") - F.col("click_price"), 6).alias("own"), F.round((F.col("purchase_price") - F.col("view_price")) / F.col("view_price") * 10000, 4).alias("spread_bps"))


FOLDS = "n AS (SELECT *, row_number() OVER (PARTITION BY exchange ORDER BY seq) - 1 AS i, count(*) OVER (PARTITION BY exchange) AS n FROM {src}), k AS (SELECT n.*, f AS fold, i >= f * 100 + 200 AS is_test FROM n, generate_series(0, 200) g(f) WHERE i >= f * 100 AND i < f * 100 + 300 AND f * 100 + 300 <= n)"


def _folds(df):
    return learning.walk_forward(df, "exchange", ["seq"], 200, 100, 100)


@add("ml9_walk_forward_folds", f"WITH {TAPE}, {FOLDS.format(src='tape')} SELECT exchange, fold::INT AS fold, is_test, count(*) AS n, min(seq) AS first_seq FROM k GROUP BY ALL")
def _(s, d):
    return _folds(domain.tape(s, d)).groupBy("exchange", "fold", "is_test").agg(F.count("*").alias("n"), F.min("seq").alias("first_seq"))


@add("ml10_standardise", f"WITH {TAPE}, {FOLDS.format(src='tape')}, m AS (SELECT *, avg(size) FILTER (NOT is_test) OVER g AS mu, stddev_pop(size) FILTER (NOT is_test) OVER g AS sd FROM k WINDOW g AS (PARTITION BY exchange, fold)) SELECT exchange, fold::INT AS fold, seq, round(CASE WHEN is_test THEN greatest(-5, least(5, (size - mu) / sd)) ELSE (size - mu) / sd END, 6) AS z FROM m")
def _(s, d):
    return learning.standardised(_folds(domain.tape(s, d)), ["exchange", "fold"], ["size"]).select("exchange", "fold", "seq", F.round("size", 6).alias("z"))


RIDGE1 = FEAT + ", lab AS (SELECT *, next_mid - mid AS drift FROM feats WHERE next_mid IS NOT NULL), " + FOLDS.format(src="lab") + ", fit AS (SELECT exchange, fold, avg(size) FILTER (NOT is_test) AS mx, avg(drift) FILTER (NOT is_test) AS my, (sum(size * drift) FILTER (NOT is_test) - count(*) FILTER (NOT is_test) * avg(size) FILTER (NOT is_test) * avg(drift) FILTER (NOT is_test)) / (sum(size * size) FILTER (NOT is_test) - count(*) FILTER (NOT is_test) * pow(avg(size) FILTER (NOT is_test), 2) + 1) AS b FROM k GROUP BY ALL)"


def _ridge1(s, d):
    rows = _folds(_labelled(s, d))
    return rows, learning.ridge(rows, ["exchange", "fold"], ["size"], "drift", 1.0)


@add("ml11_ridge", f"WITH {RIDGE1} SELECT exchange, fold::INT AS fold, round(b, 6) AS slope, round(my - b * mx, 5) AS intercept FROM fit")
def _(s, d):
    _, models = _ridge1(s, d)
    return models.select("exchange", "fold", F.round(F.col("coefficients")[0], 6).alias("slope"), F.round("intercept", 5).alias("intercept"))


@add("ml12_ols_with_split", f"WITH {FEAT}, lab AS (SELECT exchange, size AS x, next_mid - mid AS y, row_number() OVER (PARTITION BY exchange ORDER BY seq) > floor(count(*) OVER (PARTITION BY exchange) * 0.7) AS t FROM feats WHERE next_mid IS NOT NULL), f AS (SELECT exchange, regr_slope(y, x) FILTER (NOT t) AS b, regr_intercept(y, x) FILTER (NOT t) AS a FROM lab GROUP BY 1) SELECT exchange, round(1 - sum(pow(y - a - b * x, 2)) / (sum(y * y) - sum(y) * avg(y)), 6) AS r2, count(*) AS n FROM lab JOIN f USING (exchange) WHERE t GROUP BY 1")
def _(s, d):
    rows = learning.temporal_split(_labelled(s, d), "exchange", ["seq"], 0.7)
    models = learning.ridge(rows, ["exchange"], ["size"], "drift", 0.0)
    test = learning.predicted(rows, models, ["exchange"], ["size"]).where("is_test")
    m = learning.regression_metrics(F.col("drift"), F.col("predicted"))
    return test.groupBy("exchange").agg(F.round(m["r2"], 6).alias("r2"), m["n"].alias("n"))


def _split(s, df, share):
    """Rows that a fit reads many times, with ``is_test``: joined and numbered once."""
    return domain.stored(s, learning.temporal_split(df, "exchange", ["seq"], share))


@add("ml13_boosted_trees")
def _(s, d):
    rows = _split(s, _labelled(s, d).select("exchange", "seq", "ts_ms", "drift", *FEATURES), 0.7)
    out, _ = learning.boosted(rows, FEATURES, "drift", ["ts_ms", "seq"])
    return out.where("is_test").select("seq", "exchange", "drift", "predicted")


@add("ml14_logistic")
def _(s, d):
    rows = _split(s, _labelled(s, d).select("exchange", "seq", *FEATURES, (F.abs("drift") > 40).cast("int").alias("large")), 0.7)
    return learning.logistic(rows, FEATURES, "large").where("is_test").select("seq", "exchange", "large", F.round("probability", 6).alias("probability"))


@add("ml15_balanced_logistic")
def _(s, d):
    rows = _split(s, _labelled(s, d).select("exchange", "seq", *FEATURES, (F.abs("drift") > 100).cast("int").alias("large")), 0.8)
    return learning.logistic(rows, FEATURES, "large", balanced=True).where("is_test").select("seq", "exchange", "large", F.round("probability", 6).alias("probability"))


@add("ml16_fold_metrics", f"WITH {RIDGE1}, p AS (SELECT k.*, my - b * mx + b * size AS pred FROM k JOIN fit USING (exchange, fold) WHERE is_test) SELECT exchange, fold::INT AS fold, round(avg((sign(drift) = sign(pred))::INT), 6) AS direction, count(*) AS n FROM p GROUP BY ALL")
def _(s, d):
    rows, models = _ridge1(s, d)
    test = learning.predicted(rows, models, ["exchange", "fold"], ["size"]).where("is_test")
    m = learning.regression_metrics(F.col("drift"), F.col("predicted"))
    return test.groupBy("exchange", "fold").agg(F.round(m["direction"], 6).alias("direction"), m["n"].alias("n"))


SCORED = TAPE + ", s AS (SELECT exchange, seq, size AS score, (price > 80)::INT AS y FROM tape)"


def _scored(s, d):
    return domain.tape(s, d).select("exchange", "seq", F.col("size").alias("score"), (F.col("price") > 80).cast("int").alias("y"))


@add("ml17_auc", f"WITH {SCORED}, r AS (SELECT *, rank() OVER (PARTITION BY exchange ORDER BY score) + (count(*) OVER (PARTITION BY exchange, score) - 1) / 2.0::DOUBLE AS rk FROM s) SELECT exchange, round((sum(rk) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2.0::DOUBLE) / (sum(y) * sum(1 - y)), 8) AS auc FROM r GROUP BY 1")
def _(s, d):
    return learning.auc(_scored(s, d), ["exchange"], "score", "y").select("exchange", F.round("auc", 8).alias("auc"))


@add("ml17_precision_and_capture", f"WITH {SCORED}, r AS (SELECT *, row_number() OVER (PARTITION BY exchange ORDER BY score DESC, seq) AS i, count(*) OVER (PARTITION BY exchange) AS n FROM s) SELECT exchange, round(avg(y) FILTER (i <= greatest(1, floor(n * 0.2))), 8) AS precision, round(sum(y) FILTER (i <= greatest(1, floor(n * 0.2))) / sum(y), 8) AS capture FROM r GROUP BY 1")
def _(s, d):
    return learning.precision_at(_scored(s, d), ["exchange"], "score", "y", ["seq"], 0.2).select("exchange", F.round("precision", 8).alias("precision"), F.round("capture", 8).alias("capture"))


@add("ml17_average_precision", f"WITH {SCORED}, r AS (SELECT *, sum(y) OVER w / count(*) OVER w AS p FROM s WINDOW w AS (PARTITION BY exchange ORDER BY score DESC, seq)) SELECT exchange, round(avg(p) FILTER (y = 1), 8) AS ap FROM r GROUP BY 1")
def _(s, d):
    return learning.average_precision(_scored(s, d), ["exchange"], "score", "y", ["seq"]).select("exchange", F.round("average_precision", 8).alias("ap"))


@add("ml18_beta_kalman")
def _(s, d):
    return adapters.beta_kalman(_labelled(s, d), "exchange", ["seq"], FEATURES, "drift")


@add("ml22_delayed_labels")
def _(s, d):
    rows = _labelled(s, d)
    fitted = adapters.calibrated(rows, "exchange", ["seq"], FEATURES, "drift", warm=0.3, time="ts_ms")
    return adapters.delayed_beta(rows, "exchange", ["ts_ms", "seq"], FEATURES, "mid", fitted, horizon_ms=HOUR, time="ts_ms")


@add("ml24_sign_strategy", f"WITH {RIDGE1}, p AS (SELECT k.*, my - b * mx + b * size AS pred FROM k JOIN fit USING (exchange, fold) WHERE is_test) SELECT exchange, round(sum(sign(pred) * drift - 0.19), 4) AS net, count(*) AS n FROM p GROUP BY 1")
def _(s, d):
    rows, models = _ridge1(s, d)
    test = learning.predicted(rows, models, ["exchange", "fold"], ["size"]).where("is_test")
    return test.groupBy("exchange").agg(F.round(F.sum(F.signum("predicted") * F.col("drift") - 0.19), 4).alias("net"), F.count("*").alias("n"))


@add("ml27_toxicity_label", f"WITH {TAPE}, c AS (SELECT quantile_cont(price, 0.95) AS cut FROM tape WHERE price > 0) SELECT seq, (price >= cut)::INT AS toxic FROM tape, c")
def _(s, d):
    t = domain.tape(s, d)
    cut = t.where("price > 0").agg(F.percentile("price", 0.95).alias("cut"))  # one row
    return t.crossJoin(F.broadcast(cut)).select("seq", (F.col("price") >= F.col("cut")).cast("int").alias("toxic"))


@add("ml28_temporal_split", f"WITH {TAPE} SELECT seq, row_number() OVER (PARTITION BY exchange ORDER BY seq) > floor(count(*) OVER (PARTITION BY exchange) * 0.8) AS is_test FROM tape")
def _(s, d):
    return learning.temporal_split(domain.tape(s, d), "exchange", ["seq"], 0.8).select("seq", "is_test")


#: An average's weights shrink by 0.8 a row: what is more than 200 rows back is below the precision of a double.
EMA = """WITH {with_}, w AS (SELECT list_transform(range(200, -1, -1), lambda k: 0.2::DOUBLE * pow(0.8::DOUBLE, k)) AS w),
 r AS (SELECT {k}, seq, row_number() OVER o - 1 AS i, first_value({x}) OVER o AS x0, list({x}) OVER (PARTITION BY {k} ORDER BY seq ROWS 200 PRECEDING) AS xs FROM {src} WINDOW o AS (PARTITION BY {k} ORDER BY seq))
 SELECT {k}, seq, round(list_dot_product(xs, w[202 - len(xs):]) + pow(0.8::DOUBLE, i + 1) * x0, 7) AS ema FROM r, w"""


@add("fv6_ema", EMA.format(with_=MEASURES, x="mid", src="measures", k="market"))
def _(s, d):
    return adapters.ema(domain.measures(s, d), ["market"], ["seq"], "mid", 0.2, width=2_000).withColumn("ema", F.round("ema", 7))


def _states(s, d):
    """States after each event of a market: its filters run through its whole history."""
    e = domain.fair(s, d).where("variance is not null")
    states = fusion.latest_states(e, domain.VENUES, ["seq"])
    return states.withColumn("age_ms", (F.col("now_ms") - F.col("state_ts_ms")).cast("double"))


@add("kf6_fused_kalman")
def _(s, d):
    return adapters.fused_kalman(_states(s, d), "market", cutoff_ms=6.0 * HOUR)


@add("bf6_basis_kalman")
def _(s, d):
    return adapters.basis_kalman(_states(s, d), "market", anchor="click", order=("click", "view"), cutoff_ms=6.0 * HOUR, overlap=2_000)


def _maker_rows(s, d):
    side = lambda name: F.when(F.col("side") == name, F.col("size"))
    rows = domain.fair(s, d).where("variance is not null").withColumn("drift", F.col("micro") - F.col("mid"))
    return w.trailing_sums(rows, ["exchange"], "ts_ms", "seq", HOUR, {"buy_flow": side("buy"), "sell_flow": side("sell")}, peers=True).fillna(0.0, ["buy_flow", "sell_flow"])


@add("sim1_maker_grid")
def _(s, d):
    rows = simulators.with_grid(_maker_rows(s, d), [{"half_spread": h, "skew": k} for h in (0.5, 2.0) for k in (0.0, 0.1)])
    return simulators.maker_summary(simulators.maker(rows, ["exchange"], ["half_spread", "skew"]), ["exchange", "half_spread", "skew"])


@add("sim2_fill_agreement")
def _(s, d):
    fills = simulators.maker(simulators.with_grid(_maker_rows(s, d), [{"half_spread": 1.0, "skew": 0.0}]), ["exchange"], ["half_spread", "skew"])
    t = domain.measures(s, d)
    ahead = align.asof_forward(fills, t, keys=["exchange"], time="ts_ms", seq="seq", values=["mid"], ahead=HOUR, bucket_ms=DAY)
    move = F.col("r_mid") - F.col("price")
    return ahead.where("r_mid is not null").groupBy("exchange", "side").agg(F.count("*").alias("n"), F.round(F.avg(F.when(F.col("side") == "buy", move).otherwise(-move)), 6).alias("edge"))


def _dislocated(s, d):
    return w.trailing_moments(domain.tape(s, d), "price", ["exchange"], "ts_ms", "seq", 6 * HOUR).withColumn("dislocation", F.col("price") - F.col("roll_mean")).withColumn("z", F.when(F.col("roll_std") > 0.01, F.col("dislocation") / F.col("roll_std")).otherwise(0.0))


@add("sim3_taker")
def _(s, d):
    return simulators.taker(_dislocated(s, d), "exchange", threshold=50.0, horizon_ms=HOUR, fee=0.0004)


@add("sim4_mean_reversion")
def _(s, d):
    return simulators.mean_reversion(_dislocated(s, d), "exchange", enter=1.5, leave=0.5, hold_ms=6 * HOUR, warm_ms=DAY, fees=0.1)


@add("sim5_funding_carry", f"WITH {TAPE}, h AS (SELECT exchange, ts_ms // {HOUR} AS hour, avg(size) / 1000 AS funding, avg(price) AS basis FROM tape GROUP BY ALL), c AS (SELECT exchange, hour, basis, sum(funding) OVER w AS f, count(*) OVER w AS k, lead(basis, 8) OVER (PARTITION BY exchange ORDER BY hour) AS x FROM h WINDOW w AS (PARTITION BY exchange ORDER BY hour ROWS BETWEEN 1 FOLLOWING AND 8 FOLLOWING)) SELECT exchange, hour, round(f, 6) AS funding_sum, round(f + basis - x - 0.5 + 3e-9, 6) AS net FROM c WHERE k = 8")
def _(s, d):
    h = domain.tape(s, d).groupBy("exchange", F.floor(F.col("ts_ms") / HOUR).cast("long").alias("hour")).agg((F.avg("size") / 1000).alias("funding"), F.avg("price").alias("basis"))
    return simulators.carry(h, "exchange", 8, 0.5).select("exchange", "hour", F.round("funding_sum", 6).alias("funding_sum"), F.round(F.col("net") + 3e-9, 6).alias("net"))


LP = TAPE + ", sw AS (SELECT *, lag(price) OVER (PARTITION BY exchange ORDER BY seq) AS pb FROM tape WHERE price > 0)"


@add("sim6_passive_liquidity", f"WITH {LP}, a AS (SELECT *, coalesce(pb, price) AS p0 FROM sw), r AS (SELECT *, sqrt(least(greatest(p0, 40), 120)) AS a, sqrt(least(greatest(price, 40), 120)) AS b FROM a) SELECT exchange, round(sum(CASE WHEN p0 BETWEEN 40 AND 120 THEN size * 0.003 * 100 / (5000 + 100) ELSE 0 END), 6) AS fees, round(sum(100 * (1 / b - 1 / a) * price * 1.01 + 100 * (b - a)), 4) AS dv, count(*) FILTER (p0 BETWEEN 40 AND 120) AS inside FROM r GROUP BY 1")
def _(s, d):
    sw = domain.tape(s, d).where("price > 0").select("exchange", "seq", F.col("price").alias("pool"), (F.col("price") * 1.01).alias("ext"), F.col("size").alias("amount_usd"), F.lit(5000.0).alias("active"))
    out = simulators.passive_liquidity(sw, "exchange", ["seq"], low=40.0, high=120.0, liquidity=100.0, fee=0.003)
    return out.groupBy("exchange").agg(F.round(F.sum("fee_usd"), 6).alias("fees"), F.round(F.sum("dv_ext"), 4).alias("dv"), F.count_if("in_range").alias("inside"))


@add("sim7_active_liquidity")
def _(s, d):
    sw = domain.tape(s, d).where("price > 1").select("exchange", "seq", "ts_ms", F.col("price").alias("pool"), F.col("size").alias("amount_usd"), F.lit(5000.0).alias("active"))
    return simulators.active_liquidity(sw, "exchange", width=0.5, trigger=1.0, grace=5, capital=10_000.0, fee=0.003, gas=1.0)


@add("sim10_gate_flips", f"WITH {TAPE}, g AS (SELECT *, size > 50 AS on_, coalesce(lag(size > 50) OVER (PARTITION BY exchange ORDER BY seq), false) AS was FROM tape) SELECT exchange, round(sum(CASE WHEN on_ THEN price ELSE 0 END), 4) AS gross, sum((on_ <> was)::INT)::BIGINT AS flips, round(sum(CASE WHEN on_ THEN price ELSE 0 END) - 0.5 * sum((on_ <> was)::INT), 4) AS net FROM g GROUP BY 1")
def _(s, d):
    t = domain.tape(s, d).withColumn("gate", F.col("size") > 50)
    return simulators.gate_flips(t, "exchange", ["seq"], "gate", "price", 0.5).select("exchange", F.round("gross", 4).alias("gross"), "flips", F.round("net", 4).alias("net"))


@add("sim11_pairwise_arb", f"WITH {TAPE}, l AS (SELECT * FROM tape WHERE exchange = 'purchase'), r AS (SELECT * FROM tape WHERE exchange = 'click'), p AS (SELECT l.seq, l.price, r.price AS rp, l.ts_ms - r.ts_ms AS g1 FROM l ASOF LEFT JOIN r ON l.ts_ms >= r.ts_ms), n AS (SELECT l.seq, r.price AS np, r.ts_ms - l.ts_ms AS g2 FROM l ASOF LEFT JOIN r ON l.ts_ms <= r.ts_ms), e AS (SELECT p.price - CASE WHEN g2 IS NULL OR g1 <= g2 THEN rp ELSE np END AS edge FROM p JOIN n USING (seq) WHERE least(coalesce(g1, 1e18), coalesce(g2, 1e18)) <= {HOUR}) SELECT count(*) AS n, round(median(edge), 6) AS median, round(avg((edge > 0)::INT), 6) AS positive FROM e")
def _(s, d):
    t = domain.tape(s, d)
    near = align.nearest(t.where("exchange = 'purchase'"), t.where("exchange = 'click'"), keys=[], time="ts_ms", seq="seq", values=["price"], tolerance=HOUR, bucket_ms=DAY)
    edge = F.col("price") - F.col("r_price")
    return near.where("r_price is not null").agg(F.count("*").alias("n"), F.round(F.median(edge), 6).alias("median"), F.round(stats.share(edge > 0), 6).alias("positive"))


def _messages(s, d):
    """The tape as venue messages in JSON text."""
    t = domain.quotes(s, d)
    text = lambda c: F.col(c).cast("decimal(20,8)").cast("string")
    ticker = F.to_json(F.struct(F.lit("ticker").alias("channel"), F.array(F.struct(F.lit("snapshot").alias("type"), F.array(F.struct(F.col("market").alias("product_id"), text("bid").alias("best_bid"), text("bid_size").alias("best_bid_quantity"), text("ask").alias("best_ask"), text("ask_size").alias("best_ask_quantity"))).alias("tickers"))).alias("events"), F.date_format(F.timestamp_millis("ts_ms"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("timestamp")))
    return t.select("seq", F.col("ts_ms").alias("received_ts_ms"), F.when(F.col("seq") % 10 == 0, "{\"channel\":\"heartbeats\"}").otherwise(ticker).alias("raw"))


@add("nrm5_coinbase_ticker", f"WITH {domain.QUOTES} SELECT seq, ts_ms AS source_ts_ms, market, size + 1 AS bid_size FROM quotes WHERE seq % 10 <> 0")
def _(s, d):
    return normalize.coinbase_ticker(_messages(s, d)).select("seq", "source_ts_ms", "market", F.col("bid_size").cast("double").alias("bid_size"))


@add("nrm18_unknown_channel", f"WITH {TAPE} SELECT seq FROM tape WHERE seq % 10 = 0")
def _(s, d):
    raw = _messages(s, d)
    return normalize.quarantine(raw, normalize.coinbase_ticker(raw)).select("seq")


def _trades_json(s, d, venue):
    t = domain.tape(s, d)
    price, size = F.col("price").cast("string"), F.col("size").cast("string")
    shapes = {
        "okx": F.struct(F.struct(F.lit("trades").alias("channel"), F.col("market").alias("instId")).alias("arg"), F.array(F.struct(F.col("market").alias("instId"), F.col("seq").cast("string").alias("tradeId"), F.col("side"), price.alias("px"), size.alias("sz"), F.col("ts_ms").cast("string").alias("ts"))).alias("data")),
        "kraken": F.struct(F.lit("trade").alias("channel"), F.lit("update").alias("type"), F.array(F.struct(F.col("market").alias("symbol"), F.col("side"), F.col("price"), F.col("size").alias("qty"), F.col("seq").alias("trade_id"), F.date_format(F.timestamp_millis("ts_ms"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("timestamp"))).alias("data")),
        "hyperliquid": F.struct(F.lit("trades").alias("channel"), F.array(F.struct(F.col("market").alias("coin"), F.when(F.col("side") == "buy", "B").otherwise("A").alias("side"), F.col("ts_ms").alias("time"), price.alias("px"), size.alias("sz"), F.col("seq").cast("string").alias("hash"))).alias("data")),
        "coinbase": F.struct(F.lit("market_trades").alias("channel"), F.array(F.struct(F.array(F.struct(F.col("seq").cast("string").alias("trade_id"), F.col("market").alias("product_id"), price.alias("price"), size.alias("size"), F.upper("side").alias("side"), F.date_format(F.timestamp_millis("ts_ms"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("time"))).alias("trades"))).alias("events")),
    }
    return t.select("seq", F.col("ts_ms").alias("received_ts_ms"), F.to_json(shapes[venue]).alias("raw"))


for _n, _v in ((2, "hyperliquid"), (6, "coinbase"), (10, "kraken"), (13, "okx")):

    @add(f"nrm{_n}_{_v}_trades", f"WITH {TAPE} SELECT CAST(seq AS VARCHAR) AS trade_id, ts_ms AS source_ts_ms, side, price, size FROM tape")
    def _(s, d, v=_v):
        df = getattr(normalize, f"{v}_trades")(_trades_json(s, d, v))
        return df.select("trade_id", "source_ts_ms", "side", F.col("price").cast("double").alias("price"), F.col("size").cast("double").alias("size"))


@add("bk4_best_levels", f"WITH {TAPE}, b AS (SELECT exchange, ts_ms // {DAY} AS epoch, side, round(price) AS level, arg_max(size, seq) AS size FROM tape GROUP BY ALL) SELECT exchange, epoch, max(level) FILTER (side = 'buy') AS bid, min(level) FILTER (side = 'sell') AS ask FROM b WHERE size > 10 GROUP BY ALL")
def _(s, d):
    t = domain.tape(s, d).groupBy("exchange", F.floor(F.col("ts_ms") / DAY).cast("long").alias("epoch"), "side", F.round("price").alias("level")).agg(F.max_by("size", "seq").alias("size")).where("size > 10")
    return t.groupBy("exchange", "epoch").agg(F.max(F.when(F.col("side") == "buy", F.col("level"))).alias("bid"), F.min(F.when(F.col("side") == "sell", F.col("level"))).alias("ask"))


#: A tape as book messages: every 40th is a snapshot of five levels, others change one level; each 97th skips a sequence number.
BOOK = TAPE + f""", msg AS (SELECT exchange, seq, side, row_number() OVER o AS i, (row_number() OVER o) % 40 = 1 AS snap, seq % 97 = 0 AS gap, round(price) AS level, CASE WHEN size < 10 THEN 0 ELSE size END AS size FROM tape WINDOW o AS (PARTITION BY exchange ORDER BY seq)),
 seg AS (SELECT *, sum(snap::INT) OVER (PARTITION BY exchange ORDER BY seq) AS segment FROM msg),
 st AS (SELECT *, sum((gap AND NOT snap)::INT) OVER (PARTITION BY exchange, segment ORDER BY seq) AS gaps, gap AND NOT snap AS hit FROM seg),
 lv AS (SELECT exchange, segment, seq, side, level, size FROM st WHERE NOT snap UNION ALL
   SELECT exchange, segment, seq, CASE WHEN k % 2 = 0 THEN 'buy' ELSE 'sell' END, level + k, size + k FROM st, generate_series(0, 4) g(k) WHERE snap),
 held AS (SELECT m.exchange, m.seq, l.side, l.level, arg_max(l.size, l.seq) AS size FROM st m JOIN lv l ON m.exchange = l.exchange AND m.segment = l.segment AND l.seq <= m.seq WHERE m.gaps = 0 GROUP BY ALL)"""


def _book_messages(s, d):
    t = ranges.numbered(domain.tape(s, d), ["exchange"], ["seq"], "i")
    snap, size = F.col("i") % 40 == 1, F.when(F.col("size") < 10, 0.0).otherwise(F.col("size"))
    text = F.lit("0")
    one = F.struct("side", F.round("price").alias("price"), size.alias("size"), text.alias("price_text"), text.alias("size_text"))
    five = F.array(*[F.struct(F.lit("buy" if k % 2 == 0 else "sell").alias("side"), (F.round("price") + k).alias("price"), (size + k).alias("size"), text.alias("price_text"), text.alias("size_text")) for k in range(5)])
    t = t.select("exchange", F.lit("m").alias("market"), "seq", F.when(snap, "snapshot").otherwise("delta").alias("kind"), F.when(snap, five).otherwise(F.array(one)).alias("levels"))
    gaps = ranges.running_sum(t, ["exchange"], ["seq"], (F.col("seq") % 97 == 0).cast("long"), "skipped")
    return ranges.numbered(gaps, ["exchange"], ["seq"], "sequence").withColumn("sequence", F.col("sequence") + F.col("skipped"))


@add("bk5_book_replay", f"""WITH {BOOK}, best AS (SELECT exchange, seq, max(level) FILTER (side = 'buy') AS bid, arg_max(size, level) FILTER (side = 'buy') AS bid_size, min(level) FILTER (side = 'sell') AS ask, arg_min(size, level) FILTER (side = 'sell') AS ask_size FROM held WHERE size > 0 GROUP BY ALL)
SELECT st.exchange, st.seq, CASE WHEN gaps = 0 THEN 'ok' WHEN hit AND gaps = 1 THEN 'resync' ELSE 'dropped' END AS status, bid, bid_size, ask, ask_size FROM st LEFT JOIN best USING (exchange, seq)""")
def _(s, d):
    return adapters.replay_books(_book_messages(s, d), sequenced=True).select("exchange", "seq", "status", "bid", "bid_size", "ask", "ask_size")


@add("bk6_checked_books", f"""WITH {BOOK}, bad AS (SELECT *, ((min(i) OVER (PARTITION BY exchange, segment)) // 40) % 5 = 0 AS wrong FROM st)
SELECT exchange, seq, CASE WHEN NOT wrong THEN 'ok' WHEN snap THEN 'resync' ELSE 'dropped' END AS status FROM bad""")
def _(s, d):
    """Snapshots declare the CRC32 of their ten best asks and bids, made here by expressions; that of every fifth is wrong."""
    t = ranges.numbered(domain.tape(s, d), ["exchange"], ["seq"], "i")
    size = F.when(F.col("size") < 10, 0.0).otherwise(F.col("size"))
    text = lambda c, scale: c.cast(f"decimal(20,{scale})").cast("string")

    def level(k, side):
        p, z = F.round("price") + k, size + k
        return F.struct(side.alias("side"), p.alias("price"), z.alias("size"), text(p, 2).alias("price_text"), text(z, 4).alias("size_text"))

    def digits(x, scale):
        found = F.ltrim(F.replace(text(x, scale), F.lit("."), F.lit("")), F.lit("0"))
        return F.when(found == "", "0").otherwise(found)

    five = [level(k, F.lit("buy" if k % 2 == 0 else "sell")) for k in range(5)]
    parts = [F.when(size + k > 0, F.concat(digits(F.round("price") + k, 2), digits(size + k, 4))).otherwise("") for k in (1, 3, 4, 2, 0)]
    snap = F.col("i") % 40 == 1
    declared = F.crc32(F.concat(*parts)) + F.when(F.floor(F.col("i") / 40) % 5 == 0, 1).otherwise(0)
    rows = t.select(
        "exchange", F.lit("m").alias("market"), "seq", F.when(snap, "snapshot").otherwise("delta").alias("kind"),
        F.when(snap, F.array(*five)).otherwise(F.array(level(0, F.col("side")))).alias("levels"), F.when(snap, declared).alias("checksum"),
    )
    return adapters.replay_books(rows, depth=10, checked=True).select("exchange", "seq", "status")


@add("sc1_scalar_math", f"WITH {TAPE} SELECT seq, round(sqrt(abs(price)), 8) AS root, sign(size - 50)::DOUBLE AS s, CASE WHEN size < 50 THEN -abs(price) ELSE abs(price) END AS signed, (ts_ms // {DAY}) % 7 AS dow, ts_ms // {HOUR} * {HOUR} AS hour_ms FROM tape")
def _(s, d):
    return domain.tape(s, d).select("seq", F.round(F.sqrt(F.abs("price")), 8).alias("root"), F.signum(F.col("size") - 50).alias("s"), q.copysign(F.col("price"), F.col("size") - 50).alias("signed"), F.pmod(F.floor(F.col("ts_ms") / DAY), F.lit(7)).cast("long").alias("dow"), (F.floor(F.col("ts_ms") / HOUR) * HOUR).cast("long").alias("hour_ms"))


@add("sc3_amm_amounts", f"WITH {TAPE}, r AS (SELECT seq, sqrt(least(greatest(price, 40), 120)) AS s FROM tape) SELECT seq, round(100 * (1 / s - 1 / sqrt(120.0::DOUBLE)), 8) AS token0, round(100 * (s - sqrt(40.0::DOUBLE)), 8) AS token1 FROM r")
def _(s, d):
    zero, one = q.amm_amounts(F.lit(100.0), F.sqrt(F.greatest("price", F.lit(0.0))), F.sqrt(F.lit(40.0)), F.sqrt(F.lit(120.0)))
    return domain.tape(s, d).select("seq", F.round(zero, 8).alias("token0"), F.round(one, 8).alias("token1"))
