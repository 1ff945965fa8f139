"""Temporal and key joins over the tape."""

from __future__ import annotations

from pyspark.sql import functions as F

from quotemill.operators import align
from quotemill.plans import domain
from quotemill.plans.book import QueryBook
from quotemill.plans.domain import DAY, HOUR, TAPE
from quotemill.session import load

book = QueryBook()
add = book.add


def _sides(s, d):
    t = domain.tape(s, d).select("seq", "ts_ms", "exchange", "price")
    return t.where("exchange = 'purchase'"), t.where("exchange = 'click'")


SIDES = TAPE + ", l AS (SELECT * FROM tape WHERE exchange = 'purchase'), r AS (SELECT * FROM tape WHERE exchange = 'click')"
PICK = "l.seq, r.ts_ms AS r_ts_ms, r.price AS r_price"


@add("jn1_asof_backward", f"WITH {SIDES} SELECT {PICK} FROM l ASOF LEFT JOIN r ON l.ts_ms >= r.ts_ms")
def _(s, d):
    l, r = _sides(s, d)
    return align.asof_backward(l, r, keys=[], time="ts_ms", seq="seq", values=["price"], bucket_ms=DAY).select("seq", "r_ts_ms", "r_price")


@add("jn1_asof_backward_bucketed", f"WITH {SIDES} SELECT {PICK} FROM l ASOF LEFT JOIN r ON l.ts_ms >= r.ts_ms")
def _(s, d):
    l, r = _sides(s, d)
    return align.asof_backward(l, r, keys=[], time="ts_ms", seq="seq", values=["price"], bucket_ms=6 * HOUR).select("seq", "r_ts_ms", "r_price")


FORWARD = f"WITH {TAPE}, l AS (SELECT *, ts_ms + {HOUR} AS goal FROM tape) SELECT l.seq, r.ts_ms AS r_ts_ms, r.price AS r_price FROM l ASOF LEFT JOIN tape r ON l.exchange = r.exchange AND l.goal <= r.ts_ms"


@add("jn2_asof_forward", FORWARD)
def _(s, d):
    t = domain.tape(s, d)
    return align.asof_forward(t, t, keys=["exchange"], time="ts_ms", seq="seq", values=["price"], ahead=HOUR, bucket_ms=DAY).select("seq", "r_ts_ms", "r_price")


@add("jn3_asof_tolerance", f"WITH {SIDES} SELECT l.seq, CASE WHEN l.ts_ms - r.ts_ms <= {HOUR} THEN r.price END AS r_price FROM l ASOF LEFT JOIN r ON l.ts_ms >= r.ts_ms")
def _(s, d):
    l, r = _sides(s, d)
    return align.asof_backward(l, r, keys=[], time="ts_ms", seq="seq", values=["price"], tolerance=HOUR, bucket_ms=DAY).select("seq", "r_price")


@add("jn4_asof_lagged", f"WITH {TAPE}, l AS (SELECT *, ts_ms - {HOUR} AS goal FROM tape) SELECT l.seq, CASE WHEN l.ts_ms - r.ts_ms <= {2 * HOUR} THEN r.price END AS r_price FROM l ASOF LEFT JOIN tape r ON l.exchange = r.exchange AND l.goal >= r.ts_ms")
def _(s, d):
    t = domain.tape(s, d)
    df = align.asof_backward(t, t, keys=["exchange"], time="ts_ms", seq="seq", values=["price"], lag=HOUR, bucket_ms=DAY)
    return df.select("seq", F.when(F.col("ts_ms") - F.col("r_ts_ms") <= 2 * HOUR, F.col("r_price")).alias("r_price"))


@add("jn5_asof_forward_where_target", f"WITH {TAPE}, g AS (SELECT * FROM tape WHERE size >= 50), l AS (SELECT *, ts_ms + {HOUR} AS goal FROM tape) SELECT l.seq, r.price AS r_price FROM l ASOF LEFT JOIN g r ON l.exchange = r.exchange AND l.goal <= r.ts_ms")
def _(s, d):
    t = domain.tape(s, d)
    return align.asof_forward(t, t.where("size >= 50"), keys=["exchange"], time="ts_ms", seq="seq", values=["price"], ahead=HOUR, bucket_ms=DAY).select("seq", "r_price")


@add("jn6_asof_first_duplicate", f"WITH {SIDES}, u AS (SELECT ts_ms // {HOUR} * {HOUR} AS h, arg_min(price, seq) AS price FROM r GROUP BY 1) SELECT l.seq, CASE WHEN l.ts_ms - u.h <= {2 * HOUR} THEN u.price END AS r_price FROM l ASOF LEFT JOIN u ON l.ts_ms >= u.h")
def _(s, d):
    l, r = _sides(s, d)
    first = r.groupBy((F.floor(F.col("ts_ms") / HOUR) * HOUR).cast("long").alias("ts_ms")).agg(F.min_by("price", "seq").alias("price"), F.min("seq").alias("seq"))
    return align.asof_backward(l, first, keys=[], time="ts_ms", seq="seq", values=["price"], tolerance=2 * HOUR, bucket_ms=DAY).select("seq", "r_price")


@add("jn7_asof_default_zero", f"WITH {SIDES} SELECT l.seq, coalesce(r.price, 0.0) AS r_price FROM l ASOF LEFT JOIN r ON l.ts_ms >= r.ts_ms")
def _(s, d):
    l, r = _sides(s, d)
    return align.asof_backward(l, r, keys=[], time="ts_ms", seq="seq", values=["price"], bucket_ms=DAY).select("seq", F.coalesce("r_price", F.lit(0.0)).alias("r_price"))


NEAR = f"WITH {SIDES}, p AS (SELECT l.seq, l.ts_ms, r.ts_ms AS pt, r.price AS pp FROM l ASOF LEFT JOIN r ON l.ts_ms >= r.ts_ms), n AS (SELECT l.seq, r.ts_ms AS nt, r.price AS np FROM l ASOF LEFT JOIN r ON l.ts_ms <= r.ts_ms), b AS (SELECT seq, CASE WHEN nt IS NULL OR ts_ms - pt <= nt - ts_ms THEN pp ELSE np END AS price, CASE WHEN nt IS NULL OR ts_ms - pt <= nt - ts_ms THEN ts_ms - pt ELSE nt - ts_ms END AS gap FROM p JOIN n USING (seq))"


@add("jn8_nearest_tolerance", f"{NEAR} SELECT seq, CASE WHEN gap <= {HOUR} THEN price END AS r_price FROM b")
def _(s, d):
    l, r = _sides(s, d)
    return align.nearest(l, r, keys=[], time="ts_ms", seq="seq", values=["price"], tolerance=HOUR, bucket_ms=DAY).select("seq", "r_price")


@add("jn9_nearest", f"{NEAR} SELECT seq, price AS r_price FROM b")
def _(s, d):
    l, r = _sides(s, d)
    return align.nearest(l, r, keys=[], time="ts_ms", seq="seq", values=["price"], bucket_ms=DAY).select("seq", "r_price")


@add("jn10_forward_clipped", f"WITH {SIDES}, z AS (SELECT arg_max(price, ts_ms) AS price FROM r) SELECT l.seq, coalesce(r.price, z.price) AS r_price FROM l ASOF LEFT JOIN r ON l.ts_ms <= r.ts_ms CROSS JOIN z")
def _(s, d):
    l, r = _sides(s, d)
    return align.asof_forward(l, r, keys=[], time="ts_ms", seq="seq", values=["price"], clip=True, bucket_ms=DAY).select("seq", "r_price")


@add("jn11_nearest_at_end", f"{NEAR} SELECT max(seq) AS seq, arg_max(price, seq) AS r_price FROM b")
def _(s, d):
    l, r = _sides(s, d)
    near = align.nearest(l, r, keys=[], time="ts_ms", seq="seq", values=["price"], bucket_ms=DAY)
    return near.agg(F.max("seq").alias("seq"), F.max_by("r_price", "seq").alias("r_price"))


def _hourly(s, d, who, unit=6 * HOUR):
    t = domain.tape(s, d).where(F.col("exchange") == who)
    return t.groupBy(F.floor(F.col("ts_ms") / unit).cast("long").alias("hour")).agg(F.max_by("price", "seq").alias(f"p_{who}"))


HOURLY = TAPE + f", h AS (SELECT exchange, ts_ms // {6 * HOUR} AS hour, arg_max(price, seq) AS p FROM tape GROUP BY 1, 2)"


@add("jn12_hour_intersection", f"WITH {HOURLY} SELECT a.hour, a.p AS p_click, b.p AS p_view FROM h a JOIN h b ON a.hour = b.hour WHERE a.exchange = 'click' AND b.exchange = 'view'")
def _(s, d):
    return _hourly(s, d, "click").join(_hourly(s, d, "view"), "hour")


@add("jn13_exact_lookup_last_wins", f"WITH {TAPE}, p AS (SELECT user_id AS k, arg_max(value, event_id) AS v FROM events GROUP BY 1) SELECT o_orderkey, p.v AS predicted FROM orders LEFT JOIN p ON o_custkey = p.k")
def _(s, d):
    p = load(s, d, "events").groupBy(F.col("user_id").alias("k")).agg(F.max_by("value", "event_id").alias("predicted"))
    return load(s, d, "orders").join(p, F.col("o_custkey") == F.col("k"), "left").select("o_orderkey", "predicted")


@add("jn14_interval_join", f"WITH {HOURLY}, t AS (SELECT seq, ts_ms // {6 * HOUR} AS a, ts_ms // {6 * HOUR} + 1 + seq % 4 AS z FROM tape WHERE exchange = 'purchase'), e AS (SELECT seq, unnest(generate_series(a + 1, z)) AS hour FROM t) SELECT e.seq, round(coalesce(sum(h.p), 0), 6) AS funding, count(h.p) AS n FROM e LEFT JOIN h ON h.hour = e.hour AND h.exchange = 'click' GROUP BY e.seq")
def _(s, d):
    t = domain.tape(s, d).where("exchange = 'purchase'").withColumn("a", F.floor(F.col("ts_ms") / (6 * HOUR)).cast("long"))
    e = t.select("seq", F.explode(F.sequence(F.col("a") + 1, F.col("a") + 1 + F.col("seq") % 4)).alias("hour"))
    return e.join(_hourly(s, d, "click"), "hour", "left").groupBy("seq").agg(F.round(F.coalesce(F.sum("p_click"), F.lit(0.0)), 6).alias("funding"), F.count("p_click").alias("n"))


@add("jn15_catalog_join_by_priority", "WITH c AS (SELECT c_nationkey AS k, arg_min(c_custkey, (CASE c_mktsegment WHEN 'BUILDING' THEN 0 WHEN 'MACHINERY' THEN 1 ELSE 2 END, c_custkey)) AS cust FROM customer GROUP BY 1), p AS (SELECT s_nationkey AS k, min(s_suppkey) AS supp FROM supplier GROUP BY 1) SELECT c.k, cust, supp FROM c JOIN p ON c.k = p.k WHERE c.k NOT IN (0, 1)")
def _(s, d):
    rank = F.when(F.col("c_mktsegment") == "BUILDING", 0).when(F.col("c_mktsegment") == "MACHINERY", 1).otherwise(2)
    c = load(s, d, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.min_by("c_custkey", F.struct(rank, "c_custkey")).alias("cust"))
    p = load(s, d, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.min("s_suppkey").alias("supp"))
    return c.join(p, "k").where(~F.col("k").isin(0, 1)).select("k", "cust", "supp")


@add("jn16_parameter_grid", f"WITH {TAPE}, g AS (SELECT * FROM (VALUES (1.0, 0.0), (1.0, 0.5), (2.0, 0.0), (2.0, 0.5)) v(half_spread, skew)) SELECT half_spread::DOUBLE AS half_spread, skew::DOUBLE AS skew, exchange, round(avg(price - half_spread - skew * size), 6) AS bid FROM tape CROSS JOIN g GROUP BY ALL")
def _(s, d):
    grid = s.createDataFrame([(a, b) for a in (1.0, 2.0) for b in (0.0, 0.5)], "half_spread double, skew double")  # fixed, four rows
    df = domain.tape(s, d).crossJoin(F.broadcast(grid))
    return df.groupBy("half_spread", "skew", "exchange").agg(F.round(F.avg(F.col("price") - F.col("half_spread") - F.col("skew") * F.col("size")), 6).alias("bid"))


@add("jn17_ordered_venue_pairs", f"WITH {TAPE}, v AS (SELECT DISTINCT exchange AS e FROM tape) SELECT a.e AS leader, b.e AS follower FROM v a JOIN v b ON a.e <> b.e")
def _(s, d):
    v = domain.tape(s, d).select("exchange").distinct()
    return v.select(F.col("exchange").alias("leader")).join(v.select(F.col("exchange").alias("follower")), F.col("leader") != F.col("follower"))


@add("jn18_trade_flow_default", f"WITH {TAPE}, f AS (SELECT exchange, sum(CASE side WHEN 'buy' THEN size ELSE -size END) AS net, count(*) AS n FROM tape WHERE size > 60 GROUP BY 1) SELECT t.exchange, coalesce(net, 0.0) AS net, coalesce(n, 0) AS n FROM (SELECT DISTINCT exchange FROM tape) t LEFT JOIN f USING (exchange)")
def _(s, d):
    t = domain.tape(s, d)
    f = t.where("size > 60").groupBy("exchange").agg(F.sum(F.when(F.col("side") == "buy", F.col("size")).otherwise(-F.col("size"))).alias("net"), F.count("*").alias("n"))
    return t.select("exchange").distinct().join(f, "exchange", "left").select("exchange", F.coalesce("net", F.lit(0.0)).alias("net"), F.coalesce("n", F.lit(0)).alias("n"))


@add("jn19_exit_tick", f"WITH {SIDES}, g AS (SELECT *, ts_ms + {6 * HOUR} AS goal FROM l) SELECT g.seq, r.seq AS exit_seq FROM g ASOF JOIN l r ON g.goal <= r.ts_ms")
def _(s, d):
    l, _ = _sides(s, d)
    df = align.asof_forward(l, l.withColumn("exit_seq", F.col("seq")), keys=[], time="ts_ms", seq="seq", values=["exit_seq"], ahead=6 * HOUR, prefix="r_", bucket_ms=DAY)
    return df.where("r_exit_seq is not null").select("seq", F.col("r_exit_seq").alias("exit_seq"))


@add("jn20_feature_target_pairs", f"WITH {TAPE}, l AS (SELECT *, ts_ms + {HOUR} AS goal FROM tape), j AS (SELECT l.exchange, l.seq, l.size, r.price - l.price AS drift FROM l ASOF JOIN tape r ON l.exchange = r.exchange AND l.goal <= r.ts_ms WHERE r.ts_ms - l.goal <= {2 * HOUR}) SELECT seq, size, round(drift, 6) AS drift FROM j QUALIFY count(*) OVER (PARTITION BY exchange) >= 50")
def _(s, d):
    t = domain.tape(s, d)
    df = align.asof_forward(t, t, keys=["exchange"], time="ts_ms", seq="seq", values=["price"], ahead=HOUR, tolerance=2 * HOUR, bucket_ms=DAY).where("r_price is not null")
    counts = df.groupBy("exchange").agg(F.count("*").alias("n")).where("n >= 50")
    return df.join(counts, "exchange").select("seq", "size", F.round(F.col("r_price") - F.col("price"), 6).alias("drift"))
