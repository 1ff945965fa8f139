"""Relational, set and sort operators over the relational tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quotemill.operators import ranges
from quotemill.operators import windows as w
from quotemill.plans import domain
from quotemill.plans.book import QueryBook
from quotemill.session import load

book = QueryBook()
add = book.add
OL = "lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey"


def _ol(s, d):
    return load(s, d, "lineitem").join(load(s, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))


@add("rel1_inner_join", f"SELECT l_orderkey, l_linenumber, o_custkey, round(l_extendedprice, 4) AS price FROM {OL}")
def _(s, d):
    return _ol(s, d).select("l_orderkey", "l_linenumber", "o_custkey", F.round("l_extendedprice", 4).alias("price"))


@add("rel2_left_join_then_not_null", f"SELECT l_orderkey, l_linenumber, s_name FROM {OL} LEFT JOIN supplier s ON l.l_suppkey = s.s_suppkey AND s.s_acctbal > 0 WHERE s.s_suppkey IS NOT NULL")
def _(s, d):
    rich = load(s, d, "supplier").where("s_acctbal > 0")
    return _ol(s, d).join(rich, F.col("l_suppkey") == F.col("s_suppkey"), "left").where("s_suppkey is not null").select("l_orderkey", "l_linenumber", "s_name")


@add("rel3_three_way_inner", f"SELECT l_orderkey, l_linenumber, s_name, o_orderstatus FROM {OL} JOIN supplier s ON l.l_suppkey = s.s_suppkey WHERE l_quantity > 45")
def _(s, d):
    return _ol(s, d).where("l_quantity > 45").join(load(s, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).select("l_orderkey", "l_linenumber", "s_name", "o_orderstatus")


@add("rel4_left_join_literal_on", "SELECT c_custkey, n_name FROM customer c LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey AND n.n_regionkey = 1")
def _(s, d):
    one = load(s, d, "nation").where("n_regionkey = 1")
    return load(s, d, "customer").join(one, F.col("c_nationkey") == F.col("n_nationkey"), "left").select("c_custkey", "n_name")


@add("rel5_projection_expressions", "SELECT l_orderkey, l_linenumber, round(coalesce(l_discount, 0) + l_tax, 6) AS both, round(l_extendedprice * (1 - l_discount), 4) AS net FROM lineitem")
def _(s, d):
    return load(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(F.coalesce("l_discount", F.lit(0.0)) + F.col("l_tax"), 6).alias("both"), F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")), 4).alias("net"))


@add("rel6_predicates", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag IS NOT NULL AND l_linestatus = 'O' AND l_quantity <= 10 AND l_linenumber <> 1")
def _(s, d):
    return load(s, d, "lineitem").where("l_returnflag is not null and l_linestatus = 'O' and l_quantity <= 10 and l_linenumber <> 1").select("l_orderkey", "l_linenumber")


@add("rel7_order_by", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS place FROM orders")
def _(s, d):
    by = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return load(s, d, "orders").select("o_orderkey", F.row_number().over(by).cast("long").alias("place"))


@add("rel8_pivot", "SELECT o_custkey, " + ", ".join(f"count(*) FILTER (o_orderstatus = '{x}') AS n_{x.lower()}" for x in "FOP") + " FROM orders GROUP BY o_custkey")
def _(s, d):
    return load(s, d, "orders").groupBy("o_custkey").agg(*[F.count_if(F.col("o_orderstatus") == x).alias(f"n_{x.lower()}") for x in "FOP"])


@add("rel9_partitioned_scan", f"WITH {domain.TAPE} SELECT exchange, count(*) AS n, min(ts_ms) AS first_ms, max(ts_ms) AS last_ms FROM tape GROUP BY exchange")
def _(s, d):
    return domain.tape(s, d).groupBy("exchange").agg(F.count("*").alias("n"), F.min("ts_ms").alias("first_ms"), F.max("ts_ms").alias("last_ms"))


@add("rel10_min_rows_gate", "SELECT o_orderkey, o_custkey FROM orders QUALIFY count(*) OVER (PARTITION BY o_custkey) >= 10")
def _(s, d):
    return load(s, d, "orders").withColumn("n", F.count("*").over(Window.partitionBy("o_custkey"))).where("n >= 10").select("o_orderkey", "o_custkey")


@add("set1_union_all", "SELECT s_nationkey AS nation, 'supplier' AS kind FROM supplier UNION ALL SELECT c_nationkey, 'customer' FROM customer")
def _(s, d):
    a = load(s, d, "supplier").select(F.col("s_nationkey").alias("nation"), F.lit("supplier").alias("kind"))
    return a.unionByName(load(s, d, "customer").select(F.col("c_nationkey").alias("nation"), F.lit("customer").alias("kind")))


@add("set2_intersection", "SELECT s_nationkey AS nation FROM supplier INTERSECT SELECT c_nationkey FROM customer")
def _(s, d):
    return load(s, d, "supplier").select(F.col("s_nationkey").alias("nation")).intersect(load(s, d, "customer").select("c_nationkey"))


@add("set3_difference", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 7 = 0)")
def _(s, d):
    return load(s, d, "customer").select("c_custkey").join(load(s, d, "orders").where("o_orderkey % 7 = 0"), F.col("c_custkey") == F.col("o_custkey"), "left_anti")


@add("set4_dedupe_last_wins", "SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey FROM orders GROUP BY o_custkey")
def _(s, d):
    return load(s, d, "orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("o_orderkey"))


@add("srt1_full_sort", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey")
def _(s, d):
    return load(s, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey")


@add("srt2_top_fraction", "SELECT l_returnflag, l_orderkey, l_linenumber FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) <= greatest(1, floor(count(*) OVER (PARTITION BY l_returnflag) * 0.05))")
def _(s, d):
    df = load(s, d, "lineitem").select("l_returnflag", "l_orderkey", "l_linenumber", "l_extendedprice")
    return ranges.top_share(df, ["l_returnflag"], "l_extendedprice", ["l_orderkey", "l_linenumber"], 0.05, width=100.0).drop("l_extendedprice")


@add("srt3_top_by_magnitude", "SELECT p_brand, round(avg(p_retailprice - 1500), 4) AS coef FROM part GROUP BY p_brand ORDER BY abs(avg(p_retailprice - 1500)) DESC, p_brand LIMIT 10")
def _(s, d):
    df = load(s, d, "part").groupBy("p_brand").agg(F.avg(F.col("p_retailprice") - 1500).alias("c"))
    return df.orderBy(F.abs("c").desc(), "p_brand").limit(10).select("p_brand", F.round("c", 4).alias("coef"))


@add("srt4_limit", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 25")
def _(s, d):
    return load(s, d, "orders").select("o_orderkey").orderBy("o_orderkey").limit(25)


@add("srt5_even_downsample", f"WITH {domain.TAPE}, r AS (SELECT *, row_number() OVER (PARTITION BY exchange ORDER BY seq) - 1 AS i, count(*) OVER (PARTITION BY exchange) AS n FROM tape) SELECT exchange, seq FROM r WHERE n <= 50 OR (floor(ceil(i * 50 / n) * n / 50) = i AND ceil(i * 50 / n) < 50)")
def _(s, d):
    return w.downsample(domain.tape(s, d), ["exchange"], ["seq"], 50).select("exchange", "seq")


@add("srt6_skip_first", f"WITH {domain.TAPE} SELECT exchange, seq FROM tape QUALIFY row_number() OVER (PARTITION BY exchange ORDER BY seq) > 10")
def _(s, d):
    return w.skip_first(domain.tape(s, d), ["exchange"], ["seq"], 10).select("exchange", "seq")
