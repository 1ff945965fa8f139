"""The driver's tables seen as market data, and the same views in SQL.

``events`` is a tape: exchange = event_type, price = value, size = props.k, time in
epoch milliseconds, seq = event_id. Quotes put a spread around the price.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quotemill.functions import quotes as q
from quotemill.session import load
from quotemill.sources import sinks

HOUR = 3_600_000
DAY = 24 * HOUR
VENUES = ["click", "error", "purchase", "signup", "view"]

TAPE = """tape AS (
  SELECT event_id AS seq, epoch_us(ts) // 1000 AS ts_ms, event_type AS exchange, 'm' || (user_id % 3) AS market, value AS price,
         CAST(json_extract(props, '$.k') AS DOUBLE) AS size, CASE WHEN event_id % 2 = 0 THEN 'buy' ELSE 'sell' END AS side
  FROM events)"""
QUOTES = TAPE + """, quotes AS (
  SELECT *, price * (1 - d) AS bid, price * (1 + d) AS ask FROM (
    SELECT *, (1 + seq % 7) / 10000.0::DOUBLE AS d, size + 1 AS bid_size, (seq % 13 + 1)::DOUBLE AS ask_size, seq % 600 AS age_ms FROM tape))"""
MEASURES = QUOTES + """, measures AS (
  SELECT *, (bid + ask) / 2 AS mid, CASE WHEN bid + ask <> 0 THEN (ask - bid) / ((bid + ask) / 2) * 10000 END AS spread_bps,
         (ask * bid_size + bid * ask_size) / (bid_size + ask_size) AS micro, (bid_size - ask_size) / (bid_size + ask_size) AS imb, bid_size + ask_size AS depth
  FROM quotes)"""
FAIR = MEASURES + """, alphas AS (
  SELECT *, CASE WHEN spread_bps IS NULL OR spread_bps <= 0 THEN 0.0 ELSE least(1.0, greatest(0.0,
      abs(imb) * CASE WHEN spread_bps <= 1 THEN 1.0 WHEN spread_bps <= 2 THEN 0.6 WHEN spread_bps <= 5 THEN 0.25 ELSE 0.0 END::DOUBLE
      * CASE WHEN age_ms <= 100 THEN 1.0 WHEN age_ms <= 250 THEN 0.7 WHEN age_ms <= 500 THEN 0.4 ELSE 0.0 END::DOUBLE
      * CASE WHEN depth <= 0 THEN 0.5 WHEN depth < 1 THEN 0.6 WHEN depth < 5 THEN 0.8 ELSE 1.0 END::DOUBLE)) END AS alpha
  FROM measures), fair AS (
  SELECT *, mid + alpha * (micro - mid) AS fair_value,
    CASE WHEN mid > 0 THEN greatest(1e-10, greatest(pow(coalesce(spread_bps, 0) / 10000, 2), pow(1.5 / 10000, 2))
      * CASE WHEN depth * mid <= 0 THEN 10000.0 WHEN depth * mid >= 250000 THEN 1.0 ELSE pow(250000.0 / (depth * mid), 2) END
      * CASE WHEN age_ms <= 100 THEN 1.0 WHEN age_ms <= 250 THEN 1.2 WHEN age_ms <= 500 THEN 1.5 ELSE 2.0 END::DOUBLE * mid * mid) END AS variance
  FROM alphas)"""


def tape(spark: SparkSession, sf_dir: str) -> DataFrame:
    ms = "timestampdiff(MICROSECOND, timestamp_ntz '1970-01-01 00:00:00', cast(ts as timestamp_ntz)) div 1000"
    return load(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"),
        F.expr(ms).cast("long").alias("ts_ms"),
        F.col("event_type").alias("exchange"),
        F.concat(F.lit("m"), (F.col("user_id") % 3).cast("string")).alias("market"),
        F.col("value").alias("price"),
        F.get_json_object("props", "$.k").cast("double").alias("size"),
        F.when(F.col("event_id") % 2 == 0, "buy").otherwise("sell").alias("side"),
    )


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = tape(spark, sf_dir).withColumns({"d": (1 + F.col("seq") % 7) / F.lit(10000.0), "bid_size": F.col("size") + 1, "ask_size": (F.col("seq") % 13 + 1).cast("double"), "age_ms": F.col("seq") % 600})
    return df.withColumns({"bid": F.col("price") * (1 - F.col("d")), "ask": F.col("price") * (1 + F.col("d"))})


def measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, a, bs, as_ = (F.col(c) for c in ("bid", "ask", "bid_size", "ask_size"))
    return quotes(spark, sf_dir).withColumns({"mid": q.mid(b, a), "spread_bps": q.spread_bps(b, a), "micro": q.microprice(b, bs, a, as_), "imb": q.imbalance(bs, as_), "depth": bs + as_})


def fair(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, u, s, i, g, d = (F.col(c) for c in ("mid", "micro", "spread_bps", "imb", "age_ms", "depth"))
    df = measures(spark, sf_dir).withColumn("alpha", q.micro_alpha(m, u, s, i, g, d))
    none = F.lit(None).cast("double")
    return df.withColumns({"fair_value": q.raw_fair_value(m, u, F.col("alpha")), "variance": q.measurement_variance(m, s, none, none, d, g)})


def stored(spark: SparkSession, df: DataFrame) -> DataFrame:
    """Written once to the shared folder, as what follows reads it several times."""
    at = f"{sinks.shared_folder(spark)}/live-{uuid.uuid4().hex}"
    df.write.parquet(at)
    return spark.read.schema(df.schema).parquet(at)
