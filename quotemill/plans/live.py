"""The 40-feature frame, models on it, and live features streamed over landed events."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from quotemill.functions import quotes as q
from quotemill.operators import adapters, frames, learning
from quotemill.plans import domain, models
from quotemill.plans.book import QueryBook
from quotemill.plans.domain import DAY, HOUR, MEASURES, stored

from quotemill.sources import captures, sinks
from quotemill.streaming.drift import live_drift
from quotemill.streaming.features import live_features

book = QueryBook()
add = book.add

VENUES = ["click", "error", "purchase", "view"]
FEATURES = ["lean", "imb", "spread_bps", "depth", "size", "mid"]
LAGGED = ["imb", "mid"]
LAGS = [HOUR, 3 * HOUR]
SLICE_ROWS = 2_000_000
NAMES = frames.lagged_names(VENUES, FEATURES, LAGGED, LAGS)
MID_LAGS = [c for c in NAMES if "_mid_lag" in c]

WIDE = MEASURES + ", wide AS (SELECT *, micro - mid AS lean FROM measures)"


def _wide(s, d):
    return domain.measures(s, d).withColumn("lean", F.col("micro") - F.col("mid"))


def _frame(s, d, complete=True, of=None):
    return frames.lagged_frame(_wide(s, d), time="ts_ms", seq="seq", who="exchange", venues=VENUES, features=FEATURES, lagged=LAGGED, lags=LAGS, bucket_ms=DAY, complete=complete, of=of)


def _frame_sql():
    at = lambda v, w: f"x{w // HOUR}{v} AS (SELECT l.seq, r.ts_ms AS at, {', '.join('r.' + f for f in FEATURES)} FROM (SELECT *, ts_ms - {w} AS goal FROM wide) l ASOF JOIN (SELECT * FROM wide WHERE exchange = '{v}') r ON l.goal >= r.ts_ms)"
    shifts = [0, *LAGS]
    parts = ", ".join(at(v, w) for v in VENUES for w in shifts)
    joins = " ".join(f"JOIN x{w // HOUR}{v} USING (seq)" for v in VENUES for w in shifts)
    cols = [f"x0{v}.{f} AS {v}_{f}" for v in VENUES for f in FEATURES]
    cols += [f"x0{v}.{f} - x{w // HOUR}{v}.{f} AS {v}_{f}_lag{i}" for v in VENUES for f in LAGGED for i, w in enumerate(LAGS)]
    fresh = " AND ".join(f"wide.ts_ms - x{w // HOUR}{v}.at <= {2 * w}" for v in VENUES for w in LAGS)
    return f"{WIDE}, {parts}, frame AS (SELECT wide.seq, {', '.join(cols)} FROM wide {joins} WHERE {fresh})"


@add("ml6_feature_frame", f"WITH {_frame_sql()} SELECT seq, {', '.join(f'round({c}, 6) AS {c}' for c in NAMES)} FROM frame")
def _(s, d):
    return _frame(s, d, complete=False).select("seq", *[q.rounded(F.col(c), 6).alias(c) for c in NAMES])


def _fold_rows(s, d, features):
    """The frame of one venue's events with its drift, by folds, standardised."""
    own = models._labelled(s, d).where("exchange = 'click'").select("exchange", "seq", "drift")
    rows = learning.walk_forward(stored(s, stored(s, _frame(s, d, of="click")).join(own, "seq")), "exchange", ["seq"], 200, 100, 100)
    return stored(s, learning.standardised(rows, ["exchange", "fold"], features))


@add("ml11_frame_ridge")
def _(s, d):
    rows = _fold_rows(s, d, NAMES)
    return learning.ridge(rows, ["exchange", "fold"], NAMES, "drift", 1.0).select("exchange", "fold", "intercept", "coefficients")


def _scored(s, d):
    rows = _fold_rows(s, d, NAMES)
    return learning.predicted(rows, learning.ridge(rows, ["exchange", "fold"], NAMES, "drift", 1.0), ["exchange", "fold"], NAMES).where("is_test")


@add("ml16_frame_metrics")
def _(s, d):
    test = _scored(s, d)
    cuts = test.groupBy("exchange", "fold").agg(F.percentile(F.abs("predicted"), 0.5).alias("cut"))
    m = learning.regression_metrics(F.col("drift"), F.col("predicted"), F.abs("predicted") >= F.col("cut"))
    return test.join(cuts, ["exchange", "fold"]).groupBy("exchange", "fold").agg(*[m[k].alias(k) for k in ("r2", "direction", "confident_direction", "n")])


@add("ml21_frame_gate")
def _(s, d):
    m = learning.regression_metrics(F.col("drift"), F.col("predicted"))
    found = _scored(s, d).groupBy("exchange").agg(m["r2"].alias("r2"), m["direction"].alias("direction"), m["n"].alias("n"))
    return found.withColumn("passes", (F.col("r2") >= 0.0) & (F.col("direction") >= 0.5))


#: Two features and the normal equations written out.
_FROZEN = models.FEAT + """, lab AS (SELECT seq, exchange, size AS a, imb AS b, next_mid - mid AS y FROM feats WHERE next_mid IS NOT NULL),
 t AS (SELECT *, row_number() OVER (PARTITION BY exchange ORDER BY seq) > floor(count(*) OVER (PARTITION BY exchange) * 0.7) AS later FROM lab),
 m AS (SELECT exchange, avg(a) AS ma, avg(b) AS mb, avg(y) AS my, count(*) AS n FROM t WHERE NOT later GROUP BY 1),
 c AS (SELECT exchange, sum(pow(a - ma, 2)) + 1 AS aa, sum(pow(b - mb, 2)) + 1 AS bb, sum((a - ma) * (b - mb)) AS ab, sum((a - ma) * (y - my)) AS ay, sum((b - mb) * (y - my)) AS by_ FROM t JOIN m USING (exchange) WHERE NOT later GROUP BY 1),
 w AS (SELECT exchange, (bb * ay - ab * by_) / (aa * bb - ab * ab) AS wa, (aa * by_ - ab * ay) / (aa * bb - ab * ab) AS wb FROM c)"""


@add("ml29_frozen_replay", f"WITH {_FROZEN} SELECT seq, round(my + wa * (a - ma) + wb * (b - mb), 6) AS predicted FROM t JOIN m USING (exchange) JOIN w USING (exchange) WHERE later")
def _(s, d):
    rows = learning.temporal_split(models._labelled(s, d), "exchange", ["seq"], 0.7)
    frozen = stored(s, learning.ridge(rows, ["exchange"], ["size", "imb"], "drift", 1.0))
    return learning.predicted(rows.where("is_test"), frozen, ["exchange"], ["size", "imb"]).select("seq", F.round("predicted", 6).alias("predicted"))


def _live_sql():
    latest = ", ".join(f"last_value(CASE WHEN exchange = '{v}' THEN seq END IGNORE NULLS) OVER o AS {v}_seq" for v in VENUES[1:])
    past = lambda v, w: f"p{w // HOUR}{v} AS (SELECT l.seq, {', '.join('r.' + f for f in LAGGED)} FROM (SELECT *, ts_ms - {w} AS goal FROM own) l ASOF JOIN (SELECT * FROM latest_at WHERE exchange = '{v}') r ON l.market = r.market AND l.goal >= r.ts_ms WHERE l.goal - r.ts_ms <= {2 * w})"
    joins = " ".join(f"JOIN wide {v} ON {v}.seq = own.{v}_seq" for v in VENUES[1:]) + " " + " ".join(f"JOIN p{w // HOUR}{v} ON p{w // HOUR}{v}.seq = own.seq" for v in VENUES for w in LAGS)
    now = lambda v: "own" if v == VENUES[0] else v
    cols = [f"round({now(v)}.{f}, 6) AS {v}_{f}" for v in VENUES for f in FEATURES]
    cols += [f"round({now(v)}.{f} - p{w // HOUR}{v}.{f}, 6) AS {v}_{f}_lag{i}" for v in VENUES for f in LAGGED for i, w in enumerate(LAGS)]
    return f"""WITH {WIDE}, seen AS (SELECT *, {latest} FROM wide WINDOW o AS (PARTITION BY market ORDER BY ts_ms, seq ROWS UNBOUNDED PRECEDING)),
 own AS (SELECT * FROM seen WHERE exchange = '{VENUES[0]}'), latest_at AS (SELECT * FROM wide QUALIFY row_number() OVER (PARTITION BY market, exchange, ts_ms ORDER BY seq DESC) = 1),
 {", ".join(past(v, w) for v in VENUES for w in LAGS)} SELECT own.market, own.seq, {", ".join(cols)} FROM own {joins}"""


def _landed(s, rows):
    """Stored ``rows`` as a stream over files that land in slices of time, a micro-batch each; and a folder for what comes out.

    One pass deals the rows to slices, and each slice then lands from its own folder, so
    the work grows with the rows, not with rows times slices.
    """
    at = f"{sinks.shared_folder(s)}/live-{uuid.uuid4().hex}"
    slices = max(4, -(-rows.count() // SLICE_ROWS))
    cuts = rows.agg(F.percentile_approx("ts_ms", [i / slices for i in range(1, slices)], 10_000)).first()[0] or []  # a number for each slice
    cuts = sorted(set(cuts))
    place = F.size(F.filter(F.array(*[F.lit(c).cast("long") for c in cuts]), lambda c: c < F.col("ts_ms")))
    rows.where("ts_ms is not null").withColumn("slice", place).repartition("slice").write.partitionBy("slice").parquet(f"{at}/dealt")
    for i in range(len(cuts) + 1):
        part = s.read.schema(StructType([*rows.schema, StructField("slice", IntegerType())])).parquet(f"{at}/dealt").where(F.col("slice") == i)
        part.drop("slice").coalesce(1).write.mode("append").parquet(f"{at}/landed")  # a file, and so a micro-batch, of bounded size
    s.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return s.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{at}/landed"), at


def _drained(s, out, at):
    """What the stream has made of all that has landed."""
    # a state store and a worker for every partition and micro-batch, for a few keys: no more partitions than cores
    name = "spark.sql.shuffle.partitions"
    before = s.conf.get(name)
    s.conf.set(name, min(int(before), s.sparkContext.defaultParallelism))
    try:
        query = out.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        s.conf.set(name, before)
    return s.read.schema(out.schema).parquet(f"{at}/out")


@add("ml30_live_features", _live_sql())
def _(s, d):
    rows = stored(s, _wide(s, d).where(F.col("exchange").isin(VENUES)).select("market", "exchange", "ts_ms", "seq", *FEATURES))
    stream, at = _landed(s, rows)
    out = live_features(stream, "market", venues=VENUES, features=FEATURES, lagged=LAGGED, lags=LAGS, names=NAMES)
    return _drained(s, out, at).select("market", "seq", *[F.round(c, 6).alias(c) for c in NAMES])


@add("pipe4_live_drift")
def _(s, d):
    """Coefficients calibrated on each venue's first events, then predictions on the stream of the rest, learning as outcomes come due."""
    rows = stored(s, models._labelled(s, d).select("exchange", "ts_ms", "seq", "mid", "drift", *models.FEATURES))
    fitted = adapters.calibrated(rows, "exchange", ["seq"], models.FEATURES, "drift", warm=0.3, time="ts_ms")
    stream, at = _landed(s, rows.drop("drift"))
    out = live_drift(stream, "exchange", fitted, features=models.FEATURES, price="mid", horizon_ms=HOUR)
    return _drained(s, out, at).select("exchange", "seq", F.round("predicted", 6).alias("predicted"))


@add("src9_capture_scan", f"WITH {domain.TAPE} SELECT exchange, count(*) AS n, round(sum(size), 4) AS size, min(seq) AS first_seq FROM tape WHERE size >= 20 AND exchange <> 'view' GROUP BY 1")
def _(s, d):
    """The tape in capture files, scanned by ranges of rowid with the condition inside."""
    at = f"{sinks.shared_folder(s)}/live-{uuid.uuid4().hex}"
    captures.write_captures(domain.tape(s, d).select("seq", "exchange", "price", "size"), at, "trades")
    rows = captures.read_capture(s, at, "trades", "seq long, exchange string, price double, size double", where="size >= 20 AND exchange <> 'view'", range_rows=20_000)
    return rows.groupBy("exchange").agg(F.count("*").alias("n"), F.round(F.sum("size"), 4).alias("size"), F.min("seq").alias("first_seq"))


@add("ml26_toxic_classifier")
def _(s, d):
    """Balanced logistic scores of toxic flow, learned on the first 70 %; what gating by them leaves of the rest, with a perfect gate beside it."""
    rows = models._labelled(s, d).select("exchange", "seq", *models.FEATURES, (F.col("size") * 0.05).alias("fee"), F.greatest(-F.col("drift"), F.lit(0.0)).alias("loss"))
    rows = stored(s, learning.temporal_split(rows, "exchange", ["seq"], 0.7))
    cut = rows.where("not is_test").agg(F.percentile("loss", 0.95).alias("cut"))  # one row
    rows = rows.crossJoin(F.broadcast(cut)).withColumn("toxic", (F.col("loss") >= F.col("cut")).cast("int"))
    scored = learning.logistic(rows, models.FEATURES, "toxic", balanced=True).where("is_test").select("exchange", "seq", "probability", "fee", "loss", "toxic")
    scored = stored(s, scored)
    gated = learning.gated_value(scored, ["exchange"], "probability", "fee", "loss", ["seq"], 0.1)
    return gated.join(learning.auc(scored, ["exchange"], "probability", "toxic"), "exchange")
