import json
import os

from quotemill.operators.kernels import Ema
from quotemill.sources import sinks, tables, venues
from quotemill.streaming.stateful import stream_kernel


def test_stream_equals_batch_over_micro_batches(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    values = {"a": [1.0, 2.0, 5.0, 3.0], "b": [10.0, 0.0, 4.0, 4.0]}
    for batch in range(2):
        rows = [{"k": k, "seq": i, "x": v[i]} for k, v in values.items() for i in range(2 * batch, 2 * batch + 2)]
        (tmp_path / "in").mkdir(exist_ok=True)
        file = tmp_path / "in" / f"{batch}.json"
        file.write_text("\n".join(map(json.dumps, reversed(rows))))
        os.utime(file, (1000 + batch, 1000 + batch))  # files are taken in order of their times
    stream = spark.readStream.schema("k string, seq long, x double").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    out = stream_kernel(stream, ["k"], ("seq",), lambda: Ema(0.5), lambda k, r: {"seq": r.seq, "ema": k.step(r.x)}, "k string, seq long, ema double")
    query = out.writeStream.format("memory").queryName("emas").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = {(r.k, r.seq): r.ema for r in spark.table("emas").collect()}
    for k, v in values.items():
        e = Ema(0.5)
        assert [got[k, i] for i in range(4)] == [e.step(x) for x in v]


def test_capture_writer_is_idempotent(spark, tmp_path):
    rows = [(1, 1776384014957, 1.0, 0.1, True, [("a", 1.0)]), (2, 1776470414957, 2.0, 0.1, False, [("a", 1.0), ("b", 2.0)])]
    df = spark.createDataFrame(rows, "id long, timestamp_ms long, price double, stddev double, is_live boolean, states array<struct<exchange:string,fair_value:double>>")
    write = sinks.capture_writer(str(tmp_path))
    write(df, 0)
    write(df, 0)
    assert spark.read.parquet(f"{tmp_path}/updates").count() == 2 and spark.read.parquet(f"{tmp_path}/venue_states").count() == 3


def test_sources(spark, tmp_path):
    (tmp_path / "s.json").write_text('{"id":"1","timestamp":"5","amountUSD":"2.5","sqrtPriceX96":"79228162514264337593543950336","tick":"-3","logIndex":"7"}')
    row = tables.swaps(spark, str(tmp_path / "s.json")).first()
    assert (row.ts, row.log_index, row.sqrtPriceX96, row.tick) == (5, 7, 2.0**96, -3)
    probed = tables.with_columns_or(spark.range(1), {"id": "long", "flow": "double"}, 0.0).first()
    assert (probed.id, probed.flow) == (0, 0.0)
    assert len(venues.FEEDS["coinbase"].subscriptions("BTC-USD")) == 4 and [venues.backoff(i) for i in (0, 1, 9)] == [1.0, 2.0, 30.0]
    products = spark.createDataFrame([("XBT", "USD", "online", "x1"), ("XBT", "USDC", "online", "x2"), ("ABC", "EUR", "online", "e"), ("XDG", "USD", "halted", "h")], "base string, quote string, status string, symbol string")
    assert [tuple(r) for r in tables.product_list(products, {"USD": 0, "USDC": 1}).collect()] == [("BTC", "x1")]
