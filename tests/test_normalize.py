"""Messages are parsed once for a row, however often what is parsed is read."""

import pytest

import __spark_entry__


@pytest.mark.parametrize("name", ["nrm4_hyperliquid_books", "nrm8_coinbase_books", "nrm11_kraken_books", "nrm14_okx_books"])
def test_books_parse_each_message_once(spark, name):
    df = __spark_entry__.queries()[name](spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lower().count("from_json(") + plan.lower().count("jsontostructs(") == 1
