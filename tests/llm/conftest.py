import pytest


@pytest.fixture(scope="session")
def docs_schema():
    return "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make_docs(spark, docs_schema):
    """Documents with columns whose names clash with those that operators use inside."""

    def make(texts, ids=None):
        rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in zip(ids or range(len(texts)), texts)]
        df = spark.createDataFrame(rows, docs_schema)
        for name in ("word", "flag", "part", "key", "fp", "least", "gone", "name"):
            df = df.withColumn(name, df.doc_id * 0)
        return df

    return make
