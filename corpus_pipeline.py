"""The corpus pipeline: five stages over ``documents``, each the next one's input."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quotemill.llm.idfilter import may_contain
from quotemill.llm.lines import dedup_lines
from quotemill.llm.mil import quality_score, train
from quotemill.llm.packing import pack_documents
from quotemill.llm.queries.op8 import tokenizer_path
from quotemill.llm.recompress import remove_repeats
from quotemill.llm.scratch import drop, materialize, prepare, release_stored, scope, served, written_at
from quotemill.llm.similar import similar_classes
from quotemill.session import load, with_worker_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
THRESHOLD = 0.3


def _shaped(docs: DataFrame) -> DataFrame:
    """The columns of documents, with characters counted anew."""
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores below the threshold go."""
    model = train(docs, load(with_worker_path(prepare(spark)), sf_dir, "labels"))
    return docs.select(*COLUMNS).where(quality_score(model, F.col("text")) >= THRESHOLD)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of like lines the first stays."""
    prepare(spark)
    return _shaped(dedup_lines(docs, extra=("lang", "source")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the first document by id stays; rows without an id stay.

    Links are those of op10 (SimHash balls, two bits) and shingle sets of a similarity of 0.8.
    """
    with_worker_path(prepare(spark))
    classes = similar_classes(docs, words=5, similarity=0.8, radius=2)
    gone = materialize(classes.where("not keep").select("doc_id", "row").distinct(), "near-gone")
    own = docs.select(*COLUMNS)
    maybe = may_contain(gone, "doc_id")(F.col("doc_id"))
    kept = own.where(maybe).withColumn("row", F.xxhash64("text")).join(gone, ["doc_id", "row"], "left_anti")
    return own.where(~maybe).unionAll(kept.select(*COLUMNS))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Runs of 50 words or more stay in the document with the least id only."""
    with_worker_path(prepare(spark))
    return _shaped(remove_repeats(docs, window=50, extra=("lang", "source")))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all remaining documents and their places in sequences."""
    with_worker_path(prepare(spark))
    return pack_documents(docs, tokenizer_path(), capacity=2048)


_ORDER = (quality, line_dedup, near_dedup, substring_dedup, packing)


def _staged(place: int) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """The stage as a function of its own.

    What it returns reads tables in the shared folder. They go when the next stage is
    given a table that was written after this one returned: its result is stored then.
    Results that no later stage follows keep their tables.
    """

    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if place:
            release_stored(spark, _ORDER[place - 1].__name__, written_at(docs))
        with scope() as paths:
            out = _ORDER[place](spark, docs, sf_dir)
        served(spark, _ORDER[place].__name__, paths)
        return out

    return run_stage


STAGES = [(f.__name__, _staged(i)) for i, f in enumerate(_ORDER)]

#: No stage's learning, fingerprints or tokens can be put in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; a stage's tables, and its input, go as soon as its output is stored."""
    docs, before = load(spark, sf_dir, "documents"), []
    for stage in _ORDER[:-1]:
        with scope() as paths:
            kept = stage(spark, docs, sf_dir)
        with scope() as stored:
            docs = materialize(kept, f"stage-{stage.__name__}")
        for path in (*paths, *before):
            drop(spark, path)
        before = stored
    return _ORDER[-1](spark, docs, sf_dir)
