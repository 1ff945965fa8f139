"""Two sampled segmentations of every document."""

from pyspark.sql import DataFrame, SparkSession

from quotemill.llm.queries.op8 import tokenizer_path
from quotemill.llm.sentencepiece_sampling import encode_documents
from quotemill.session import load

NAME = "op7_sentencepiece_sampling"
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(load(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"), k=2, digest=True)
