"""Best-fit packing of all documents."""

from pyspark.sql import DataFrame, SparkSession

from quotemill.llm.packing import pack_documents
from quotemill.session import load

NAME = "op8_best_fit_packing"
ORACLE_SQL = None


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(load(spark, sf_dir, "documents"), tokenizer_path(), capacity=2048)
