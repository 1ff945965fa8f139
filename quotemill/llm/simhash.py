"""SimHash near-duplicate detection by meet-in-the-middle ball hashing.

Two fingerprints within radius 2r share some word within r of both, so every
distinct fingerprint emits all words within r of it, the words are shuffled, and
whoever meets on a word is a colliding pair. Members of one word are within 2r of
each other by the triangle inequality, so a star to the least member holds every
component together without listing all pairs; each kept link is still verified.
Exact copies meet once: only distinct fingerprints emit variants.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from quotemill.llm.components import connected_components
from quotemill.llm.scratch import materialize
from quotemill.llm.words import shingle_hashes

BITS = 64
_BLOCK = 1 << 15


def fingerprint_of(hashes: np.ndarray) -> int:
    """64-bit majority of unsigned 64-bit hashes; a bit is 1 if set in over half. No hashes: 0."""
    n = len(hashes)
    if not n:
        return 0
    counts = np.zeros(BITS, dtype=np.int64)
    for i in range(0, n, _BLOCK):
        part = np.ascontiguousarray(hashes[i : i + _BLOCK])
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits((2 * counts > n).astype(np.uint8), bitorder="little").view(np.uint64)[0])


def fingerprint_column(text: Column, words: int = 3, seed: int = 42) -> Column:
    """Signed 64-bit SimHash of a text's word shingles (null text: 0)."""

    @pandas_udf("long")
    def simhash64(texts: pd.Series) -> pd.Series:
        values = [fingerprint_of(shingle_hashes(t, words, seed)) for t in texts]
        return pd.Series(np.array(values, dtype=np.uint64).view(np.int64))

    return simhash64(text)


def ball_masks(bits: int, radius: int) -> list[int]:
    """Signed 64-bit masks of all words within ``radius`` of zero."""
    masks = [sum(1 << i for i in at) for r in range(radius + 1) for at in combinations(range(bits), r)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in masks]


def fingerprint_links(fingerprints: DataFrame, radius: int = 2) -> DataFrame:
    """Verified links (a, b) that connect all fingerprints ``fp`` at most ``radius`` bits apart.

    ``radius`` must be even. Distinct fingerprints are expected; a word's ball
    bounds how many can meet on it, whatever the input.
    """
    if radius % 2:
        raise ValueError("radius must be even")
    masks = F.array(*[F.lit(m) for m in ball_masks(BITS, radius // 2)])
    variants = fingerprints.select("fp", F.explode(masks).alias("mask")).select("fp", F.col("fp").bitwiseXOR(F.col("mask")).alias("word"))
    met = variants.withColumn("least", F.min("fp").over(Window.partitionBy("word")))
    return met.where("fp <> least").select(F.col("fp").alias("a"), F.col("least").alias("b")).distinct().where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)


def near_duplicate_classes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 3, radius: int = 2) -> DataFrame:
    """One row per document: its id, ``fp`` (signed 64-bit) and ``component_id``.

    The component is the smallest id reachable over links of at most ``radius``
    differing bits. Null or empty texts have fingerprint zero and link like any
    other; repeated rows stay, each with its class; an empty table gives an empty
    result; other columns are ignored.
    """
    marked = materialize(docs.select(F.col(id_col).alias("doc_id"), fingerprint_column(F.col(text_col), words).alias("fp")), "simhash")
    distinct = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "simhash-distinct")
    classes = connected_components(fingerprint_links(distinct.select("fp"), radius))
    named = distinct.join(classes, F.col("fp") == F.col("node"), "left").select("fp", "least_id", F.coalesce("component", "fp").alias("component"))
    least = named.groupBy("component").agg(F.min("least_id").alias("component_id"))
    by_fp = named.join(least, "component").select("fp", "component_id")
    return marked.join(by_fp, "fp").select("doc_id", "fp", "component_id")
