"""Document fingerprints from a homomorphic multiset hash of paragraphs.

A paragraph hashes to a wide vector of 32-bit lanes; a document's fingerprint is
the sum of its paragraphs' vectors modulo 2**32. So order does not matter, and a
paragraph is inserted or deleted by adding or subtracting its vector. The first
lanes are uniform (equality); the others are a signed sketch of the paragraph's
character grams, whose scalar products estimate how much two documents share.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from quotemill.llm import rowids

LANES = 16  # uniform lanes, 512 bits
SKETCH = 128
GRAM = 6
_BLOCK = 1 << 18


def _grams(codes: np.ndarray, gram: int, width: int) -> np.ndarray:
    """Signed sketch of the grams of one text, none of them across a line break."""
    out = np.zeros(width, dtype=np.int64)
    for at in range(0, len(codes), _BLOCK):
        part = codes[at : at + _BLOCK + gram - 1]
        n = len(part) - gram + 1
        if n <= 0:
            break
        h = np.zeros(n, dtype=np.uint32)
        for i in range(gram):
            h = h * np.uint32(0x01000193) + part[i : i + n]
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x85EBCA6B)
        h ^= h >> np.uint32(13)
        breaks = np.flatnonzero(part == 10)
        if len(breaks):
            inside = np.ones(n, dtype=bool)
            for i in range(gram):
                b = breaks - i
                inside[b[(b >= 0) & (b < n)]] = False
            h = h[inside]
        lane = np.bincount(h % np.uint32(2 * width), minlength=2 * width)
        out += lane[:width] - lane[width:]
    return out


def _short(paragraph: str, width: int) -> np.ndarray:
    """A short paragraph has few grams, so its pairs of characters count as well."""
    out = np.zeros(width, dtype=np.int64)
    for pair in map("".join, zip(paragraph, paragraph[1:] + "\n")):
        h = zlib.crc32(pair.encode("utf-8", "surrogatepass"))
        out[h % width] += 1 if h & 0x80000000 else -1
    return out


def fingerprint_vector(text: str | None, lanes: int = LANES, sketch: int = SKETCH, gram: int = GRAM) -> np.ndarray:
    """The vector (uint32) of a text; paragraphs are its lines, the null text is empty."""
    text = text or ""
    paragraphs = text.split("\n")
    raw = b"".join([hashlib.blake2b(p.encode("utf-8", "surrogatepass"), digest_size=4 * lanes).digest() for p in paragraphs])
    equal = np.frombuffer(raw, dtype="<u4").reshape(-1, lanes).sum(axis=0, dtype=np.uint64).astype(np.uint32)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    like = _grams(codes, gram, sketch)
    for p in paragraphs:
        if 0 < len(p) < 4 * gram:
            like += _short(p, sketch)
    return np.concatenate([equal, like.astype(np.uint32)])


def add(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Fingerprint of two multisets of paragraphs together."""
    return (a + b).astype(np.uint32)


def subtract(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Fingerprint of ``a`` without the paragraphs of ``b``."""
    return (a - b).astype(np.uint32)


def likeness(a: np.ndarray, b: np.ndarray, lanes: int = LANES) -> float:
    """Share of grams in common, 0 to 1: 1 for equal fingerprints, else the sketches' cosine, at least 0."""
    if np.array_equal(a, b):
        return 1.0
    x, y = a[lanes:].astype(np.int32).astype(np.float64), b[lanes:].astype(np.int32).astype(np.float64)
    norm = float(np.sqrt((x @ x) * (y @ y)))
    return min(1.0, max(0.0, float(x @ y) / norm)) if norm else 0.0


def text_of(vector: np.ndarray) -> str:
    return vector.astype("<u4").tobytes().hex()


def vector_of(fingerprint: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(fingerprint), dtype="<u4")


def document_fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint (hex) of every document; null text: empty, null ids stay null, other columns are ignored."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            yield df[["doc_id", "no_id"]].assign(fingerprint=[text_of(fingerprint_vector(t)) for t in df["text"]])

    found = docs.select(*rowids.apart(), "text").mapInPandas(scan, "doc_id long, no_id boolean, fingerprint string")
    return found.select(rowids.together(), "fingerprint")


EDITS = "doc_id long, no_id boolean, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _limits(base: DataFrame, parts: int) -> np.ndarray:
    """Some ``parts`` keys in ascending order, all of them keys of the table: about evenly many rows lie between."""
    spark = base.sparkSession
    rows = max(1, base.count())
    # a hashed share of the keys, of a size set by the number of ranges alone
    share = min(1.0, 200.0 * parts / rows)
    drawn = base.select("key").distinct().where(F.pmod(F.xxhash64("key"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))).orderBy("key")
    keys = np.array([r["key"] for r in drawn.collect()], dtype=np.int64)
    return np.unique(keys[np.linspace(0, len(keys) - 1, min(parts, len(keys))).astype(int)]) if len(keys) else keys


def with_next(docs: DataFrame) -> DataFrame:
    """Documents dealt by ranges of their ids, each range followed by the first document of the next.

    Columns doc_id, no_id, text, key, part, copy: rows with copy = 1 are only
    successors. One shuffle carries each text once. The driver sees a sample of ids of
    a size set by the number of shuffle partitions, and the first row of each range.
    """
    spark = docs.sparkSession
    # null ids come first, also before the least id
    base = docs.select(*rowids.apart(), "text").withColumn("key", F.when(F.col("no_id"), F.lit(-(2**63))).otherwise(F.col("doc_id")))
    parts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    limits = _limits(base, parts)

    @pandas_udf("int")
    def place(keys: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(limits, keys.to_numpy(np.int64), side="right").astype(np.int32))

    dealt = base.withColumn("part", place("key"))
    first = F.min(F.struct(~F.col("no_id"), "key")).alias("first")
    full = sorted((r["part"], r["first"][0], r["first"][1]) for r in dealt.groupBy("part").agg(first).collect())  # a row for each range
    ahead = {part: full[i - 1][0] for i, (part, _, _) in enumerate(full)}  # the range before, of those with rows
    if not full:
        return dealt.withColumn("copy", F.lit(0))
    heads = spark.createDataFrame([(part, key, not known, ahead[part]) for part, known, key in full], "part int, key long, no_id boolean, before int")
    heads = dealt.join(F.broadcast(heads), ["part", "key", "no_id"])
    # of rows that share an id the first by text is first
    heads = heads.groupBy("part", "before", "key", "no_id", "doc_id").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    copies = heads.select("doc_id", "no_id", "text", "key", F.col("before").alias("part"), F.lit(1).alias("copy"))
    return dealt.withColumn("copy", F.lit(0)).unionByName(copies)


def edit_likeness(docs: DataFrame) -> DataFrame:
    """Fingerprints of every document and of its edited text, and how alike they are.

    The edited text has its last floor(n/2) code points replaced by the first as many
    (or all) of the next document by ascending id; the last document's next is the
    first. Null text: empty. Null ids come first. Repeated ids follow one another in
    order of their text. A single document is its own successor. Empty table: empty
    result. Other columns are ignored.
    """
    dealt = with_next(docs).withColumn("text", F.coalesce("text", F.lit("")))
    parts = dealt.sparkSession.conf.get("spark.sql.shuffle.partitions")
    ordered = dealt.repartition(int(parts), "part").sortWithinPartitions("part", "copy", F.col("no_id").desc(), "key", "text")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None  # (id, no id, text, vector, part) of the row before
        for df in batches:
            rows = []
            for doc_id, no_id, text, part, copy in zip(df["doc_id"], df["no_id"], df["text"], df["part"], df["copy"]):
                vector = fingerprint_vector(text)
                if held is not None and held[4] == part:
                    before, own = held[2], held[3]
                    half = len(before) // 2
                    edited = before[: len(before) - half] + text[:half]
                    changed = fingerprint_vector(edited)
                    rows.append((held[0], held[1], len(before), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), text_of(own), text_of(changed), likeness(own, changed), likeness(own, vector)))
                held = (doc_id, no_id, text, vector, part) if not copy else None
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in EDITS.split(", ")])

    found = ordered.mapInPandas(compare, EDITS)
    return found.select(rowids.together(), *found.columns[2:])
