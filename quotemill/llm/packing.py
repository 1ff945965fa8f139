"""Best-fit packing of token pieces into sequences of bounded length.

Only whole counts per length matter to the plan, and there are at most
``capacity`` lengths, so the driver plans on a histogram of bounded size however
large the corpus: pieces above one third of the capacity are matched greedily, at
most two to a bin; smaller ones go, longest first, into the tightest remaining
gaps. The plan says which ranks of each length go to which bins; every piece then
looks up its own place. Ranks come from counts per length and bucket, so a length
that a third of all pieces share is spread over buckets.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quotemill.llm import rowids
from quotemill.llm.scratch import materialize
from quotemill.llm.tokens import encoder

BUCKET_ROWS = 50_000
PIECES = "doc_id long, no_id boolean, piece int, start long, length long, ids_crc32 long"


def plan_bins(counts: dict[int, int], capacity: int) -> np.ndarray:
    """Slots (length, first rank, ranks, first bin, offset, copies per bin) that place every piece.

    Rank r of a length, r within a slot's ranks, goes to bin ``first bin + k // copies``
    at ``offset + (k % copies) * length`` with k = r - first rank.
    """
    left = {n: c for n, c in counts.items() if c}
    if any(not 0 < n <= capacity for n in left):
        raise ValueError("lengths must be from 1 to the capacity")
    ranks = dict.fromkeys(left, 0)
    slots: list[tuple[int, ...]] = []
    gaps: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]  # by gap: (first bin, bins)
    open_gaps = 0  # bit g: gaps[g] is not empty
    bins = 0

    def put(length: int, n: int, first: int, offset: int, copies: int = 1) -> None:
        slots.append((length, ranks[length], n, first, offset, copies))
        ranks[length] += n
        left[length] -= n

    def leave(gap: int, first: int, n: int) -> None:
        nonlocal open_gaps
        if n and gap:
            gaps[gap].append((first, n))
            open_gaps |= 1 << gap

    third = capacity // 3
    large = sorted((n for n in left if n > third), reverse=True)
    for a in large:
        for b in large:
            if not left[a]:
                break
            if b > min(a, capacity - a) or not left[b]:
                continue
            n = left[a] // 2 if a == b else min(left[a], left[b])
            if n:
                put(a, n, bins, 0)
                put(b, n, bins, a)
                leave(capacity - a - b, bins, n)
                bins += n
        if n := left[a]:
            put(a, n, bins, 0)
            leave(capacity - a, bins, n)
            bins += n
    for length in sorted((n for n in left if n <= third), reverse=True):
        while n := left[length]:
            fitting = open_gaps >> length
            if fitting:
                gap = length + (fitting & -fitting).bit_length() - 1
                first, m = gaps[gap].pop()
                if not gaps[gap]:
                    open_gaps &= ~(1 << gap)
            else:
                gap, first, m = capacity, bins, -(-n // (capacity // length))
                bins += m
            copies = gap // length
            full = min(m, n // copies)
            if full:
                put(length, full * copies, first, capacity - gap, copies)
                leave(gap - copies * length, first, full)
            if full < m and (rest := n - full * copies):
                put(length, rest, first + full, capacity - gap, copies)
                leave(gap - rest * length, first + full, 1)
                full += 1
            leave(gap, first + full, m - full)
    return np.array(slots, dtype=np.int64).reshape(-1, 6)


def pack(pieces: DataFrame, capacity: int, order: list[str]) -> DataFrame:
    """``pieces`` (a ``length`` column and others) with sequence_id and offset added.

    ``order``: columns that order pieces of one length; equal rows may be told apart
    in any way. Whole-number columns must not hold nulls (see ``rowids``). An empty table gives an empty result.
    """
    spark = pieces.sparkSession
    counts = {int(r["length"]): int(r["n"]) for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    slots = plan_bins(counts, capacity)
    at = np.lexsort((slots[:, 1], slots[:, 0]))
    slots = slots[at]
    shared = spark.sparkContext.broadcast(slots)  # bounded by the number of lengths, not by the corpus
    buckets = max(8, sum(counts.values()) // BUCKET_ROWS)
    # equal rows are dealt over buckets too: which of them has which place is open
    split = pieces.withColumn("_bucket", F.pmod(F.xxhash64(*order, F.monotonically_increasing_id()), F.lit(buckets)).cast("int"))
    before = (
        split.groupBy("length", "_bucket")
        .agg(F.count("*").alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .drop("_n")
    )
    ranked = split.withColumn("_rank", F.row_number().over(Window.partitionBy("length", "_bucket").orderBy(*order)) - 1)
    ranked = ranked.join(before, ["length", "_bucket"]).withColumn("_rank", (F.col("_rank") + F.col("_before")).cast("long")).drop("_bucket", "_before")
    kept = [f for f in ranked.schema if f.name != "_rank"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", sequence_id long, offset long"

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = shared.value
        key = table[:, 0] << 48 | table[:, 1]
        for df in batches:
            k = np.searchsorted(key, (df["length"].to_numpy(np.int64) << 48) | df["_rank"].to_numpy(np.int64), side="right") - 1
            s, nth = table[k], df["_rank"].to_numpy(np.int64) - table[k, 1]
            yield df.drop(columns="_rank").assign(sequence_id=s[:, 3] + nth // s[:, 5], offset=s[:, 4] + nth % s[:, 5] * s[:, 0])

    return ranked.mapInPandas(place, schema)


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """Pieces of at most ``capacity`` ids of each document: its whole text's ids, then ``end_id``.

    Null and empty texts have the end id alone. Only documents longer than the
    capacity are cut. Repeated rows give repeated pieces; other columns are ignored.
    """
    end = int(end_id).to_bytes(4, "little")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(tokenizer).encode
        for df in batches:
            rows = []
            for doc_id, no_id, ids in zip(df["doc_id"], df["no_id"], encode(df["text"].tolist())):
                ids += end
                for i in range(0, len(ids), 4 * capacity):
                    part = ids[i : i + 4 * capacity]
                    rows.append((doc_id, no_id, i // (4 * capacity), i // 4, len(part) // 4, zlib.crc32(part)))
            yield pd.DataFrame(rows, columns=["doc_id", "no_id", "piece", "start", "length", "ids_crc32"])

    cuts = docs.select(*rowids.apart(), "text").mapInPandas(cut, PIECES)
    return cuts.select(rowids.together(), "piece", "start", "length", "ids_crc32")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048) -> DataFrame:
    """Every piece of every document with its place in a sequence (see ``token_pieces``, ``pack``)."""
    pieces = token_pieces(docs, tokenizer, capacity).select(*rowids.apart(), "piece", "start", "length", "ids_crc32")
    packed = pack(materialize(pieces, "pieces"), capacity, ["doc_id", "piece", "start", "ids_crc32"])
    return packed.select(rowids.together(), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
