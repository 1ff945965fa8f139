"""Removal of long repeated word runs by recompression.

A text's words are renamed in rounds: a round names maximal runs of one symbol,
then pairs of a left symbol followed by a right one (the side is a bit of the
symbol's name). A name is a hash of what it stands for, so all executors give
equal runs and pairs the same name with no dictionary to ship or shuffle; names
only propose, 128-bit digests of the words themselves decide.

A symbol's identity depends on a bounded stretch of words, its *context*. Every
window of ``window`` words picks the least-named top-level symbol whose context
lies inside it, so equal windows pick equal symbols wherever they stand; a window
without one (deep inside a periodic stretch) stands for itself. Consecutive
windows with one pick form a group, the unit that Spark shuffles:

1. names that occur in two documents survive, the rest of the corpus drops out;
2. among those, groups with equal digests are repeats of the least document;
3. where one name has several digests (edges of a repeat), the least document of
   each digest lists its single windows, and these are matched by digest.

Every window is decided on the input texts; words under repeated windows go.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotemill.llm import rowids
from quotemill.llm.idfilter import may_contain
from quotemill.llm.scratch import materialize
from quotemill.llm.words import split_words

WINDOW = 50
ROUNDS = 5
RUN_ROUNDS = 2
CHUNK_WORDS = 100_000
_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def parse(names: np.ndarray, seg: np.ndarray, first: np.ndarray, last: np.ndarray, rounds: int = ROUNDS, run_rounds: int = RUN_ROUNDS):
    """Top-level symbols of several word sequences laid end to end.

    ``seg``: sequence of each word; ``first``/``last``: bounds of each sequence.
    Returns names and contexts [c, d) as positions; a context that reaches beyond
    its sequence starts before or ends after it. Contexts never decrease.
    """
    c = np.arange(len(names), dtype=np.int64)
    d = c + 1
    for level in range(rounds):
        if level < run_rounds:
            new = np.ones(len(names), dtype=bool)
            new[1:] = (names[1:] != names[:-1]) | (seg[1:] != seg[:-1])
            at = np.flatnonzero(new)
            k = np.diff(np.append(at, len(names)))
            end = at + k - 1
            own = seg[at]
            inner = np.zeros(len(at), dtype=bool)
            inner[1:] = own[1:] == own[:-1]
            outer = np.zeros(len(at), dtype=bool)
            outer[:-1] = own[1:] == own[:-1]
            c = np.where(inner, c[np.maximum(at - 1, 0)], first[own] - 1)
            d = np.where(outer, d[np.minimum(end + 1, len(d) - 1)], last[own] + 1)
            named = names[at]
            names = np.where(k > 1, _mix(named + _mix(k.astype(_U) + _U(1000 + level))), named)
            seg = own
        right = (_mix(names + _U(0x9E3779B97F4A7C15 * (level + 1) % 2**64)) & _U(1)).astype(bool)
        same = np.zeros(len(names), dtype=bool)  # the next symbol is of the same sequence
        same[:-1] = seg[1:] == seg[:-1]
        nxt = np.minimum(np.arange(len(names)) + 1, len(names) - 1)
        prv = np.maximum(np.arange(len(names)) - 1, 0)
        pair = ~right & same & right[nxt]
        second = np.zeros(len(names), dtype=bool)
        second[1:] = pair[:-1]
        before = np.zeros(len(names), dtype=bool)
        before[1:] = same[:-1]
        c2 = np.where(right & ~second, np.where(before, c[prv], first[seg] - 1), c)
        d2 = np.where(~right, np.where(same, d[nxt], last[seg] + 1), d)
        joint = _mix(names * _U(0x9E3779B97F4A7C15) + _mix(names[nxt] + _U(level + 1)))
        names, keep = np.where(pair, joint, names), ~second
        names, c, d, seg = names[keep], c2[keep], d2[keep], seg[keep]
    return names, c, d


def _least(key: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Index of the leftmost least key in each [lo, hi); -1 where empty."""
    n = hi - lo
    out = np.full(len(lo), -1, dtype=np.int64)
    table = np.arange(len(key), dtype=np.int64)
    span = 1
    while True:
        now = (n >= span) & (n < 2 * span)
        if now.any():
            a, b = table[lo[now]], table[hi[now] - span]
            out[now] = np.where(key[a] <= key[b], a, b)
        if not (n >= 2 * span).any():
            return out
        a, b = table[:-span], table[span:]
        table = np.where(key[a] <= key[b], a, b)
        span *= 2


def window_groups(texts: list[str | None], window: int = WINDOW) -> tuple[np.ndarray, ...]:
    """Groups of consecutive windows that pick one symbol: (row, first window, windows, name, digest).

    The name is a hash of the words of the symbol's context, which equal windows share;
    a symbol's own name stands for a few words only and would meet by chance.
    """
    out: list[tuple[np.ndarray, ...]] = []
    pending: list[tuple[int, int, list[bytes]]] = []
    held = 0
    for row, text in enumerate(texts):
        words = split_words(text)
        for at in range(0, len(words) - window + 1, CHUNK_WORDS):  # windows starting in [at, at + CHUNK_WORDS)
            part = words[at : at + CHUNK_WORDS + window - 1]
            pending.append((row, at, part))
            held += len(part)
            if held >= CHUNK_WORDS:
                out.append(_chunk_groups(pending, window))
                pending, held = [], 0
    if pending:
        out.append(_chunk_groups(pending, window))
    if not out:
        return tuple(np.empty(0, dtype=np.int64) for _ in range(5))
    return tuple(np.concatenate(x) for x in zip(*out))


def _chunk_groups(parts: list[tuple[int, int, list[bytes]]], window: int) -> tuple[np.ndarray, ...]:
    words = [w for _, _, ws in parts for w in ws]
    sizes = np.array([len(ws) for _, _, ws in parts], dtype=np.int64)
    last = np.cumsum(sizes)
    first = last - sizes
    seg = np.repeat(np.arange(len(parts)), sizes)
    hash64 = xxhash.xxh3_64_intdigest
    names, c, d = parse(np.fromiter(map(hash64, words), dtype=_U, count=len(words)), seg, first, last)
    starts = np.concatenate([np.arange(a, b - window + 1) for a, b in zip(first, last)])
    of = np.repeat(np.arange(len(parts)), sizes - window + 1)
    lo, hi = np.searchsorted(c, starts, side="left"), np.searchsorted(d, starts + window, side="right")
    pick = _least(_mix(names), lo, np.maximum(hi, lo))
    new = np.ones(len(starts), dtype=bool)
    new[1:] = (pick[1:] != pick[:-1]) | (of[1:] != of[:-1]) | (pick[1:] < 0)
    at = np.flatnonzero(new)
    n = np.diff(np.append(at, len(starts)))
    p0, picked, of = starts[at], pick[at], of[at]
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)
    begin = np.concatenate([[0], ends[:-1]])
    digest = xxhash.xxh3_128_digest
    spans = zip(begin[p0].tolist(), (ends[p0 + n + window - 2] - 1).tolist())
    digests = np.frombuffer(b"".join([digest(joined[a:b])[:8] for a, b in spans]), dtype=np.int64)
    own = np.flatnonzero(picked >= 0)
    spans = zip(begin[c[picked[own]]].tolist(), (ends[d[picked[own]] - 1] - 1).tolist())
    name = digests.copy()
    name[own] = np.array([hash64(joined[a:b], 1) for a, b in spans], dtype=_U).view(np.int64)
    rows, offsets = np.array([r for r, _, _ in parts]), np.array([o for _, o, _ in parts])
    return rows[of], p0 - first[of] + offsets[of], n, name, digests


def _slices(words: list[bytes], groups, window: int) -> list[bytes]:
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1).tolist()
    joined, digest = b" ".join(words), xxhash.xxh3_128_digest
    return [digest(joined[ends[p - 1] if p else 0 : ends[p + n + window - 2] - 1]) if p + n + window - 1 <= len(words) else b"\0" * 16 for p, n in groups]


GROUPS = "doc_id long, p int, n int, name long, g1 long"


def repeated_windows(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, p, n, g1): the n windows from word p on each also start in a document with a smaller id.

    Null ids and texts and texts of fewer than ``window`` words give no rows.
    """

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            for i in range(0, len(df), 500):
                part = df.iloc[i : i + 500]
                row, p, n, name, g1 = window_groups(part["text"].tolist(), window)
                yield pd.DataFrame({"doc_id": part["doc_id"].to_numpy()[row], "p": p.astype(np.int32), "n": n.astype(np.int32), "name": name, "g1": g1})

    known = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    groups = materialize(known.mapInPandas(scan, GROUPS), "windows")
    ranged = [F.min("doc_id").alias("least"), F.max("doc_id").alias("most")]
    shared = materialize(groups.groupBy("name").agg(*ranged).where("least < most").select("name"), "shared")
    live = materialize(groups.join(shared, "name", "left_semi"), "live")
    variants = materialize(live.groupBy("name", "g1").agg(F.min("doc_id").alias("source")), "variants")
    mixed = materialize(variants.groupBy("name").agg(F.count("*").alias("k")).where("k > 1").select("name", F.lit(True).alias("mixed")), "mixed")
    placed = materialize(live.join(variants, ["name", "g1"]).select("doc_id", "p", "n", "name", "g1", "source"), "placed")
    whole = placed.where("doc_id > source").select("doc_id", "p", "n", "g1")
    edges = placed.where("doc_id = source").join(mixed, "name", "left_semi").groupBy("doc_id").agg(F.collect_set(F.struct("p", "n")).alias("at"))

    def single(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            for doc_id, text, at in zip(df["doc_id"], df["text"], df["at"]):
                words = split_words(text)
                ps = sorted({p + i for g in at for p, n in [(g["p"], g["n"])] for i in range(n)})
                raw = np.frombuffer(b"".join(_slices(words, [(p, 1) for p in ps], window)), dtype=np.int64).reshape(-1, 2)
                yield pd.DataFrame({"doc_id": np.full(len(ps), doc_id), "p": ps, "g1": raw[:, 0], "g2": raw[:, 1]})

    edges = materialize(edges, "edges")
    wanted = known.where(may_contain(edges, "doc_id")(F.col("doc_id")))
    windows = materialize(wanted.join(edges, "doc_id").select("doc_id", "text", "at").mapInPandas(single, "doc_id long, p int, g1 long, g2 long"), "single")
    sources = materialize(windows.groupBy("g1", "g2").agg(*ranged).where("least < most").select("g1", "g2", F.col("least").alias("source")), "sources")
    part = windows.join(sources, ["g1", "g2"]).where("doc_id > source").select("doc_id", "p", F.lit(1).alias("n"), "g1")
    return whole.unionAll(part)


RESULT = "doc_id long, no_id boolean, text string, n_words long, n_removed long, kept_sha256 string"


def remove_repeats(docs: DataFrame, window: int = WINDOW, extra: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: id, remaining text, counts of its words, and the columns ``extra`` as they are.

    The text stays as it is where nothing goes, else it is the kept words joined by
    one space. Of equal windows only those in the least document stay whole. Null
    text: no words, text null. Null id: kept whole. Repeated rows are all treated
    alike. Empty table: empty result. Other columns are ignored.
    """
    marks = repeated_windows(docs, window).groupBy("doc_id").agg(F.collect_list(F.struct("p", "n", "g1")).alias("gone"))
    marks = materialize(marks, "gone")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            rows = []
            for doc_id, no_id, text, marks in zip(df["doc_id"], df["no_id"], df["text"], df["gone"]):
                words = split_words(text)
                if marks is not None and len(marks):
                    at = [(m["p"], m["n"]) for m in marks]
                    found = np.frombuffer(b"".join(_slices(words, at, window)), dtype=np.int64).reshape(-1, 2)[:, 0]
                    cover = np.zeros(len(words) + 1, dtype=np.int64)
                    for (p, n), g, m in zip(at, found.tolist(), marks):
                        if g == m["g1"]:  # the very words that were matched
                            cover[p] += 1
                            cover[p + n + window - 1] -= 1
                    kept = [w for w, k in zip(words, np.cumsum(cover).tolist()) if not k]
                else:
                    kept = words
                joined = b" ".join(kept)
                rows.append((doc_id, no_id, text if len(kept) == len(words) else joined.decode("utf-8", "surrogatepass"), len(words), len(words) - len(kept), hashlib.sha256(joined).hexdigest()))
            out = pd.DataFrame(rows, columns=["doc_id", "no_id", "text", "n_words", "n_removed", "kept_sha256"])
            yield pd.concat([out, df[names].reset_index(drop=True)], axis=1)

    names = [f"extra_{i}" for i in range(len(extra))]
    wanted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *[F.col(c).alias(n) for c, n in zip(extra, names)])
    kinds = "".join(f", {f.name} {f.dataType.simpleString()}" for f in wanted.schema[2:]) if extra else ""
    marked = may_contain(marks, "doc_id")(F.col("doc_id"))
    plain = wanted.where(~marked).withColumn("gone", F.lit(None).cast(marks.schema["gone"].dataType))
    joined = wanted.where(marked).join(marks, "doc_id", "left").select("doc_id", "text", *names, "gone")
    done = plain.unionAll(joined).select(*rowids.apart(), "text", *names, "gone").mapInPandas(cut, RESULT + kinds)
    return done.select(rowids.together(), "text", "n_words", "n_removed", "kept_sha256", *[F.col(n).alias(c) for n, c in zip(names, extra)])
