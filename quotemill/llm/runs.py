"""Maximal periodic runs of words, by the runs theorem.

Every run has a root that is the longest Lyndon word at its start under one of two
opposite orders of the words. Such words end at the next smaller value of the inverse
suffix array (under the opposite order: at the next greater one), so one pass yields
at most two candidate roots for each word of a text. A candidate [i, j) extends to a
run by the longest common prefix of the suffixes at i and j and the longest common
suffix of what ends before them; both are minima of ranges of the LCP array, of the
text and of its mirror image, answered from sparse tables.

Several texts are laid end to end, their words numbered apart, each closed by a
sentinel of its own, so no run crosses texts and all steps are array operations.
Only texts with a root whose first words recur one period later get LCP arrays. The
arrays take about 200 bytes a word of the longest text, 24 * log2(words) more where
the text has such roots. Spark deals out documents; a document is one row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from quotemill.llm import rowids
from quotemill.llm.words import split_words

MIN_LENGTH = 24
MIN_PERIODS = 3
BLOCK_WORDS = 1 << 17


def suffix_ranks(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array and its inverse, by prefix doubling; only suffixes not yet told apart are sorted again.

    ``symbols`` must end, text by text, in sentinels that occur once.
    """
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    ordered = symbols[order]
    new = np.ones(n, dtype=bool)
    new[1:] = ordered[1:] != ordered[:-1]
    start = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.empty(n, dtype=np.int64)
    rank[order] = start
    single = new & np.append(new[1:], True)
    at = np.flatnonzero(~single)  # places in the suffix array that are still open
    step = 1
    while len(at):
        suffixes = order[at]
        group = rank[suffixes]
        key = group * n + rank[suffixes + step]
        by = np.argsort(key, kind="stable")
        suffixes, group, key = suffixes[by], group[by], key[by]
        new = np.ones(len(key), dtype=bool)
        new[1:] = key[1:] != key[:-1]
        lead = np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))
        order[at] = suffixes
        rank[suffixes] = at[lead]
        at = at[~(new & np.append(new[1:], True))]
        step *= 2
    return order, rank


def next_smaller(values: np.ndarray) -> np.ndarray:
    """For each i the least k > i with values[k] < values[i], or len(values): up and down a tree of minima."""
    n = len(values)
    levels = [values]
    while len(levels[-1]) > 1:
        v = levels[-1]
        if len(v) % 2:
            v = levels[-1] = np.append(v, np.iinfo(v.dtype).max)
        levels.append(np.minimum(v[0::2], v[1::2]))
    out = np.full(n, n, dtype=np.int64)
    climbing = np.arange(n)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for level, v in enumerate(levels[:-1]):
        node = climbing >> level
        right = node + 1
        hit = (node & 1 == 0) & (v[np.minimum(right, len(v) - 1)] < values[climbing])
        found.append((climbing[hit], right[hit]))
        climbing = climbing[~hit]
    who, node = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    for level in range(len(levels) - 2, -1, -1):
        who, node = np.concatenate([who, found[level][0]]), np.concatenate([node, found[level][1]])
        if level:
            below = levels[level - 1]
            node = 2 * node
            node += below[node] >= values[who]
    out[who] = node
    return out


class CommonPrefixes:
    """Longest common prefixes of suffixes: LCP array (Kasai) and sparse table of its range minima."""

    def __init__(self, symbols: np.ndarray, order: np.ndarray, rank: np.ndarray):
        self.rank = rank
        text, before = symbols.tolist(), np.empty(len(order), dtype=np.int64)
        before[order[1:]] = order[:-1]
        before[order[0]] = -1
        plcp, h = [0] * len(text), 0
        for i, j in enumerate(before.tolist()):
            if j < 0:
                h = 0
                continue
            while text[i + h] == text[j + h]:  # sentinels stop this within the text
                h += 1
            plcp[i] = h
            if h:
                h -= 1
        table = np.array(plcp, dtype=np.int32)[order]
        self.tables = [table]
        span = 1
        while 2 * span <= len(order):
            table = np.minimum(table[:-span], table[span:])
            self.tables.append(table)
            span *= 2

    def of(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Common prefix lengths of the suffixes at i and j, i and j different."""
        a, b = self.rank[i], self.rank[j]
        lo, hi = np.minimum(a, b) + 1, np.maximum(a, b) + 1
        level = np.frexp((hi - lo).astype(np.float64))[1] - 1
        out = np.empty(len(lo), dtype=np.int64)
        for k in np.unique(level):
            now = level == k
            table = self.tables[k]
            out[now] = np.minimum(table[lo[now]], table[hi[now] - (1 << int(k))])
        return out


def number_words(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of texts laid end to end, and where each begins; a text's sentinel is less than its words and than all later texts'."""
    symbols: list[int] = []
    starts = np.empty(len(texts) + 1, dtype=np.int64)
    base = 0
    for k, words in enumerate(texts):
        starts[k] = len(symbols)
        known: dict[bytes, int] = {}
        first = base + 1
        symbols += [known.setdefault(w, first + len(known)) for w in words]
        symbols.append(base)
        base = first + len(known)
    starts[-1] = len(symbols)
    return np.array(symbols, dtype=np.int64), starts


def _roots(symbols: np.ndarray, rank: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Candidates (i, j): longest Lyndon words [i, j) under either order, followed by the same ``least`` symbols as they begin with."""
    n = len(symbols)
    out_i, out_j = [], []
    for values in (rank, n - 1 - rank):
        j = next_smaller(values)
        i = np.flatnonzero(j < n)
        j = j[i]
        for k in range(least):
            if k:
                fits = j + k < n
                i, j = i[fits], j[fits]
            same = symbols[i + k] == symbols[j + k]
            i, j = i[same], j[same]
        out_i.append(i)
        out_j.append(j)
    return np.concatenate(out_i), np.concatenate(out_j)


def find_runs(texts: list[list[bytes]], min_length: int = MIN_LENGTH, min_periods: int = MIN_PERIODS) -> list[list[tuple[int, int, int]]]:
    """Runs (start, length, period) of each text with length >= max(min_length, min_periods * period), by start, then period.

    ``min_periods`` is 2 at least: shorter repetitions are no runs.
    """
    if min_periods < 2:
        raise ValueError("a run has two periods at least")
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    symbols, starts = number_words(texts)
    if not len(symbols):
        return out
    rank = suffix_ranks(symbols)[1]
    # a run's first root starts less than a period from its start, so its symbols recur one period later for that long at least
    least = min(max((min_periods - 2) * p + 1, min_length - 2 * p + 1) for p in range(1, min_length + 1))
    i, j = _roots(symbols, rank, max(least, 1))
    hit = np.unique(np.searchsorted(starts, i, side="right") - 1)
    for k in hit.tolist():  # one at a time: their tables are the largest arrays
        lo, hi = starts[k], starts[k + 1]
        own = (i >= lo) & (i < hi)
        out[k] = _extend(symbols[lo:hi] - symbols[hi - 1], i[own] - lo, j[own] - lo, min_length, min_periods)
    return out


def _extend(symbols: np.ndarray, i: np.ndarray, j: np.ndarray, min_length: int, min_periods: int) -> list[tuple[int, int, int]]:
    """Runs of one text (its sentinel last and least) from its candidate roots [i, j)."""
    n = len(symbols)
    forward = CommonPrefixes(symbols, *suffix_ranks(symbols))
    mirror = np.append(symbols[-2::-1], symbols[-1])
    backward = CommonPrefixes(mirror, *suffix_ranks(mirror))
    ahead = forward.of(i, j)
    behind = np.zeros(len(i), dtype=np.int64)
    inner = i > 0
    behind[inner] = backward.of(n - 1 - i[inner], n - 1 - j[inner])
    start, period = i - behind, j - i
    length = j + ahead - start
    long = length >= np.maximum(min_length, min_periods * period)
    found = np.unique(np.stack([start[long], period[long], length[long]], axis=1), axis=0)
    return [(s, size, p) for s, p, size in found.tolist()]


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run contains after its first period."""
    if not runs:
        return words
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return [w for w, gone in zip(words, np.cumsum(edge).tolist()) if not gone]


RESULT = (
    "doc_id long, no_id boolean, text string, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string, spans array<struct<start:long,length:long,period:long>>"
)


def periodic_runs(docs: DataFrame, *, min_length: int = MIN_LENGTH, min_periods: int = MIN_PERIODS) -> DataFrame:
    """One row per document: its runs of words and its text without their repetitions.

    Columns: doc_id, text (the kept words joined by one space where words go, else
    as it was), n_runs, start, length, period and exponent_milli of the run with the
    greatest length / period (ties: smallest start, then period; no run: null),
    runs_sha256 (``start,length,period`` and a line feed per run, by start, then
    period), collapsed_sha256 (kept words joined by one space), spans (all runs). Null
    and empty texts have no words and no runs; a null text stays null. Repeated rows
    and null ids are treated like any other; an empty table gives an empty result;
    other columns are ignored.
    """

    def block(ids: list, marks: list, texts: list) -> pd.DataFrame:
        words = [split_words(t) for t in texts]
        rows = []
        for doc_id, no_id, text, own, runs in zip(ids, marks, texts, words, find_runs(words, min_length, min_periods)):
            kept = collapse(own, runs)
            joined = b" ".join(kept)
            top = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else (None, None, None)
            listed = hashlib.sha256("".join(f"{s},{n},{p}\n" for s, n, p in runs).encode()).hexdigest()
            left = text if len(kept) == len(own) else joined.decode("utf-8", "surrogatepass")
            spans = [{"start": s, "length": n, "period": p} for s, n, p in runs]
            rows.append((doc_id, no_id, left, len(runs), *top, 1000 * top[1] // top[2] if runs else None, listed, hashlib.sha256(joined).hexdigest(), spans))
        out = pd.DataFrame(rows, columns=["doc_id", "no_id", "text", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256", "spans"])
        return out.astype({c: "Int64" for c in ("start", "length", "period", "exponent_milli")})

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            ids, marks, texts, held = [], [], [], 0
            for doc_id, no_id, text in zip(df["doc_id"], df["no_id"], df["text"]):
                ids.append(doc_id)
                marks.append(no_id)
                texts.append(text)
                held += len(text or "") // 6
                if held >= BLOCK_WORDS:
                    yield block(ids, marks, texts)
                    ids, marks, texts, held = [], [], [], 0
            if ids:
                yield block(ids, marks, texts)

    found = docs.select(*rowids.apart(), "text").mapInPandas(scan, RESULT)
    return found.select(rowids.together(), "text", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256", "spans")
