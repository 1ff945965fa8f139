"""Words and shingles shared by the text operators."""

from __future__ import annotations

import numpy as np
import xxhash


def split_words(text: str | None) -> list[bytes]:
    """Maximal runs of characters other than space and \\t\\n\\v\\f\\r, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def shingle_hashes(text: str | None, n: int, seed: int) -> np.ndarray:
    """XXH64 of every n-word shingle of the text with A-Z lower-cased, repeats included.

    Fewer than n words: one shingle of all of them; no words: none.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    joined, hash64 = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= n:
        return np.array([hash64(joined, seed)], dtype=np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)
    starts = [0, *ends[: -n].tolist()]
    return np.array([hash64(joined[s:e], seed) for s, e in zip(starts, (ends[n - 1 :] - 1).tolist())], dtype=np.uint64)
