"""Token ids of whole texts through a word cache.

The tokenizer drops white space and never joins across it, so the ids of a text
are the ids of its white-space-separated chunks in order. Chunks repeat, so a
bounded per-worker cache answers most of them; when it is full it becomes the older
of two, and what is asked for again moves over to the new one. A chunk that is Latin-1 letters
followed by ASCII punctuation is put together from its lower-cased letters and
its punctuation, which repeat more often still; tests hold all of this against
encoding the whole text at once.
"""

from __future__ import annotations

import ctypes
import gc
import re
import string
from functools import lru_cache

import numpy as np

#: str.split() cuts at these and drops them; to the tokenizer they are no white space.
_SEPARATORS = re.compile("[\x1c-\x1f]")
_CHUNK = re.compile("(?:\\S|[\x1c-\x1f])+")


def chunks_of(text: str) -> list[str]:
    """What stands between the tokenizer's white space."""
    return _CHUNK.findall(text) if _SEPARATORS.search(text) else text.split()


def return_freed_memory() -> None:
    """Give the system back what a reused worker's earlier tasks have freed; the allocator keeps it otherwise."""
    gc.collect()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


class WordEncoder:
    """``encode(texts)`` gives little-endian unsigned 32-bit ids as bytes, without special tokens."""

    #: Entries after which a cache becomes the older one; words are short, and a block of long ones empties the caches too.
    CACHE = 400_000

    def __init__(self, path: str):
        import os

        return_freed_memory()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self._tokenizer = Tokenizer.from_file(path)
        # the same model for lower-case Latin-1 letters, which normalising and word splitting leave as they are
        self._lean = Tokenizer(self._tokenizer.model)
        self._lean.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.CharDelimiterSplit(" "), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocab = self._tokenizer.get_vocab(with_added_tokens=True)
        self._ends = np.zeros(max(vocab.values()) + 1, dtype=bool)
        for token, at in vocab.items():
            self._ends[at] = token.endswith("</w>")
        self._chunks: dict[str, bytes] = {}
        self._cores: dict[str, bytes] = {}
        self._older_chunks: dict[str, bytes] = {}
        self._older_cores: dict[str, bytes] = {}
        self._tails: dict[str, bytes] = {"": b""}

    def _each(self, parts: list[str]) -> list[bytes]:
        found = self._tokenizer.encode_batch_fast(parts, add_special_tokens=False)
        return [np.array(e.ids, dtype="<u4").tobytes() for e in found]

    def _letters(self, cores: list[str]) -> list[bytes]:
        """Ids of words of letters only: encoded in one go and cut at word ends."""
        ids = np.array(self._lean.encode(" ".join(cores), add_special_tokens=False).ids, dtype="<u4")
        ends = np.flatnonzero(self._ends[ids]) + 1
        if len(ends) != len(cores):
            return self._each(cores)
        raw, at = ids.tobytes(), (ends * 4).tolist()
        return [raw[a:b] for a, b in zip([0, *at[:-1]], at)]

    def _learn(self, new: list[str]) -> None:
        if older := self._older_chunks:
            known = [c for c in new if c in older]
            self._chunks.update(zip(known, map(older.__getitem__, known)))
            new = [c for c in new if c not in older]
        chunks, cores, tails, odd = [], [], [], []
        strip = string.punctuation
        for chunk in new:
            core = chunk.rstrip(strip)
            tail = chunk[len(core) :]
            # an apostrophe after letters may start a contraction: such chunks are encoded whole
            if core.isalpha() and (core.isascii() or max(core) < "\u0100") and "'" not in tail:
                chunks.append(chunk)
                cores.append(core.lower())
                tails.append(tail)
            else:
                odd.append(chunk)
        known, ends = self._cores, self._tails
        fresh = {c for c in cores if c not in known}
        if older := self._older_cores:
            again = fresh & older.keys()
            known.update(zip(again, map(older.__getitem__, again)))
            fresh -= again
        fresh = list(fresh)
        for i in range(0, len(fresh), 20_000):
            known.update(zip(fresh[i : i + 20_000], self._letters(fresh[i : i + 20_000])))
        if rare := list({t for t in tails if t not in ends}):
            ends.update(zip(rare, self._each(rare)))
        self._chunks.update(zip(chunks, map(bytes.__add__, map(known.__getitem__, cores), map(ends.__getitem__, tails))))
        self._chunks.update(zip(odd, self._each(odd)))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        out = []
        for i in range(0, len(texts), 256):
            split = [chunks_of(t or "") for t in texts[i : i + 256]]
            known = self._chunks
            parts = [list(map(known.get, chunks)) for chunks in split]
            new: list[str] = []
            gaps = [k for k, p in enumerate(parts) if not all(p)]  # also chunks without ids, which are rare
            if gaps:
                new = list({c for k in gaps for c, p in zip(split[k], parts[k]) if p is None})
                self._learn(new)
                for k in gaps:
                    parts[k] = map(known.__getitem__, split[k])
            out += map(b"".join, parts)
            # emptied between blocks only: a block needs all of its chunks; also after a block of very long ones
            if len(self._tails) > self.CACHE or sum(map(len, new)) > 20 * self.CACHE:
                self._chunks, self._older_chunks, self._cores, self._older_cores, self._tails = {}, {}, {}, {}, {"": b""}
            elif len(known) > self.CACHE:
                self._chunks, self._older_chunks, self._cores, self._older_cores = {}, known, {}, self._cores
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)
