"""SentencePiece encoding with distinct sampled segmentations, and decoding.

A text's segmentations are the paths of a lattice of vocabulary pieces; white space
begins a chunk, pieces never cross chunks, so the lattice is a chain of chunk lattices,
built once for each distinct chunk of a batch. Perturbed A* search gives the k largest
Gumbel-perturbed log-probabilities, a sample of k segmentations without replacement:
the root's perturbed value is passed to a path sampled downwards; at each step all
other choices together get the maximum of their truncated Gumbel; the best such group
on the frontier holds the next segmentation. The largest value left on the frontier
is the threshold from which each sample's inclusion probability follows. All
randomness is a hash of (seed, row key, sample, place), so a row's samples are the
same in any batch, on any executor.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame

from quotemill.llm import rowids

SPACE = "▁"
_CHUNK = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
_U = np.uint64
_K = _U(0x100000001B3)
BATCH_CHARS = 1 << 21  # a larger batch has fewer distinct chunks for its length, and takes some 200 MB


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _uniform(x: np.ndarray) -> np.ndarray:
    """In (0, 1), from hashed words."""
    return ((_mix(x) >> _U(12)).astype(np.float64) + 0.5) * 2.0**-52


class Vocabulary:
    """Pieces of a SentencePiece model with weights: log-probabilities for unigram models, minus log ranks for BPE ones."""

    def __init__(self, path: str, alpha: float = 1.0):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.bytes: dict[int, int] = {}
        self.byte_ids = np.full(256, model.unk_id(), dtype=np.int64)
        plain, scores = [], []
        self.text = [b""] * n
        for i in range(n):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                self.text[i] = bytes([int(piece[3:5], 16)])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                plain.append((i, piece))
                scores.append(model.get_score(i))
                self.text[i] = piece.encode()
        scores = np.array(scores)
        ranked = bool(np.all(scores == np.round(scores)))
        weight = -np.log(2 - scores) if ranked else scores
        self.byte_weight = alpha * float(-np.log(n))
        self.longest = max(len(p) for _, p in plain)
        keys = np.array([self._key(p) for _, p in plain], dtype=_U)
        slots = self._slot(keys)
        order = np.argsort(slots, kind="stable")
        self._first = np.full(1 << 22, -1, dtype=np.int32)  # by slot: where its keys begin
        at = np.flatnonzero(np.concatenate([[True], np.diff(slots[order]) != 0]))
        self._first[slots[order][at]] = at
        self._most = int(np.diff(np.append(at, len(keys))).max())
        self.keys, self.ids = keys[order], np.array([i for i, _ in plain], dtype=np.int64)[order]
        self.weights, self.sizes = alpha * weight[order], np.array([len(p) for _, p in plain])[order]
        if len(np.unique(keys)) != len(keys):
            raise ValueError("two pieces share a key")

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        return ((keys * _U(0x9E3779B97F4A7C15)) >> _U(42)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Index of each key among ``keys``, -1 where it is none."""
        at = self._first[self._slot(keys)]
        out = np.where((at >= 0) & (self.keys[at] == keys), at, -1)
        for probe in range(1, self._most):
            rest = np.flatnonzero((at >= 0) & (out < 0))
            nxt = np.minimum(at[rest] + probe, len(self.keys) - 1)
            good = self.keys[nxt] == keys[rest]
            out[rest[good]] = nxt[good]
        return out

    @staticmethod
    def _key(piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * int(_K) + ord(c) + 1) % 2**64
        return h

    def decode(self, ids) -> str:
        """The text of ids: pieces and bytes joined, the leading space that encoding adds taken off."""
        text = b"".join([self.text[i] for i in ids]).decode("utf-8", "replace").replace(SPACE, " ")
        return text[1:] if text.startswith(" ") else text


class Lattice:
    """Lattices of distinct chunks, end to end: a state for every character, transitions sorted by state."""

    def __init__(self, vocabulary: Vocabulary, chunks: list[str]):
        v = vocabulary
        sizes = np.fromiter(map(len, chunks), dtype=np.int64, count=len(chunks))
        codes = np.frombuffer("".join(chunks).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(_U)
        n = len(codes)
        self.codes = codes
        self.end = np.cumsum(sizes)
        self.start = self.end - sizes
        stop = np.repeat(self.end, sizes)
        h, src, dst, piece, weight = np.zeros(n, dtype=_U), [], [], [], []
        at = np.arange(n)
        for length in range(1, v.longest + 1):
            live = at + length <= stop[at]
            at = at[live]
            if not len(at):
                break
            h = h[live] * _K + codes[at + length - 1] + _U(1)
            k = v.find(h)
            hit = (k >= 0) & (v.sizes[k] == length)
            src.append(at[hit])
            dst.append(at[hit] + length)
            piece.append(v.ids[k[hit]])
            weight.append(v.weights[k[hit]])
            if length == 1:  # characters that are no pieces are spelt in bytes
                bare = at[~hit]
                many = 1 + (codes[bare] >= 0x80) + (codes[bare] >= 0x800).astype(np.int64) + (codes[bare] >= 0x10000)
                src.append(bare)
                dst.append(bare + 1)
                piece.append(np.full(len(bare), -1))
                weight.append(v.byte_weight * many)
        src, dst, piece, weight = (np.concatenate(x) if x else np.empty(0, dtype=np.int64) for x in (src, dst, piece, weight))
        order = np.lexsort((dst, src))
        self.src, self.dst, self.piece, weight = src[order], dst[order], piece[order], weight[order].astype(np.float64)
        self.row = np.searchsorted(self.src, np.arange(n + 1))
        back = np.zeros(n + 1)  # log of the weight of all ways to the chunk's end; a chunk's end is the next one's start
        left = stop - np.arange(n)
        by = np.lexsort((self.src, left[self.src]))
        edges = np.searchsorted(left[self.src][by], np.arange(1, (left.max() if n else 0) + 2))
        for d in range(len(edges) - 1):
            t = by[edges[d] : edges[d + 1]]
            ahead = np.where(self.dst[t] == stop[self.src[t]], 0.0, back[self.dst[t]])
            x, s = weight[t] + ahead, self.src[t]
            firsts = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
            top = np.maximum.reduceat(x, firsts)
            back[s[firsts]] = top + np.log(np.add.reduceat(np.exp(x - np.repeat(top, np.diff(np.append(firsts, len(s))))), firsts))
        ahead = np.where(self.dst == stop[self.src], 0.0, back[self.dst]) if n else np.empty(0)
        self.logp = np.minimum(0.0, weight + ahead - back[self.src])
        p = np.exp(self.logp)
        total = np.cumsum(p)
        before = np.concatenate([[0.0], total])[self.row[self.src]]
        self.step = self.src + np.clip(total - before, 0.0, 1.0)
        self.step[self.row[1:] - 1] = np.arange(1, n + 1)  # rows end at one exactly
        self.other = np.log1p(-np.minimum(p, 1.0 - 2.0**-53))
        self.other[np.diff(self.row)[self.src] == 1] = -np.inf
        self.prob = p

    def walk(self, chunk: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A sampled way through each chunk: transitions, chunk after chunk, and the number of each chunk's."""
        who = np.argsort(chunk, kind="stable")  # neighbours in the lattice are looked up together
        states, stops = self.start[chunk[who]], self.end[chunk[who]]
        rounds: list[tuple[np.ndarray, np.ndarray]] = []
        count = np.zeros(len(chunk), dtype=np.int64)
        while len(who):
            u = _uniform(key[who] + _U(len(rounds) + 1))
            t = np.searchsorted(self.step, states + u, side="right")
            rounds.append((who, t))
            count[who] += 1
            states = self.dst[t]
            on = states < stops
            states, stops, who = states[on], stops[on], who[on]
        begin = np.cumsum(count) - count
        out = np.empty(int(count.sum()), dtype=np.int64)
        for i, (w, t) in enumerate(rounds):
            out[begin[w] + i] = t
        return out, count


def _truncated(loc: np.ndarray, most: float, u: np.ndarray) -> np.ndarray:
    """Gumbel values at ``loc``, given that they are at most ``most``."""
    with np.errstate(divide="ignore"):
        return loc - np.logaddexp(loc - most, np.log(-np.log(u)))


def search(lattice: Lattice, chunk: np.ndarray, walks: list[tuple[np.ndarray, np.ndarray]], key: int, k: int):
    """Up to k distinct ways, best first: (transitions, log-probability, perturbed value), and the threshold."""
    base = _U(key)
    root = float(-np.log(-np.log(_uniform(np.array([base ^ _U(0xA5A5A5A5)], dtype=_U))))[0])
    found = []
    frontier: list[dict] = []

    def emit(path: np.ndarray, value: float, sample: int, since: int, used: set[int]) -> None:
        logp = lattice.logp[path]
        total = float(logp.sum())
        found.append((path, total, value))
        before = np.cumsum(logp) - logp
        loc = before[since:] + lattice.other[path[since:]]
        if since < len(path) and used:  # at the branching step all earlier choices are gone as well
            row = slice(lattice.row[lattice.src[path[since]]], lattice.row[lattice.src[path[since]] + 1])
            rest = float(lattice.prob[row].sum() - sum(lattice.prob[t] for t in used | {int(path[since])}))
            free = row.stop - row.start > len(used) + 1
            loc[0] = before[since] + np.log(rest) if free and rest > 1e-15 else -np.inf
        if len(loc):
            u = _uniform(base + (np.arange(since, len(path)).astype(_U) << _U(8)) + _U(sample + 0x51ED2701))
            frontier.append({"path": path, "since": since, "values": _truncated(loc, value, u), "used": used})

    emit(walks[0][0], root, 0, 0, set())
    while True:
        best = max(((float(f["values"].max()), i) for i, f in enumerate(frontier)), default=(-np.inf, -1), key=lambda x: (x[0], -x[1]))
        if len(found) == k or best[0] == -np.inf:
            return found, best[0]
        f, sample = frontier[best[1]], len(found)
        at = int(f["values"].argmax())
        f["values"][at] = -np.inf
        step = f["since"] + at
        taken = int(f["path"][step])
        gone = {taken} | (f["used"] if at == 0 else set())
        state = int(lattice.src[taken])
        options = np.array([t for t in range(lattice.row[state], lattice.row[state + 1]) if t not in gone])
        p = np.cumsum(lattice.prob[options])
        u = _uniform(base + _U(sample + 0x1234567) + (np.arange(256, dtype=_U) << _U(32)))
        t = int(options[min(np.searchsorted(p, u[0] * p[-1], side="right"), len(options) - 1)])
        # the rest of this chunk, then the fresh way through all later ones
        bounds = np.cumsum(walks[0][1]) if f["path"] is walks[0][0] else f["bounds"]
        which = int(np.searchsorted(bounds, step, side="right"))
        head, stop, more = [t], int(lattice.end[chunk[which]]), 1
        while lattice.dst[head[-1]] < stop:
            s = int(lattice.dst[head[-1]])
            draw = float(u[more]) if more < 256 else float(_uniform(np.array([base + _U(more * 2654435761 + sample)], dtype=_U))[0])
            head.append(int(np.searchsorted(lattice.step, s + draw, side="right")))
            more += 1
        fresh, counts = walks[sample]
        own = np.cumsum(counts)
        path = np.concatenate([f["path"][:step], np.array(head, dtype=np.int64), fresh[own[which] :]])
        old = np.diff(np.concatenate([[0], bounds]))
        lengths = np.concatenate([old[:which], [step - int(bounds[which] - old[which]) + len(head)], counts[which + 1 :]])
        size = len(frontier)
        emit(path, best[0], sample, step, gone)
        if len(frontier) > size:
            frontier[-1]["bounds"] = np.cumsum(lengths)


def _ids(lattice: Lattice, v: Vocabulary, path: np.ndarray) -> np.ndarray:
    ids = lattice.piece[path]
    spelt = np.flatnonzero(ids < 0)
    if not len(spelt):
        return ids
    codes = lattice.codes[lattice.src[path[spelt]]].astype(np.int64)
    if (codes < 0x80).all():  # one byte each, as line breaks are
        ids = ids.copy()
        ids[spelt] = v.byte_ids[codes]
        return ids
    out: list[int] = []
    for t, i in zip(path.tolist(), ids.tolist()):
        out += [i] if i >= 0 else v.byte_ids[list(chr(int(lattice.codes[lattice.src[t]])).encode("utf-8", "surrogatepass"))].tolist()
    return np.array(out, dtype=np.int64)


def sample_segmentations(v: Vocabulary, texts: list[str | None], keys: list, k: int, seed: int = 0) -> list[list[tuple[np.ndarray, float, float, float]]]:
    """For each text up to k (ids, log-probability, perturbed value, log inclusion probability), best first.

    A null text is empty; an empty text has one segmentation, of no pieces.
    """
    index: dict[str, int] = {}
    rows = []
    for text in texts:
        marked = (SPACE + text.replace(" ", SPACE)) if text else ""
        rows.append(np.array([index.setdefault(c, len(index)) for c in _CHUNK.findall(marked)], dtype=np.int64))
    lattice = Lattice(v, list(index))
    hashed = [xxhash.xxh3_64_intdigest(f"{seed}:{key}") for key in keys]
    sizes = np.array([len(r) for r in rows])
    chunk = np.concatenate([*rows, np.empty(0, dtype=np.int64)])
    place = np.concatenate([*map(np.arange, sizes), np.empty(0, dtype=np.int64)]).astype(_U)
    doc = np.repeat(np.array(hashed, dtype=_U), sizes)
    cuts = np.concatenate([[0], np.cumsum(sizes)])
    walks = []
    for j in range(k):
        path, count = lattice.walk(chunk, _mix(doc + (place << _U(20)) + (_U(j) << _U(52))))
        walks.append((path, count, np.concatenate([[0], np.cumsum(count)])))
    out = []
    for i in range(len(texts)):
        a, b = cuts[i], cuts[i + 1]
        if a == b:
            out.append([(np.empty(0, dtype=np.int64), 0.0, 0.0, 0.0)])
            continue
        own = [(path[e[a] : e[b]], count[a:b]) for path, count, e in walks]
        found, threshold = search(lattice, chunk[a:b], own, hashed[i], k)
        result = []
        for path, logp, value in found:
            x = logp - threshold
            inclusion = 0.0 if threshold == -np.inf else float(x if x < -30 else np.log(-np.expm1(-np.exp(min(x, 700)))))
            result.append((_ids(lattice, v, path), logp, value, inclusion))
        out.append(result)
    return out


@lru_cache(maxsize=2)
def vocabulary(path: str, alpha: float = 1.0) -> Vocabulary:
    return Vocabulary(path, alpha)


SAMPLES = "doc_id long, no_id boolean, rank int, ids array<int>, log_prob double, perturbed double, log_inclusion double"
DIGESTS = "doc_id long, no_id boolean, rank int, n_pieces long, ids_crc32 long, log_prob double, perturbed double, log_inclusion double, round_trip boolean"


def _batches(df: pd.DataFrame) -> Iterator[pd.DataFrame]:
    size = np.cumsum(df["text"].str.len().fillna(0).to_numpy())
    for _, part in df.groupby((size // BATCH_CHARS).astype(np.int64), sort=False):
        yield part


def encode_documents(docs: DataFrame, model: str, k: int = 2, seed: int = 0, alpha: float = 1.0, digest: bool = False) -> DataFrame:
    """k sampled segmentations of every whole text, distinct, best perturbed value first (fewer if there are fewer).

    Keyed by doc_id: rows with one id and text get the same samples. Null text: empty,
    one segmentation of no pieces. ``digest``: counts and checksums in place of ids, and
    whether decoding gives the text back. Other columns are ignored.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        v = vocabulary(model, alpha)
        for df in batches:
            for part in _batches(df):
                rows = []
                keys = [None if none else key for key, none in zip(part["doc_id"].tolist(), part["no_id"])]
                for doc_id, no_id, text, found in zip(part["doc_id"], part["no_id"], part["text"], sample_segmentations(v, part["text"].tolist(), keys, k, seed)):
                    for rank, (ids, logp, value, inclusion) in enumerate(found, 1):
                        if digest:
                            rows.append((doc_id, no_id, rank, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), logp, value, inclusion, v.decode(ids.tolist()) == (text or "")))
                        else:
                            rows.append((doc_id, no_id, rank, ids.astype(np.int32), logp, value, inclusion))
                out = pd.DataFrame(rows, columns=[c.split()[0] for c in (DIGESTS if digest else SAMPLES).split(", ")])
                yield out

    found = docs.select(*rowids.apart(), "text").mapInPandas(run, DIGESTS if digest else SAMPLES)
    return found.select(rowids.together(), *found.columns[2:])


def decode_documents(encoded: DataFrame, model: str) -> DataFrame:
    """The rows of ``encode_documents`` with their decoded text in place of ids; null ids: null."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        v = vocabulary(model)
        for df in batches:
            yield df[["doc_id", "no_id", "rank"]].assign(text=[None if ids is None else v.decode(list(ids)) for ids in df["ids"]])

    texts = encoded.select(*rowids.apart(), "rank", "ids").mapInPandas(run, "doc_id long, no_id boolean, rank int, text string")
    return texts.select(rowids.together(), "rank", "text")
