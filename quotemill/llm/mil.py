"""Quality classifier: gated-attention multiple-instance learning over passages.

A document is a bag of passages of ``PASSAGE`` words. A passage is described by its
words and pairs of words, lower-cased and hashed into ``BUCKETS`` slots, and by ratios
of its characters; a learned layer encodes both, gated attention weighs the passages,
and a linear layer scores the weighted mean. Only document labels are used; the weights
of the passages are learned with the rest. Training uses a bounded, documented sample
of labelled documents (``SAMPLE``), of each at most ``FIT_PASSAGES`` passages spread over
the text; scoring reads every passage of every document.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

PASSAGE = 50
SAMPLE = 12_000
#: Passages of one document that fitting takes; scoring takes all.
FIT_PASSAGES = 16
#: Slots for hashed words and pairs of words.
BUCKETS = 256
_KINDS = ("lower", "upper", "digit", "blank", "line", "stop", "comma", "bang", "hash", "money", "bar", "punct", "lead", "more")
RATIOS = 20
FEATURES = RATIOS + BUCKETS
#: Words weigh only where they tell more than this pull towards nothing: with few labelled documents each would be learned by heart.
#: An inner split of the learned rows puts this value first of three (README).
WORD_DECAY = 0.02


def _kind_table() -> np.ndarray:
    at = {k: i for i, k in enumerate(_KINDS)}
    table = np.full(256, at["punct"], dtype=np.int64)
    table[:33] = at["blank"]
    for chars, kind in (("abcdefghijklmnopqrstuvwxyz", "lower"), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "upper"), ("0123456789", "digit"), ("\n", "line"), (".?:;", "stop"), (",", "comma"), ("!", "bang"), ("#", "hash"), ("$%&*", "money"), ("|", "bar")):
        table[[ord(c) for c in chars]] = at[kind]
    table[128:192] = at["more"]
    table[192:] = at["lead"]
    return table


_TABLE = _kind_table()
_SOLID = ~np.isin(np.arange(256), (32, 9, 10, 11, 12, 13))


def passage_features(text: str | None, passage: int = PASSAGE) -> np.ndarray:
    """One row of FEATURES numbers for each passage; an empty or null text has one empty passage.

    Pairs of words lie within one passage. Slots hold square roots of shares, so that
    the frequent words of a passage do not outweigh the others.
    """
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    if not words:
        return np.zeros((1, FEATURES), dtype=np.float32)
    codes = np.frombuffer(raw, dtype=np.uint8)
    solid = _SOLID[codes]
    begins = np.flatnonzero(solid & ~np.concatenate([[False], solid[:-1]]))
    heads = begins[::passage]
    n = len(heads)
    of = np.zeros(len(codes), dtype=np.int64)
    of[heads[1:]] = 1
    of = np.cumsum(of)
    kinds = _TABLE[codes]
    c = np.bincount(of * len(_KINDS) + kinds, minlength=n * len(_KINDS)).reshape(n, -1).astype(np.float64)
    own = np.arange(len(words)) // passage
    count = np.bincount(own, minlength=n).astype(np.float64)
    ids = np.fromiter(map(xxhash.xxh3_64_intdigest, raw.lower().split()), dtype=np.uint64, count=len(words))
    pairs = (ids[:-1] * np.uint64(0x9E3779B97F4A7C15) + ids[1:]) >> np.uint64(32)
    inside = own[1:] == own[:-1]
    slots = np.concatenate([own * BUCKETS + (ids % np.uint64(BUCKETS)).astype(np.int64), (own[1:] * BUCKETS + (pairs % np.uint64(BUCKETS)).astype(np.int64))[inside]])
    shares = np.sqrt(np.bincount(slots, minlength=n * BUCKETS).reshape(n, BUCKETS).astype(np.float32) / count[:, None].astype(np.float32))
    sizes = np.fromiter(map(len, words), dtype=np.float64, count=len(words))
    same = np.zeros(len(words))
    same[1:] = (ids[1:] == ids[:-1]) & (own[1:] == own[:-1])
    order = np.lexsort((ids, own))
    fresh = np.ones(len(words))
    fresh[1:] = (ids[order][1:] != ids[order][:-1]) | (own[order][1:] != own[order][:-1])
    first = kinds[begins]
    letters = c[:, 0] + c[:, 1] + c[:, 12] + 1
    mean = np.bincount(own, sizes, n) / count
    x = [c[:, 1] / letters, c[:, 2] / letters, c[:, 12] / letters]
    x += [c[:, k] / count for k in (4, 5, 6, 7, 8, 9, 10, 11)]
    x += [np.bincount(own, fresh[np.argsort(order)], n) / count, np.bincount(own, same, n) / count]
    x += [np.bincount(own, first == 1, n) / count, np.bincount(own, first == 0, n) / count]
    x += [mean / 10, np.sqrt(np.maximum(0, np.bincount(own, sizes**2, n) / count - mean**2)) / 10, np.bincount(own, sizes > 20, n) / count]
    x += [np.log1p(count) / 5, np.ones(n)]
    return np.concatenate([np.minimum(np.stack(x, axis=1), 5).astype(np.float32), shares], axis=1)


def _spread(bag: np.ndarray, most: int = FIT_PASSAGES) -> np.ndarray:
    """At most so many passages, evenly spread from the first to the last."""
    return bag if len(bag) <= most else bag[np.linspace(0, len(bag) - 1, most).astype(np.int64)]


@dataclass
class Model:
    """x -> tanh(x W + w) = h; a = softmax((tanh(h V) * sigmoid(h U)) g); score = sigmoid(sum(a h) . c + b)."""

    params: dict[str, np.ndarray]
    shift: np.ndarray
    scale: np.ndarray

    def score(self, bags: list[np.ndarray]) -> np.ndarray:
        if not bags:
            return np.empty(0)
        params = {k: p.astype(np.float32) for k, p in self.params.items()}
        out = []
        for i in range(0, len(bags), 2000):
            some = bags[i : i + 2000]
            starts = np.cumsum([0, *(len(b) for b in some[:-1])])
            x = (np.concatenate(some).astype(np.float32) - self.shift.astype(np.float32)) / self.scale.astype(np.float32)
            out.append(_forward(params, x, starts)["p"].astype(np.float64))
        return np.concatenate(out)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _forward(q: dict[str, np.ndarray], x: np.ndarray, starts: np.ndarray) -> dict[str, np.ndarray]:
    sizes = np.diff(np.append(starts, len(x)))
    of = np.repeat(np.arange(len(starts)), sizes)
    h = np.tanh(x @ q["W"] + q["w"])
    t, s = np.tanh(h @ q["V"]), _sigmoid(h @ q["U"])
    e = (t * s) @ q["g"]
    e = np.exp(e - np.maximum.reduceat(e, starts)[of])
    a = e / np.add.reduceat(e, starts)[of]
    z = np.add.reduceat(a[:, None] * h, starts, axis=0)
    return {"of": of, "h": h, "t": t, "s": s, "a": a, "z": z, "p": _sigmoid(z @ q["c"] + q["b"])}


def _gradients(q: dict[str, np.ndarray], x: np.ndarray, starts: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    f = _forward(q, x, starts)
    of, h, t, s, a = f["of"], f["h"], f["t"], f["s"], f["a"]
    dy = (f["p"] - y) / len(y)
    dz = dy[:, None] * q["c"]
    da = (h * dz[of]).sum(axis=1)
    de = a * (da - np.add.reduceat(a * da, starts)[of])
    dts = de[:, None] * q["g"]
    dt, ds = dts * s * (1 - t**2), dts * t * s * (1 - s)
    dh = a[:, None] * dz[of] + dt @ q["V"].T + ds @ q["U"].T
    dp = dh * (1 - h**2)
    return {"W": x.T @ dp, "w": dp.sum(axis=0), "V": h.T @ dt, "U": h.T @ ds, "g": (t * s).T @ de, "c": f["z"].T @ dy, "b": dy.sum(keepdims=True)}


def fit(bags: list[np.ndarray], labels: np.ndarray, *, epochs: int = 40, hidden: int = 16, attention: int = 8, batch: int = 256, rate: float = 0.01, seed: int = 7) -> Model:
    """Fit by Adam on the log loss; the same bags in the same order give the same model.

    No bags, or labels of one class only: a model that scores the share of ones
    (one half without any) for every document.
    """
    rng = np.random.default_rng(seed)
    width = bags[0].shape[1] if bags else FEATURES
    q = {"W": rng.normal(0, width**-0.5, (width, hidden)), "w": np.zeros(hidden), "V": rng.normal(0, hidden**-0.5, (hidden, attention)), "U": rng.normal(0, hidden**-0.5, (hidden, attention)), "g": rng.normal(0, attention**-0.5, attention), "c": rng.normal(0, hidden**-0.5, hidden), "b": np.zeros(1)}
    labels = np.asarray(labels, dtype=np.float64)
    if not bags or labels.min() == labels.max():
        q["c"][:] = 0
        share = np.clip(labels.mean() if bags else 0.5, 1e-3, 1 - 1e-3)
        q["b"][:] = np.log(share / (1 - share))
        return Model(q, np.zeros(width), np.ones(width))
    decay = {k: np.full_like(p, 1e-5) for k, p in q.items()}
    decay["W"][RATIOS:] = WORD_DECAY
    q["W"][RATIOS:] *= 0.1
    count = sum(map(len, bags))  # bags are never copied as a whole
    shift = sum(b.sum(axis=0, dtype=np.float64) for b in bags) / count
    scale = np.sqrt(sum(((b - shift) ** 2).sum(axis=0) for b in bags) / count)
    scale[scale < 1e-6] = 1
    scale[RATIOS:] = np.maximum(scale[RATIOS:], 0.1)  # rare words are not blown up
    m, v, step = {k: np.zeros_like(p) for k, p in q.items()}, {k: np.zeros_like(p) for k, p in q.items()}, 0
    for epoch in range(epochs):
        order = rng.permutation(len(bags))
        for i in range(0, len(bags), batch):
            some = order[i : i + batch]
            x = (np.concatenate([bags[j] for j in some]) - shift) / scale
            starts = np.cumsum([0, *(len(bags[j]) for j in some[:-1])])
            grad, step = _gradients(q, x, starts, labels[some]), step + 1
            for k in q:
                g = grad[k] + decay[k] * q[k]
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                q[k] = q[k] - rate * (1 - epoch / epochs) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return Model(q, shift, scale)


def held_out(doc_id: Column) -> Column:
    """Whether a document's labels are never learned from."""
    return F.crc32(doc_id.cast("string")) % 5 == 0


BAG = "doc_id long, quality int, n int, x binary"


def _packed(bag: np.ndarray) -> bytes:
    """A bag on its way to the driver: most slots are empty, so it shrinks several times."""
    return zlib.compress(bag.tobytes(), 1)


def _unpacked(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(zlib.decompress(raw), dtype=np.float32).reshape(n, -1)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on at most ``sample`` labelled documents, those of least hashed id, held-out ones left out.

    Null texts count as empty; rows without an id or a label of 0 or 1 are not learned
    from, nor are ids that have both labels. Of the texts of one id the least counts, so
    what the driver gets is bounded by ``sample`` times FIT_PASSAGES rows of FEATURES
    numbers, compressed on the way. Empty tables give a model that scores one half.
    """
    marked = labels.select(F.col("doc_id").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("quality in (0, 1) and doc_id is not null")
    chosen = marked.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("other")).where("quality = other").drop("other")
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            found = [_spread(passage_features(t)) for t in df["text"]]
            yield pd.DataFrame({"doc_id": df["doc_id"], "quality": df["quality"], "n": [len(b) for b in found], "x": [_packed(b) for b in found]})

    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "quality").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    rows = texts.mapInPandas(scan, BAG).toPandas().sort_values("doc_id")
    bags = [_unpacked(x, n) for n, x in zip(rows["n"], rows["x"])]
    return fit(bags, rows["quality"].to_numpy())


def quality_score(model: Model, text: Column) -> Column:
    """Score of a whole text, 0 to 1; a null text scores as an empty one."""

    @pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(np.concatenate([np.empty(0), *(model.score([passage_features(t) for t in texts.iloc[i : i + 500]]) for i in range(0, len(texts), 500))]))

    return score(text)


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """All columns of ``docs`` with quality_score and quality_keep added."""
    model = train(docs, labels)
    scored = docs.withColumn("quality_score", quality_score(model, F.col("text")))
    return scored.withColumn("quality_keep", F.col("quality_score") >= threshold)
