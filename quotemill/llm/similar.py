"""Near-duplicates of a stated shingle similarity.

SimHash balls, as in :mod:`simhash`, cannot be had at a similarity of 0.8: two texts
with 0.8 of their shingles in common differ in some 10 to 16 of 64 bits, and all
variants within half of that number in millions for each text. So texts meet on
``BANDS`` keys of ``ROWS`` minima of salted shingle hashes, which two texts of
similarity s share with a probability of 1 - (1 - s^ROWS)^BANDS: 0.9999 at 0.8, and
1 in 30 at 0.3, as of texts that have a passage in common. A sketch of 128 bits, one
from each of as many minima, rules out what is far apart, and exact sets of shingles
decide. Equal sets are one node from the start. SimHash fingerprints within a radius, by
the balls of :mod:`simhash`, link texts as well where a radius is given: it finds copies
with edits that leave the fingerprint, the minima find the rest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotemill.llm.components import connected_components
from quotemill.llm.idfilter import may_contain
from quotemill.llm.meeting import components_of, meetings
from quotemill.llm.scratch import discard, materialize
from quotemill.llm.simhash import fingerprint_links, fingerprint_of
from quotemill.llm.words import shingle_hashes

ROWS, BANDS = 6, 32
MINIMA = ROWS * BANDS
#: Of 128 sketch bits. At a similarity of 0.8 a tenth differs, 13 with a deviation of 3.4; FAR is over four deviations away.
FAR = 28
#: Texts of up to MANY shingles take the minima of salted hashes, those of over FEW the minima of parts of one hash; between them both, so that all similar texts share a kind.
FEW, MANY = 1000, 1250
#: Rows that share a partner are dealt over so many tasks.
SALT = 16
_U = np.uint64
_ODD = np.random.default_rng(1).integers(0, 2**63, MINIMA, dtype=np.uint64) * _U(2) + _U(1)
_BLOCK = 1 << 12


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def shingle_set(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct 64-bit names of the n-word shingles of a text, A-Z lower-cased.

    A name is mixed from the hashes of the shingle's words in their order. Fewer than
    n words: one shingle of all; none: an empty set.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, dtype=_U)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=_U, count=len(words))
    n = min(n, len(words))
    out = np.zeros(len(words) - n + 1, dtype=_U)
    for i in range(n):
        out = (out ^ h[i : len(h) - n + 1 + i]) * _U(0x9E3779B97F4A7C15)
        out ^= out >> _U(32)
    return np.unique(_mix(out))


def _salted(names: np.ndarray) -> np.ndarray:
    out = np.full(MINIMA, 2**64 - 1, dtype=_U)
    for at in range(0, len(names), _BLOCK // 16):
        product = names[at : at + _BLOCK // 16, None] * _ODD[None, :]
        np.minimum(out, product.min(axis=0), out=out)
    return out


def _parted(names: np.ndarray) -> np.ndarray:
    """The least name of each of ``MINIMA`` parts; an empty part takes over the next one's."""
    part = (names % _U(MINIMA)).astype(np.int64)
    out = np.zeros(MINIMA, dtype=_U)
    full = np.zeros(MINIMA, dtype=bool)
    out[part[::-1]] = names[::-1]  # of repeated places the last value stays: the least name
    full[part] = True
    at = np.flatnonzero(full)
    taken = at[np.searchsorted(at, np.arange(MINIMA)) % len(at)]
    return out[taken] + _U(0x9E3779B97F4A7C15) * ((np.arange(MINIMA) - taken) % MINIMA).astype(_U)


def _keys(minima: np.ndarray, kind: int) -> np.ndarray:
    banded = minima.reshape(BANDS, ROWS)
    key = np.arange(BANDS, dtype=_U) + _U(kind * BANDS)
    for i in range(ROWS):
        key = _mix(key * _U(0x9E3779B97F4A7C15) + banded[:, i])
    return key


def marks_of(names: np.ndarray) -> tuple[list[int], list[bytes]]:
    """Signed meeting keys of a set of shingles, and its sketch of 128 bits of each kind of minima (empty where it takes none)."""
    keys, sketch = [], []
    for kind, (wanted, minima) in enumerate(((len(names) <= MANY, _salted), (len(names) > FEW, _parted))):
        if wanted and len(names):
            found = minima(names)
            keys.append(_keys(found, kind))
            bits = (_mix(found[:128]) & _U(1)).astype(np.uint8)
            sketch.append(np.packbits(bits).tobytes())
        else:
            sketch.append(b"")
    return np.concatenate(keys).view(np.int64).tolist() if keys else [], sketch


def _near(a: str, b: str) -> Column:
    """Whether the sketches of a kind that both have are not far apart."""
    bits = lambda w: F.bit_count(F.col(f"{a}.{w}").bitwiseXOR(F.col(f"{b}.{w}")))
    return F.coalesce(bits("w0") + bits("w1") <= FAR, F.lit(False)) | F.coalesce(bits("w2") + bits("w3") <= FAR, F.lit(False))


def _with_fingerprints(classes: DataFrame, marked: DataFrame, radius: int) -> DataFrame:
    """(node, component) over links of ``classes`` and those of fingerprints at most ``radius`` bits apart."""
    balls = connected_components(fingerprint_links(marked.select("fp").distinct(), radius))
    held = marked.select("fp", F.col("s1").alias("a")).distinct()
    held = held.join(balls.withColumnRenamed("node", "fp"), "fp", "left").select("a", F.coalesce("component", "fp").alias("ball")).distinct()
    hubs = held.groupBy("ball").agg(F.min("a").alias("b"), F.count("*").alias("n")).where("n > 1")
    edges = held.join(hubs, "ball").where("a <> b").select("a", "b")
    out = connected_components(edges.unionAll(classes.select(F.col("node").alias("a"), F.col("component").alias("b"))))
    discard(balls, classes)
    return out


def similar_classes(docs: DataFrame, words: int = 5, similarity: float = 0.8, radius: int | None = None) -> DataFrame:
    """doc_id, row, component_id (the least id of its group) and keep, of every document.

    Documents whose sets of ``words``-word shingles have at least the similarity are
    linked, and so are, where ``radius`` is given, those whose SimHash fingerprints (of
    three-word shingles, as in op10) differ in at most so many bits. Texts of fewer words
    are one shingle; null and empty texts have none and are alike. ``row`` is a hash of the text: rows that share an id and differ in text
    are documents of their own, rows that share both are one, and ``keep`` is true for
    the first of a group by (doc_id, row). Null ids are left out. An empty table gives
    an empty result; other columns are ignored.
    """
    known = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketches = [f"w{i}" for i in range(4)]

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            rows = []
            for text in df["text"]:
                names = shingle_set(text, words)
                digest = np.frombuffer(xxhash.xxh3_128_digest(names.tobytes()), dtype=np.int64)
                keys, sketch = marks_of(names)
                fp = 0 if radius is None else fingerprint_of(shingle_hashes(text, 3, 42))
                rows.append((*digest.tolist(), fp - (fp >> 63 << 64), len(names), *[x for s in sketch for x in (np.frombuffer(s, dtype=np.int64).tolist() or (None, None))], keys))
            found = pd.DataFrame(rows, columns=["s1", "s2", "fp", "n", *sketches, "keys"]).astype({w: "Int64" for w in sketches})
            yield pd.concat([df[["doc_id", "row"]].reset_index(drop=True), found], axis=1)

    schema = "doc_id long, row long, s1 long, s2 long, fp long, n int, " + ", ".join(f"{w} long" for w in sketches) + ", keys array<long>"
    marked = materialize(known.select("doc_id", F.xxhash64("text").alias("row"), "text").mapInPandas(scan, schema), "near-marked")
    # equal sets are one node
    own = [F.min(F.struct("doc_id", "row")).alias("first"), F.first("n").alias("n"), F.first(F.struct(*sketches)).alias("sig"), F.first("keys").alias("keys")]
    nodes = materialize(marked.groupBy("s1", "s2").agg(*own).withColumn("node", F.col("s1")), "near-nodes")
    met = meetings(nodes.select(F.explode("keys").alias("key"), "node"), "near-met")
    wanted = materialize(nodes.join(met.select("node").distinct(), "node", "left_semi").select("first.doc_id").distinct(), "near-wanted")

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            raw = [shingle_set(t, words).tobytes() for t in df["text"]]
            yield pd.DataFrame({"node": [int(np.frombuffer(xxhash.xxh3_128_digest(r), dtype=np.int64)[0]) for r in raw], "names": raw})

    some = known.where(may_contain(wanted, "doc_id")(F.col("doc_id"))).join(wanted, "doc_id", "left_semi").select("text")
    texts = materialize(some.mapInPandas(sets, "node long, names binary").dropDuplicates(["node"]), "near-sets")

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            good = []
            for x, y in zip(df["x"], df["y"]):
                x, y = np.frombuffer(x, dtype=_U), np.frombuffer(y, dtype=_U)
                both = np.intersect1d(x, y, assume_unique=True).size
                good.append(both >= similarity * (len(x) + len(y) - both) - 1e-9)
            yield df.loc[good, ["a", "b"]]

    def linked(pairs: DataFrame) -> DataFrame:
        side = lambda c, s, n: nodes.select(F.col("node").alias(c), F.col("sig").alias(s), F.col("n").alias(n))
        both = pairs.join(side("a", "sa", "na"), "a").join(side("b", "sb", "nb"), "b")
        both = both.where(_near("sa", "sb") & (F.least("na", "nb") >= similarity * F.greatest("na", "nb") - 1e-9)).select("a", "b")
        both = materialize(both.withColumn("salt", F.pmod(F.xxhash64("a"), F.lit(SALT)).cast("int")), "near-pairs")
        x = texts.select(F.col("node").alias("a"), F.col("names").alias("x"))
        # the least member of a large group is a partner of all its rows
        y = texts.select(F.col("node").alias("b"), F.col("names").alias("y")).join(both.select("b", "salt").distinct(), "b")
        return both.join(x, "a").join(y, ["b", "salt"]).select("a", "b", "x", "y").mapInPandas(check, "a long, b long")

    classes = components_of(met, linked, "near", nodes.select("node", "sig"), (_near,))
    if radius is not None:
        classes = _with_fingerprints(classes, marked, radius)
    named = nodes.join(classes, "node", "left").select("s1", "s2", "first", F.coalesce("component", "node").alias("component"))
    least = named.groupBy("component").agg(F.min("first").alias("group"))
    named = materialize(named.join(least, "component").select("s1", "s2", F.col("group.doc_id").alias("component_id"), F.col("group.row").alias("component_row")), "near-named")
    discard(met, wanted, texts, nodes)
    keep = (F.col("doc_id") == F.col("component_id")) & (F.col("row") == F.col("component_row"))
    return marked.select("doc_id", "row", "s1", "s2").join(named, ["s1", "s2"]).select("doc_id", "row", "component_id", keep.alias("keep"))
