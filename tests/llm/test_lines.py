import hashlib
import re

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import functions as F

from quotemill.llm import lines

SCHEMA = "doc_id long, text string, at int, byte int"


def norm(line):
    return [w for w in re.split(lines.BETWEEN, line.lower()) if w]


def simhash(words):
    h = [xxhash.xxh64_intdigest(w.encode(), 42) for w in words]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def distance(a, b):
    row = np.arange(len(b) + 1)
    y = np.array([ord(c) for c in b])
    for i, c in enumerate(a, 1):
        new = np.minimum(row[1:] + 1, row[:-1] + (y != ord(c)))
        new = np.concatenate([[i], new])
        row = np.minimum.accumulate(new - np.arange(len(new))) + np.arange(len(new))
    return int(row[-1])


def brute(docs):
    """Kept texts by all pairs of lines."""
    where = {}
    for d, t in docs:
        for i, line in enumerate((t or "").split("\n")):
            if w := norm(line):
                where.setdefault(tuple(w), []).append((d, i))
    keys = list(where)
    prints = [simhash([w for w in k for _ in range(2 if len(w) >= lines.LETTERS else 1)]) for k in keys]
    parent = list(range(len(keys)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(keys)):
        for j in range(i + 1, len(keys)):
            if min(len(keys[i]), len(keys[j])) >= lines.FEW_WORDS and bin(prints[i] ^ prints[j]).count("1") > lines.RADIUS:
                continue
            a, b = " ".join(keys[i]), " ".join(keys[j])
            if distance(a, b) <= int(max(len(a), len(b)) * (1 - lines.SIMILARITY) + 1e-9):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    groups = {}
    for i, k in enumerate(keys):
        groups.setdefault(root(i), []).extend(where[k])
    gone = {o for g in groups.values() for o in g if o != min(g)}
    return {d: None if t is None else "\n".join(line for i, line in enumerate(t.split("\n")) if (d, i) not in gone) for d, t in docs}


def fixture():
    rng = np.random.default_rng(3)
    words = ["alpha", "beta", "gamma", "delta", "river", "stone", "light", "Über", "naïve", "x1", "run", "far"]
    base = [[words[i] for i in rng.integers(0, len(words), 60)] for _ in range(12)]
    docs = []
    for d in range(60):
        text = []
        for _ in range(4):
            line = list(base[rng.integers(len(base))])
            for _ in range(rng.integers(0, 3)):
                line[rng.integers(len(line))] = words[rng.integers(len(words))] + "s"
            text.append(" ".join(line) + str(rng.choice(["", ".", " !!"])))
        text.append("Common footer line.")
        text.append(f"unique line number {d}" if d % 3 else "  ")
        docs.append((d, "\n".join(text)))
    return [*docs, (100, None), (101, ""), (102, "\n\n"), (103, "common FOOTER line"), (104, ("word " * 3000).strip()), (105, "Common footer line.")]


def test_matches_brute_force(spark):
    docs = fixture()
    df = spark.createDataFrame([(d, t, 1, 2) for d, t in docs], SCHEMA)
    got = {r["doc_id"]: r["text"] for r in lines.dedup_lines(df).collect()}
    assert got == brute(docs)


def test_simhash_is_exact_for_long_lines(spark):
    texts = ["one two three", "once more we try this with seven", "a " * 40000 + "b c"]
    df = spark.createDataFrame(list(enumerate(" ".join(norm(t)) for t in texts)), "node long, norm string")
    got = {r["node"]: r["sig"] for r in lines.with_simhash(df).collect()}
    assert got[0] is None  # too few words
    for i in (1, 2):
        assert got[i] & (2**64 - 1) == simhash([w for w in norm(texts[i]) for _ in range(2 if len(w) >= lines.LETTERS else 1)])


def test_empty_table_and_repeated_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert lines.dedup_lines(empty).collect() == []
    twice = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (2, "a b c\nother"), (None, "a b c")], "doc_id long, text string")
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"]) for r in lines.dedup_lines(twice).collect())
    assert got == [(False, 1, "a b c"), (False, 1, "a b c"), (False, 2, "other"), (True, 0, "a b c")]


def test_replaced_words_and_typos_are_linked(spark):
    rng = np.random.default_rng(11)
    letters = list("abcdefghijklmnopqrstuvwxyz")
    word = lambda: "".join(rng.choice(letters, rng.integers(3, 9)))
    docs, wanted = [], 0
    for n in (5, 8, 12, 20, 30, 40):
        for k in range(40):
            line = [word() for _ in range(n)]
            copy, at = list(line), int(rng.integers(n))
            copy[at] = word() if k % 2 else copy[at][:-1] + "é"
            a, b = " ".join(line), " ".join(copy)
            if distance(a, b) <= int(max(len(a), len(b)) * (1 - lines.SIMILARITY) + 1e-9):
                wanted += 1
                docs += [(2 * wanted, a), (2 * wanted + 1, b)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    removed = [r["doc_id"] for r in lines.dedup_lines(df).collect() if r["n_removed"]]
    assert all(d % 2 for d in removed)
    assert wanted > 200 and len(removed) >= 0.97 * wanted


def test_no_pair_that_meets_is_left_out_by_words_bits_or_length(spark):
    rng = np.random.default_rng(17)
    letters = list("abcdefghijklmnopqrstuvwxyz")
    word = lambda n: "".join(rng.choice(letters, n))
    texts = []
    for n in (5, 8, 15, 30):  # a typo in each word: other words and bits, like characters
        line = [word(8) for _ in range(n)]
        texts += [" ".join(line), " ".join(w[:3] + "é" + w[4:] for w in line), " ".join(w[:3] + "éé" + w[5:] for w in line)]
    long = word(5000)
    texts += [long, "é" + long[1:-1] + "é", long[:3000] + word(2000), " ".join(word(4) for _ in range(1200))]
    df = spark.createDataFrame(list(enumerate(texts)), "node long, norm string")
    table = lines.with_simhash(df).select("node", "sig", "norm", lines.spelt_by_words(F.col("norm")).alias("spelt"), lines.longest_word(F.col("norm")).alias("longest"))
    pairs = [(i, j) for i in range(len(texts)) for j in range(i)]
    got = {tuple(r) for r in lines._linked(spark.createDataFrame(pairs, "a long, b long"), table).collect()}
    allowed = lambda x, y: int(max(len(x), len(y)) * (1 - lines.SIMILARITY) + 1e-9)
    room = lambda x, y: abs(len(x) - len(y)) <= allowed(x, y)
    assert got == {(i, j) for i, j in pairs if room(texts[i], texts[j]) and distance(texts[i], texts[j]) <= allowed(texts[i], texts[j])}
    assert {(1, 0), (4, 3), (7, 6), (10, 9), (13, 12)} <= got


def test_long_lines_of_one_word_are_linked(spark):
    long = "".join(np.random.default_rng(18).choice(list("abcdefghijklmnopqrstuvwxyz"), 5000))
    df = spark.createDataFrame([(1, long), (2, "é" + long[1:-1] + "é")], "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in lines.dedup_lines(df).collect()} == {1: 0, 2: 1}
