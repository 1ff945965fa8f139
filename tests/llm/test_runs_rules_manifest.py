"""Periodic runs, quality rules and Merkle manifests against brute force."""

import hashlib
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quotemill.llm import merkle, quality_rules, runs
from quotemill.llm.queries import op11, op12, op13


def brute_runs(w, least=24, periods=3):
    found = set()
    for p in range(1, len(w) // 2 + 1):
        i = 0
        while i + p < len(w):
            start = i
            while i + p < len(w) and w[i] == w[i + p]:
                i += 1
            size = i - start + p
            if i > start and size >= max(least, periods * p):
                part = w[start : start + size]
                if all(any(part[k] != part[k + q] for k in range(size - q)) for q in range(1, p)):
                    found.add((start, size, p))
            i += i == start
    return sorted(found, key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("least,periods", [(24, 3), (6, 3), (4, 2)])
def test_runs_match_brute_force(least, periods):
    rng = np.random.default_rng(3)
    for _ in range(150):
        texts = []
        for n in rng.choice([0, 1, 2, 7, 40, 130], size=3):
            w = [b"%d" % x for x in rng.integers(0, rng.choice([1, 2, 4]), n)]
            if n and rng.random() < 0.6:
                a = int(rng.integers(n))
                p = 1 + (n - a) // int(rng.integers(3, 9))
                w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
            texts.append(w)
        assert runs.find_runs(texts, least, periods) == [brute_runs(w, least, periods) for w in texts]


def test_lcp_and_next_smaller():
    rng = np.random.default_rng(4)
    values = rng.permutation(77)
    want = [next((k for k in range(i + 1, 77) if values[k] < values[i]), 77) for i in range(77)]
    assert runs.next_smaller(values).tolist() == want
    symbols = np.append(rng.integers(1, 3, 90), 0)
    lcp = runs.CommonPrefixes(symbols, *runs.suffix_ranks(symbols))
    i, j = np.meshgrid(np.arange(90), np.arange(90))
    i, j = i[i != j], j[i != j]
    for a, b, n in zip(i.tolist(), j.tolist(), lcp.of(i, j).tolist()):
        assert (symbols[a : a + n] == symbols[b : b + n]).all() and symbols[a + n] != symbols[b + n]


def test_query_of_runs(make_docs, spark, tmp_path):
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 40, int(n))) for n in rng.integers(0, 200, 60)] + [None, "", "  ", "a " * 60, "x y\tz\n" * 400]
    ids = list(range(len(texts)))
    docs = make_docs(texts, ids)
    docs.unionAll(docs.where("doc_id = 63")).write.parquet(f"{tmp_path}/documents.parquet")  # a repeated row
    rows = op11.run(spark, str(tmp_path)).collect()
    assert len(rows) == len(texts) + 1 and sum(r.n_runs > 0 for r in rows) > 4
    for r in rows:
        w, h = (texts[r.doc_id] or "").split(), zlib.crc32(str(r.doc_id).encode())
        if h % 10 == 0 and w:
            g, n = h // 10, len(w)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        found = brute_runs(w)
        gone = {k for s, n, p in found for k in range(s + p, s + n)}
        top = sorted(found, key=lambda x: (-x[1] / x[2], x[0], x[2]))[0] if found else (None,) * 3
        assert (r.n_runs, r.start, r.length, r.period) == (len(found), *top)
        assert r.exponent_milli == (1000 * top[1] // top[2] if found else None)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{p}\n" for s, n, p in found).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest()


def test_runs_of_empty_table_and_null_id(spark, make_docs):
    assert runs.periodic_runs(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    row = runs.periodic_runs(make_docs(["a " * 30], [2**60]).withColumn("doc_id", F.lit(None).cast("long"))).first()
    assert (row.doc_id, row.text, row.spans[0].length) == (None, "a", 30)


def test_base_counts_match_brute_force(make_docs):
    rng = np.random.default_rng(6)
    words = ["the", "of", "a", "É", "#tag", "x|y", "B2.", "1"]
    texts = [" ".join(words[i] for i in rng.integers(0, len(words), int(n))) for n in rng.integers(0, 90, 50)]
    texts += [None, "", " \t\n", "a b c", "l\n l\nl\n\n \nl", "a b c a b c", "the of a " * 40, texts[0]]
    rows = {r.doc_id: r for r in quality_rules.judge(make_docs(texts)).collect()}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        t = t or ""
        w = t.split()
        tri = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        many = Counter(tri)
        repeat = len({k + o for k, g in enumerate(tri) if many[g] > 1 for o in range(3)})
        lines = [x for x in t.split("\n") if x.split()]
        r = rows[i]
        assert (r.n_words, r.word_chars, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(lines) - len(set(lines)), repeat), t
        assert r.n_symbols == sum(c in "#*$%&|<>" for c in t)
        assert r.base_failed == (len(w) < 50 or 100 * repeat > 50 * len(w)) and not (r.kept and r.base_failed)


def test_word_codes_by_size_are_places_among_common_words(make_docs):
    words = ["the", "Über", "THE", "ΟΔΟΣ", "İx", "naïve", "a", "longer", "日本"]
    rng = np.random.default_rng(8)
    docs = make_docs([" ".join(words[i] for i in rng.integers(0, len(words), 300)) for _ in range(10)] + ["rare " * 60])
    known = quality_rules.references(docs, common=6)
    rows = docs.crossJoin(known).withColumn("w", quality_rules.lowered(quality_rules.words_of(F.col("text")))).select("w", "ref_words", quality_rules.word_codes(F.col("w")).alias("codes")).collect()
    assert len(rows) == 11 and len(rows[0].ref_words) == 6
    for r in rows:
        assert r.codes == [quality_rules._CODES[r.ref_words.index(w) + 1 if w in r.ref_words else 0] for w in r.w]


def test_rules_reject_other_distributions(make_docs, spark):
    rng = np.random.default_rng(7)
    vocab = ["the", "of", "and", "to"] * 10 + [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(90)]
    clean = [" ".join(vocab[i] for i in rng.integers(0, len(vocab), 120)) for _ in range(60)]
    junk = [" ".join(f"W{x}!!#" for x in rng.integers(0, 1000, 120)), " ".join(f"zq{chr(97 + x % 26)}{chr(97 + x // 26)}" for x in rng.integers(0, 600, 300))]
    kept = [r.kept for r in quality_rules.judge(make_docs(clean + junk)).orderBy("doc_id").collect()]
    assert kept == [True] * 60 + [False] * 2
    foreign = quality_rules.judge(make_docs(clean + junk).withColumn("lang", F.when(F.col("doc_id") < 60, F.lit("en")))).orderBy("doc_id").collect()
    assert [r.class_divergence is None for r in foreign] == [False] * 60 + [True] * 2 and all(r.kept for r in foreign)  # no language, no reference
    assert quality_rules.judge(spark.createDataFrame([], "doc_id long, text string, lang string")).collect() == []


def brute_manifest(docs):
    H = lambda x: hashlib.sha256(x.encode()).hexdigest()
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda d: H("".join(field(v) for v in d))

    def climb(level):  # the root, and per leaf its (before, after) texts by level
        paths, at = [[] for _ in level], list(range(len(level)))
        while len(level) > 1:
            for k, i in enumerate(at):
                a = i // 16 * 16
                paths[k].append(("".join(level[a:i]), "".join(level[i + 1 : a + 16])))
            level, at = [H("".join(level[a : a + 16])) for a in range(0, len(level), 16)], [i // 16 for i in at]
        return level[0], paths

    sources = sorted({d[1] for d in docs}, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in sources:
        own = sorted((d for d in docs if d[1] == s), key=lambda d: (d[0] is not None, d[0] or 0, leaf(d)))
        trees[s] = (own, *climb([leaf(d) for d in own]))
    root, tops = climb([trees[s][1] for s in sources])
    out = []
    for s, top in zip(sources, tops):
        own, subroot, paths = trees[s]
        for d, path in zip(own, paths):
            path = path + top
            x = leaf(d)
            if d[0] is not None and zlib.crc32(str(d[0]).encode()) % 5 == 0 and d[4] is not None:
                x = leaf((*d[:4], "".join(c.lower() if "A" <= c <= "Z" else c for c in d[4])))
            for a, b in path:
                x = H(a + x + b)
            out.append((d[0], leaf(d), subroot, root, H("".join(a + b for a, b in path)), x, x == root))
    return sorted(out, key=repr)


@pytest.mark.parametrize("rows", [7, 50_000])
def test_manifest_matches_brute_force(spark, tmp_path, monkeypatch, rows):
    monkeypatch.setattr(merkle, "PARTITION_ROWS", rows)  # ranges end inside of groups, at their edges and hold many groups
    rng = np.random.default_rng(8)
    docs = [(i, "hot" if i % 3 else f"s{int(rng.integers(40))}", None if i % 7 == 0 else "en", i, None if i % 11 == 0 else f"Text É {i}") for i in range(420)]
    docs += [(500, None, "en", 1, "no source"), (None, "hot", None, None, "NO ID"), (None, "lone", None, None, None), docs[5], docs[5]]
    docs += [(600, "copies", "en", 1, "Same")] * 300
    df = spark.createDataFrame(docs, "doc_id long, source string, lang string, n_chars long, text string").withColumn("g", F.lit(1)).withColumn("leaf", F.lit(2))
    df.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = op13.run(spark, str(tmp_path)).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()
    assert sorted(map(tuple, got), key=repr) == brute_manifest(docs)


def test_manifest_paths_and_edges(spark):
    leaves = spark.createDataFrame([("a", i, merkle.digest_of(str(i)), None) for i in range(9)], "g string, o long, d string, s string")
    for r in merkle.merkle_manifest(leaves, group="g", order="o", digest="d", shown="s", arity=2, paths=True).collect():
        assert merkle.fold(r.leaf, [(x["at"], x["others"]) for x in r.path]) == r.root == r.subroot and r.verified and len(r.path) == 4
    empty = merkle.merkle_manifest(leaves.where("false"), group="g", order="o", digest="d", shown="s")
    assert empty.collect() == []
    lone = merkle.merkle_manifest(leaves.limit(1), group="g", order="o", digest="d", shown="s").first()
    assert lone.leaf == lone.subroot == lone.root and lone.proof_sha256 == merkle.digest_of("")
    with pytest.raises(ValueError):
        merkle.merkle_manifest(leaves, group="g", order="o", digest="d", shown="s", arity=3)


def test_rules_match_sql(spark, make_docs, tmp_path):
    rng = np.random.default_rng(9)
    vocab = ["the", "of", "and"] * 20 + [f"w{i}" for i in range(60)] + ["X!", "É#"]
    texts = [" ".join(vocab[i] for i in rng.integers(0, len(vocab), int(n))) for n in rng.integers(30, 160, 80)] + [None, "", "a\nb\na"]
    docs = make_docs(texts).withColumn("lang", F.when(F.col("doc_id") % 9 != 0, F.lit("en")))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    df = op12.run(spark, str(tmp_path))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.sql(f"SELECT {', '.join(df.columns)} FROM ({op12.ORACLE_SQL})").fetchall()
    assert sorted(map(tuple, df.collect()), key=repr) == sorted(want, key=repr)
