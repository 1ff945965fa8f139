import zlib

import numpy as np
from test_lines import brute as kept_lines

import corpus_pipeline
from quotemill.llm.queries import op8
from quotemill.session import load


def without_repeats(docs, window=50):
    first, split = {}, {d: (t or "").split() for d, t in docs}
    for d in sorted(split):
        for p in range(len(split[d]) - window + 1):
            first.setdefault(tuple(split[d][p : p + window]), d)
    out = {}
    for d, t in docs:
        w, gone = split[d], set()
        for p in range(len(w) - window + 1):
            if first[tuple(w[p : p + window])] < d:
                gone |= set(range(p, p + window))
        out[d] = " ".join(x for i, x in enumerate(w) if i not in gone) if gone else t
    return out


def shingles(t):
    w = (t or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_run_matches_brute_force(spark, tmp_path):
    from tokenizers import Tokenizer

    rng = np.random.default_rng(11)
    many = [f"w{i}" for i in range(4000)]
    prose = lambda n: " ".join(many[i] for i in rng.integers(0, 4000, n))
    passage = prose(80)
    texts = [prose(120) + "\n" + prose(60) for _ in range(24)]
    texts += [texts[0], texts[1].replace(texts[1].split()[7], "edit", 1), prose(40) + "\n" + passage, passage + "\n" + prose(50)]
    texts += ["LOUD!! WORDS!! *** $$$ " * 30 for _ in range(6)]
    docs = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    junk = range(28, 34)
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i not in junk), 0) for i in range(34)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert load(spark, str(tmp_path), "documents").count() == 34

    left = kept_lines([(i, t) for i, t in enumerate(texts) if i not in junk])
    sets = {i: shingles(t) for i, t in left.items()}
    near = lambda i, j: len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])
    left = {i: t for i, t in left.items() if not any(j < i and near(i, j) for j in left)}
    left = without_repeats(sorted(left.items()))
    t = Tokenizer.from_file(op8.tokenizer_path())
    want = {}
    for i, x in left.items():
        ids = t.encode(x or "", add_special_tokens=False).ids + [0]
        want[i] = (len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()))
    got = {r.doc_id: (r.length, r.ids_crc32) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert got == want


def small_tables(spark, tmp_path, texts, ids=None):
    docs = [(i, t, "en", "s", None if t is None else len(t)) for i, t in zip(ids or range(len(texts)), texts)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(d[0], int(not (d[1] or "").isupper()), 0) for d in docs if d[0] is not None], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


def test_results_of_stages_and_runs_live_side_by_side(spark, tmp_path):
    rng = np.random.default_rng(12)
    prose = lambda n: " ".join(f"w{i}" for i in rng.integers(0, 4000, n))
    texts = [prose(90) + "\n" + prose(60) for _ in range(10)] + ["LOUD!! WORDS!! " * 30] * 4
    sf = small_tables(spark, tmp_path, [*texts, texts[0]])
    docs = load(spark, sf, "documents")
    stages = dict(corpus_pipeline.STAGES)
    a, b = stages["line_dedup"](spark, docs, sf), stages["line_dedup"](spark, docs, sf)
    assert b.count() == a.count() == 15
    a.write.parquet(f"{tmp_path}/lines")
    c = stages["near_dedup"](spark, spark.read.parquet(f"{tmp_path}/lines"), sf)
    assert c.count() == c.count() <= 15
    first, second = corpus_pipeline.run(spark, sf), corpus_pipeline.run(spark, sf)
    assert second.count() == first.count() > 0


def test_pipeline_of_nulls_ties_and_repeats(spark, tmp_path):
    rng = np.random.default_rng(13)
    prose = lambda n: " ".join(f"w{i}" for i in rng.integers(0, 4000, n))
    clean = [prose(90) for _ in range(12)]
    texts = [*clean, None, "", "LOUD!! WORDS!! " * 30, "BAD!! TEXTS!! " * 30, clean[0], clean[1]]
    ids = [*range(12), 12, 13, 14, 15, 0, None]  # a repeated row, a copy without an id
    sf = small_tables(spark, tmp_path, texts, ids)
    kept = {r.doc_id for r in corpus_pipeline.run(spark, sf).collect()}
    assert set(range(2, 12)) <= kept and not {14, 15} & kept
