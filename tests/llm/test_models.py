import math

import numpy as np

from quotemill.llm import mil
from quotemill.llm import sentencepiece_sampling as sp
from quotemill.llm.queries.op8 import tokenizer_path

MODEL = "piece_bpe_32k.model"
SF = "/root/testdata/sf0.01"


def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    bags = [rng.normal(size=(n, mil.FEATURES)) for n in (1, 3, 2)]
    model = mil.fit(bags, np.array([0, 1, 1]), epochs=1)
    x, starts, y = np.concatenate(bags), np.array([0, 1, 4]), np.array([0.0, 1.0, 1.0])

    def loss():
        p = mil._forward(model.params, x, starts)["p"]
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    grad = mil._gradients(model.params, x, starts, y)
    for k, v in model.params.items():
        at = tuple(rng.integers(n) for n in v.shape)
        keep = v[at]
        v[at] = keep + 1e-6
        up = loss()
        v[at] = keep - 1e-6
        down = loss()
        v[at] = keep
        assert abs((up - down) / 2e-6 - grad[k][at]) < 1e-5


def test_attention_finds_the_marked_passage(spark, make_docs):
    rng = np.random.default_rng(1)
    good, bad = "plain words of ordinary prose stand here. ", "LOUD!! WORDS!! *** $$$ "
    texts = [good * int(n) + (bad * 12 if i % 3 == 0 else "") for i, n in enumerate(rng.integers(5, 60, 120))] + [None, ""]
    labels = spark.createDataFrame([(i, int(i % 3 != 0), 0) for i in range(120)] + [(121, None, 0)], "doc_id long, quality int, toxic int")
    rows = mil.score_documents(make_docs(texts), labels).collect()
    held = [r for r in rows if r.doc_id < 120]
    assert len(rows) == 122 and all(0 <= r.quality_score <= 1 for r in rows)
    assert np.mean([r.quality_keep == (r.doc_id % 3 != 0) for r in held]) > 0.95


def test_words_alone_can_tell(spark, make_docs):
    rng = np.random.default_rng(3)
    draw = lambda words: " ".join(rng.choice(words, 80))  # noqa: E731  words of one length and kind
    texts = [draw(["stone", "river", "cloud", "maple"] if i % 2 else ["stone", "river", "wager", "bonus"]) for i in range(300)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, quality int")
    rows = mil.score_documents(make_docs(texts), labels).where("doc_id >= 200").collect()
    assert len(rows) == 100 and all((r.quality_score >= 0.5) == (r.doc_id % 2 == 1) for r in rows)


def test_long_and_odd_texts_have_all_their_passages():
    long = "word " * (mil.PASSAGE * 40 + 1)
    assert mil.passage_features(long).shape == (41, mil.FEATURES) and len(mil._spread(mil.passage_features(long))) == mil.FIT_PASSAGES
    for text in (None, "", " ", "\x00", "a", "\ud800", "é" * 5000):
        x = mil.passage_features(text)
        assert x.shape == (1, mil.FEATURES) and np.isfinite(x).all()


def test_bags_shrink_on_their_way_to_the_driver():
    rng = np.random.default_rng(5)
    for n in (0, 40, 2000):
        bag = mil._spread(mil.passage_features(" ".join(f"w{i}" for i in rng.integers(0, 500, n))))
        raw = mil._packed(bag)
        assert len(raw) < bag.nbytes / 2 and (mil._unpacked(raw, len(bag)) == bag).all()


def test_learning_ignores_clashes_repeats_and_rows_without_id(spark, make_docs):
    texts = [f"some plain words {i}" if i % 2 else f"LOUD! WORDS! {i}" for i in range(60)]
    docs, labels = make_docs(texts), spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    plain = mil.train(docs, labels)
    more = docs.unionAll(docs).unionAll(docs.limit(1).selectExpr("cast(null as long) doc_id", *docs.columns[1:]))
    noisy = labels.unionAll(labels).unionAll(spark.createDataFrame([(None, 1), (100, 0), (100, 1), (101, 7)], labels.schema))
    more = more.unionAll(make_docs(["clash"], [100])).unionAll(make_docs(["none"], [101]))
    again = mil.train(more, noisy)
    assert all((plain.params[k] == again.params[k]).all() for k in plain.params)
    scored = mil.score_documents(more, noisy)
    assert scored.count() == 123 and scored.where("quality_score is null").count() == 0
    empty = mil.score_documents(docs.where("false"), labels.where("false"))
    assert empty.collect() == []
    assert {r.quality_score for r in mil.score_documents(docs, labels.where("false")).collect()} == {0.5}


def test_query_is_right_on_held_out_documents(spark):
    from quotemill.llm.queries import op9

    rows = op9.run(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality"), "doc_id").where("held_out and quality in (0, 1)").collect()
    ones, zeros = [r.score for r in rows if r.quality == 1], [r.score for r in rows if r.quality == 0]
    assert len(zeros) > 5 and np.mean([a > b for a in ones for b in zeros]) > 0.98
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.95
    assert op9.run(spark, SF).count() == spark.read.parquet(f"{SF}/documents.parquet").count()


def test_without_labels():
    assert mil.fit([], np.array([])).score([mil.passage_features("")]).tolist() == [0.5]


def segmentations(v, chunk):
    """All ways through one chunk by recursion: (ids, weight)."""
    known = {v.text[i].decode(): i for i in v.ids.tolist()}
    weight = dict(zip(v.ids.tolist(), v.weights.tolist()))
    out = []

    def go(at, ids, total):
        if at == len(chunk):
            out.append((tuple(ids), total))
        for end in range(at + 1, len(chunk) + 1):
            i = known.get(chunk[at:end])
            if i in weight:
                go(end, [*ids, i], total + weight[i])

    go(0, [], 0.0)
    return out


def test_samples_follow_the_lattice():
    v = sp.vocabulary(tokenizer_path(MODEL), 0.3)
    ways = segmentations(v, "▁thor")
    z = math.log(sum(math.exp(w) for _, w in ways))
    p = {ids: math.exp(w - z) for ids, w in ways}
    n = 4000
    found = sp.sample_segmentations(v, ["thor"] * n, list(range(n)), 3)
    first = {}
    second = {}
    for r in found:
        ids = [tuple(x[0].tolist()) for x in r]
        assert len(set(ids)) == min(3, len(ways)) == len(ids)
        assert all(abs(x[1] - math.log(p[i])) < 1e-9 for x, i in zip(r, ids))
        assert [x[2] for x in r] == sorted((x[2] for x in r), reverse=True)
        first[ids[0]] = first.get(ids[0], 0) + 1
        second[ids[1]] = second.get(ids[1], 0) + 1
    for ids, q in p.items():
        assert abs(first.get(ids, 0) / n - q) < 4 * math.sqrt(q * (1 - q) / n) + 1e-3
        q2 = sum(p[a] * q / (1 - p[a]) for a in p if a != ids)  # without replacement
        assert abs(second.get(ids, 0) / n - q2) < 4 * math.sqrt(q2 * (1 - q2) / n) + 1e-3


def test_inclusion_scores_are_unbiased():
    v = sp.vocabulary(tokenizer_path(MODEL), 0.3)
    n = 4000
    total = [sum(math.exp(x[1] - x[3]) for x in r) for r in sp.sample_segmentations(v, ["thor"] * n, list(range(n)), 2)]
    assert abs(np.mean(total) - 1) < 4 * np.std(total) / math.sqrt(n)


def test_round_trip_and_edge_cases(spark, make_docs):
    texts = ["Is and retitioning ouen", " two  spaces ", "línea\nnueva\t☃ 日本 🙂", "", None, " ", "a", "x" * 500, "\x00"]
    model = tokenizer_path(MODEL)
    rows = sp.encode_documents(make_docs(texts), model, k=3)
    back = {(r.doc_id, r.rank): r.text for r in sp.decode_documents(rows, model).collect()}
    assert all(t == (texts[d] or "") for (d, _), t in back.items()) and {d for d, _ in back} == set(range(len(texts)))
    by = {}
    for r in rows.collect():
        by.setdefault(r.doc_id, []).append(tuple(r.ids))
    assert all(len(set(x)) == len(x) for x in by.values()) and by[3] == [()] and len(by[0]) == 3
    again = sp.sample_segmentations(sp.vocabulary(model), [texts[2]], [2], 3)[0]
    assert [tuple(x[0].tolist()) for x in again] == by[2]  # the same in any batch
    assert sp.encode_documents(spark.createDataFrame([], "doc_id long, text string"), model).collect() == []
