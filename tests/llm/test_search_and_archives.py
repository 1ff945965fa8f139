import hashlib
import math

import numpy as np
import pytest

from quotemill.llm import mtree, warc


def brute_top(rows, k, every):
    ok = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            ok[i] = np.floor(256 * np.array(v, dtype=np.float32).astype(float)).astype(int)
    width = max((len(q) for q in ok.values()), default=0)
    pad = {i: np.pad(q, (0, width - len(q))) for i, q in ok.items()}
    out = set()
    for i, q in pad.items():
        if i % every == 0:
            scored = sorted((-int(q @ c), j) for j, c in pad.items() if j != i)[:k]
            out |= {(i, r, j, -s) for r, (s, j) in enumerate(scored, 1)}
    return out


def test_top_k_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(mtree, "BLOCK", 100)
    monkeypatch.setattr(mtree, "PAGE", 8)
    rng = np.random.default_rng(0)
    centers = rng.normal(size=(5, 6))
    rows = [(i, (centers[i % 5] + rng.normal(size=6) * 0.2).tolist()) for i in range(300)]
    rows += [(300 + i, [0.5] * 6) for i in range(150)]  # one vector a third of all rows share
    rows += [(450, None), (451, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (452, [math.nan] * 6), (453, [math.inf] * 6), (455, [1.0, 2.0]), (460, [])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, cell string")
    got = {tuple(r) for r in mtree.top_k(df, 5, 5).collect()}
    assert got == brute_top(rows, 5, 5)


def test_top_k_of_few_rows(spark):
    schema = "vec_id long, embedding array<float>"
    assert mtree.top_k(spark.createDataFrame([], schema)).collect() == []
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (1, [0.0, 1.0])], schema)
    assert [tuple(r) for r in mtree.top_k(few, 5, 50).collect()] == [(0, 1, 1, 0)]


def test_tree_skips_computations():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.integers(-5, 5, (400, 8)) + 100 * c for c in np.eye(8, dtype=int)])
    most = float((x**2).sum(axis=1).max())
    import pandas as pd

    pages = mtree.build_tree(np.arange(len(x)), x, most)
    none = np.empty(0, dtype=np.int64)
    df = pd.DataFrame([{"node": n, "parent": p, "leaf": leaf, "center": c.astype("<f8").tobytes(), "radius": r, "parent_dist": up, "ids": (m if leaf else none).astype("<i8").tobytes(), "vectors": x[m if leaf else none].astype("<i8").tobytes(), "dists": (d if leaf else np.empty(0)).astype("<f8").tobytes()} for n, p, leaf, c, _, r, up, m, d in pages])
    tree = mtree.Tree(df, 8, most)
    asked = np.array([10, 900])
    found = tree.search(np.array([-1, -2]), x[asked], 5, np.full(2, np.nan))
    want = []
    for name, row in zip((-1, -2), asked):
        best = sorted(((int(s), i) for i, s in enumerate(x @ x[row])), key=lambda t: (-t[0], t[1]))[:5]
        want += [(name, i, s) for s, i in best]
    assert found == want
    assert tree.computed < len(x)


def test_archives(spark):
    big = "<p>" + "é" * 600 + "</p>"
    rows = [(1, "http://a b/\n", big), (2, None, big), (3, "u", "small"), (4, "u", "small"), (5, "u", None), (None, "u", big), (7, "u", ""), (7, "u", ""), (9, "u", big + "x"), (1, "u", "another text of page 1")]
    df = spark.createDataFrame([(*r, 0) for r in rows], "page_id long, url string, html string, digest int")
    read, index, folder = warc.archive_pages(df)
    got = sorted((r.page_id is None, r.page_id or 0, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, r.intact) for r in read.collect())
    want = []
    for i, _, h in rows:
        b = (h or "").encode()
        keeper = max(j for j, _, g in rows if g == h and j is not None) if len(b) >= 1000 else None
        revisit = i is not None and keeper is not None and i < keeper
        want.append((i is None, i or 0, len(b), hashlib.sha1(b).hexdigest(), "revisit" if revisit else "response", keeper if revisit else None, True))
    assert got == sorted(want, key=lambda x: (x[0], x[1], x[2]))
    place = index.where("page_id = 2").first()
    bundle = bytes(spark.read.format("binaryFile").load(f"{folder}/{place.bundle}").first().content)
    head, block = warc.read_record(bundle, place.frame, place.offset)
    assert head["X-Page-ID"] == "2" and block.endswith(big.encode())
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.archive_pages(empty)[0].collect() == []


def test_frames_are_independent_zstandard():
    import zstandard

    w = warc.BundleWriter(frame_bytes=100)
    records = [warc.record_bytes(i, "u", b"x" * 50 * i, "d", None) for i in range(5)]
    places = [w.add(r) for r in records]
    data = w.close()
    assert zstandard.ZstdDecompressor().decompressobj().decompress(data).startswith(b"WARC/1.1")
    for i, (frame, offset) in enumerate(places):
        assert warc.read_frame(data, frame)[offset:].startswith(records[i])
    with pytest.raises(ValueError):
        warc.seek_table(b"0" * 20)


def test_two_large_groups_of_copies_in_a_block():
    x = np.concatenate([np.zeros((300, 4), dtype=np.int64), np.full((7892, 4), 3, dtype=np.int64)])
    for seed in range(6):
        pages = mtree.build_tree(np.arange(len(x)), x, 36.0, seed)
        held = np.concatenate([p[7] for p in pages if p[2]])
        assert sorted(held.tolist()) == list(range(len(x)))
        assert all(len(p[7]) <= mtree.PAGE for p in pages if p[2])


def test_scores_of_queries_far_larger_than_what_is_indexed(spark, monkeypatch):
    monkeypatch.setattr(mtree, "BLOCK", 40)
    rng = np.random.default_rng(31)
    small = [(i, (rng.integers(2**11, 2**12, 6) / 1.0).tolist()) for i in range(1, 120) if i % 50]
    large = [(i, (rng.integers(2**27, 2**28, 6) / 1.0).tolist()) for i in (0, 50, 100)]
    rows = small + large
    got = {tuple(r) for r in mtree.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), 5, 50).collect()}
    assert got == brute_top(rows, 5, 50)


def test_queries_of_several_groups(spark, monkeypatch):
    rng = np.random.default_rng(8)
    rows = spark.createDataFrame([(i, rng.normal(0, 1, 4).tolist()) for i in range(300)], "vec_id long, embedding array<double>")
    want = mtree.top_k(rows, every=10).orderBy("query_id", "rank").collect()
    monkeypatch.setattr(mtree, "QUERY_BLOCK", 7)
    assert mtree.top_k(rows, every=10).orderBy("query_id", "rank").collect() == want
