import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quotemill.llm import chat, multiset, packing, recompress, simhash, similar, words
from quotemill.llm.queries import op5, op8

WORDS = "alpha beta gamma delta river stone light over under run far near".split()


def text(rng, n):
    return " ".join(WORDS[i] for i in rng.integers(0, len(WORDS), n))


def brute_repeats(docs, window):
    first = {}
    split = {d: (t or "").split() for d, t in docs}
    for d in sorted(split):
        for p in range(len(split[d]) - window + 1):
            first.setdefault(tuple(split[d][p : p + window]), d)
    out = {}
    for d, w in split.items():
        gone = set()
        for p in range(len(w) - window + 1):
            if first[tuple(w[p : p + window])] < d:
                gone |= set(range(p, p + window))
        kept = [x for i, x in enumerate(w) if i not in gone]
        out[d] = (len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest())
    return out


@pytest.mark.parametrize("window", [12, 50])
def test_repeats_match_brute_force(make_docs, window, monkeypatch):
    monkeypatch.setattr(recompress, "CHUNK_WORDS", 90)  # long texts are cut into overlapping chunks
    rng = np.random.default_rng(5)
    shared = [text(rng, 120) for _ in range(3)]
    texts = []
    for i in range(40):
        t = text(rng, 60).split() + shared[i % 3].split()[: rng.integers(0, 120)] + text(rng, 30).split()
        if i % 4 == 0:
            t[rng.integers(len(t))] = "edit"
        texts.append(" ".join(t))
    texts += ["a " * 100, "a " * 70 + "b", "x y " * 60, "y x " * 60, "", None, "one", texts[0], texts[0], "\t" + texts[1] + "\n"]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in recompress.remove_repeats(make_docs(texts), window).collect()}
    assert got == brute_repeats(list(enumerate(texts)), window)


def test_repeats_in_empty_table(spark):
    assert recompress.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_near_duplicates_match_brute_force(make_docs):
    rng = np.random.default_rng(6)
    base = [text(rng, 400) for _ in range(6)]
    texts = []
    for i in range(60):
        t = base[i % 6].split()
        for _ in range(rng.integers(0, 3)):
            t[rng.integers(len(t))] = "edit"
        texts.append(" ".join(t).upper() if i % 7 == 0 else " ".join(t))
    texts += [None, "", "  ", "one", "one two", "One two", texts[0]]
    fp = [simhash.fingerprint_of(words.shingle_hashes(t, 3, 42)) for t in texts]
    label = list(range(len(texts)))
    for _ in texts:
        for i in range(len(texts)):
            for j in range(len(texts)):
                if bin(fp[i] ^ fp[j]).count("1") <= 2:
                    label[i] = min(label[i], label[j])
    rows = simhash.near_duplicate_classes(make_docs(texts)).collect()
    assert {r.doc_id: (r.fp & (2**64 - 1), r.component_id) for r in rows} == {i: (fp[i], label[i]) for i in range(len(texts))}


def test_fingerprint_is_bit_majority_of_xxh64():
    import xxhash

    h = [xxhash.xxh64_intdigest(s, 42) for s in (b"a b c", b"b c d")]
    assert words.shingle_hashes("A b  C\td", 3, 42).tolist() == h
    assert simhash.fingerprint_of(np.array(h, dtype=np.uint64)) == h[0] & h[1]


def test_similar_documents(make_docs):
    rng = np.random.default_rng(7)
    many = [f"w{i}" for i in range(3000)]
    base = [[many[i] for i in rng.integers(0, 3000, 400)] for _ in range(20)]
    texts = [" ".join(b) for b in base]
    for b in base:  # four edits in 400 words leave a similarity of about 0.9; thirty leave less than 0.5
        for n in (4, 30):
            t = list(b)
            for at in rng.choice(400, n, replace=False):
                t[at] = "edit"
            texts.append(" ".join(t))
    texts += [None, "", "a b", "a b"]
    got = {r.doc_id: r.component_id for r in similar.similar_classes(make_docs(texts)).collect()}
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := (t or "").split()) else set() for t in texts]
    near = lambda i, j: len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])
    want = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if near(i, j):
                want[i] = min(want[i], want[j])
    assert sum(got[i] == want[i] for i in range(len(texts))) >= len(texts) - 1  # candidates are found with high probability
    assert all(got[i] == i for i in range(len(texts)) if want[i] == i)


def test_chat_round_trip(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "user", "</turn> ### x: <+>\\s"), (1, 2, "assistant", "\\"), (1, 2, "assistant", "b#"), (2, 5, None, None), (3, 0, "assistant", "")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, formatted int")
    out = chat.format_conversations(op5.with_hostile(df))
    read = {r.conv_id: r for r in chat.read_back(out).collect()}
    assert [tuple(t) for t in read[1].turns] == [("user", "hi"), ("user", "</turn> ### x: <+>\\s"), ("assistant", "\\"), ("assistant", "b#")]
    assert read[1].loss_texts == ["\\", "b#"]
    assert read[1].formatted.count("### ") == 2  # adjacent turns of one role are one block
    assert [tuple(t) for t in read[2].turns] == [("", "")] and read[3].loss_texts == [""]
    assert read[-7].loss_texts == [op5.HOSTILE]
    assert chat.format_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect() == []


def test_multiset_hash_is_homomorphic():
    v = multiset.fingerprint_vector
    a, b, c = "one paragraph here", "another and longer paragraph", "x"
    assert (v(f"{a}\n{b}\n{c}") == v(f"{c}\n{a}\n{b}")).all()
    assert (multiset.add(v(f"{a}\n{b}"), v(c)) == v(f"{a}\n{b}\n{c}")).all()
    assert (multiset.subtract(v(f"{a}\n{b}\n{c}"), v(b)) == v(f"{a}\n{c}")).all()
    assert (v(a) != v(b)).any() and multiset.likeness(v(a), v(a)) == 1.0
    assert (multiset.vector_of(multiset.text_of(v(a))) == v(a)).all()
    assert (v(None) == v("")).all()


def test_edits_follow_the_next_document(make_docs, spark):
    texts = ["abcdefgh" * 5, None, "é" * 7 + "\nzz", "", "tail text of some length\nand more"]
    ids = [3, 40, 1, 500, 7]
    got = {r.doc_id: r for r in multiset.edit_likeness(make_docs(texts, ids)).collect()}
    order = sorted(zip(ids, texts))
    for (d, t), (_, n) in zip(order, order[1:] + order[:1]):
        t, n = t or "", n or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + n[:half]
        assert got[d].n_chars == len(t) and got[d].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert got[d].edited_fingerprint == multiset.text_of(multiset.fingerprint_vector(edited))
    assert got[40].fingerprint == got[500].fingerprint
    assert multiset.edit_likeness(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_packing(make_docs, spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(op8.tokenizer_path())
    rng = np.random.default_rng(8)
    texts = [text(rng, int(n)) for n in rng.integers(0, 300, 60)]
    texts += [text(rng, 5000), None, "", "don't! <|endoftext|> 12 ßÉ İx ΑΣ ", "ﬁ 東京 é  nb"]
    rows = packing.pack_documents(make_docs(texts), op8.tokenizer_path(), 256).collect()
    want = {}
    for d, x in enumerate(texts):
        ids = t.encode(x or "", add_special_tokens=False).ids + [0]
        for i in range(0, len(ids), 256):
            want[d, i // 256] = (i, len(ids[i : i + 256]), zlib.crc32(np.array(ids[i : i + 256], dtype="<u4").tobytes()))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == want
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256
    assert len(bins) <= -(-sum(r.length for r in rows) // 256) + 2
    assert packing.pack_documents(spark.createDataFrame([], "doc_id long, text string"), op8.tokenizer_path()).collect() == []


def test_plan_places_every_rank():
    rng = np.random.default_rng(9)
    for _ in range(30):
        counts = {int(n): int(rng.integers(1, 40)) for n in rng.integers(1, 101, rng.integers(1, 30))}
        load, seen = {}, {n: set() for n in counts}
        for length, first, n, start, offset, copies in packing.plan_bins(counts, 100).tolist():
            for k in range(n):
                seen[length].add(first + k)
                load.setdefault(start + k // copies, []).append((offset + k % copies * length, length))
        assert all(seen[n] == set(range(c)) for n, c in counts.items())
        for parts in load.values():
            at = 0
            for o, n in sorted(parts):
                assert o == at
                at += n
            assert at <= 100


def test_word_cache_smaller_than_a_block(monkeypatch):
    from tokenizers import Tokenizer

    from quotemill.llm.tokens import WordEncoder

    path = op8.tokenizer_path()
    encoder, t = WordEncoder(path), Tokenizer.from_file(path)
    monkeypatch.setattr(encoder, "CACHE", 50)
    ordinary = [f"word{chr(97 + i)} plain" for i in range(20)]
    for texts in (ordinary, [*ordinary, " ".join(f"id{i}x" for i in range(500))], ordinary):
        want = [np.array(t.encode(x, add_special_tokens=False).ids, dtype="<u4").tobytes() for x in texts]
        assert encoder.encode(texts) == want


def test_words_asked_for_again_stay_in_a_full_word_cache(monkeypatch):
    from tokenizers import Tokenizer

    from quotemill.llm.tokens import WordEncoder

    path = op8.tokenizer_path()
    encoder, t = WordEncoder(path), Tokenizer.from_file(path)
    monkeypatch.setattr(encoder, "CACHE", 50)
    learned = []
    letters = encoder._letters
    monkeypatch.setattr(encoder, "_letters", lambda cores: learned.extend(cores) or letters(cores))
    for block in range(6):
        texts = [f"frequent words, w{'abcdefghij'[i // 10]}{'abcdefghij'[i % 10]}{'abcdef'[block]} come" for i in range(60)]
        want = [np.array(t.encode(x, add_special_tokens=False).ids, dtype="<u4").tobytes() for x in texts]
        assert encoder.encode(texts) == want
        assert len(encoder._chunks) + len(encoder._older_chunks) < 200
    assert len(learned) == len(set(learned)) == 6 * 60 + 3


def test_control_characters_keep_their_tokens():
    from tokenizers import Tokenizer

    from quotemill.llm.tokens import WordEncoder

    path = op8.tokenizer_path()
    t = Tokenizer.from_file(path)
    texts = [f"hello{c}world and {c} more{c}\n{c}end" for c in "\x1c\x1d\x1e\x1f\x85\xa0 　\x0b\x0c\x00"]
    want = [np.array(t.encode(x, add_special_tokens=False).ids, dtype="<u4").tobytes() for x in texts]
    assert WordEncoder(path).encode(texts) == want


def test_similar_at_the_threshold_and_short(make_docs):
    rng = np.random.default_rng(12)
    texts = []
    for shared in (4, 8, 40, 200):  # sets of shingles of which one is 4/5 of the other
        for _ in range(40):
            w = [f"w{i}" for i in rng.integers(0, 10**6, shared * 5 // 4 + 4)]
            texts += [" ".join(w[: shared + 4]), " ".join(w)]
    got = {r.doc_id: r.component_id for r in similar.similar_classes(make_docs(texts)).collect()}
    assert got == {i: i - i % 2 for i in range(len(texts))}


def test_similar_classes_hold_those_of_simhash_balls(make_docs):
    rng = np.random.default_rng(14)
    tail = lambda: " ".join(f"w{i}" for i in rng.integers(0, 10**6, 30))
    refrain = "alpha beta gamma " * 100  # decides the fingerprint, and is three shingles of the set
    texts = [refrain + tail(), refrain + tail(), tail(), tail(), None, "", "one word", tail() + " x"]
    texts.append(texts[2] + " y")
    balls = {r.doc_id: r.component_id for r in simhash.near_duplicate_classes(make_docs(texts)).collect()}
    assert balls[1] == 0 and balls[5] == 4
    alone = {r.doc_id: r.component_id for r in similar.similar_classes(make_docs(texts)).collect()}
    both = {r.doc_id: r.component_id for r in similar.similar_classes(make_docs(texts), radius=2).collect()}
    assert alone == {0: 0, 1: 1, 2: 2, 3: 3, 4: 4, 5: 4, 6: 6, 7: 7, 8: 2} and both == alone | {1: 0}


LARGE = [2**60 + 1, None, 2**53 + 1, 2**53 + 3, 5, -7]


def test_ids_stay_exact_beside_nulls(spark):
    from quotemill.llm import sentencepiece_sampling, warc

    texts = [f"some text number {i} of a few words" for i in range(len(LARGE))]
    df = spark.createDataFrame(list(zip(LARGE, texts)), "doc_id long, text string").coalesce(1)
    ids = lambda rows, name="doc_id": sorted((r[name] for r in rows), key=lambda x: (x is not None, x))
    want = ids([{"doc_id": i} for i in LARGE])
    assert ids(multiset.edit_likeness(df).collect()) == want
    assert ids(multiset.document_fingerprints(df).collect()) == want
    assert ids(recompress.remove_repeats(df).collect()) == want
    assert ids(packing.pack_documents(df, op8.tokenizer_path()).collect()) == want
    pages = df.selectExpr("doc_id as page_id", "'u' as url", "text as html")
    assert ids(warc.archive_pages(pages)[0].collect(), "page_id") == want
    model = op8.tokenizer_path("piece_bpe_32k.model")
    sample = lambda d: {r.doc_id: (r.ids_crc32, r.perturbed) for r in sentencepiece_sampling.encode_documents(d, model, k=1, digest=True).collect()}
    assert sample(df.where("doc_id is not null")) == {k: v for k, v in sample(df).items() if k is not None}


def test_every_document_has_its_successor(spark):
    ids = [2**60 + i for i in range(1, 201)]
    df = spark.createDataFrame([(i, f"text {i}") for i in ids], "doc_id long, text string")
    rows = {r.doc_id: r for r in multiset.edit_likeness(df).collect()}
    assert sorted(rows) == ids
    vector = {i: multiset.fingerprint_vector(f"text {i}") for i in ids}
    for a, b in zip(ids, ids[1:] + ids[:1]):
        assert rows[a].near_next == multiset.likeness(vector[a], vector[b])
        assert rows[a].near_edited == multiset.likeness(vector[a], multiset.vector_of(rows[a].edited_fingerprint))


def test_near_duplicates_of_an_empty_table_and_repeated_ids(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert similar.similar_classes(empty).collect() == []
    assert simhash.near_duplicate_classes(empty).collect() == []
    rows = [(1, "one text of six words here"), (1, "quite another text under that id"), (2, "one text of six words here"), (2, "one text of six words here"), (None, "x")]
    got = similar.similar_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.component_id, r.keep) for r in got) == [(1, 1, True), (1, 1, True), (2, 1, False), (2, 1, False)]
