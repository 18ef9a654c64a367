import random

import numpy as np
import pytest

from lodestone.llm import neardup as N
from lodestone.llm._common import components


def test_signatures_estimate_weighted_similarity():
    r = np.random.default_rng(3)
    got = []
    for _ in range(60):
        h = r.integers(0, 2**63, 40).astype(np.uint64)
        w = np.concatenate([np.full(40, 2.5), np.full(40, 1.5)])
        s = N.dart_minhash(np.repeat([0, 1], 40), np.concatenate([h, h]), w, 2, 128)
        got.append((s[0] == s[1]).mean())
    assert abs(np.mean(got) - 0.6) < 0.03


@pytest.mark.parametrize("part", [7, 10**6])
def test_word_hashes_follow_the_words(monkeypatch, part):
    monkeypatch.setattr(N, "SLICE", part)
    text = "One, two_three ÉTÉ one TWO! 漢字 x1\ud800 été three" + " long" * 20
    words = N.WORD.findall(text.lower())
    got = N.word_hashes(text).tolist()
    assert len(got) == len(words) and len(set(got)) == len(set(words))
    assert len(set(zip(words, got, strict=True))) == len(set(words))
    assert len(N.word_hashes("")) == len(N.word_hashes("!_!")) == 0


def test_darts_thrown_in_parts_make_the_same_signature(monkeypatch):
    h, w = np.arange(500, dtype=np.uint64) * np.uint64(7919), np.linspace(0.2, 3.7, 500)
    whole = N.dart_minhash(np.repeat([0, 1], [40, 460]), h, w, 2, 64)
    monkeypatch.setattr(N, "THROWN", 13)
    assert (N.dart_minhash(np.repeat([0, 1], [40, 460]), h, w, 2, 64) == whole).all()


def brute(texts, threshold=0.8):
    def shingles(t):
        w = N.WORD.findall((t or "").lower())
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else {("", t or "")}

    sets = [shingles(t) for t in texts]
    label = list(range(len(texts)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if len(a & sets[j]) >= threshold * len(a | sets[j]):
                label[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(texts))]


@pytest.fixture(scope="module")
def texts():
    r = random.Random(11)
    vocab = [f"word{i}" for i in range(3000)]
    base = [r.choice(vocab) for _ in range(150)]
    out = []
    for _ in range(160):  # a group of near copies of every degree
        w = list(base)
        for _ in range(r.choice([0, 1, 2, 4, 8])):
            w[r.randrange(len(w))] = r.choice(vocab)
        out.append(" ".join(w))
    out += [" ".join(r.choice(vocab) for _ in range(r.randint(1, 80))) for _ in range(60)]
    out += [out[3]] * 40 + ["one two", "One, two!", "!!!", "!!!", "", None, "one"] + ["long " * 5000]
    return out


def test_equals_brute_force(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "0 as label", "1 as id2", "'x' as key").repartition(4)
    got = {r.doc_id: r.class_id for r in N.near_duplicate_classes(df).collect()}
    want = brute(texts)
    assert [got[i] for i in range(len(texts))] == want


def test_blocks_lose_nothing(spark, texts, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 7)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in N.near_duplicate_classes(df).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts)


def test_edges(spark):
    df = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (None, "a b c"), (2, "a b c")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.class_id) for r in N.near_duplicate_classes(df).collect()) == [(0, 1), (1, 1), (1, 1), (2, 1)]
    assert N.near_duplicate_classes(df.where("false")).count() == 0


def test_one_row_of_each_class_stays_whatever_its_id(spark):
    from corpus_pipeline import drop_near_duplicates

    rows = [(1, "a b c"), (5, "a b c"), (5, "quite another text"), (7, "said twice"), (7, "said twice"), (None, "said twice"), (None, "no id"), (None, "no id"), (None, "a b c"), (8, None), (9, ""), (10, "alone")]
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    want = {(1, "a b c"), (5, "quite another text"), (7, "said twice"), (None, "no id"), (8, None), (10, "alone")}
    got = [(r.doc_id, r.text) for r in drop_near_duplicates(spark, df, "").collect()]
    assert len(got) == len(want) and set(got) == want
    classes = sorted((r.doc_id or 0, r.class_id or 0) for r in N.near_duplicate_classes(df).collect())
    assert classes == [(0, 0), (0, 0), (0, 1), (0, 7), (1, 1), (5, 1), (5, 5), (7, 7), (7, 7), (8, 8), (9, 8), (10, 10)]


def test_components_of_a_long_chain(spark):
    r = random.Random(2)
    ids = list(range(300))
    r.shuffle(ids)
    edges = spark.createDataFrame([*zip(ids, ids[1:], strict=False), (1000, 1001)], "a long, b long")
    got = {x.id: x.label for x in components(edges).collect()}
    assert {got[i] for i in ids} == {0} and got[1001] == 1000


def test_texts_that_share_a_hash_are_told_apart(spark, monkeypatch):
    from pyspark.sql import functions as F

    rows = [(i, t) for i, t in enumerate(["one text of its own", "another text here", "one text of its own", "third", None, ""])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(N, "_text_hash", lambda text, turn: F.length(text) * 0 + turn if turn < 2 else F.xxhash64(text))
    keys = [r._key for r in N.keyed(docs).orderBy("doc_id").collect()]
    assert len(set(keys)) == 4 and keys[0] == keys[2] and keys[4] == keys[5]
    assert {r.doc_id: r.class_id for r in N.near_duplicate_classes(docs).collect()} == {0: 0, 1: 1, 2: 0, 3: 3, 4: 4, 5: 4}
