import random

import pytest

from lodestone.llm import decontaminate as D


@pytest.fixture(scope="module")
def data():
    r = random.Random(5)
    vocab = [f"w{i}" for i in range(12)] + ["Été", "ß"]
    items = [(str(i), " ".join(r.choice(vocab) for _ in range(r.choice([1, 2, 5, 10, 11, 25])))) for i in range(30)] + [("e", ""), ("n", None), (None, "lonely words"), ("0", "w1 w2")]
    docs = []
    for i in range(120):
        w = [r.choice(vocab) for _ in range(r.randint(0, 60))]
        if i % 3 == 0:
            w[5:5] = r.choice(items[:30])[1].upper().split()
        docs.append((i, ", ".join(w)))
    return [*docs, (500, None), (501, ""), (3, docs[3][1]), (None, "lonely words here"), (502, "w1 " * 20_000)], items


@pytest.mark.parametrize("block", [10**6, 40])
def test_equals_brute_force(spark, data, monkeypatch, block):
    monkeypatch.setattr(D, "BLOCK_WORDS", block)
    docs, items = data
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as items", "2 as spans", "3 as n_words")
    b = spark.createDataFrame(items, "item_id string, text string")
    rows = D.digest(D.contamination(d, b, size=10)).collect()
    assert len(rows) == len(docs)
    text = dict(docs)
    for r in rows:
        if r.doc_id == 502:
            continue
        n, hit = D.exact_words([t for _, t in items if t], text[r.doc_id])
        ids = {str(i) if i is not None else "null" for i, t in items if t and D.exact_words([t], text[r.doc_id])[1]}
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated, r.items_sha256) == (n, hit, len(ids), hit > 0, D.items_digest(list(ids)))


def test_empty_tables(spark):
    d, b = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    one = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert D.contamination(d, b).count() == 0
    assert D.digest(D.contamination(one, b)).first().n_words == 2
