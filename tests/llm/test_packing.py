import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.llm import packing

RANKS = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = ["", None, "Hello  world's\n\n end\t", "x" * 6000, "naïve café ²³ ¼ Ω 漢字 🙂", "a b c " * 1500, "\x1c\x85\xa0 '", "!'s 's", "it'll  we've\r\n", "a <|endoftext|> b<|endoftext|><|endoftext|> é漢", "<|endoftext|>", "<|endoftext |>"]


def test_ids_equal_the_tokenizers_library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    enc = packing.Encoder(RANKS)
    for x in TEXTS:
        assert np.frombuffer(enc.encode(x or ""), "<u4").tolist() == t.encode(x or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=30), st.sampled_from(["<|endoftext|>", "<|", "|>"])), max_size=4).map("".join))
def test_ids_of_any_text(text):
    from tokenizers import Tokenizer

    test_ids_of_any_text.t = getattr(test_ids_of_any_text, "t", None) or Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    test_ids_of_any_text.e = getattr(test_ids_of_any_text, "e", None) or packing.Encoder(RANKS)
    if any(0xD800 <= ord(c) < 0xE000 for c in text):
        return
    assert np.frombuffer(test_ids_of_any_text.e.encode(text), "<u4").tolist() == test_ids_of_any_text.t.encode(text, add_special_tokens=False).ids


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=200))
def test_plan_covers_the_histogram(lengths):
    hist = np.bincount(lengths, minlength=65).astype(np.int64) if lengths else np.zeros(65, np.int64)
    used = np.zeros(65, np.int64)
    n = 0
    for p, c in packing.plan(hist, 64):
        assert sum(p) <= 64 and c > 0
        n += c
        for v in p:
            used[v] += c
    assert (used == hist).all()
    assert n <= -(-sum(lengths) // 64) * 1.5 + 3


def test_exact_patterns_are_found():
    hist = np.zeros(65, np.int64)
    hist[[40, 24, 10, 54]] = 1000
    assert sum(c for _, c in packing.plan(hist, 64)) == 2000


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([*enumerate(TEXTS), (2, TEXTS[2]), (None, "no id")], "doc_id long, text string").selectExpr("doc_id", "text", "1 as sequence_id", "2 as length")


def test_documents(spark, docs):
    rows = packing.pack_documents(docs, RANKS, capacity=256, with_ids=True).collect()
    seq = defaultdict(list)
    for r in rows:
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
        seq[r.sequence_id].append((r.offset, r.length))
    for s in seq.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= 256
    four = sorted((r.piece, r.start, r.length) for r in rows if r.doc_id == 5)
    assert all(n == 256 for p, _, n in four if p) and [p for p, _, _ in four] == list(range(len(four)))
    assert sum(r.doc_id == 2 for r in rows) == 2 and sum(r.doc_id is None for r in rows) == 1


def test_empty(spark, docs):
    assert packing.pack_documents(docs.where("false"), RANKS).count() == 0


def test_hot_lengths_get_more_salts(spark):
    pieces = spark.range(3000).selectExpr("id as doc_id", "0 as piece", "if(id % 3 = 0, 64, cast(id % 60 + 1 as int)) as length")
    rows = packing.pack_pieces(pieces, capacity=64, per_salt=20).collect()
    assert len({(r.sequence_id, r.offset) for r in rows}) == len(rows) == 3000
    held = defaultdict(int)
    for r in rows:
        held[r.sequence_id] += r.length
    assert max(held.values()) <= 64 and len(held) == sum(n for _, n in packing.plan(np.bincount([r.length for r in rows], minlength=65), 64))


def test_few_sequences_on_uneven_histograms():
    r = np.random.default_rng(4)
    for lengths in (r.integers(1, 1025, 20_000), np.minimum(r.lognormal(5.5, 1, 20_000).astype(int) + 1, 1024), np.full(5000, 600), r.choice([513, 300, 211], 9000)):
        hist = np.bincount(lengths, minlength=1025).astype(np.int64)
        big = int(hist[513:].sum())  # no two of these share a sequence
        least = max(-(-int(lengths.sum()) // 1024), big)
        assert sum(n for _, n in packing.plan(hist, 1024)) <= 1.02 * least + 2


def test_salts_are_bounded(monkeypatch):
    monkeypatch.setattr(packing, "MOST_SALTS", 50)
    hist = np.array([0, *[1000] * 64])
    unit = max(4, -(-int(hist.sum()) // packing.MOST_SALTS))
    assert np.maximum(1, -(-hist // unit)).sum() <= 50 + 2 * 64
