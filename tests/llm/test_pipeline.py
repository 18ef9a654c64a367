import importlib.util
from pathlib import Path

import pytest

import corpus_pipeline as P
from lodestone.llm import decontaminate, toxicity
from lodestone.llm._common import table

DIR = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def _brute(name):
    """The brute-force functions of the operators' own tests."""
    spec = importlib.util.spec_from_file_location(name, Path(__file__).with_name(f"{name}.py"))
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    return module.brute


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_stages_equal_brute_force(spark):
    docs = table(spark, DIR, "documents")
    near, spans = _brute("test_neardup"), _brute("test_pii")
    items = [r.text for r in table(spark, DIR, "benchmark").collect()]

    kept = P.drop_toxic(spark, docs, DIR)
    model = toxicity.train_toxicity(docs, table(spark, DIR, "labels").select("doc_id", "toxic"))
    assert rows_of(kept) == sorted((tuple(r) for r in docs.collect() if model.score([r.text])[0] < 0.5), key=str)

    kept = spark.createDataFrame(kept.collect(), SCHEMA)
    before = sorted(kept.collect(), key=lambda r: r.doc_id)
    classes = near([r.text for r in before])
    kept = P.drop_near_duplicates(spark, kept, DIR)
    assert rows_of(kept) == sorted((tuple(r) for i, r in enumerate(before) if classes[i] == i), key=str)

    kept = spark.createDataFrame(kept.collect(), SCHEMA)
    before = kept.collect()
    kept = P.drop_contaminated(spark, kept, DIR)
    assert rows_of(kept) == sorted((tuple(r) for r in before if not decontaminate.exact_words(items, r.text)[1]), key=str)

    kept = spark.createDataFrame(kept.collect(), SCHEMA)
    before = {r.doc_id: r.text for r in kept.collect()}
    masked = P.mask_private(spark, kept, DIR).collect()
    assert {r.doc_id for r in masked} == set(before) and all(r.n_chars == len(r.text) for r in masked)
    for r in masked:
        assert not spans(r.text)
        found = spans(before[r.doc_id])
        assert (r.text == before[r.doc_id]) or found or "[SECRET]" in r.text
        if found and not any(x in r.text for x in ("[TERM]", "[SECRET]")) and all(a[2] <= b[0] for a, b in zip(found, found[1:], strict=False)):
            text, at = "", 0
            for a, _, e, kind in found:
                text, at = text + before[r.doc_id][at:a] + f"[{kind.upper()}]", e
            assert r.text == text + before[r.doc_id][at:]

    packed = P.pack(spark, spark.createDataFrame(masked, SCHEMA), DIR).collect()
    assert {r.doc_id for r in packed} == set(before)
    used = {}
    for r in packed:
        used[r.sequence_id] = used.get(r.sequence_id, 0) + r.length
    assert max(used.values()) <= 1024 and len(used) <= 1.1 * sum(used.values()) / 1024 + 2


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, "no id here", "en", "s", 10), (3, "said twice", "en", "s", 10), (3, "said twice", "en", "s", 10), (4, "said twice", "en", "s", 10), (5, "word " * 30_000, "en", "s", 150_000)]
    df = spark.createDataFrame(rows, SCHEMA)
    return df.selectExpr("*", "1 as score", "'x' as spans", "2 as _key", "3 as sequence_id", "4 as clean", "5 as toxic")


def test_odd_rows_in_every_stage(spark, odd):
    columns = odd.columns[:5]
    every = rows_of(odd.select(columns))
    for stage in (P.drop_toxic, P.drop_contaminated):
        out = stage(spark, odd, DIR)
        assert out.columns == P.COLUMNS and rows_of(out) == every
    out = P.drop_near_duplicates(spark, odd, DIR)
    assert rows_of(out) == sorted([(1, None, None, None, None), (None, "no id here", "en", "s", 10), (3, "said twice", "en", "s", 10), (5, "word " * 30_000, "en", "s", 150_000)], key=str)
    out = P.mask_private(spark, odd, DIR)
    assert out.columns == P.COLUMNS and sorted(str(r.text) for r in out.collect()) == sorted(["", "", "no id here", *["said twice"] * 3, "word " * 30_000])
    packed = P.pack(spark, odd, DIR).collect()
    assert sum(r.piece == 0 for r in packed) == 7 and sum(r.length for r in packed if r.doc_id == 5) > 30_000


def test_empty_tables_in_every_stage(spark, odd):
    for _, stage in P.STAGES:
        assert stage(spark, odd.where("false"), DIR).count() == 0
