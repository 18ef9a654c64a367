"""Stored tables, full text and filters of both branches."""

import math
import os
import re
from datetime import datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lodestone.functions.stemming import STOP_WORDS, stem
from lodestone.operators import fulltext, lexical
from lodestone.plans import search
from lodestone.sources.tables import StoredTable, record_versions, version_table

SCHEMA = "k long, s string, body string, first int"
#: words of the stemmer's published sample vocabulary, with their stems
SAMPLE = """consign consign|consigned consign|consigning consign|consignment consign|consistency consist|consistently consist|consolation consol|consolatory consolatori|consolidated consolid
consolingly consol|consonant conson|conspicuously conspicu|conspiracy conspiraci|conspirators conspir|constables constabl|constancy constanc|knackeries knackeri|knaves knave|knavish knavish|kneaded knead
knees knee|knelt knelt|knif knif|knightly knight|knitted knit|knives knive|knockers knocker|knopp knopp|skies sky|dying die|ties tie|cries cri|by by|say say|hopping hop|hoping hope
luxuriated luxuri|generously generous|generate generat|communism communism|relational relat|hopefulness hope|replacement replac|kiwis kiwi|gas gas|bliss bliss|proceed proceed|exceeding exceed|inning inning
agreed agre|feed feed|analogies analog|probate probat|rate rate|controll control|youth youth|happy happi"""


def test_stems_of_the_sample_vocabulary():
    pairs = [p.split() for p in re.split(r"[|\n]", SAMPLE)]
    assert {w: stem(w) for w, _ in pairs} == dict(pairs)
    assert len(STOP_WORDS) == 127 and stem("") == "" and stem("7") == "7"


def make(spark, path, rows=0, **options):
    t = StoredTable(spark, str(path), SCHEMA, key="k", keep=("first",), **{"buckets": 8} | options)
    if rows:
        t.merge(spark.range(rows).select(F.col("id").alias("k"), F.concat(F.lit("s"), F.col("id") % 5).alias("s"), F.lit("one").alias("body"), F.lit(1).alias("first")))
    return t


def files(path):
    return {p: os.stat(p).st_mtime_ns for p in Path(path).rglob("*.parquet") if "data" in str(p)}


def content(t, **options):
    return sorted(map(tuple, t.read(**options).collect()), key=str)


def test_an_upsert_rewrites_its_buckets_only(spark, tmp_path):
    t = make(spark, tmp_path, 400)
    before, manifest = files(tmp_path), t.manifest()
    change = spark.createDataFrame([(7, "s2", "two", 2), (9, "s4", "two", 2), (1000, "s0", "two", 2)], SCHEMA)
    assert t.merge(change) == 2
    touched = {r[0] for r in change.select(t.bucket()).collect()}
    now = t.manifest()
    assert {b for b in now if now[b] != manifest[b]} == touched and len(touched) <= 3
    new = {p for p in files(tmp_path) if p not in before}
    assert {int(re.search(r"_bucket=(\d+)", str(p))[1]) for p in new} == touched
    assert {p: m for p, m in files(tmp_path).items() if p in before} == before  # nothing stored is written over
    got = {r.k: (r.body, r.first) for r in t.read().collect()}
    assert (got[7], got[9], got[1000], got[8], len(got)) == (("two", 1), ("two", 1), ("two", 2), ("one", 1), 401)
    assert content(t, version=1) == [(k, f"s{k % 5}", "one", 1) for k in sorted(range(400), key=str)]


def test_a_repeated_batch_changes_nothing(spark, tmp_path):
    t = make(spark, tmp_path, 50)
    change = spark.createDataFrame([(7, "s2", "two", 2), (99, None, None, None)], SCHEMA)
    assert t.merge(change) == 2
    before = files(tmp_path)
    assert t.merge(change) == 2 and t.merge(spark.createDataFrame([], SCHEMA)) == 2 and files(tmp_path) == before


def test_a_crash_before_the_manifest_leaves_the_old_state(spark, tmp_path, monkeypatch):
    t = make(spark, tmp_path, 50)
    old, change = content(t), spark.createDataFrame([(7, "s2", "two", 2)], SCHEMA)
    with monkeypatch.context() as m:
        m.setattr(StoredTable, "_publish", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            t.merge(change)
    assert t.version() == 1 and content(t) == old
    (tmp_path / "manifest" / "00000002").mkdir()  # a manifest that was begun
    assert t.version() == 1 and content(t) == old
    assert t.merge(change) == 2 and dict((r[0], r[2]) for r in content(t))[7] == "two"


def test_last_of_equal_keys_wins_and_null_keys_are_refused(spark, tmp_path):
    t = make(spark, tmp_path)
    t.merge(spark.createDataFrame([(1, "a", "x", 1), (1, "b", "y", 3), (1, "c", "z", 2)], SCHEMA), order="first")
    assert content(t) == [(1, "b", "y", 3)]
    with pytest.raises(ValueError, match="no k"):
        t.merge(spark.createDataFrame([(None, "a", "x", 1)], SCHEMA))
    assert t.version() == 1 and content(make(spark, tmp_path / "none")) == []


def test_deletion_and_replacement_by_source(spark, tmp_path):
    t = make(spark, tmp_path, 100, by="s")
    manifest = t.manifest()
    assert t.delete(spark.createDataFrame([("s1",), ("nowhere",)], "s string")) == 20 and t.read().where("s = 's1'").count() == 0 and t.read().count() == 80
    assert sum(t.manifest()[b] != manifest[b] for b in manifest) == 1
    assert t.delete(spark.createDataFrame([("s1",)], "s string")) == 0 and t.version() == 2
    new = spark.createDataFrame([(2, "s2", "new", 5), (500, "s2", "new", 5)], SCHEMA)
    assert t.replace(new) == 3 and t.replace(new) == 3
    assert sorted(r.k for r in t.read().where("s = 's2'").collect()) == [2, 500] and t.read().count() == 62
    assert t.delete(spark.createDataFrame([(500,)], "k long"), "k") == 1 and t.read().count() == 61


def test_versions_in_place(spark, tmp_path):
    t = version_table(spark, str(tmp_path), 8)
    rows = lambda *r: spark.createDataFrame([(s, c, datetime(2024, 1, d)) for s, c, d in r], "source_id string, content string, ingested_at timestamp")
    assert record_versions(t, rows(("a", "one", 1), ("a", "one", 2), ("b", "one", 1))).count() == 2
    assert record_versions(t, rows(("a", "two", 3), ("a", "three", 4))).count() == 2
    assert record_versions(t, rows(("a", "one", 9))).count() == 0  # known, so it stays superseded
    log = {(r.source_id, r.ingested_at.day): r.is_current for r in t.read().collect()}
    assert log == {("a", 1): False, ("a", 3): False, ("a", 4): True, ("b", 1): True}


def _brute_rank(lists):
    if len(lists) == 1:
        return 0.1 * sum(1 / j**2 for j in range(1, len(lists[0]) + 1)) / 1.64493406685
    left, some = 1.0, False
    for i, a in enumerate(lists):
        for b in lists[:i]:
            for x in a:
                for y in b:
                    if 0 < abs(x - y) <= 100:
                        some = True
                        left *= 1 - 0.1 * math.sqrt(1 / (1.005 + 0.05 * math.exp(abs(x - y) / 1.5 - 2)))
    return 1 - left if some else 1e-20


def test_rank_equals_brute_force():
    import random

    r = random.Random(5)
    for _ in range(60):
        lists = [sorted(r.sample(range(1, 400), r.randrange(0, 12))) for _ in range(r.randrange(1, 5))]
        assert math.isclose(fulltext.rank(lists), _brute_rank(lists), rel_tol=1e-9, abs_tol=1e-15)


def test_full_text_by_scan_and_index(spark, tmp_path):
    docs = [(1, "The courts considered the statutes. Courts!"), (2, "court"), (3, None), (4, ""), (5, "statute " + "x " * 150 + "court"), (6, "a courted statute"), (7, "nothing of it")]
    rows = spark.createDataFrame([(i, t, "en") for i, t in docs], "doc_id long, text string, lexeme string")
    wanted = fulltext.lexemes("the court of statutes")
    assert wanted == ["court", "statut"]
    by_scan = fulltext.fulltext_search(fulltext.scan_hits(rows, wanted), 10).collect()
    fulltext.build_fulltext(rows, str(tmp_path / "i"), buckets=4)
    assert by_scan == fulltext.fulltext_search(fulltext.index_hits(spark, str(tmp_path / "i"), wanted), 10).collect()
    assert [r.id for r in by_scan] == [1, 6, 2, 5] and by_scan[2].score == 1e-20
    one = fulltext.fulltext_search(fulltext.scan_hits(rows, ["court"]), 2).collect()
    assert [r.id for r in one] == [1, 2] and one[0].score > one[1].score


def test_filter_holds_for_both_branches(spark, tmp_path):
    """The best vector and the best text fail the filter."""
    docs = spark.createDataFrame([(i, t, c) for i, (t, c) in enumerate([("alpha alpha", "Criminal"), ("alpha beta", "Civil"), ("gamma", "Criminal"), ("beta", "Civil"), ("delta", "Criminal")])], "doc_id long, text string, case_type string")
    vectors = spark.createDataFrame([(i, [1.0, i / 10]) for i in range(5)], "vec_id long, embedding array<double>")
    request = search.Request(["alpha"], [1.0, 0.0], top_k=5, where=F.col("case_type") == "Civil")
    civil = {1, 3}
    assert {r.id for r in search.hybrid_search(docs, vectors, request).collect()} == civil
    assert {r.id for r in search.served_search(docs, vectors, "alpha beta", [1.0, 0.0], case_type="Civil").collect()} == civil
    lexical.build_index(docs, str(tmp_path / "i"), buckets=2)
    assert {r.id for r in search.indexed_search(vectors, str(tmp_path / "i"), request, docs).collect()} == civil
    with pytest.raises(ValueError, match="docs"):
        search.indexed_search(vectors, str(tmp_path / "i"), request)
    with pytest.raises(ValueError, match="candidates"):
        search.indexed_search(vectors, str(tmp_path / "i"), search.Request(["alpha"], [1.0, 0.0], scope="candidates"))


def test_vector_index(spark, tmp_path):
    import numpy as np

    from lodestone.operators import ivfpq, knn

    rng = np.random.default_rng(3)
    rows = [(i, v, 0) for i, v in enumerate((rng.standard_normal((30, 32))[rng.integers(0, 30, 900)] + 0.7 * rng.standard_normal((900, 32))).tolist())]
    odd = [(9001, None, 0), (9002, [0.0] * 32, 0), (9003, [float("nan")] * 32, 0)]
    vectors = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, list_id int")
    path = str(tmp_path / "i")
    ivfpq.build(vectors, path, lists=20, parts=8, longest=60)
    stored = ivfpq.stored_lists(spark, path)
    assert stored.count() == 900 and stored.groupBy("list_id", "slice").count().agg(F.max("count")).first()[0] < 110 and stored.where("slice > 0").count() > 0
    asked = vectors.where("vec_id % 20 = 0")
    exact = knn.knn_batch(vectors.where("vec_id < 9000"), asked, 10)
    found = ivfpq.search(spark, path, asked, 10, probes=5, rerank=60)  # a quarter of the lists, a 15th of the rows scored exactly
    recalls = [r.recall for r in knn.recall(found, exact, 10).collect()]
    assert len(recalls) == 45 and sum(recalls) / 45 >= 0.9
    full = ivfpq.search(spark, path, asked, 10, probes=20, rerank=900)
    assert {(r.query_id, r.id) for r in full.collect()} == {(r.query_id, r.id) for r in exact.collect()}
    plan = found._jdf.queryExecution().toString()
    assert "dynamicpruning" in plan.lower()


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_vector_index_finds_nine_of_ten(spark, sf):
    from lodestone.plans import catalog

    got = [r.recall for r in catalog.queries()["ivfpq_recall"](spark, f"/root/testdata/{sf}").collect()]
    assert len(got) == {"sf0.01": 5, "sf0.1": 20}[sf] and sum(got) / len(got) >= 0.9


def test_what_streams_read_is_not_landed_by_one_task(spark, tmp_path, monkeypatch):
    from lodestone.plans import catalog_stored

    monkeypatch.setattr(catalog_stored, "scratch_path", lambda _, name: str(tmp_path / name))
    docs = spark.range(40).selectExpr("id as doc_id", "'s' as source", "'t' as text")
    monkeypatch.setattr(catalog_stored.ingest, "run_stored_ingest", lambda *_: 1 / 0)
    monkeypatch.setattr(catalog_stored, "table", lambda *_: docs.repartition(4))
    with pytest.raises(ZeroDivisionError):
        catalog_stored.stored_ingest(spark, str(tmp_path))
    assert len(list((tmp_path / "landed").glob("*.parquet"))) == 4
    monkeypatch.setattr(catalog_stored, "scratch_path", lambda _, name: str(tmp_path / f"drained-{name}"))
    assert catalog_stored._drained(spark, [docs.repartition(4)], lambda s: s).count() == 40
    assert len(list((tmp_path / "drained-landed").glob("*.parquet"))) == 4
