from datetime import date

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import chunking, evaluate, filings, fusion, graph, lexical, observe, versions


def col(spark, f, *values):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], "x string").select(f("x")).collect()]


def test_query_classification(spark):
    kinds = [r[0] for r in spark.createDataFrame([("I.C. § 5-1",), ("why is it so",), ("why I.C. § 5-1",), ("deeds",)], "x string").select(T.classified("x")["query_type"]).collect()]
    assert kinds == ["citation_lookup", "semantic", "hybrid", "hybrid"]


def test_jurisdiction_prefers_the_first_alias_and_matches_inside_words(spark):
    assert col(spark, T.jurisdiction, "Lake and Marion", "a challenge", "in court", "elsewhere", None) == ["Marion County", "Allen County", "Indiana", None, None]


def test_sentences_keep_citations_together(spark):
    assert col(spark, T.sentences, "See 1 N.E. 2. Held so. then") == [["See 1 N.E. 2.", "Held so. then"]]


def test_court_weight_prefers_the_longest_name(spark):
    assert col(spark, T.court_weight, "SCOTUS", "the court of appeals of indiana, 5th", "Windsor", "unknown", None) == [1.0, 0.70, 0.85, 0.35, 0.35]


def test_light_stem(spark):
    assert col(spark, lambda c: T.light_stem(F.col(c)), "filings", "filed", "courts", "cities", "was") == ["fil", "fil", "court", "citi", "was"]


@pytest.mark.parametrize("w", [0.0, 0.3, 0.5, 1.0])
def test_rrf(spark, w):
    dense = spark.createDataFrame([("a", 4.0), ("b", 3.0), ("c", 2.0), ("d", 1.0)], "id string, score double")
    sparse = spark.createDataFrame([("c", 4.0), ("a", 3.0), ("e", 2.0), ("f", 1.0)], "id string, score double")
    got = {r.id: r.score for r in fusion.rrf(dense, sparse, weight=w).collect()}
    want = {}
    for part, ids in ((1 - w, "abcd"), (w, "caef")):
        for i, x in enumerate(ids, 1):
            want[x] = want.get(x, 0) + part / (60 + i)
    assert got == pytest.approx({k: v for k, v in want.items() if v > 0})


def test_bm25_prefers_the_document_with_the_term(spark):
    docs = spark.createDataFrame([(1, "theft of goods"), (2, "theft theft case"), (3, "contract law text"), (4, None), (5, "")], "doc_id int, text string")
    got = {r.id: r.score for r in lexical.bm25(docs.fillna(""), ["theft"]).collect()}
    assert got[2] > got[1] > 0 == got[3] == got[5]


def test_graph(spark):
    nodes = spark.createDataFrame([(x,) for x in "abcd"], "source_id string")
    edges = spark.createDataFrame([("b", "a", "cited", False), ("c", "a", "cited", False), ("c", "b", "overruled", True), ("d", "c", "followed", False), ("z", "a", "cited", False)], "citing_id string, cited_id string, treatment string, is_negative boolean")
    rank = {r.source_id: r.pagerank for r in graph.pagerank(nodes, edges).collect()}
    assert max(rank.values()) == rank["a"] == 1.0 and rank["b"] < rank["c"]
    assert {r.source_id for r in graph.good_law(nodes, edges).where("not is_good_law").collect()} == {"b"}
    start = spark.createDataFrame([("d",)], "source_id string")
    assert {(r.source_id, r.depth) for r in graph.precedents(edges, start, 2).collect()} == {("c", 1), ("a", 2), ("b", 2)}


def test_empty_graph(spark):
    nodes = spark.createDataFrame([], "source_id string")
    edges = spark.createDataFrame([], "citing_id string, cited_id string, treatment string, is_negative boolean")
    assert graph.pagerank(nodes, edges, rounds=2).count() == graph.good_law(nodes, edges).count() == 0


@pytest.mark.parametrize(("n", "step", "want"), [(4, 1, []), (6, 1, [("medium", 0.6)]), (11, 1, [("high", 0.85)]), (6, 10, [])])
def test_burst(spark, n, step, want):
    rows = [(f"s{i}", "", ["Acme"], date.fromordinal(date(2024, 3, 1).toordinal() + step * i)) for i in range(n)]
    df = spark.createDataFrame([*rows, ("x", "", ["Acme"], None)], "source_id string, content string, parties array<string>, filing_date date")
    assert [(r.severity, pytest.approx(r.confidence)) for r in filings.burst_filing(df).collect()] == want


@pytest.mark.parametrize(("severities", "want"), [(["low"], "low"), (["medium"], "medium"), (["medium"] * 2, "high"), (["high"], "high"), (["high", "low", "low"], "critical"), (["high"] * 2, "critical"), (["critical"], "critical")])
def test_risk(spark, severities, want):
    df = spark.createDataFrame([(s,) for s in severities], "severity string")
    assert filings.risk_level(df).first().risk == want


def test_metrics_edge_cases(spark):
    q = spark.createDataFrame([("a",), ("b",)], "query_id string")
    got = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y")], "query_id string, rank int, doc_id string")
    rel = spark.createDataFrame([("a", "y", 2)], "query_id string, doc_id string, grade int")
    m = {(r.query_id, r.k): r for r in evaluate.ranking_metrics(q, got, rel, ks=(0, 1, 5)).collect()}
    assert m["b", 5].recall == 1.0 and m["b", 5].ndcg == 0.0 and m["a", 0].precision == 0.0
    assert m["a", 5].recall == 1.0 and m["a", 5].precision == 0.2 and m["a", 1].recall == 0.0 and m["a", 5].mrr == 0.5


def test_validation(spark):
    df = spark.createDataFrame([("The court held X. [SOURCE: a, § 1] [SOURCE: q]", ["a"]), ("These do not contain sufficient information.", ["a"])], "answer string, context_ids array<string>")
    a, b = evaluate.validated(df).collect()
    assert (a.missing, a.is_valid, a.uncited) == (["q"], False, ["The court held X."])
    assert b.is_valid and set(b.warnings) == {"fallback_response_detected", "no_citations_in_output"}


@settings(max_examples=50, deadline=None)
@given(st.lists(st.text("ab", min_size=1, max_size=30), max_size=20), st.integers(10, 40), st.integers(0, 9))
def test_packing_keeps_every_part_in_order(parts, room, overlap):
    runs = [r for r, _ in chunking.packed(parts, room, overlap)]
    assert all(len(r) == 1 or sum(map(len, r)) <= max(room, overlap + max(map(len, r))) for r in runs)
    seen = []
    for r in runs:
        k = next(k for k in range(len(r) + 1) if seen[len(seen) - k :] == r[:k] and len(seen) + len(r) - k <= len(parts) and parts[len(seen) : len(seen) + len(r) - k] == r[k:])
        seen += r[k:]
    assert seen == parts


def test_chunks(spark):
    body = "This is a sentence of some length here. " * 5
    docs = spark.createDataFrame([(1, "short"), (2, f"SECTION 1. One\n{body}\nSECTION 2. Two\n{body * 20}"), (3, None), (4, "   ")], "doc_id int, text string")
    rows = chunking.chunk_documents(docs, max_tokens=100).collect()
    assert {r.source_id for r in rows} == {"1", "2"}
    two = [r for r in rows if r.source_id == "2"]
    assert {r.section.split(".")[0] for r in two} == {"SECTION 1", "SECTION 2"} and len(two) > 5
    assert [r.chunk_id for r in two] == [f"2:chunk:{i}" for i in range(len(two))]


def test_addresses_are_no_headers():
    for text in ("56.187.231.175 reads a line.\n" + "x" * 120, "one\n1.22.3.4\n" + "x" * 120):
        assert [(c["section"], c["char_start"], c["char_end"], c["content"]) for c in chunking.document_chunks("a", text, 2048, 256, 100)] == [("", 0, len(text), text)]
    assert [h for h, _, _ in chunking.sections("1.2.3.4. Terms\n" + "x" * 120 + "\n1.2 Scope\n" + "x" * 120, 100)] == ["1.2.3.4. Terms", "1.2 Scope"]


def test_versions(spark):
    rows = spark.createDataFrame([("a", "x", 1), ("a", "y", 2), ("b", "x", 1)], "source_id string, content string, ingested_at int")
    log = versions.version_log(versions.with_hash(rows))
    assert {(r.source_id, r.content) for r in log.where("is_current").collect()} == {("a", "y"), ("b", "x")}
    again = versions.new_versions(rows.where("content = 'x'"), log)
    assert again.count() == 0


def test_upsert_keeps_first_columns(spark):
    cur = spark.createDataFrame([(1, "old", "d1", 1)], "id int, v string, first string, t int")
    new = spark.createDataFrame([(1, "new", "d2", 1), (2, "n", "d3", 1)], "id int, v string, first string, t int")
    assert {tuple(r) for r in versions.upsert_latest(cur, new, "id", "t", keep=("first",)).collect()} == {(1, "new", "d1", 1), (2, "n", "d3", 1)}


def test_limits(spark):
    ev = spark.createDataFrame([(1, t) for t in (0, 1, 2, 61, 62)], "user_id long, s long").withColumn("ts", F.timestamp_seconds("s"))
    fixed = observe.fixed_window_limit(ev, "user_id", "ts", limit=2).orderBy("seq").collect()
    assert [r.allowed for r in fixed] == [True, True, False, True, True]
    bucket = observe.token_bucket(ev, "user_id", "ts", capacity=2, per_second=0.02).orderBy("seq").collect()
    assert [r.allowed for r in bucket] == [True, True, False, True, False]


def test_alarm_needs_consecutive_periods(spark):
    ev = spark.createDataFrame([(60 * m, v) for m, v in ((0, 9.0), (5, 9.0), (15, 9.0), (20, 9.0), (25, 9.0))], "s long, value double").withColumn("ts", F.timestamp_seconds("s"))
    rows = observe.alarms(ev, "ts", 5, F.max("value"), 5, 3).orderBy("period_start").collect()
    assert [r.alarm for r in rows] == [False, False, False, False, False, True]


@pytest.mark.parametrize("n", [1, 2, 3, 1000])
def test_order_statistics_are_exact(spark, n):
    import random

    from lodestone.operators.ordering import order_statistics

    r = random.Random(n)
    data = {g: [r.choice([r.gauss(0, 1), 0.5]) for _ in range(n)] for g in "ab"}
    df = spark.createDataFrame([(g, v) for g, vs in data.items() for v in vs] + [("a", None)], "g string, v double").repartition(3)
    got = {x.g: x for x in order_statistics(df, ["g"], "v", {"low": F.lit(0), "mid": F.floor(F.col("n") / 2), "top": F.col("n") - 1}).collect()}
    for g, vs in data.items():
        vs = sorted(vs)
        assert (got[g].n, got[g].low, got[g].mid, got[g].top) == (n, vs[0], vs[n // 2], vs[-1])


def test_next_in_group_crosses_partitions(spark):
    from lodestone.operators.ordering import with_next_in_group

    rows = [("hot", i, f"v{i}") for i in range(500)] + [("b", 1, "x"), (None, 1, "n"), (None, 2, "m")]
    df = spark.createDataFrame(rows, "g string, t int, v string").repartition(4)
    got = {(x.g, x.t): x.nxt for x in with_next_in_group(df, "g", ["t"], "v", "nxt").collect()}
    assert all(got["hot", i] == (f"v{i + 1}" if i < 499 else None) for i in range(500)) and got["b", 1] is None and got[None, 1] == "m" and got[None, 2] is None


def test_index_and_scan_give_the_same_scores(spark, tmp_path):
    docs = spark.createDataFrame([(1, "The theft of the goods"), (2, "theft THEFT case"), (3, ""), (4, "the the the"), (5, "the end")], "doc_id int, text string")
    lexical.build_index(docs, str(tmp_path / "ix"), buckets=4)
    for terms in (["the", "Theft"], ["nowhere"], ["goods"], []):
        want = {r.id: r.score for r in lexical.bm25(docs, terms).collect() if r.score}
        assert {r.id: r.score for r in lexical.bm25_from_index(spark, str(tmp_path / "ix"), terms).collect() if r.score} == pytest.approx(want)


def test_an_index_holds_a_row_for_each_term_of_a_slice(spark, tmp_path):
    texts = ["the theft of the goods", None, "", *(f"the end {i}" for i in range(40)), "\x1c the\x1ct"]
    docs = spark.createDataFrame([*((f"d{i}", t) for i, t in enumerate(texts)), ("d0", "the goods"), (None, "goods")], "name string, body string")
    lexical.build_index(docs, str(tmp_path / "ix"), buckets=4, id_col="name", text_col="body")
    rows = spark.read.parquet(str(tmp_path / "ix/postings")).where("term = 'the'").collect()
    assert len(rows) <= spark.sparkContext.defaultParallelism  # not a row for each of its 42 postings
    assert sum(r.n for r in rows) == sum(len(r.docs) for r in rows) == 42 and sum(r.words for r in rows) == 43
    scan, read = lexical.statistics(docs, [], id_col="name", text_col="body"), spark.read.parquet(str(tmp_path / "ix/statistics")).first()
    assert (read.n_docs, read.mean_length) == (scan.n_docs, pytest.approx(scan.mean_length)) and read.mean_idf == pytest.approx(lexical.mean_idf(docs, "body", scan.n_docs))
    terms = ["the", "goods", "the\x1ct"]
    want = sorted((str(r.id), round(r.score, 9)) for r in lexical.bm25(docs.where("name is null or name <> 'd0'").union(docs.where("name = 'd0'").withColumn("name", F.concat("name", F.length("body")))), terms, id_col="name", text_col="body").collect() if r.score)
    got = {str(r.id): r.score for r in lexical.bm25_from_index(spark, str(tmp_path / "ix"), terms).collect()}
    both = sum(s for i, s in want if i.startswith("d0"))  # of two rows with one id
    assert got == pytest.approx({i: s for i, s in want if not i.startswith("d0")} | {"d0": both}, abs=1e-6)


def test_vocabulary_is_counted_only_for_frequent_terms(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "common " + ("rare" if i == 0 else "x")) for i in range(9)], "doc_id int, text string")
    called = []
    mean = lexical.mean_idf
    monkeypatch.setattr(lexical, "mean_idf", lambda *a: called.append(1) or mean(*a))
    lexical.bm25(docs, ["rare"])
    assert not called
    lexical.bm25(docs, ["common"])
    assert called


def test_nearest_neighbours_in_blocks(spark):
    import numpy as np

    from lodestone.operators import knn

    v = np.random.default_rng(1).normal(size=(300, 8))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(999, None)], "vec_id long, embedding array<double>").repartition(5)
    asked = df.where("vec_id % 10 = 0")
    got = {}
    for r in knn.knn_batch(df, asked, 5, block=7, tile=11).collect():
        got.setdefault(r.query_id, []).append((-round(r.score, 9), r.id))
    whole, tiled = (sorted((r.query_id, r.id, round(r.score, 9)) for r in knn.knn_batch(df, asked, 5, **o).collect()) for o in ({}, {"block": 7, "tile": 100}))
    assert whole == tiled
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    for q in range(0, 300, 10):
        s = [(-round(float(u[q] @ u[j]), 9), j) for j in range(300) if j != q]
        assert sorted(got[q]) == sorted(s)[:5]
    assert set(got) == set(range(0, 300, 10)) and knn.knn_batch(df, asked.where("false"), 5).count() == 0
    assigned, centres = knn.build_ivf(df, lists=8)
    shares = knn.recall(knn.probe_ivf_batch(assigned, centres, asked, 5, probes=8), knn.knn_batch(df, asked, 5), 5).collect()
    assert len(shares) == 30 and all(x.recall == 1.0 for x in shares)  # all lists are all rows
    own = {r.vec_id: r.list_id for r in assigned.collect()}
    c = np.array(centres) / np.linalg.norm(centres, axis=1, keepdims=True)
    want = set()
    for q in range(0, 300, 10):
        lists = set(np.argsort(-(u[q] @ c.T))[:2])
        s = sorted((-round(float(u[q] @ u[j]), 9), j) for j in range(300) if j != q and own[j] in lists)
        want |= {(q, j) for _, j in s[:5]}
    for tile in (13, 1000):
        assert {(r.query_id, r.id) for r in knn.probe_ivf_batch(assigned, centres, asked, 5, probes=2, tile=tile, block=3).collect()} == want


def test_neighbours_with_equal_scores_come_by_id(spark):
    from lodestone.operators import knn

    df = spark.createDataFrame([(i, [1.0, float(i % 2)]) for i in range(40)] + [(None, [1.0, 1.0]), (50, None)], "vec_id long, embedding array<double>").repartition(3)
    for options in ({}, {"block": 2, "tile": 4}):
        got = knn.knn_batch(df, df.where("vec_id < 8 or vec_id is null"), 3, **options).collect()
        assert {r.query_id for r in got} == set(range(8))
        for q in range(8):
            assert sorted(r.id for r in got if r.query_id == q) == [j for j in range(q % 2, 40, 2) if j != q][:3]


def test_rows_numbered_across_parts(spark):
    from lodestone.operators.ordering import numbered_in_group

    rows = [("hot", i) for i in range(200)] + [(None, i) for i in range(30)] + [(f"g{i % 7}", i) for i in range(50)]
    df = spark.createDataFrame(rows, "g string, o long").repartition(5)
    got = numbered_in_group(df, "g", ["o"], "n")
    assert got.columns == ["g", "o", "n"]
    seen = {}
    for r in got.collect():
        seen.setdefault(r.g, []).append((r.o, r.n))
    assert sum(map(len, seen.values())) == len(rows)
    assert all([n for _, n in sorted(v)] == list(range(1, len(v) + 1)) for v in seen.values())
    assert numbered_in_group(df.where("false"), "g", ["o"]).count() == 0


def test_evidence_is_bounded_and_links_are_whole(spark):
    rows = [(f"s{i:03d}", "A quitclaim deed for the sum of $1.00 XXX-XX-1234", ["Entity 4 LLC"], date(2024, 1, 1)) for i in range(50)]
    df = spark.createDataFrame(rows, "source_id string, content string, parties array<string>, filing_date date")
    found = {r.indicator_type: r for r in filings.indicators(df, evidence=3).collect()}
    assert set(found) == {"burst_filing", "identity_reuse", "deed_fraud_pattern", "suspicious_entity"}
    assert all(r.evidence == ["s000", "s001", "s002"] and r.n_evidence == 50 for r in found.values())
    assert filings.evidence_links(df).count() == 200
    assert filings.indicators(df.where("false")).count() == 0


def test_model_reranker_loads_once_and_scores_batches(spark):
    rows = spark.createDataFrame([(1, "the cat"), (2, "the dog and the cat"), (3, None)], "id int, content string").coalesce(1)
    sizes = []

    def make():
        def score(pairs):
            sizes.append(len(pairs))
            return [float(len(t)) for _, t in pairs]

        return score

    got = fusion.rerank(rows, fusion.model_reranker("q", make, batch=2), 2).collect()
    assert [(r.id, r.score) for r in got] == [(2, 19.0), (1, 7.0)]
    assert fusion.overlap_scorer()([("the cat", "The CAT sat"), ("", "x")]) == [1.0, 0.0]
