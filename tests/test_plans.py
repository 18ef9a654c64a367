from datetime import date

import numpy as np
from pyspark.sql import functions as F

from lodestone.functions import embedding
from lodestone.plans import ingest, search

DIR = "/root/testdata/sf0.001"


def test_vectors_are_deterministic_unit_vectors(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "t string").select(embedding.embedded("t", lambda: embedding.offline_provider(8)).alias("v"))
    a, b, c, d = (np.array(r.v) for r in df.collect())
    assert np.allclose(a, b) and not np.allclose(a, c) and abs(np.linalg.norm(d) - 1) < 1e-6
    v = embedding.congruential_vector("x", 16)
    assert len(v) == 16 and all(-1 <= x < 1 for x in v) and v == embedding.congruential_vector("x", 16)


def test_ingest_plans(spark):
    cases = spark.createDataFrame([("1", "Lake", "Civil", "deed", ["A"], date(2024, 1, 2)), ("2", "Lake", "Civil", "x", ["B"], date(2023, 1, 2))], "case_number string, county string, case_type string, summary string, parties array<string>, filing_date date")
    docs = spark.createDataFrame([("1", "d1", "t", date(2024, 1, 2), "u"), ("2", "d2", "t", None, "u")], "case_number string, document_id string, title string, filed_date date, download_url string")
    assert ingest.ingest_recent(cases, docs, "Lake", F.lit(date(2024, 1, 5)), dry_run=True).first().n == 1
    assert ingest.ingest_search(cases, docs, "DEED").count() == ingest.ingest_case(cases, docs, "2").count() == 1
    both = ingest.union_of_courts({"x": cases.select("case_number"), "y": docs})
    assert both.where("court = 'x'").first().document_id is None and both.count() == 4
    rows = spark.createDataFrame([("35", "ic-35-1", "para one is long enough to stay\n\n" * 3), ("9", "ic-9", "short")], "title string, source_id string, text string")
    assert [r.chunk_id for r in ingest.statute_chunks(rows, room=50).orderBy("chunk_no").collect()] == ["ic-ic-35-1-000", "ic-ic-35-1-001", "ic-ic-35-1-002"]


def test_research(spark):
    from lodestone.plans.catalog import QUERY_TERMS, query_vector

    docs, vectors = (spark.read.parquet(f"{DIR}/{t}.parquet") for t in ("documents", "embeddings"))
    for mode, scope in (("production", "corpus"), ("lexical", "candidates")):
        r = search.research(docs, vectors, search.Request(QUERY_TERMS, query_vector(), top_k=5, mode=mode, scope=scope), "what now?").first()
        assert r.is_valid and len(r.cited) == len(r.context_ids) and r.confidence in ("High", "Medium", "Low") and r.context.startswith("[1] SOURCE: ")
    found = search.presented(spark.createDataFrame([("x" * 700, 0.12345678)], "content string, score double")).first()
    assert len(found.content) == 600 and found.score == 0.123457


def test_requests_are_bounded(spark):
    import pytest

    for k in (0, 21):
        with pytest.raises(ValueError):
            search.Request(["a"], [1.0], top_k=k)
    assert [search.Request(["a"], [1.0], top_k=k).n for k in (1, 5, 20)] == [4, 20, 20]
    for q in ("ab", "x" * 1001):
        with pytest.raises(ValueError):
            search.parsed_query(spark, q)
    told = search.parsed_query(spark, "Ind. Code § 35-42-1-1 in Marion")
    assert (told.weight, told.alpha, told.jurisdiction) == (0.70, 0.35, "Marion County")


def test_research_uses_dates_graph_and_scorer(spark):
    from datetime import timedelta

    rows = [(i, f"current license law number {i}", "src", date(2020, 1, 1) + timedelta(days=400 * i), None) for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, effective_date date, expiry_date date")
    vectors = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(6)], "vec_id long, embedding array<double>")
    request = search.Request(["license"], [1.0, 1.0], top_k=3)
    law = spark.createDataFrame([("1", False, "x")], "source_id string, is_good_law boolean, overruled_by string")
    tables = (spark.createDataFrame([("0", 1.0)], "source_id string, pagerank double"), law, spark.createDataFrame([("0", 2)], "source_id string, n_citing long"))
    r = search.research(docs, vectors, request, "what is the current license law", today=F.lit(date(2021, 6, 1)), graph_tables=tables).first()
    assert r.context_ids == ["0"]  # 1 is in force, but overruled
    by_id = search.research(docs, vectors, request, "license law as it was", scorer=F.col("id").cast("double")).first()
    assert set(by_id.context_ids) == {"3", "4", "5"}


def test_failed_courts_are_left_out(spark):
    failed = {}

    def broken():
        raise OSError("no answer")

    got = ingest.union_of_courts({"a": spark.range(2), "b": broken}, failed)
    assert got.count() == 2 and failed == {"b": "no answer"} and ingest.union_of_courts({"b": broken}) is None


def test_judgements_look_nothing_up_in_the_map_of_an_example(spark):
    from lodestone.operators import evaluate

    one = spark.createDataFrame([("a", ["x"], {"x": 2})], "query_id string, relevant_source_ids array<string>, graded_relevance map<string,int>")
    assert "element_at" not in evaluate.judgements(one)._jdf.queryExecution().optimizedPlan().toString()  # a walk through the map for each id


def test_records_and_examples(spark, tmp_path):
    from lodestone.operators import evaluate, filings, graph
    from lodestone.sources import records

    lines = spark.createDataFrame([('{"orderId": "1", "county": "Lake", "issuedDate": "2024-02-30"}',), ("oops",)], "value string")
    rows = records.decoded(lines, "protection_order")
    assert records.matching(rows, county="Lake", status=None).first().issuedDate is None and rows.where("bad is not null").count() == 1
    (tmp_path / "set.json").write_text('{"name": "n", "examples": [{"query_id": "a", "query": "q", "relevant_source_ids": ["x", "y"], "graded_relevance": {"y": 3, "z": 0}}]}')
    ex = evaluate.load_examples(spark, str(tmp_path / "set.json"))
    assert {tuple(r) for r in evaluate.judgements(ex).collect()} == {("a", "x", 1), ("a", "y", 3), ("a", "z", 0)}
    more = ex.unionByName(spark.createDataFrame([("a", ["z", "v", "u"], {"y": 2, "v": None, "w": None}), ("b", None, {"y": 2}), ("c", [], None)], "query_id string, relevant_source_ids array<string>, graded_relevance map<string,int>"), allowMissingColumns=True)
    assert sorted(evaluate.judgements(more).collect(), key=str) == sorted([("a", "x", 1), ("a", "y", 3), ("a", "z", 0), ("a", "v", 1), ("a", "u", 1), ("a", "w", None), ("b", "y", 2)], key=str)
    evaluate.save_examples(ex, str(tmp_path / "out"), "n")
    assert evaluate.load_examples(spark, str(tmp_path / "out")).first().query == "q"
    g = evaluate.guarded(spark.createDataFrame([("x [SOURCE: a]", ["a"]), ("x [SOURCE: b]", ["a"]), ("x", [])], "answer string, context_ids array<string>"), "none").collect()
    assert [r.answer for r in g] == ["x [SOURCE: a]", "none", "none"]
    nodes = spark.createDataFrame([("a", "1 Ind. 2"), ("b", None)], "source_id string, citation_string string")
    edges = spark.createDataFrame([("b", "1 Ind. 2", "cited", False)], "citing_id string, cited_id string, treatment string, is_negative boolean")
    assert graph.resolved(edges, nodes).first().cited_id == "a" and tuple(graph.sizes(nodes, edges).first()) == (2, 1, 0)
    found = spark.createDataFrame([("burst_filing", "high", 0.855, ["123456789", "b"]), ("x", "low", 0.5, ["b"])], "indicator_type string, severity string, confidence double, evidence array<string>")
    assert {r.evidence for r in filings.all_evidence(found).collect()} == {"123456789", "b"} and filings.displayed(found).first().first_source == "12345678"
