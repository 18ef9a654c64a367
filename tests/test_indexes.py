"""Segmented index, joins with names, precedents of many starts, alarms over a stream."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lodestone.functions.text import bm25_tokens
from lodestone.operators import graph, lexical, names, segments
from lodestone.operators.segments import SegmentedIndex
from lodestone.streaming import state

WORDS = [f"w{k}" for k in range(60)]


def corpus(spark, n, seed=2):
    r = random.Random(seed)
    rows = [(i, " ".join(r.choices(WORDS, [1 / (k + 1) for k in range(60)], k=r.randrange(1, 40))) + (" rare" * r.randrange(1, 4) if r.random() < 0.04 else ""), f"s{i % 4}") for i in range(n)]
    return spark.createDataFrame([*rows, (n, None, "s0"), (n + 1, "", None)], "doc_id long, text string, source string")


def top(rows, k):
    return [(r.id, round(r.score, 9)) for r in rows.orderBy(F.desc(F.round("score", 9)), "id").limit(k).collect()]


def test_segments_give_the_top_of_the_corpus_and_skip_blocks(spark, tmp_path):
    docs, terms = corpus(spark, 600), ["rare", "w50", "w41", "nowhere"]
    index = SegmentedIndex(spark, str(tmp_path), buckets=4, block=16)
    for part in range(3):
        index.add(docs.where(F.col("doc_id") % 3 == part))
    counts = {}
    want = top(lexical.bm25(docs.where("text is not null"), terms).where("score > 0"), 10)
    all_docs = top(lexical.bm25(docs.withColumn("text", F.coalesce("text", F.lit(""))), terms).where("score > 0"), 10)
    assert top(index.search(terms, 10, counts=counts), 10) == all_docs and len(want) == 10
    assert 0 < counts["read"] < counts["blocks"]
    frequent = ["w0", "rare"]  # w0 is in most documents, so its idf falls back to the mean of the vocabulary
    assert top(index.search(frequent, 10), 10) == top(lexical.bm25(docs.withColumn("text", F.coalesce("text", F.lit(""))), frequent).where("score > 0"), 10)
    assert index.search([], 5).count() == 0 and index.search(["nowhere"], 5).count() == 0


def test_deletion_needs_no_rebuild_and_a_merge_forgets(spark, tmp_path):
    docs, terms = corpus(spark, 200), ["rare", "w30"]
    index = SegmentedIndex(spark, str(tmp_path), buckets=4, block=16)
    index.add(docs)
    segment = sorted(p for p in tmp_path.rglob("segments/*/blocks/**/*.parquet"))
    gone = spark.createDataFrame([("s1",), ("s2",)], "source string")
    assert index.delete_source(gone) == 100 and index.delete_source(gone) == 0
    assert sorted(tmp_path.rglob("segments/*/blocks/**/*.parquet")) == segment
    assert all(r.id % 4 not in (1, 2) for r in index.search(terms, 100).collect()) and index.search(terms, 100).count() > 0
    index.merge()
    left = docs.where("source is null or source not in ('s1', 's2')").withColumn("text", F.coalesce("text", F.lit("")))
    assert top(index.search(terms, 20), 20) == top(lexical.bm25(left, terms).where("score > 0"), 20)
    index.add(corpus(spark, 50, 9).withColumn("doc_id", F.col("doc_id") + 1000))
    assert len(index.log()) == 2
    (tmp_path / "log" / "00000099").mkdir()  # a change that was begun
    assert len(index.log()) == 2


def _exchanges(plan):
    return plan._jdf.queryExecution().executedPlan().toString().count("Exchange")


def test_shards_are_made_and_merged_without_shuffling_postings(spark, tmp_path, monkeypatch):
    docs, terms, plans = corpus(spark, 400), ["rare", "w30"], []
    index = SegmentedIndex(spark, str(tmp_path), buckets=4, block=16)
    segment = index._segment
    monkeypatch.setattr(index, "_segment", lambda kind, blocks, known: (plans.append(blocks), segment(kind, blocks, known)))
    for part in range(2):
        index.add(docs.where(F.col("doc_id") % 2 == part))
    assert [_exchanges(p) for p in plans] == [1, 1]  # that of the texts
    before = {r.shard for r in index._docs().collect()}
    index.delete_source(spark.createDataFrame([("s1",)], "source string"))
    index.merge()
    assert "hashpartitioning(shard" not in plans[2]._jdf.queryExecution().executedPlan().toString()  # blocks stay where they are
    left = docs.where("source is null or source <> 's1'").withColumn("text", F.coalesce("text", F.lit("")))
    want = top(lexical.bm25(left, terms).where("score > 0"), 20)
    assert top(index.search(terms, 20), 20) == want and len({r.shard for r in index._docs().collect()}) > len(before)
    rows = index._blocks(None).select("term", "shard", "n", F.size("docs").alias("k"), "max_tf", F.array_max("docs.tf").alias("t"), "min_dl", F.array_min("docs.dl").alias("d")).collect()
    assert all(r.n == r.k and r.max_tf == r.t and r.min_dl == r.d for r in rows) and len({(r.term, r.shard) for r in rows}) == len(rows)
    held = {(r.id, r.shard) for r in index._docs().collect()}
    assert {(r.id, r.shard) for r in index._blocks(None).select("shard", F.explode("docs.id").alias("id")).collect()} <= held and len(held) == left.count()


def test_words_of_blocks_are_those_of_the_scan(spark):
    import pyarrow as pa

    texts = [None, "", " ", " a  b ", "\x1c", *(f"A{chr(c)}b{chr(c)}{chr(c)} {chr(c)}c" for c in [*range(1, 0x3100), 0xFEFF, 0x1F600])]
    want = {r.i: (r.low, r.t) for r in spark.createDataFrame(list(enumerate(texts)), "i int, text string").select("i", F.lower("text").alias("low"), bm25_tokens("text").alias("t")).collect()}
    for some in (range(5), [i for i in want if i not in range(4, 37)], list(want)):  # with and without the separators that Arrow alone splits at
        low = pa.array([want[i][0] for i in some], pa.string())
        assert lexical.lengths(low).tolist() == [len(want[i][1] or []) for i in some]
        made = lexical.blocks(pa.array(list(some)), low)
        got = {(d["id"], t): (d["tf"], d["dl"]) for t, docs in zip(made["term"].to_pylist(), made["docs"].to_pylist()) for d in docs}
        assert got == {(i, t): (want[i][1].count(t), len(want[i][1])) for i in some for t in want[i][1] or []}
    batches = [pa.RecordBatch.from_pydict({"i": list(range(k, k + 4)), "text": ["x" * k, None, "", "yy"]}) for k in (0, 4, 8)]
    for most in (1, 6, 100):
        with pytest.MonkeyPatch.context() as m:
            m.setattr(lexical, "SLICE", most)
            cut = list(lexical.slices(batches, "text"))
        assert [i for b in cut for i in b.column("i").to_pylist()] == list(range(12)) and (len(cut) > 1) == (most < 100)


def test_a_segment_is_made_of_blocks_not_of_postings(spark, tmp_path, monkeypatch):
    rows = [(1, "a b\x1cc a", "s"), (1, "a", "s"), (None, "B b", None), (3, None, "s"), (4, "\x1d \u00a0d", "s")]
    docs, plans = spark.createDataFrame(rows, "doc_id int, text string, source string"), []
    index = SegmentedIndex(spark, str(tmp_path), buckets=2, block=2)
    segment = index._segment
    monkeypatch.setattr(index, "_segment", lambda kind, blocks, known: (plans.append(blocks), segment(kind, blocks, known)))
    index.add(docs)
    plan = plans[0]._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Aggregate" not in plan  # no row for each posting in the JVM
    got = sorted(((r.term, d.id is None, d.id, d.tf, d.dl) for r in index._blocks(None).collect() for d in r.docs), key=str)
    assert got == sorted([("a", False, 1, 2, 3), ("b\x1cc", False, 1, 1, 3), ("a", False, 1, 1, 1), ("b", True, None, 2, 2), ("\x1d", False, 4, 1, 2), ("d", False, 4, 1, 2)], key=str)
    assert sorted(r.dl for r in index._docs().collect()) == [0, 1, 2, 2, 3]


@pytest.mark.parametrize("most", [2_000_000, 0])
def test_a_merge_joins_shards_that_have_become_small(spark, tmp_path, monkeypatch, most):
    monkeypatch.setattr(segments, "BROADCAST_IDS", most)
    docs, terms = corpus(spark, 400), ["rare", "w30"]
    index = SegmentedIndex(spark, str(tmp_path), buckets=4, block=16)
    for part in range(2):
        index.add(docs.where(F.col("doc_id") % 2 == part))
    index.delete_source(spark.createDataFrame([("s1",), ("s2",), ("s3",)], "source string"))
    index.merge()
    left = docs.where("source is null or source = 's0'").withColumn("text", F.coalesce("text", F.lit("")))
    assert top(index.search(terms, 20), 20) == top(lexical.bm25(left, terms).where("score > 0"), 20)
    assert len({r.shard for r in index._docs().collect()}) <= 7
    index.delete_source(spark.createDataFrame([("s0",)], "source string"))
    index.merge()
    assert index.search(terms, 20).count() == 0 and [(r[0], r[2]) for r in index.log()] == [("merge", 1)]


@pytest.mark.parametrize("most", [1000, 3])
def test_longest_name_equals_brute_force(spark, most):
    r = random.Random(4)
    known = sorted({"".join(r.choices("abc", k=r.randrange(1, 14))) for _ in range(60)})
    texts = ["".join(r.choices("abcd", k=r.randrange(0, 60))) for _ in range(80)] + [None, "", known[0], known[-1]] * 2
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    dim = spark.createDataFrame([(n, 1) for n in [*known, None, "", known[3]]], "name string, id int")
    got = {x.id: x.found for x in names.longest_name(rows, dim, most=most).collect()}
    assert got == {i: min((n for n in known if t and n in t), key=lambda n: (-len(n), n), default=None) for i, t in enumerate(texts)}
    assert {x.found for x in names.longest_name(rows, dim.limit(0), most=most).collect()} == {None}


def test_fifty_thousand_names(spark):
    known = [f"{k * 7919 % 1_000_003:x}-{k:x}" for k in range(50_000)]
    rows = spark.createDataFrame([(k, f"see {known[k]} or {known[k + 1]}") for k in range(0, 49_000, 700)], "id long, text string")
    dim = spark.createDataFrame([(n,) for n in known], "name string")
    got = {x.id: x.found for x in names.longest_name(rows, dim).collect()}
    assert got == {x.id: x.found for x in names.longest_name(rows, dim, most=10).collect()}
    some = [k for k in list(got)[:5]]
    assert {k: got[k] for k in some} == {k: min((n for n in known if n in f"see {known[k]} or {known[k + 1]}"), key=lambda n: (-len(n), n)) for k in some}


def test_precedents_of_many_starts(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 6), (6, 7), (8, 8), (1, 2)], "citing_id long, cited_id long")
    start = spark.createDataFrame([(1,), (8,), (9,)], "source_id long")
    got = {(r.start_id, r.source_id): r.depth for r in graph.precedents_of_many(edges, start, 5).collect()}
    assert got == {(1, 2): 1, (1, 3): 2, (1, 1): 3, (1, 4): 3, (1, 5): 4, (1, 6): 5, (8, 8): 1}
    two = {(r.start_id, r.source_id, r.depth) for r in graph.precedents(edges, start, 2).collect()}
    assert {(r.start_id, r.source_id, r.depth) for r in graph.precedents_of_many(edges, start, 2).collect()} == two


def test_alarm_rules():
    t, f, n = True, False, None
    told = {
        "not breaching": ["ALARM", "OK", "OK", "OK"], "breaching": ["ALARM", "ALARM", "ALARM", "OK"],
        "ignore": ["ALARM", "before", "before", "OK"], "missing": ["ALARM", "before", "INSUFFICIENT_DATA", "OK"],
    }
    for rule, want in told.items():
        assert [state.judged(p, rule, "before") for p in ([t, t], [t, n], [n, n], [n, f])] == want


@pytest.mark.parametrize("rule", state.MISSING)
def test_alarms_over_a_stream(spark, tmp_path, rule):
    start, r = datetime(2024, 1, 1), random.Random(7)
    rows = [(start + timedelta(minutes=m), float(r.choice([1, 9, 9, 9]))) for m in sorted(r.sample(range(0, 120), 60)) if not 40 <= m < 60] + [(start + timedelta(minutes=400), 1.0)]
    value = {}
    for t, v in rows:
        value[t.replace(minute=t.minute // 5 * 5)] = max(v, value.get(t.replace(minute=t.minute // 5 * 5), 0))
    src, got = str(tmp_path / "in"), []
    for batch in (rows[:25], rows[25:], [(start + timedelta(minutes=900), 1.0)]):
        spark.createDataFrame([("cpu", *b) for b in batch], "name string, ts timestamp, v double").coalesce(1).write.mode("append").json(src)
        stream = state.alarm_stream(spark.readStream.schema("name string, ts timestamp, v double").json(src), "name", F.max("v"), threshold=5, periods=2, rule=rule)
        q = stream.writeStream.option("checkpointLocation", str(tmp_path / "cp")).foreachBatch(lambda d, n: got.extend(d.collect()))
        q.trigger(availableNow=True).start().awaitTermination()
    want, points, now, at = [], [], "INSUFFICIENT_DATA", min(value)
    while at <= max(value):
        points = [*points, None if at not in value else value[at] > 5][-2:]
        now = state.judged([None] * (2 - len(points)) + points, rule, now)
        want.append((at, value.get(at), now))
        at += timedelta(minutes=5)
    got = sorted((r.period_start, r.value, r.state) for r in got if r.period_start <= max(value))
    assert [(a, b, c) for a, b, c in got] == want
