"""The registered queries of the reference's operators, each over whole tables, with its SQL."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.functions import fixed
from lodestone.functions import text as T
from lodestone.operators import chunking, evaluate, filings, fusion, graph, knn, lexical, observe, versions
from lodestone.plans import search
from lodestone.plans.registry import QUERIES, SQL
from lodestone.plans.registry import literal as _lit
from lodestone.plans.registry import query as _query
from lodestone.plans.registry import table as _t
from lodestone.plans.registry import values as _values
from lodestone.sources import documents, records
from lodestone.storage import scratch_path, written

QUERY_TERMS = ("license", "ertion", "the", "worthless")


def query_vector() -> list[float]:
    """A fixed 64-dimensional query."""
    return [((7 * i) % 13 - 6) / 10 for i in range(64)]


# --- vectors and text retrieval -------------------------------------------------------------

_VEC = _lit([float(x) for x in query_vector()]) + "::DOUBLE[]"
_COS = f"list_cosine_similarity(embedding::DOUBLE[], {_VEC})"
_KNN = f"SELECT vec_id AS id, {_COS} AS score FROM embeddings ORDER BY score DESC, id LIMIT "
_TOK = r"list_filter(string_split_regex(lower(text), '\s+'), lambda t: t <> '')"


def _bm25_sql(source: str, terms=QUERY_TERMS) -> str:
    terms = _lit(list(terms))
    return f"""
tok AS (SELECT doc_id AS id, {_TOK} AS tokens FROM {source}),
cnt AS (SELECT count(*) AS n, avg(len(tokens)) AS avgdl FROM tok),
voc AS (SELECT t, count(*) AS df FROM (SELECT DISTINCT id, unnest(tokens) AS t FROM tok) GROUP BY t),
idf AS (SELECT t, ln(n - df + 0.5) - ln(df + 0.5) AS raw, avg(ln(n - df + 0.5) - ln(df + 0.5)) OVER () AS mean FROM voc, cnt),
term AS (SELECT t, CASE WHEN raw < 0 THEN 0.25 * mean ELSE raw END AS w FROM idf WHERE list_contains({terms}, t)),
tf AS (SELECT id, t, count(*) AS f FROM (SELECT id, unnest(tokens) AS t FROM tok) WHERE list_contains({terms}, t) GROUP BY id, t),
bm AS (SELECT tok.id, coalesce(sum(w * f * 2.5 / (f + 1.5 * (0.25 + 0.75 * len(tokens) / avgdl))), 0) AS score
       FROM tok CROSS JOIN cnt LEFT JOIN tf ON tf.id = tok.id LEFT JOIN term ON term.t = tf.t GROUP BY tok.id)"""


@_query(_KNN.replace(f"{_COS} AS score", f"round({_COS}, 6) AS score") + "10")
def knn_cosine(spark, sf_dir):
    return knn.knn(_t(spark, sf_dir, "embeddings"), query_vector(), 10).withColumn("score", F.round("score", 6))


@_query(f"SELECT vec_id AS id, round({_COS}, 6) AS score FROM embeddings WHERE label = 3 ORDER BY score DESC, id LIMIT 10")
def knn_filtered(spark, sf_dir):
    return knn.knn(_t(spark, sf_dir, "embeddings"), query_vector(), 10, where=F.col("label") == 3).withColumn("score", F.round("score", 6))


@_query(f"SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: (x::DOUBLE) * x))), 5) AS size FROM embeddings")
def vector_norms(spark, sf_dir):
    from lodestone.functions.vectors import norm

    return _t(spark, sf_dir, "embeddings").select("vec_id", F.round(norm(F.col("embedding")), 5).alias("size"))


def _asked(spark, sf_dir):
    vectors = _t(spark, sf_dir, "embeddings")
    return vectors, vectors.where("vec_id % 100 = 0")


@_query()
def ivf_probe(spark, sf_dir):
    """Recall of the clustered index against exact neighbours, for every query (ids divisible by 100) against all rows."""
    vectors, asked = _asked(spark, sf_dir)
    assigned, centres = knn.build_ivf(vectors, lists=16)
    assigned = written(assigned, "lists")
    return knn.recall(knn.probe_ivf_batch(assigned, centres, asked, 10, probes=12), knn.knn_batch(vectors, asked, 10), 10)


@_query("""WITH s AS (SELECT q.vec_id AS query_id, e.vec_id AS id, list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) AS score FROM embeddings q JOIN embeddings e ON q.vec_id <> e.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, id) AS k FROM s) WHERE k <= 10""")
def knn_batch(spark, sf_dir):
    return knn.knn_batch(*_asked(spark, sf_dir), 10).withColumn("score", F.round("score", 6))


@_query(f"WITH {_bm25_sql('documents')} SELECT id, round(score, 6) AS score FROM bm")
def bm25_corpus(spark, sf_dir):
    return lexical.bm25(_t(spark, sf_dir, "documents"), QUERY_TERMS).withColumn("score", F.round("score", 6))


@_query(f"WITH {_bm25_sql('documents')} SELECT id, round(score, 6) AS score FROM bm WHERE id IN (SELECT id FROM tf)")
def bm25_index(spark, sf_dir):
    path = scratch_path(spark, "index")
    lexical.build_index(_t(spark, sf_dir, "documents"), path)
    return lexical.bm25_from_index(spark, path, QUERY_TERMS).withColumn("score", F.round("score", 6))


_MATCH = f"list_has_any(regexp_extract_all(lower(text), '[a-z0-9]+'), {_lit(list(QUERY_TERMS))})"


@_query(f"WITH cand AS (SELECT * FROM documents WHERE {_MATCH}), {_bm25_sql('cand')} SELECT id, round(score, 6) AS score FROM bm")
def bm25_candidates(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents")
    return lexical.bm25(docs.where(lexical.matches_any("text", QUERY_TERMS)), QUERY_TERMS).withColumn("score", F.round("score", 6))


@_query(f"SELECT doc_id AS id, len(list_intersect(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')), {_lit(list(QUERY_TERMS))}))::DOUBLE AS score FROM documents WHERE {_MATCH} ORDER BY score DESC, id LIMIT 50")
def keyword_or_match(spark, sf_dir):
    return lexical.keyword_search(_t(spark, sf_dir, "documents"), QUERY_TERMS, 50)


def _stem_sql(w: str) -> str:
    plural = f"CASE WHEN regexp_matches({w}, '(?:sses|shes|ches|xes)$') THEN regexp_replace({w}, 'es$', '') WHEN regexp_matches({w}, 'ies$') THEN regexp_replace({w}, 'ies$', 'i') WHEN regexp_matches({w}, '[^su]s$') THEN regexp_replace({w}, 's$', '') ELSE {w} END"
    return f"CASE WHEN length({w}) <= 4 THEN {w} ELSE regexp_replace(regexp_replace({plural}, '([a-z][a-z][a-z])(?:ing|edly|ed|ly)$', '\\1'), 'y$', 'i') END"


_STEMS = f"list_transform(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda w: {_stem_sql('w')})"
_WANTED = f"list_transform(['licenses', 'onens', 'thing'], lambda w: {_stem_sql('w')})"


@_query(f"SELECT doc_id AS id, len(list_intersect(list_distinct({_STEMS}), {_WANTED}))::DOUBLE AS score FROM documents WHERE list_has_any({_STEMS}, {_WANTED}) ORDER BY score DESC, id LIMIT 200")
def keyword_stemmed(spark, sf_dir):
    return lexical.keyword_search(_t(spark, sf_dir, "documents"), ["licenses", "onens", "thing"], 200, stem=True)


def _rrf_sql(w: float, k: int = 60) -> str:
    return f"""WITH {_bm25_sql('documents')}, d AS ({_KNN}40), s AS (SELECT id, score FROM bm WHERE score > 0 ORDER BY score DESC, id LIMIT 40),
part AS (SELECT id, {1 - w} / ({k} + row_number() OVER (ORDER BY score DESC, id)) AS p FROM d UNION ALL SELECT id, {w} / ({k} + row_number() OVER (ORDER BY score DESC, id)) FROM s)
SELECT id, round(sum(p), 6) AS score FROM part GROUP BY id HAVING sum(p) > 0"""


def _branches(spark, sf_dir, n=40):
    dense = knn.knn(_t(spark, sf_dir, "embeddings"), query_vector(), n)
    # the filter comes after the cut, as below it the scores would be worked out twice
    sparse = lexical.bm25(_t(spark, sf_dir, "documents"), QUERY_TERMS).orderBy(F.desc("score"), "id").limit(n).where("score > 0")
    return dense, sparse


def _rrf(w: float):
    def run(spark, sf_dir):
        return fusion.rrf(*_branches(spark, sf_dir), weight=w).withColumn("score", F.round("score", 6))

    return run


for _w in (0.0, 0.3, 0.5, 0.7, 1.0):
    _query(_rrf_sql(_w), f"rrf_w{round(_w * 10):02d}")(_rrf(_w))


@_query(_rrf_sql(0.5) + " ORDER BY sum(p) DESC, id LIMIT 10")
def hybrid_search(spark, sf_dir):
    request = search.Request(QUERY_TERMS, query_vector(), top_k=10, candidates=40)
    return search.hybrid_search(_t(spark, sf_dir, "documents"), _t(spark, sf_dir, "embeddings"), request).withColumn("score", F.round("score", 6))


_ONE = "source = 'src1'"
_FILTERED_DENSE = f"SELECT vec_id AS id, {_COS} AS score FROM embeddings WHERE vec_id IN (SELECT doc_id FROM documents WHERE {_ONE}) ORDER BY score DESC, id LIMIT 40"


def _fused_sql(dense: str, sparse: str, w: float = 0.5, k: int = 60) -> str:
    return f"""d AS ({dense}), s AS ({sparse}),
part AS (SELECT id, {1 - w} / ({k} + row_number() OVER (ORDER BY score DESC, id)) AS p FROM d UNION ALL SELECT id, {w} / ({k} + row_number() OVER (ORDER BY score DESC, id)) FROM s)
SELECT id, round(sum(p), 6) AS score FROM part GROUP BY id ORDER BY sum(p) DESC, id LIMIT 10"""


@_query(f"WITH one AS (SELECT * FROM documents WHERE {_ONE}), {_bm25_sql('one')}, " + _fused_sql(_FILTERED_DENSE, "SELECT id, score FROM bm WHERE score > 0 ORDER BY score DESC, id LIMIT 40"))
def hybrid_filtered(spark, sf_dir):
    """Both branches see the rows of one source only."""
    request = search.Request(QUERY_TERMS, query_vector(), top_k=10, candidates=40, where=F.expr(_ONE))
    return search.hybrid_search(_t(spark, sf_dir, "documents"), _t(spark, sf_dir, "embeddings"), request).withColumn("score", F.round("score", 6))


@_query(f"WITH {_bm25_sql('documents')}, " + _fused_sql(_FILTERED_DENSE, f"SELECT id, score FROM bm WHERE score > 0 AND id IN (SELECT doc_id FROM documents WHERE {_ONE}) ORDER BY score DESC, id LIMIT 40"))
def indexed_filtered(spark, sf_dir):
    """The filter over an index: statistics of the whole corpus, rows of one source."""
    docs, path = _t(spark, sf_dir, "documents"), scratch_path(spark, "index")
    lexical.build_index(docs, path)
    request = search.Request(QUERY_TERMS, query_vector(), top_k=10, candidates=40, where=F.expr(_ONE))
    return search.indexed_search(_t(spark, sf_dir, "embeddings"), path, request, docs).withColumn("score", F.round("score", 6))


_SAID = "what is the license of ertion"


@_query(f"""WITH {_bm25_sql('documents', _SAID.split())}, d AS ({_KNN}20), s AS (SELECT id, score FROM bm WHERE score > 0 ORDER BY score DESC, id LIMIT 20),
part AS (SELECT id, 0.7 / (60 + row_number() OVER (ORDER BY score DESC, id)) AS p FROM d UNION ALL SELECT id, 0.3 / (60 + row_number() OVER (ORDER BY score DESC, id)) FROM s),
f AS (SELECT id, sum(p) AS p FROM part GROUP BY id ORDER BY p DESC, id LIMIT 20)
SELECT id, left(text, 600) AS content, round_even(len(list_intersect(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')), {_lit(_SAID.split())}))::DOUBLE / 6, 6) AS score
FROM f JOIN documents ON doc_id = id ORDER BY score DESC, id LIMIT 5""")
def served_search(spark, sf_dir):
    return search.served_search(_t(spark, sf_dir, "documents"), _t(spark, sf_dir, "embeddings"), _SAID, query_vector()).select("id", "content", "score")


@_query(f"""WITH one AS (SELECT * FROM documents WHERE lang = 'de'), {_bm25_sql('one', _SAID.split())}, d AS (SELECT vec_id AS id, {_COS} AS score FROM embeddings WHERE vec_id IN (SELECT doc_id FROM one) ORDER BY score DESC, id LIMIT 20),
s AS (SELECT id, score FROM bm WHERE score > 0 ORDER BY score DESC, id LIMIT 20),
part AS (SELECT id, 0.7 / (60 + row_number() OVER (ORDER BY score DESC, id)) AS p FROM d UNION ALL SELECT id, 0.3 / (60 + row_number() OVER (ORDER BY score DESC, id)) FROM s),
f AS (SELECT id, sum(p) AS p FROM part GROUP BY id ORDER BY p DESC, id LIMIT 20)
SELECT id, left(text, 600) AS content, round_even(len(list_intersect(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')), {_lit(_SAID.split())}))::DOUBLE / 6, 6) AS score
FROM f JOIN documents ON doc_id = id ORDER BY score DESC, id LIMIT 5""")
def served_filtered(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents").withColumn("case_type", F.when(F.col("lang") == "de", "Civil").otherwise("Criminal"))
    return search.served_search(docs, _t(spark, sf_dir, "embeddings"), _SAID, query_vector(), case_type="Civil").select("id", "content", "score")


@_query()
def research_answer(spark, sf_dir):
    request = search.Request(QUERY_TERMS, query_vector(), top_k=5)
    docs = _t(spark, sf_dir, "documents").withColumns({"effective_date": F.date_add(F.lit(date(2020, 1, 1)), (F.col("doc_id") % 1000).cast("int")), "expiry_date": F.lit(None).cast("date")})
    return search.research(docs, _t(spark, sf_dir, "embeddings"), request, "what is the current license law", today=F.lit(date(2022, 1, 1)))


@_query(f"WITH {_bm25_sql('documents')}, d AS ({_KNN}40), s AS (SELECT id, score FROM bm WHERE score > 0 ORDER BY score DESC, id LIMIT 40) SELECT id, round(score, 6) AS score FROM d UNION ALL SELECT id, round(score, 6) FROM s WHERE id NOT IN (SELECT id FROM d)")
def merge_dedup(spark, sf_dir):
    return fusion.merge_dedup(*_branches(spark, sf_dir)).withColumn("score", F.round("score", 6))


@_query("""SELECT doc_id AS id, round(len(list_intersect(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')), ['the', 'ertion', 'of']))::DOUBLE / 3, 6) AS score
FROM documents ORDER BY score DESC, id LIMIT 20""")
def rerank_lexical(spark, sf_dir):
    rows = _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"))
    return fusion.rerank(rows, fusion.lexical_reranker("the ertion of"), 20).select("id", F.round("score", 6).alias("score"))


@_query("""SELECT doc_id AS id, round(len(list_intersect(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')), ['the', 'ertion', 'of']))::DOUBLE / 3, 6) AS score
FROM documents ORDER BY score DESC, id LIMIT 20""")
def rerank_model(spark, sf_dir):
    rows = _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"))
    return fusion.rerank(rows, fusion.model_reranker("the ertion of", fusion.overlap_scorer), 20).select("id", F.round("score", 6).alias("score"))


_COURTS = [("src0", "Indiana Supreme Court"), ("src1", "SCOTUS"), ("src2", "Windsor Probate"), ("src3", "ca7"), ("src4", "Court of Appeals of Indiana, Fifth District"), ("src5", "Small Claims")]


def _court_sql(c: str) -> str:
    exact = " ".join(f"WHEN lower({c}) = {_lit(n)} THEN {w}" for n, w in fixed.COURT_WEIGHTS.items())
    inside = " ".join(f"WHEN contains(lower({c}), {_lit(n)}) THEN {fixed.COURT_WEIGHTS[n]}" for n in sorted(fixed.COURT_WEIGHTS, key=lambda x: (-len(x), x)))
    return f"(CASE WHEN {c} IS NULL THEN 0.35 {exact} {inside} ELSE 0.35 END)::DOUBLE"


@_query(f"SELECT doc_id AS id, court, {_court_sql('court')} AS weight FROM documents LEFT JOIN {_values(_COURTS, 'source, court')} USING (source)")
def court_weight(spark, sf_dir):
    courts = spark.createDataFrame(_COURTS, "source string, court string")
    return _t(spark, sf_dir, "documents").join(courts, "source", "left").select(F.col("doc_id").alias("id"), "court", T.court_weight("court").alias("weight"))


@_query(f"""SELECT doc_id AS id, round(0.7 * least(1.0, n_chars / 10000.0) + 0.3 * {_court_sql('court')}, 6) AS score
FROM documents LEFT JOIN {_values(_COURTS, 'source, court')} USING (source)""")
def authority_blend(spark, sf_dir):
    courts = spark.createDataFrame(_COURTS, "source string, court string")
    rows = _t(spark, sf_dir, "documents").join(courts, "source", "left").select(F.col("doc_id").alias("id"), "court", F.least(F.lit(1.0), F.col("n_chars") / 10000).alias("score"))
    return fusion.blend_authority(rows, alpha=0.3).select("id", F.round("score", 6).alias("score"))


@_query("SELECT o_orderkey FROM orders WHERE o_orderdate::DATE <= DATE '1998-06-01' AND (CASE WHEN o_orderstatus = 'O' THEN NULL ELSE o_orderdate::DATE + 400 END IS NULL OR o_orderdate::DATE + 400 >= DATE '1998-06-01')")
def temporal_valid(spark, sf_dir):
    rows = _t(spark, sf_dir, "orders").withColumn("effective_date", F.to_date("o_orderdate")).withColumn("expiry_date", F.when(F.col("o_orderstatus") != "O", F.date_add("effective_date", 400)))
    return rows.where(fusion.valid_on(F.lit(date(1998, 6, 1)))).select("o_orderkey")


@_query("""SELECT event_type, CASE WHEN t > 0.018 AND t - m > 0.004 THEN 'High' WHEN t > 0.010 AND t - m > 0.002 THEN 'Medium' ELSE 'Low' END AS confidence
FROM (SELECT event_type, max(value / 10000) AS t, median(value / 10000) AS m FROM events GROUP BY event_type)""")
def confidence_label(spark, sf_dir):
    return fusion.confidence(_t(spark, sf_dir, "events").withColumn("score", F.col("value") / 10000), "event_type")


# --- query parsing and text functions -------------------------------------------------------

_LEGAL = [
    (1, "What is the current penalty for felony theft in Marion County?"), (2, "Ind. Code § 35-42-1-1"), (3, "explain Ind. Code § 12-3-4 and I.C. § 5-1"), (4, "Doe v. Smith custody, juvenile court"),
    (5, "small claims limit in Indiana courts..."), (6, "Is it still valid?  contract  terms "), (7, "123 Ind. 456 estate of Jones"), (8, "how do I challenge a will"), (9, ""), (10, "§ 9-30 ;;"),
]
_V = f"(SELECT id::BIGINT AS id, query FROM {_values(_LEGAL, 'id, query')} UNION ALL SELECT 1000 + conv_id * 1000 + turn, text FROM conversations)"


def _legal(spark, sf_dir):
    """Typical queries and all turns of the conversations."""
    said = _t(spark, sf_dir, "conversations").select((1000 + F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("text").alias("query"))
    return spark.createDataFrame(_LEGAL, "id long, query string").unionByName(said)


def _chain(table, c):
    return "CASE " + " ".join(f"WHEN contains({c}, {_lit(k)}) THEN {_lit(v)}" for k, v in table.items())


_STATE = " OR ".join(f"contains(lower(query), {_lit(s)})" for s in fixed.STATE_SIGNS)
_NOW = " OR ".join(f"contains(lower(query), {_lit(s)})" for s in fixed.CURRENT_SIGNS)
_LOOKUP, _ASK = (f"regexp_matches(query, {_lit(p)})" for p in (fixed.LOOKUP_SIGN, fixed.QUESTION_SIGN))
_PARSED = f"""SELECT id, rtrim(trim(regexp_replace(query, '\\s+', ' ', 'g')), '?.,;:') AS normalized, {_chain(fixed.COUNTIES, 'lower(query)')} WHEN {_STATE} THEN 'Indiana' END AS jurisdiction,
{_chain(fixed.CASE_TYPES, 'lower(query)')} END AS case_type, ({_NOW}) AS temporal,
array_to_string(regexp_extract_all(query, {_lit('(?i)' + fixed.STATUTE)}), '|') AS citations,
CASE WHEN {_LOOKUP} AND NOT {_ASK} THEN 'citation_lookup' WHEN {_ASK} AND NOT {_LOOKUP} THEN 'semantic' ELSE 'hybrid' END AS query_type,
(CASE WHEN {_LOOKUP} AND NOT {_ASK} THEN 0.70 WHEN {_ASK} AND NOT {_LOOKUP} THEN 0.30 ELSE 0.50 END)::DOUBLE AS bm25_weight,
(CASE WHEN {_LOOKUP} AND NOT {_ASK} THEN 0.35 WHEN {_ASK} AND NOT {_LOOKUP} THEN 0.25 ELSE 0.30 END)::DOUBLE AS authority_alpha FROM {_V}"""


@_query(_PARSED)
def query_parse(spark, sf_dir):
    return search.parse_queries(_legal(spark, sf_dir)).select("id", "normalized", "jurisdiction", "case_type", "temporal", F.array_join("citations", "|").alias("citations"), "query_type", "bm25_weight", "authority_alpha")


_KW = f"list_filter(list_transform(list_filter(regexp_extract_all(query, '[\\p{{L}}\\p{{M}}\\p{{N}}_]+'), lambda w: regexp_full_match(w, '[a-zA-Z]{{3,}}')), lambda w: lower(w)), lambda w: NOT list_contains({_lit(list(fixed.STOPWORDS))}, w))"


@_query(f"SELECT id, array_to_string(list_sort(list_distinct({_KW})), ' ') AS words FROM {_V}")
def keywords(spark, sf_dir):
    return _legal(spark, sf_dir).select("id", F.array_join(F.array_sort(T.keywords("query")), " ").alias("words"))


@_query("SELECT conv_id, turn, md5(rtrim(trim(regexp_replace(text, '\\s+', ' ', 'g')), '?.,;:')) AS normal FROM conversations")
def normalize_query(spark, sf_dir):
    return _t(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(T.normalize_query("text")).alias("normal"))


_PASSAGES = [
    (1, "The court held in Doe v. Smith that Ind. Code § 35-42-1-1 applies. [SOURCE: a1, § 2] It states more."), (2, "See 123 Ind. 456 and 45 N.E.2d 99. Rule requires notice within 30 days. [SOURCE: b2]"),
    (3, "Plaintiff: Jane Roe, and others; no claim."), (4, ""), (5, "Deadline: by May 3, 2024. The statute mandates it! He ruled so? [SOURCE: zz]"),
]
_P = f"(SELECT id::BIGINT AS id, text FROM {_values(_PASSAGES, 'id, text')} UNION ALL SELECT 1000 + doc_id, text FROM documents)"


def _passages(spark, sf_dir):
    """Typical passages and all documents."""
    docs = _t(spark, sf_dir, "documents").select((1000 + F.col("doc_id")).alias("id"), "text")
    return spark.createDataFrame(_PASSAGES, "id long, text string").unionByName(docs)


@_query(f"SELECT id, array_to_string(list_transform(regexp_extract_all(text, {_lit(fixed.CHUNK_CITATION)}), lambda c: trim(c)), '|') AS citations FROM {_P}")
def citation_extract(spark, sf_dir):
    return _passages(spark, sf_dir).select("id", F.array_join(T.chunk_citations("text"), "|").alias("citations"))


@_query(f"SELECT id, array_to_string(list_transform(regexp_extract_all(text, {_lit(fixed.SOURCE_MARK)}, 1), lambda c: trim(c)), '|') AS cited FROM {_P}")
def source_markers(spark, sf_dir):
    return _passages(spark, sf_dir).select("id", F.array_join(T.source_marks("text"), "|").alias("cited"))


@_query(f"""SELECT id, array_to_string(list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: trim(s)),
lambda s: s <> '' AND regexp_matches(s, {_lit(fixed.ASSERTION)}) AND NOT contains(s, '[SOURCE:')), '|') AS uncited FROM {_P}""")
def uncited_claims(spark, sf_dir):
    return _passages(spark, sf_dir).select("id", F.array_join(T.uncited_claims("text"), "|").alias("uncited"))


@_query(f"SELECT id, array_to_string(list_transform(regexp_extract_all(text, {_lit(fixed.PARTY)}, 1), lambda c: trim(c)), '|') AS parties, array_to_string(regexp_extract_all(text, {_lit(fixed.DEADLINE)}), '|') AS deadlines FROM {_P}")
def summary_extraction(spark, sf_dir):
    return search.summarize(_passages(spark, sf_dir).withColumnRenamed("text", "content")).select("id", F.array_join("parties_found", "|").alias("parties"), F.array_join("deadlines", "|").alias("deadlines"))


@_query("""SELECT doc_id, len(list_filter(string_split(regexp_replace(text, '([.!?])\\s+([A-Z])', '\\1' || chr(1) || '\\2', 'g'), chr(1)), lambda s: trim(s) <> ''))::INTEGER AS n_sentences FROM documents""")
def sentence_split_counts(spark, sf_dir):
    return evaluate.sentence_counts(_t(spark, sf_dir, "documents"))


@_query("SELECT page_id, md5(trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\\s{2,}', ' ', 'g'))) AS plain FROM pages")
def strip_html(spark, sf_dir):
    return _t(spark, sf_dir, "pages").select("page_id", F.md5(T.strip_tags("html")).alias("plain"))


def _without_sql(c: str) -> str:
    for tag in sorted(documents.DROPPED):
        c = f"regexp_replace({c}, '(?is)<{tag}\\b[^>]*>.*?</{tag}\\s*>', chr(1), 'g')"
    c = f"regexp_replace({c}, '(?s)<!--.*?-->|<[!/a-zA-Z][^>]*>', chr(1), 'g')"
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
        c = f"replace({c}, '{name}', '{char}')"
    return c


@_query(f"""SELECT page_id AS id, md5(regexp_replace(array_to_string(list_filter(list_transform(string_split({_without_sql('html')}, chr(1)), lambda t: regexp_replace(t, '^\\s+|\\s+$', '', 'g')), lambda t: t <> ''), chr(10)), '[ \\t]+', ' ', 'g')) AS text FROM pages""")
def html_text(spark, sf_dir):
    return documents.html_pages(_t(spark, sf_dir, "pages")).withColumn("text", F.md5("text"))


@_query("SELECT page_id, list_last(string_split(regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1), '/')) AS name FROM pages")
def url_filename(spark, sf_dir):
    return _t(spark, sf_dir, "pages").select("page_id", documents.filename_from_url("url").alias("name"))


@_query("SELECT doc_id, (n_chars // 4)::INTEGER AS tokens, source || '@' || left(sha256(text), 12) AS version_id, md5(source || '->' || lang) AS edge_id FROM documents")
def hashes_and_estimates(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", T.token_estimate("text").alias("tokens"), T.version_id("source", "text").alias("version_id"), T.edge_id("source", "lang").alias("edge_id"))


@_query("SELECT p_partkey, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-') AS slug, regexp_replace(p_brand, '[^A-Za-z0-9\\-]', '', 'g') AS brand_key, 'ic-' || trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-') || '-' || lpad(p_size::VARCHAR, 3, '0') AS key FROM part")
def slugs(spark, sf_dir):
    return _t(spark, sf_dir, "part").select("p_partkey", T.slug("p_name").alias("slug"), T.safe_key("p_brand").alias("brand_key"), T.chunk_key("p_name", "p_size").alias("key"))


_DATES = [(1, "2024-01-31"), (2, "2024-1-1"), (3, "20240229"), (4, "garbage"), (5, None), (6, "2024-02-30"), (7, "2024-05-06T10:00:00")]


@_query(f"SELECT id, CASE WHEN regexp_matches(left(d, 10), '^\\d{{4}}-\\d{{2}}-\\d{{2}}$') THEN try_cast(left(d, 10) AS DATE) WHEN regexp_matches(d, '^\\d{{8}}$') THEN try_strptime(d, '%Y%m%d')::DATE END AS day FROM (SELECT id::BIGINT AS id, d FROM {_values(_DATES, 'id, d')} UNION ALL SELECT 100 + o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN strftime(o_orderdate, '%Y%m%d') ELSE strftime(o_orderdate, '%Y-%m-%dT%H:%M') END FROM orders)")
def iso_dates(spark, sf_dir):
    rows = _t(spark, sf_dir, "orders").select((100 + F.col("o_orderkey")).alias("id"), F.when(F.col("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "yyyyMMdd")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm")).alias("d"))
    return spark.createDataFrame(_DATES, "id long, d string").unionByName(rows).select("id", T.iso_date("d").alias("day"))


# --- filings --------------------------------------------------------------------------------


@_query("""WITH w AS (SELECT o_custkey, o_orderdate::DATE AS d, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderdate::DATE RANGE BETWEEN CURRENT ROW AND INTERVAL 30 DAYS FOLLOWING) AS n FROM orders)
SELECT o_custkey::VARCHAR AS party, min(d) AS window_start, arg_min(n, d) AS n FROM w WHERE n >= 3 GROUP BY o_custkey""")
def burst_filing(spark, sf_dir):
    rows = _t(spark, sf_dir, "orders").select(F.array(F.col("o_custkey").cast("string")).alias("parties"), F.to_date("o_orderdate").alias("filing_date"), F.col("o_orderkey").cast("string").alias("source_id"))
    return filings.burst_windows(filings.party_filings(rows), days=30, least=3)


_MAIL = r"@([A-Za-z0-9-]+\.[A-Za-z0-9.-]+)"


@_query(f"""SELECT identifier, array_to_string(list_sort(list(DISTINCT doc_id)), ',') AS cases FROM (SELECT doc_id, unnest(regexp_extract_all(text, {_lit(_MAIL)}, 1)) AS identifier FROM documents)
GROUP BY identifier HAVING count(DISTINCT doc_id) > 1""")
def identity_reuse(spark, sf_dir):
    rows = _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("source_id"), F.col("text").alias("content"))
    return filings.shared_identifiers(rows, _MAIL, 1, most=1_000_000).select("identifier", F.array_join(F.transform("cases", lambda c: c.cast("string")), ",").alias("cases"))


@_query("""SELECT o_custkey, CASE WHEN h >= 2 OR (h >= 1 AND n >= 3) THEN 'critical' WHEN h >= 1 OR m >= 2 THEN 'high' WHEN m >= 1 THEN 'medium' ELSE 'low' END AS risk
FROM (SELECT o_custkey, count(*) AS n, count(*) FILTER (o_orderpriority = '1-URGENT') AS h, count(*) FILTER (o_orderpriority = '2-HIGH') AS m FROM orders GROUP BY o_custkey)""")
def risk_by_customer(spark, sf_dir):
    severity = F.when(F.col("o_orderpriority") == "1-URGENT", "high").when(F.col("o_orderpriority") == "2-HIGH", "medium").otherwise("low")
    return filings.risk_level(_t(spark, sf_dir, "orders").withColumn("severity", severity), "o_custkey")


@_query("""SELECT l_partkey::VARCHAR AS address, count(*) AS n, date_diff('day', min(l_shipdate), max(l_shipdate))::INTEGER AS span FROM lineitem GROUP BY l_partkey HAVING count(DISTINCT l_suppkey) >= 3 AND date_diff('day', min(l_shipdate), max(l_shipdate)) <= 2000""")
def rapid_transfer(spark, sf_dir):
    moves = _t(spark, sf_dir, "lineitem").select(F.col("l_partkey").cast("string").alias("address"), F.to_date("l_shipdate").alias("filing_date"), F.col("l_suppkey").alias("source_id"))
    return filings.rapid_addresses(moves, least=3, days=2000)


# --- citation graph -------------------------------------------------------------------------

_EDGES = """e AS (SELECT l_suppkey AS citing_id, l_partkey % 97 AS cited_id, CASE WHEN l_quantity = 50 AND l_discount = 0.1 AND l_tax = 0.08 THEN 'overruled' WHEN l_returnflag = 'R' THEN 'distinguished' ELSE 'cited' END AS treatment, l_returnflag = 'R' AS is_negative FROM lineitem)"""


def _graph(spark, sf_dir):
    treatment = F.when((F.col("l_quantity") == 50) & (F.col("l_discount") == 0.1) & (F.col("l_tax") == 0.08), "overruled").when(F.col("l_returnflag") == "R", "distinguished").otherwise("cited")
    edges = _t(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("citing_id"), (F.col("l_partkey") % 97).alias("cited_id"), treatment.alias("treatment"), (F.col("l_returnflag") == "R").alias("is_negative"))
    return _t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("source_id")), edges


@_query(f"WITH {_EDGES} SELECT s_suppkey AS source_id, count(cited_id) AS n_citing FROM supplier LEFT JOIN e ON cited_id = s_suppkey GROUP BY s_suppkey")
def citing_count(spark, sf_dir):
    return graph.citing_counts(*_graph(spark, sf_dir))


@_query(f"WITH {_EDGES}, b AS (SELECT cited_id, max(citing_id) AS overruled_by FROM e WHERE treatment IN ('overruled', 'overruled by') GROUP BY cited_id) SELECT s_suppkey AS source_id, overruled_by IS NULL AS is_good_law, overruled_by FROM supplier LEFT JOIN b ON cited_id = s_suppkey")
def good_law(spark, sf_dir):
    return graph.good_law(*_graph(spark, sf_dir))


@_query(f"""WITH {_EDGES}, h AS (SELECT DISTINCT citing_id AS a, cited_id AS b FROM e), s AS (SELECT s_suppkey AS start_id FROM supplier), d1 AS (SELECT DISTINCT start_id, b FROM s JOIN h ON a = start_id), d2 AS (SELECT DISTINCT start_id, h.b FROM d1 JOIN h ON h.a = d1.b)
SELECT start_id, b AS source_id, 1 AS depth FROM d1 UNION ALL SELECT start_id, b, 2 FROM d2 WHERE (start_id, b) NOT IN (SELECT (start_id, b) FROM d1)""")
def precedents_d2(spark, sf_dir):
    nodes, edges = _graph(spark, sf_dir)
    return graph.precedents(edges, nodes, 2)


def _pagerank_sql(rounds: int) -> str:
    ctes = [_EDGES, "ids AS (SELECT s_suppkey AS id FROM supplier)", "r AS (SELECT * FROM e WHERE citing_id IN (SELECT id FROM ids) AND cited_id IN (SELECT id FROM ids))", "deg AS (SELECT citing_id, count(*) AS o FROM r GROUP BY 1)", "f AS MATERIALIZED (SELECT r.citing_id, cited_id, sum(1.0::DOUBLE / o) AS w FROM r JOIN deg USING (citing_id) WHERE NOT is_negative GROUP BY 1, 2)", "p0 AS (SELECT id, 1.0::DOUBLE / (SELECT count(*) FROM ids) AS p FROM ids)"]
    for i in range(rounds):
        ctes.append(f"p{i + 1} AS MATERIALIZED (SELECT ids.id, 0.15::DOUBLE / (SELECT count(*) FROM ids) + 0.85 * coalesce(g, 0) AS p FROM ids LEFT JOIN (SELECT cited_id, sum(w * p) AS g FROM f JOIN p{i} ON citing_id = p{i}.id GROUP BY 1) ON cited_id = ids.id)")
    return "WITH " + ", ".join(ctes) + f", pr AS (SELECT id AS source_id, p / (SELECT max(p) FROM p{rounds}) AS pagerank FROM p{rounds})"


@_query(_pagerank_sql(30) + " SELECT source_id, round(pagerank, 5) AS pagerank FROM pr")
def pagerank(spark, sf_dir):
    return graph.pagerank(*_graph(spark, sf_dir)).withColumn("pagerank", F.round("pagerank", 5))


_CONTEXTS = [(1, "This case was overruled by later courts"), (2, "cited with approval in Roe"), (3, "followed, but criticized"), (4, "nothing here"), (5, "affirmed"), (6, None)]


_LABELS = [(n, True) for n in sorted(fixed.NEGATIVE_TREATMENTS, key=lambda x: (-len(x), x))] + [(n, False) for n in sorted(fixed.POSITIVE_TREATMENTS, key=lambda x: (-len(x), x))]


def _treated(pick) -> str:
    return "CASE " + " ".join(f"WHEN contains(lower(context), {_lit(n)}) THEN {_lit(pick(n, bad))}" for n, bad in _LABELS) + f" ELSE {_lit(pick('cited', False))} END"


@_query(f"SELECT id, {_treated(lambda n, bad: n)} AS treatment, {_treated(lambda n, bad: bad)} AS is_negative FROM (SELECT id::BIGINT AS id, context FROM {_values(_CONTEXTS, 'id, context')} UNION ALL SELECT 1000 + o_orderkey, repeat('filler ', 90) || {_lit([n for n, _ in _LABELS] + ['plain'])}[(o_orderkey % {len(_LABELS) + 1} + 1)::BIGINT] FROM orders)")
def edge_treatment(spark, sf_dir):
    names = F.array(*[F.lit(n) for n, _ in _LABELS], F.lit("plain"))
    rows = _t(spark, sf_dir, "orders").select((1000 + F.col("o_orderkey")).alias("id"), F.concat(F.repeat(F.lit("filler "), 90), F.get(names, (F.col("o_orderkey") % (len(_LABELS) + 1)).cast("int"))).alias("context"))
    rows = spark.createDataFrame(_CONTEXTS, "id long, context string").unionByName(rows)
    return rows.select("id", T.treatment("context").alias("t")).select("id", "t.*")


@_query(f"""{_pagerank_sql(30)}, b AS (SELECT DISTINCT cited_id FROM e WHERE treatment = 'overruled'), c AS (SELECT cited_id, count(*) AS n FROM e GROUP BY 1)
SELECT s_suppkey AS source_id, round(least(1.0, s_acctbal / 10000.0 + 0.15 * coalesce(pagerank, 0)), 5) AS score, coalesce(n, 0) AS n_citing FROM supplier LEFT JOIN c ON c.cited_id = s_suppkey LEFT JOIN pr ON pr.source_id = s_suppkey WHERE s_suppkey NOT IN (SELECT cited_id FROM b)""")
def enrich_with_graph(spark, sf_dir):
    nodes, edges = _graph(spark, sf_dir)
    rows = _t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("source_id"), (F.col("s_acctbal") / 10000).alias("score"))
    got = graph.enrich(rows, graph.pagerank(nodes, edges), graph.good_law(nodes, edges), graph.citing_counts(nodes, edges))
    return got.select("source_id", F.round("score", 5).alias("score"), "n_citing")


@_query(f"WITH {_EDGES} SELECT (SELECT count(DISTINCT s_suppkey) FROM supplier) AS n_nodes, count(*) AS n_edges, count(*) FILTER (is_negative) AS n_negative FROM e")
def graph_sizes(spark, sf_dir):
    return graph.sizes(*_graph(spark, sf_dir))


@_query("SELECT l_orderkey AS citing_id, coalesce(k, 'cite ' || l_partkey) AS cited_id, count(*) AS n FROM lineitem LEFT JOIN (SELECT 'cite ' || p_partkey AS c, min('part-' || p_partkey) AS k FROM part WHERE p_size % 2 = 0 GROUP BY 1) ON c = 'cite ' || l_partkey GROUP BY 1, 2")
def citations_resolved(spark, sf_dir):
    nodes = _t(spark, sf_dir, "part").select(F.concat(F.lit("part-"), "p_partkey").alias("source_id"), F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("cite "), "p_partkey")).alias("citation_string"))
    edges = _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("citing_id"), F.concat(F.lit("cite "), "l_partkey").alias("cited_id"))
    return graph.resolved(edges, nodes).groupBy("citing_id", "cited_id").agg(F.count(F.lit(1)).alias("n"))


# --- evaluation -----------------------------------------------------------------------------

_RANKED = "r AS (SELECT * FROM (SELECT lang AS query_id, doc_id, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS rank FROM documents) WHERE rank <= 100), j AS (SELECT lang AS query_id, doc_id, 1 + toxic AS grade FROM labels JOIN documents USING (doc_id) WHERE quality = 1)"
_METRICS = f"""WITH {_RANKED}, k AS (SELECT unnest([1, 5, 10]) AS k), q AS (SELECT DISTINCT query_id FROM r),
h AS (SELECT r.query_id, rank, r.doc_id, grade FROM r LEFT JOIN j USING (query_id, doc_id)),
g AS (SELECT query_id, k, count(DISTINCT doc_id) FILTER (grade IS NOT NULL AND rank <= k) AS hits, coalesce(sum((2 ** coalesce(grade, 0) - 1) / log2(rank + 1)) FILTER (rank <= k), 0) AS dcg, min(rank) FILTER (grade IS NOT NULL) AS first FROM h CROSS JOIN k GROUP BY 1, 2),
i AS (SELECT query_id, k, sum((2 ** grade - 1) / log2(pos + 1)) AS idcg FROM (SELECT query_id, grade, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC) AS pos FROM j) CROSS JOIN k WHERE pos <= k GROUP BY 1, 2),
n AS (SELECT query_id, count(*) AS n_rel FROM j GROUP BY 1),
m AS (SELECT q.query_id, k.k, CASE WHEN n_rel IS NULL THEN 1.0 ELSE hits / n_rel END AS recall, hits / k.k AS precision, CASE WHEN coalesce(idcg, 0) = 0 THEN 0.0 ELSE dcg / idcg END AS ndcg, coalesce(1.0 / first, 0.0) AS mrr
FROM q CROSS JOIN k LEFT JOIN g USING (query_id, k) LEFT JOIN i USING (query_id, k) LEFT JOIN n USING (query_id))"""
_ROUND4 = ", ".join(f"round({c}::DOUBLE, 6) AS {c}" for c in ("recall", "precision", "ndcg", "mrr"))


def _metrics(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents")
    ranked = docs.select(F.col("lang").alias("query_id"), "doc_id", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n_chars"), "doc_id")).alias("rank")).where("rank <= 100")  # the result list of each query
    judged = _t(spark, sf_dir, "labels").where("quality = 1").join(docs, "doc_id").select(F.col("lang").alias("query_id"), "doc_id", (1 + F.col("toxic")).alias("grade"))
    return evaluate.ranking_metrics(ranked.select("query_id").distinct(), ranked, judged)


def _rounded(df, *cols):
    return df.withColumns({c: F.round(c, 6) for c in cols})


@_query(f"{_METRICS} SELECT query_id, k, {_ROUND4} FROM m")
def ranking_metrics(spark, sf_dir):
    return _rounded(_metrics(spark, sf_dir), "recall", "precision", "ndcg", "mrr")


@_query(f"{_METRICS} SELECT k, " + ", ".join(f"round(avg({c})::DOUBLE, 6) AS {c}" for c in ("recall", "precision", "ndcg", "mrr")) + " FROM m GROUP BY k")
def eval_report(spark, sf_dir):
    return _rounded(evaluate.report(_metrics(spark, sf_dir)), "recall", "precision", "ndcg", "mrr")


_ANSWERS = [(1, "The holding in Doe v. Smith stands.", ["we cite doe v. smith"]), (2, "The court affirmed the statute.", ["the court"]), (3, "Nothing at all.", ["x"]), (4, "", ["x"]), (5, "court", [])]


_CLAIMS = f"CASE WHEN len(regexp_extract_all(answer, {_lit(fixed.CLAIM)})) > 0 THEN regexp_extract_all(answer, {_lit(fixed.CLAIM)}) ELSE regexp_extract_all(lower(answer), {_lit(fixed.LEGAL_TERM)}) END"
_FAITH = f"""WITH a AS (SELECT id::BIGINT AS id, answer, context FROM {_values(_ANSWERS, 'id, answer, context')} UNION ALL
SELECT 1000 + doc_id, text || CASE WHEN doc_id % 3 = 0 THEN ' The court affirmed the statute, see Doe v. Smith.' WHEN doc_id % 3 = 1 THEN ' The holding of the court' ELSE '' END, ['the court, Doe v. ' || lang, 'Statute ' || source] FROM documents),
c AS (SELECT id, answer, context, {_CLAIMS} AS claims FROM a)
SELECT id, round(CASE WHEN coalesce(answer, '') = '' OR len(context) = 0 THEN 0.0 WHEN len(claims) = 0 THEN 0.5 ELSE len(list_filter(claims, lambda x: contains(lower(array_to_string(context, ' ')), lower(x))))::DOUBLE / len(claims) END, 6) AS score FROM c"""


@_query(_FAITH)
def faithfulness(spark, sf_dir):
    more = F.when(F.col("doc_id") % 3 == 0, " The court affirmed the statute, see Doe v. Smith.").when(F.col("doc_id") % 3 == 1, " The holding of the court").otherwise("")
    docs = _t(spark, sf_dir, "documents").select((1000 + F.col("doc_id")).alias("id"), F.concat("text", more).alias("answer"), F.array(F.concat(F.lit("the court, Doe v. "), "lang"), F.concat(F.lit("Statute "), "source")).alias("context"))
    rows = spark.createDataFrame(_ANSWERS, "id long, answer string, context array<string>").unionByName(docs)
    return rows.select("id", F.round(evaluate.faithfulness("answer", "context"), 6).alias("score"))


@_query(f"SELECT id, CASE WHEN len(c) = 0 THEN 1.0 ELSE round(len(list_filter(c, lambda x: list_contains(['a1', 'b2'], x)))::DOUBLE / len(c), 6) END AS accuracy FROM (SELECT id, list_transform(regexp_extract_all(text, {_lit(fixed.SOURCE_MARK)}, 1), lambda x: trim(x)) AS c FROM {_P})")
def citation_accuracy(spark, sf_dir):
    rows = _passages(spark, sf_dir)
    return rows.select("id", F.round(evaluate.citation_accuracy(T.source_marks("text"), F.array(F.lit("a1"), F.lit("b2"))), 6).alias("accuracy"))


@_query(f"""WITH {_RANKED} SELECT query_id AS lang, string_agg('[' || rank || '] SOURCE: ' || r.doc_id || chr(10) || left(text, 200), chr(10) || chr(10) ORDER BY rank) AS context FROM r JOIN documents USING (doc_id) WHERE rank <= 5 GROUP BY query_id""")
def prompt_context(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents").withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n_chars"), "doc_id"))).where("rank <= 5")
    return evaluate.prompt_context(docs.select("lang", "rank", F.col("doc_id").alias("source_id"), F.col("text").alias("content")), "lang", chars=200)


# --- chunks and versions --------------------------------------------------------------------


def _packing_sql(parts: str, room: int, overlap: int, cols: str) -> str:
    """Greedy packing as a recursive query over parts (id, i, p, total): total is the length up to and with part i."""
    end = f"greatest(b.fresh, coalesce((SELECT max(i) FROM parts q WHERE q.id = b.id AND q.total - b.base <= {room}), b.fresh))"
    return f"""WITH RECURSIVE {parts}, b AS (SELECT id, 0 AS k, 1::BIGINT AS first, 1::BIGINT AS fresh, 0::BIGINT AS base, (SELECT greatest(1, coalesce(max(i), 1)) FROM parts q WHERE q.id = o.id AND q.total <= {room})::BIGINT AS last FROM (SELECT DISTINCT id FROM parts) o
UNION ALL SELECT id, k + 1, first, fresh, base, greatest(fresh, coalesce((SELECT max(i) FROM parts q WHERE q.id = n.id AND q.total - n.base <= {room}), fresh))::BIGINT FROM
(SELECT b.id, b.k, b.last + 1 AS fresh, f.i + 1 AS first, f.total AS base FROM b JOIN parts l ON l.id = b.id AND l.i = b.last, LATERAL (SELECT i, total FROM (SELECT b.first - 1 AS i, b.base AS total UNION ALL SELECT i, total FROM parts q WHERE q.id = b.id AND q.i BETWEEN b.first AND b.last) z WHERE l.total - z.total <= {overlap} ORDER BY i LIMIT 1) f
WHERE EXISTS (SELECT 1 FROM parts q WHERE q.id = b.id AND q.i = b.last + 1)) n)
SELECT {cols}"""


_PARAGRAPHS = r"""raw AS (SELECT doc_id::VARCHAR AS id, lang, list_filter(list_transform(regexp_split_to_array(text, '\n\s*\n'), lambda p: regexp_replace(p, '^\s+|\s+$', '', 'g')), lambda p: p <> '') AS ps FROM documents),
parts AS MATERIALIZED (SELECT id, i, p, sum(length(p)) OVER (PARTITION BY id ORDER BY i) AS total FROM (SELECT id, unnest(range(1, len(ps) + 1)) AS i, unnest(ps) AS p FROM raw))"""
_CHUNKS = "(SELECT string_agg(p, chr(10) || chr(10) ORDER BY i) FROM parts q WHERE q.id = b.id AND q.i BETWEEN b.first AND b.last)"


@_query(_packing_sql(_PARAGRAPHS, 2000, 0, f"id AS source_id, k AS chunk_no, md5({_CHUNKS}) AS content FROM b"))
def paragraph_chunks(spark, sf_dir):
    return chunking.paragraph_chunks(_t(spark, sf_dir, "documents"), id_col="doc_id", text_col="text").withColumn("content", F.md5("content"))


# documents of these tables have no section headings; those are covered by unit tests
_SENTENCES = r"""raw AS (SELECT doc_id::VARCHAR AS id, text, CASE WHEN length(text) <= 2048 THEN [text] ELSE list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\s+([A-Z])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: s <> '') END AS ps FROM documents),
parts AS MATERIALIZED (SELECT id, i, p, sum(length(p)) OVER (PARTITION BY id ORDER BY i) AS total FROM (SELECT id, unnest(range(1, len(ps) + 1)) AS i, unnest(ps) AS p FROM raw))"""
_SAID_PARTS = r"regexp_replace((SELECT string_agg(p, ' ' ORDER BY i) FROM parts q WHERE q.id = b.id AND q.i BETWEEN b.first AND b.last), '^\s+|\s+$', '', 'g')"


@_query(_packing_sql(_SENTENCES, 2048, 256, f"id AS source_id, id || ':chunk:' || k AS chunk_id, base::INTEGER AS char_start, (base + length({_SAID_PARTS}))::INTEGER AS char_end, md5({_SAID_PARTS}) AS content FROM b"))
def chunk_documents(spark, sf_dir):
    return chunking.chunk_documents(_t(spark, sf_dir, "documents")).select("source_id", "chunk_id", "char_start", "char_end", F.md5("content").alias("content"))


def _versions(spark, sf_dir):
    rows = _t(spark, sf_dir, "documents").select(F.col("source").alias("source_id"), F.col("text").alias("content"), "doc_id", F.timestamp_seconds("doc_id").alias("ingested_at"))
    return versions.version_log(versions.with_hash(rows))


_LOG = "v AS (SELECT doc_id, source AS source_id, source || '@' || left(sha256(text), 12) AS version_id, make_timestamp(doc_id * 1000000) AS ingested_at FROM documents), l AS (SELECT *, lead(version_id) OVER (PARTITION BY source_id ORDER BY ingested_at, version_id) AS superseded_by FROM v)"


@_query(f"WITH {_LOG} SELECT doc_id, version_id, superseded_by, superseded_by IS NULL AS is_current FROM l")
def doc_versions(spark, sf_dir):
    return _versions(spark, sf_dir).select("doc_id", "version_id", "superseded_by", "is_current")


@_query(f"WITH {_LOG} SELECT DISTINCT source_id FROM l WHERE superseded_by IS NULL AND ingested_at < make_timestamp(1000000000000) - INTERVAL 5 DAYS AND source_id IN (SELECT source FROM documents WHERE lang = 'en')")
def stale_sources(spark, sf_dir):
    chunks = _t(spark, sf_dir, "documents").where("lang = 'en'").select(F.col("source").alias("source_id"))
    return versions.stale_sources(_versions(spark, sf_dir), chunks, F.timestamp_seconds(F.lit(1_000_000)), 5)


@_query("SELECT DISTINCT source, sha256(text) AS content_hash FROM documents")
def content_dedup(spark, sf_dir):
    return versions.content_dedup(_t(spark, sf_dir, "documents"), source="source", content="text")


@_query("""WITH u AS (SELECT o_custkey, o_orderkey, o_orderdate, 0 AS n FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_custkey, o_orderkey, o_orderdate, 1 FROM orders WHERE o_orderkey % 3 = 0)
SELECT o_custkey, arg_max(o_orderkey, (n, o_orderdate, o_orderkey)) AS last_key, arg_min(o_orderkey, (n, o_orderdate, o_orderkey)) AS first_key FROM u GROUP BY o_custkey""")
def upsert_latest(spark, sf_dir):
    rows = _t(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").alias("last_key"), F.col("o_orderkey").alias("first_key"), F.struct("o_orderdate", "o_orderkey").alias("at"))
    return versions.upsert_latest(rows.where("last_key % 2 = 0"), rows.where("last_key % 3 = 0"), "o_custkey", "at", keep=("first_key",)).drop("at")


@_query("SELECT source, count(*) AS deleted FROM documents WHERE source IN ('src1', 'src2') GROUP BY source")
def delete_source(spark, sf_dir):
    gone = spark.createDataFrame([("src1",), ("src2",)], "source string")
    return versions.delete_source(_t(spark, sf_dir, "documents"), gone, "source")[1]


@_query("SELECT doc_id, lang FROM documents WHERE source NOT IN (SELECT source FROM documents WHERE lang = 'es') UNION ALL SELECT doc_id, lang FROM documents WHERE lang = 'es'")
def replace_by_source(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    return versions.replace_by_source(docs, docs.where("lang = 'es'"), "source").select("doc_id", "lang")


# --- records --------------------------------------------------------------------------------


@_query("SELECT o_orderpriority, year(o_orderdate)::INTEGER AS year, count(*) AS filings, count(*) FILTER (o_orderstatus = 'F') AS dispositions, round_even(count(*) FILTER (o_orderstatus = 'F')::DOUBLE / count(*), 4) AS clearance_rate FROM orders GROUP BY 1, 2")
def clearance_rate(spark, sf_dir):
    rows = _t(spark, sf_dir, "orders").groupBy("o_orderpriority", F.year("o_orderdate").alias("year")).agg(F.count(F.lit(1)).alias("filings"), F.count_if(F.col("o_orderstatus") == "F").alias("dispositions"))
    return records.caseload(rows)


@_query("SELECT o_orderkey FROM orders WHERE o_orderdate::DATE >= DATE '2001-07-25' AND o_orderstatus = 'F'")
def recent_filings(spark, sf_dir):
    rows = _t(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("filing_date"), F.col("o_orderstatus").alias("county"))
    return records.recent_filings(rows, F.lit(date(2001, 8, 1)), 7, "F").select("o_orderkey")


@_query("SELECT o_orderkey AS case_number, o_orderdate::DATE AS filing_date FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '2-HIGH' AND o_orderdate::DATE BETWEEN DATE '1997-01-01' AND DATE '1998-01-01' ORDER BY filing_date DESC, case_number LIMIT 50 OFFSET 50")
def case_search_page(spark, sf_dir):
    rows = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("case_number"), F.to_date("o_orderdate").alias("filing_date"), F.col("o_orderstatus").alias("county"), F.col("o_orderpriority").alias("case_type"))
    got = records.search_cases(rows, county="F", case_type="2-HIGH", date_from=date(1997, 1, 1), date_to=date(1998, 1, 1), page=2)
    return got.select("case_number", "filing_date")


@_query("SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS k FROM documents) WHERE k <= 3")
def newest_per_court(spark, sf_dir):
    rows = _t(spark, sf_dir, "documents").select(F.col("source").alias("court"), F.col("n_chars").alias("date_filed"), F.col("doc_id").alias("source_id"))
    return records.newest_per_court(rows, 3).select(F.col("court").alias("source"), F.col("source_id").alias("doc_id"))


@_query("SELECT source AS volume, doc_id AS name FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents WHERE source IN (SELECT DISTINCT source FROM documents ORDER BY source DESC LIMIT 2)) WHERE k <= 4")
def newest_volumes(spark, sf_dir):
    return records.newest_volumes(_t(spark, sf_dir, "documents").select(F.col("source").alias("volume"), F.col("doc_id").alias("name")), 2, 4)


@_query("SELECT s_suppkey, coalesce(n_name, CASE WHEN s_suppkey % 2 = 0 THEN s_name END, 'Unknown') AS name FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey AND n_regionkey <> 1")
def dimension_names(spark, sf_dir):
    dim = _t(spark, sf_dir, "nation").where("n_regionkey <> 1").select(F.col("n_nationkey").alias("code"), F.col("n_name").alias("name"))
    rows = _t(spark, sf_dir, "supplier").withColumn("raw", F.when(F.col("s_suppkey") % 2 == 0, F.col("s_name")).otherwise(""))
    return records.with_names(rows, "s_nationkey", dim, "raw", "name").select("s_suppkey", "name")


# --- observation ----------------------------------------------------------------------------


@_query("SELECT event_type, count(*) AS n, " + ", ".join(f"list_sort(list(value))[(floor(count(*) * {q}) + 1)::BIGINT] AS p{round(q * 100)}" for q in (0.5, 0.95, 0.99)) + " FROM events GROUP BY event_type")
def route_percentiles(spark, sf_dir):
    return observe.route_percentiles(_t(spark, sf_dir, "events"), "event_type", "value")


@_query("SELECT event_id, value FROM events ORDER BY ts DESC, event_id DESC LIMIT 10000")
def ring_buffer(spark, sf_dir):
    return observe.ring_buffer(_t(spark, sf_dir, "events"), ("ts", "event_id")).select("event_id", "value")


@_query("SELECT user_id, count(*) AS requests, count(*) FILTER (event_type = 'error') AS errors FROM events GROUP BY user_id")
def error_counts(spark, sf_dir):
    return observe.error_counts(_t(spark, sf_dir, "events"), "user_id", F.col("event_type") == "error")


@_query("SELECT user_id, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY user_id ORDER BY n DESC, user_id LIMIT 20")
def log_top_errors(spark, sf_dir):
    return observe.top_messages(_t(spark, sf_dir, "events"), F.col("event_type") == "error", "user_id")


_PERIOD = "s AS (SELECT floor(epoch(ts) / 300)::BIGINT AS p, max(value) AS value FROM events GROUP BY 1), c AS (SELECT unnest(generate_series((SELECT min(p) FROM s), (SELECT max(p) FROM s))) AS p), d AS (SELECT c.p, value, coalesce(value > 30, false) AS breaching FROM c LEFT JOIN s ON s.p = c.p)"


@_query(f"WITH {_PERIOD} SELECT p * 300 AS period_start, value, breaching, sum(breaching::INT) OVER (ORDER BY p ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) = 3 AS alarm FROM d")
def alarm_consecutive(spark, sf_dir):
    got = observe.alarms(_t(spark, sf_dir, "events"), "ts", 5, F.max("value"), 30, 3)
    return got.withColumn("period_start", F.unix_seconds("period_start"))


@_query("SELECT (floor(epoch(ts) / 300) * 300)::BIGINT AS start, event_type, count(*) AS n, round(sum(value), 4) AS total, max(value) AS highest, round(avg(value), 6) AS average FROM events GROUP BY 1, 2")
def tumbling_5m(spark, sf_dir):
    got = observe.tumbling(_t(spark, sf_dir, "events"), "ts", "5 minutes", "event_type", value="value")
    return got.select(F.unix_seconds("window_start").alias("start"), "event_type", "n", F.round("total", 4).alias("total"), "highest", F.round("average", 6).alias("average"))


@_query("SELECT start, event_type, count(*) AS n FROM (SELECT event_type, unnest([floor(epoch(ts) / 300) * 300 - 300, floor(epoch(ts) / 300) * 300])::BIGINT AS start FROM events) GROUP BY 1, 2")
def sliding_10m(spark, sf_dir):
    return observe.sliding(_t(spark, sf_dir, "events"), "ts", "10 minutes", "5 minutes", "event_type").select(F.unix_seconds("window_start").alias("start"), "event_type", "n")


@_query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTES THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, epoch_us(min(ts)) AS start, count(*) AS n FROM s GROUP BY user_id, k""")
def session_30m(spark, sf_dir):
    return observe.sessions(_t(spark, sf_dir, "events"), "ts", "30 minutes", "user_id").select("user_id", F.unix_micros("session_start").alias("start"), "n")


@_query("SELECT 'http_requests_total{route=\"' || event_type || '\"} ' || count(*) AS line FROM events GROUP BY event_type")
def metrics_text(spark, sf_dir):
    counts = _t(spark, sf_dir, "events").groupBy("event_type").count()
    return observe.exposition(counts, "http_requests_total", "route", "count", column="event_type")


_TIMES = "t AS (SELECT user_id AS key, epoch_us(ts) AS seq, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS i FROM events)"


@_query(f"""WITH RECURSIVE {_TIMES}, b AS (SELECT key, seq, i, 2.0::DOUBLE AS left_, true AS allowed FROM t WHERE i = 1
UNION ALL SELECT key, seq, i, f - (f >= 1)::INT, f >= 1 FROM (SELECT t.key, t.seq, t.i, least(3.0::DOUBLE, b.left_ + (t.seq / 1e6 - b.seq / 1e6) * 0.0001) AS f FROM b JOIN t ON t.key = b.key AND t.i = b.i + 1))
SELECT key, seq, allowed FROM b""")
def token_bucket(spark, sf_dir):
    return observe.token_bucket(_t(spark, sf_dir, "events"), "user_id", "ts", capacity=3, per_second=0.0001)


@_query(f"""WITH RECURSIVE {_TIMES}, b AS (SELECT key, seq, i, seq AS start, 1 AS n FROM t WHERE i = 1
UNION ALL SELECT t.key, t.seq, t.i, CASE WHEN t.seq >= b.start + 3600000000 THEN t.seq ELSE b.start END, CASE WHEN t.seq >= b.start + 3600000000 THEN 1 ELSE b.n + 1 END FROM b JOIN t ON t.key = b.key AND t.i = b.i + 1)
SELECT key, seq, n <= 2 AS allowed FROM b""")
def fixed_window_limit(spark, sf_dir):
    return observe.fixed_window_limit(_t(spark, sf_dir, "events"), "user_id", "ts", limit=2, seconds=3600)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from lodestone.plans import catalog_files, catalog_filings, catalog_records, catalog_stored  # noqa: F401  they register themselves

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(SQL)
