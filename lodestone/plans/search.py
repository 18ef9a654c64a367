"""Composite plans: parse, retrieve, fuse, rerank, answer; and the filing analysis."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import filings, fusion, graph, lexical
from lodestone.operators.evaluate import extractive_answer, prompt_context, validated
from lodestone.operators.knn import knn
from lodestone.storage import join_checked, written


def parse_queries(queries: DataFrame, column: str = "query") -> DataFrame:
    """The parsed form of every query of a batch."""
    q = F.col(column)
    return queries.withColumns({
        "normalized": T.normalize_query(q), "jurisdiction": T.jurisdiction(q), "case_type": T.case_type(q), "citations": T.statutes(q), "keywords": T.keywords(q), "temporal": T.wants_current_law(q),
    }).withColumn("kind", T.classified(q)).select("*", "kind.*").drop("kind")


#: Bounds of a request, and how many candidates go to the reranker at most.
QUERY_CHARS, TOP_K, RERANKED = (3, 1000), (1, 20), 20


def refused(requests: DataFrame, *, query: str = "query", top_k: str | None = "top_k", chars: tuple[int, int] = QUERY_CHARS) -> DataFrame:
    """Adds `refused`: the names of the columns that break the bounds of a request; a null query is empty, a null top_k is the default."""
    n = F.char_length(F.coalesce(query, F.lit("")))
    wrong = [F.when(~n.between(*chars), query)]
    if top_k is not None:
        wrong.append(F.when(~F.col(top_k).between(*TOP_K), top_k))
    return requests.withColumn("refused", F.array_compact(F.array(*wrong)))


@dataclass(frozen=True)
class Request:
    """One search. candidates: how many rows each branch gives (min(4 top_k, RERANKED) unless set)."""

    terms: Sequence[str]
    vector: Sequence[float]
    top_k: int = 5
    weight: float = 0.5
    mode: str = "production"
    candidates: int | None = None
    scope: str = "corpus"
    where: Column | None = None

    def __post_init__(self) -> None:
        if not TOP_K[0] <= self.top_k <= TOP_K[1]:
            raise ValueError(f"top_k must be between {TOP_K[0]} and {TOP_K[1]}")
        if self.mode not in ("production", "lexical") or self.scope not in ("corpus", "candidates"):
            raise ValueError("unknown mode or scope")

    @property
    def n(self) -> int:
        return self.candidates or min(4 * self.top_k, RERANKED)


@dataclass(frozen=True)
class Parsed:
    """What a query's text says about how to search for it."""

    normalized: str
    terms: list[str]
    weight: float
    alpha: float
    temporal: bool
    jurisdiction: str | None
    case_type: str | None


def parsed_query(spark: SparkSession, query: str) -> Parsed:
    """One query through the same expressions as parse_queries."""
    if not QUERY_CHARS[0] <= len(query) <= QUERY_CHARS[1]:
        raise ValueError(f"a query has {QUERY_CHARS[0]} to {QUERY_CHARS[1]} characters")
    r = parse_queries(spark.createDataFrame([(query,)], "query string")).first()
    words = [w for w in r["normalized"].lower().split() if w]
    return Parsed(r["normalized"], words, r["bm25_weight"], r["authority_alpha"], r["temporal"], r["jurisdiction"], r["case_type"])


def hybrid_search(docs: DataFrame, vectors: DataFrame, request: Request, *, id_col: str = "doc_id", text_col: str = "text", n: int | None = None) -> DataFrame:
    """(id, score): the n (top_k unless given) best of dense candidates and BM25 candidates by weighted reciprocal ranks.

    A filter holds for both branches: BM25 is scored over the rows that pass it, and only their vectors
    are candidates. In lexical mode the dense list is ignored, as no embedding provider is at hand.
    """
    rows = docs if request.where is None else docs.where(request.where)
    if request.where is not None and request.mode != "lexical":
        vectors = passing(vectors, rows, id_col)
    # BM25 is scored over the corpus or, if asked, over the matching rows alone
    base = rows if request.scope == "corpus" else rows.where(lexical.matches_any(text_col, request.terms))
    scores = lexical.bm25(base, request.terms, id_col=id_col, text_col=text_col)
    return fuse(None if request.mode == "lexical" else knn(vectors, request.vector, request.n), scores, request, n or request.top_k)


def passing(scored: DataFrame, rows: DataFrame, id_col: str, key: str = "vec_id") -> DataFrame:
    """The rows of scored (by key) whose id is one of rows; the ids are broadcast only if they are counted to be few."""
    return join_checked(scored, rows.select(F.col(id_col).alias(key)), key, "left_semi")


def indexed_search(vectors: DataFrame, index: str, request: Request, docs: DataFrame | None = None, *, id_col: str = "doc_id") -> DataFrame:
    """As hybrid_search over the corpus, with BM25 from a written index (lexical.build_index).

    A filter is a condition on docs, which must then be given; scores stay those of the whole corpus.
    BM25 over candidates alone is not to be had from an index.
    """
    if request.scope != "corpus":
        raise ValueError("an index has the statistics of the corpus, not of candidates")
    if request.where is not None and docs is None:
        raise ValueError("a filter needs docs, the rows that it is about")
    scores = lexical.bm25_from_index(vectors.sparkSession, index, request.terms)
    if request.where is not None:
        rows = docs.where(request.where)
        scores, vectors = passing(scores, rows, id_col, "id"), passing(vectors, rows, id_col)
    return fuse(None if request.mode == "lexical" else knn(vectors, request.vector, request.n), scores, request, request.top_k)


def fuse(dense: DataFrame | None, scores: DataFrame, request: Request, n: int) -> DataFrame:
    """(id, score): the n best by reciprocal ranks of the dense candidates, if any, and the best of scores."""
    # the filter comes after the cut, as below it the scores would be worked out twice; positive scores come first anyway
    sparse = scores.orderBy(F.desc("score"), "id").limit(request.n).where("score > 0")
    fused = fusion.rrf(sparse, sparse, weight=1.0) if dense is None else fusion.rrf(dense, sparse, weight=request.weight)
    return fused.orderBy(F.desc("score"), "id").limit(n)


def served_search(docs: DataFrame, vectors: DataFrame, query: str, vector: Sequence[float], *, top_k: int = 5, case_type: str | None = None, jurisdiction: str | None = None, scorer: Column | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, content, score): the search as served.

    The query's text gives terms, fusion weight and jurisdiction; four times top_k candidates are
    fetched, reranked by `scorer` (a column over `content`; the share of query words unless given)
    and cut to top_k. A jurisdiction filters rows only where docs has that column, a case type only if asked for.
    """
    told = parsed_query(docs.sparkSession, query)
    conditions = []
    place = jurisdiction or told.jurisdiction
    if place is not None and "jurisdiction" in docs.columns:
        conditions.append(F.col("jurisdiction") == place)
    if case_type is not None:
        conditions.append(F.col("case_type") == case_type)
    where = reduce(and_, conditions) if conditions else None
    request = Request(told.terms, vector, top_k=top_k, weight=told.weight, candidates=min(16 * top_k, RERANKED), where=where)
    found = hybrid_search(docs, vectors, request, id_col=id_col, text_col=text_col, n=4 * top_k)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("content")).join(F.broadcast(found), "id")  # found has 4 top_k rows at most
    return presented(fusion.rerank(rows, scorer if scorer is not None else fusion.lexical_reranker(told.normalized), top_k))


def presented(rows: DataFrame) -> DataFrame:
    """The rows as served: content cut at 600 characters, score half-even to six places."""
    return rows.withColumn("content", F.left("content", F.lit(600))).withColumn("score", F.bround("score", 6))


def research(docs: DataFrame, vectors: DataFrame, request: Request, question: str, *, alpha: float | None = None, court: str = "source", scorer: Column | None = None, graph_tables: tuple[DataFrame, DataFrame, DataFrame] | None = None, today: Column | None = None) -> DataFrame:
    """One row: answer, sources, confidence and the validation of the answer.

    Candidates are kept only if in force `today` (by docs' effective_date and expiry_date) where the
    question asks for current law, reranked by `scorer`, enriched with the citation graph (ranks,
    good law and counts by source_id) if its tables are given, and blended with the court's authority.
    """
    told = parsed_query(docs.sparkSession, question)
    found = hybrid_search(docs, vectors, request, n=request.n)
    dated = [c for c in ("effective_date", "expiry_date") if c in docs.columns]
    rows = docs.select(F.col("doc_id").alias("id"), F.col("text").alias("content"), F.col(court).alias("court"), *dated).join(F.broadcast(found), "id")  # found has request.n rows at most
    if told.temporal and len(dated) == 2:
        rows = rows.where(fusion.valid_on(F.current_date() if today is None else today))
    ranked = fusion.rerank(rows, scorer if scorer is not None else fusion.lexical_reranker(told.normalized), request.top_k).withColumn("source_id", F.col("id").cast("string"))
    if graph_tables is not None:
        ranked = graph.enrich(ranked, *graph_tables)
    best = fusion.ranked(fusion.blend_authority(ranked, alpha=told.alpha if alpha is None else alpha)).withColumn("q", F.lit(question))
    answer = extractive_answer(best, "q").join(prompt_context(best, "q"), "q").join(fusion.confidence(best, "q"), "q")
    known = best.groupBy("q").agg(F.collect_list("source_id").alias("context_ids"))  # top_k rows
    return validated(answer.join(known, "q")).withColumnRenamed("q", "question")


def analyze_filings(rows: DataFrame, *, evidence: int = filings.EVIDENCE) -> tuple[DataFrame, DataFrame]:
    """(indicators, one row with the risk): the columns that the detectors need are written once, the indicators too."""
    kept = written(rows.select("source_id", "content", "parties", "filing_date"), "filings")
    found = written(filings.indicators(kept, evidence=evidence), "indicators")
    return found, filings.risk_level(found)


def summarize(rows: DataFrame, *, text: str = "content", chars: int = 8000) -> DataFrame:
    """Parties, citations and deadlines of each document and the text a summary would be made from."""
    return rows.withColumns({"parties_found": T.parties(text), "citations_found": T.all_matches(text, T.fixed.STATUTE), "deadlines": T.deadlines(text), "excerpt": F.left(text, F.lit(chars))})


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hybrid retrieval over the documents for one fixed query, vectors joined by id."""
    from lodestone.plans.catalog import QUERY_TERMS, query_vector

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return hybrid_search(docs, vectors, Request(QUERY_TERMS, query_vector(), top_k=10))
