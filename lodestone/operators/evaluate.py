"""Retrieval metrics for all queries at once.

retrieved: (query_id, rank, doc_id); judged: (query_id, doc_id, grade) with grade 1 where none is given.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.functions import fixed
from lodestone.functions.text import all_matches, sentences, source_marks, uncited_claims


def ranking_metrics(queries: DataFrame, retrieved: DataFrame, judged: DataFrame, ks: Sequence[int] = (1, 5, 10)) -> DataFrame:
    """(query_id, k, recall, precision, ndcg, mrr): one row per query and k.

    A query without judgements has recall 1 and NDCG 0; k = 0 gives precision 0; repeated ids in a
    ranking count again for precision and DCG but once for recall.
    """
    n_rel = judged.groupBy("query_id").agg(F.count_distinct("doc_id").alias("n_rel"))
    # of a query's judgements only the best grades count, as many as the largest cut-off
    best_first = Window.partitionBy("query_id").orderBy(F.desc("grade"))
    few = judged.select("query_id", "grade", F.row_number().over(best_first).alias("_k")).where(F.col("_k") <= max([1, *ks]))
    ideal = n_rel.join(few.groupBy("query_id").agg(F.sort_array(F.collect_list("grade"), asc=False).alias("grades")), "query_id", "left")
    hits = retrieved.join(judged, ["query_id", "doc_id"], "left")
    gain = (F.pow(F.lit(2.0), F.coalesce("grade", F.lit(0))) - 1) / F.log2(F.col("rank") + 1)
    rel = F.col("grade").isNotNull()
    each = hits.crossJoin(F.broadcast(queries.sparkSession.createDataFrame([(int(k),) for k in ks], "k int")))  # a literal list of cut-offs
    each = each.groupBy("query_id", "k").agg(
        F.count_distinct(F.when(rel & (F.col("rank") <= F.col("k")), F.col("doc_id"))).alias("found"), F.count_if(rel & (F.col("rank") <= F.col("k"))).alias("hits"),
        F.sum(F.when(F.col("rank") <= F.col("k"), gain).otherwise(0.0)).alias("dcg"), F.min(F.when(rel, F.col("rank"))).alias("first"))
    grid = queries.select("query_id").crossJoin(F.broadcast(queries.sparkSession.createDataFrame([(int(k),) for k in ks], "k int")))
    rows = grid.join(each, ["query_id", "k"], "left").join(ideal, "query_id", "left")
    best = F.aggregate(F.transform(F.slice("grades", F.lit(1), F.greatest("k", F.lit(0))), lambda g, i: (F.pow(F.lit(2.0), g) - 1) / F.log2(i + 2)), F.lit(0.0), lambda s, v: s + v)
    return rows.select(
        "query_id", "k", F.when(F.col("n_rel").isNull(), 1.0).otherwise(F.coalesce("found", F.lit(0)) / F.col("n_rel")).alias("recall"),
        F.when(F.col("k") == 0, 0.0).otherwise(F.coalesce("hits", F.lit(0)) / F.greatest("k", F.lit(1))).alias("precision"),
        F.when(F.coalesce(best, F.lit(0.0)) == 0, 0.0).otherwise(F.coalesce("dcg", F.lit(0.0)) / best).alias("ndcg"), F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("mrr"))


def report(metrics: DataFrame) -> DataFrame:
    """(k, recall, precision, ndcg, mrr): means over queries."""
    return metrics.groupBy("k").agg(*[F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in ("recall", "precision", "ndcg", "mrr")])


def citation_accuracy(cited: Column, known: Column) -> Column:
    """Share of cited ids that are known; 1 without citations."""
    good = F.size(F.filter(cited, lambda c: F.array_contains(known, c)))
    return F.when(F.size(cited) == 0, 1.0).otherwise(good / F.size(cited))


def faithfulness(answer: str, context: str) -> Column:
    """Share of the answer's claims that the context (array of texts) contains.

    Claims are citations, else legal terms; 0.5 where there are none, 0 where answer or context is empty.
    """
    cites = all_matches(answer, fixed.CLAIM)
    claims = F.when(F.size(cites) > 0, cites).otherwise(all_matches(F.lower(answer), fixed.LEGAL_TERM))
    whole = F.lower(F.array_join(context, " "))
    share = F.size(F.filter(claims, lambda c: F.contains(whole, F.lower(c)))) / F.size(claims)
    return F.when((F.coalesce(F.col(answer), F.lit("")) == "") | (F.size(context) == 0), 0.0).when(F.size(claims) == 0, 0.5).otherwise(share)


def validated(rows: DataFrame, *, text: str = "answer", known: str = "context_ids") -> DataFrame:
    """Adds cited, missing, uncited, warnings and is_valid."""
    cited = rows.withColumn("cited", source_marks(text))
    missing = F.filter("cited", lambda c: ~F.array_contains(F.col(known), c))
    warnings = F.filter(F.array(F.when(F.lower(text).contains(fixed.FALLBACK_SIGN), "fallback_response_detected"), F.when(F.size("cited") == 0, "no_citations_in_output")), lambda w: w.isNotNull())
    return cited.withColumns({"missing": missing, "uncited": uncited_claims(text), "warnings": warnings}).withColumn("is_valid", F.size("missing") == 0)


def guarded(rows: DataFrame, fallback: str, *, text: str = "answer", known: str = "context_ids") -> DataFrame:
    """Validated rows in which an answer without context or with an unknown citation becomes the fallback."""
    checked = validated(rows, text=text, known=known)
    bad = (F.size(known) == 0) | ~F.col("is_valid")
    return checked.withColumn("fell_back", bad).withColumn(text, F.when(bad, F.lit(fallback)).otherwise(F.col(text)))


EXAMPLES = "name string, description string, created_by string, examples array<struct<query_id:string,query:string,relevant_source_ids:array<string>,graded_relevance:map<string,int>,expected_citations:array<string>,jurisdiction:string,notes:string>>"


def load_examples(spark: SparkSession, path: str) -> DataFrame:
    """One row per example of a JSON evaluation set."""
    return spark.read.schema(EXAMPLES).option("multiLine", True).json(path).select(F.explode("examples").alias("e")).select("e.*")


def save_examples(examples: DataFrame, path: str, name: str) -> None:
    cols = examples.select(F.lit(name).alias("name"), F.struct(*examples.columns).alias("e"))
    cols.groupBy("name").agg(F.array_sort(F.collect_list("e"), lambda a, b: F.when(a["query_id"] < b["query_id"], -1).when(a["query_id"] > b["query_id"], 1).otherwise(0)).alias("examples")).write.json(path)


def judgements(examples: DataFrame) -> DataFrame:
    """(query_id, doc_id, grade): relevant ids with their grade, 1 where none is given; graded ids as well.

    A query may have several examples: of an id's grades the greatest counts, and a grade before none.
    """
    named = examples.select("query_id", F.explode("relevant_source_ids").alias("doc_id"), F.lit(None).cast("int").alias("grade"), F.lit(1).alias("_least"))
    graded = examples.select("query_id", F.explode("graded_relevance").alias("doc_id", "grade"), F.lit(None).cast("int").alias("_least"))
    return named.unionByName(graded).groupBy("query_id", "doc_id").agg(F.coalesce(F.max("grade"), F.max("_least")).alias("grade"))


def extractive_answer(rows: DataFrame, *by: str, sources: int = 6, chars: int = 400) -> DataFrame:
    """(by, answer): the offline answer, the head of the best sources with their marks."""
    part = F.concat(F.left("content", F.lit(chars)), F.lit(" [SOURCE: "), F.col("source_id").cast("string"), F.lit("]"))
    kept = rows.where(F.col("rank") <= sources).groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("rank", part.alias("p")))).alias("ps"))
    return kept.select(*by, F.array_join("ps.p", "\n").alias("answer"))


def prompt_context(rows: DataFrame, *by: str, chars: int = 8000) -> DataFrame:
    """(by, context): numbered source blocks in rank order."""
    part = F.format_string("[%d] SOURCE: %s\n%s", F.col("rank").cast("int"), F.col("source_id").cast("string"), F.left("content", F.lit(chars)))
    kept = rows.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("rank", part.alias("p")))).alias("ps"))
    return kept.select(*by, F.array_join("ps.p", "\n\n").alias("context"))


def sentence_counts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return docs.select(id_col, F.size(sentences(text_col)).alias("n_sentences"))
