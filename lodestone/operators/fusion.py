"""Ranking operators: ranks, fusion, authority, validity, confidence."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.functions.text import court_weight
from lodestone.operators.ordering import order_statistics


def ranked(scores: DataFrame, by: str = "score") -> DataFrame:
    """Adds a 1-based rank. The input is a candidate list, bounded by its limit."""
    return scores.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(by), "id")))


def merge_dedup(first: DataFrame, second: DataFrame) -> DataFrame:
    """The rows of first, then those of second whose id is new."""
    return first.unionByName(second.join(first.select("id"), "id", "left_anti"))


def rrf(dense: DataFrame, sparse: DataFrame, *, weight: float = 0.5, k: int = 60) -> DataFrame:
    """(id, score): weighted reciprocal ranks of two candidate lists, zero scores dropped.

    A union of contributions and one aggregate replace a full outer join.
    """
    part = lambda df, w: ranked(df).select("id", (F.lit(float(w)) / (F.lit(k) + F.col("rank"))).alias("part"))
    both = part(dense, 1 - weight).unionByName(part(sparse, weight))
    return both.groupBy("id").agg(F.sum("part").alias("score")).where("score > 0")


def blend_authority(rows: DataFrame, *, alpha: float = 0.3, court: str = "court") -> DataFrame:
    """score := (1 - alpha) * score + alpha * authority of the court."""
    return rows.withColumn("authority", court_weight(court)).withColumn("score", F.lit(1 - alpha) * F.col("score") + F.lit(alpha) * F.col("authority"))


def valid_on(reference: Column, effective: str | Column = "effective_date", expiry: str | Column = "expiry_date") -> Column:
    """In force on the reference date; missing dates do not exclude."""
    e, x = (F.col(c) if isinstance(c, str) else c for c in (effective, expiry))
    return (e.isNull() | (e <= reference)) & (x.isNull() | (x >= reference))


def confidence(rows: DataFrame, *by: str, score: str = "score") -> DataFrame:
    """(by, confidence): High, Medium or Low from the top score and its gap to the median, which is exact whatever the group's size."""
    half = F.col("n") - 1
    stats = order_statistics(rows, by, score, {"lower": F.floor(half / 2), "upper": F.ceil(half / 2), "top": half})
    gap = F.col("top") - (F.col("lower") + F.col("upper")) / 2
    label = F.when((F.col("top") > 0.018) & (gap > 0.004), "High").when((F.col("top") > 0.010) & (gap > 0.002), "Medium").otherwise("Low")
    return stats.select(*by, label.alias("confidence"))


def lexical_reranker(query: str) -> Column:
    """The offline stand-in for a cross-encoder: share of the query's words that the content has."""
    q = F.array_distinct(F.regexp_extract_all(F.lower(F.lit(query)), F.lit(r"[a-z0-9]+"), F.lit(0)))
    words = F.regexp_extract_all(F.lower(F.col("content")), F.lit(r"[a-z0-9]+"), F.lit(0))
    return F.size(F.array_intersect(q, words)) / F.greatest(F.size(q), F.lit(1))


def rerank(rows: DataFrame, scorer: Column, k: int) -> DataFrame:
    """The k rows with the best new score. scorer: any column, such as a pandas UDF over (query, content)."""
    return rows.withColumn("score", scorer).orderBy(F.desc("score"), "id").limit(k)


Scorer = Callable[[list[tuple[str, str]]], list[float]]


def model_reranker(query: str | Column, make: Callable[[], Scorer], *, content: str = "content", batch: int = 32) -> Column:
    """Score of (query, content) pairs by a pluggable model.

    make builds the scorer in the task, once per Python worker; it gets lists of at most `batch`
    pairs and returns as many scores. Null contents count as empty.
    """

    @F.pandas_udf("double")
    def score(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        scorer = make()
        for q, text in parts:
            pairs = list(zip(q.fillna(""), text.fillna(""), strict=True))
            out = [s for i in range(0, len(pairs), batch) for s in scorer(pairs[i : i + batch])]
            yield pd.Series(out, dtype=float)

    return score(F.lit(query) if isinstance(query, str) else query, F.col(content))


def overlap_scorer() -> Scorer:
    """An offline scorer of the same shape as a model: share of the query's words that the content has."""
    import re

    words = lambda t: set(re.findall(r"[a-z0-9]+", t.lower()))
    return lambda pairs: [len(words(q) & words(t)) / max(len(words(q)), 1) for q, t in pairs]
