"""Full-text matching and BM25 as scans and aggregates.

Two ways to the same scores. `bm25` scans the corpus: one pass counts its size and the document
frequencies of the query's terms (one row to the driver), a second scores. Only if a term is so
frequent that its idf is negative is the vocabulary counted for the mean idf. `build_index` writes
postings and statistics once; `bm25_from_index` then reads the partitions of its terms only.

Postings are made in Arrow batches, all of a slice of documents at once, and leave a task as one
row for each term of the slice: fewer and shorter rows to shuffle, sort and write than postings.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.text import bm25_tokens, light_stem


@dataclass(frozen=True)
class Statistics:
    n_docs: int
    mean_length: float
    df: dict[str, int]
    mean_idf: float = 0.0

    def raw_idf(self, term: str) -> float:
        n = self.df.get(term, 0)
        return math.log(self.n_docs - n + 0.5) - math.log(n + 0.5) if n else 0.0

    def idf(self, term: str, epsilon: float) -> float:
        """ln(N - n + 0.5) - ln(n + 0.5); a negative one becomes epsilon times the mean idf of the vocabulary."""
        raw = self.raw_idf(term)
        return epsilon * self.mean_idf if raw < 0 else raw


def _distinct(terms: Sequence[str]) -> list[str]:
    return list(dict.fromkeys(t.lower() for t in terms))


def term_counts(docs: DataFrame, terms: Sequence[str], *, id_col: str, text_col: str) -> DataFrame:
    """(id, dl, tf array<int>): length and the count of each term, in the order of terms."""
    tokens = docs.select(F.col(id_col).alias("id"), bm25_tokens(text_col).alias("tokens"))
    known = F.array(*map(F.lit, terms)) if terms else F.array().cast("array<string>")
    hits = F.filter("tokens", lambda x: F.array_contains(known, x))
    tf = F.array(*[F.size(F.filter("hits", _equals(t))) for t in terms])
    return tokens.select("id", F.size("tokens").alias("dl"), hits.alias("hits")).select("id", "dl", tf.alias("tf"))


def _equals(term: str):
    return lambda x: x == F.lit(term)


def mean_idf(docs: DataFrame, text_col: str, n_docs: int) -> float:
    """The mean idf over the vocabulary, which very frequent terms fall back to."""
    words = docs.select(F.explode(F.array_distinct(bm25_tokens(text_col))).alias("t"))
    df = words.groupBy("t").agg(F.count(F.lit(1)).alias("n"))
    mean = F.avg(F.log(F.lit(n_docs) - F.col("n") + 0.5) - F.log(F.col("n") + 0.5))
    return df.agg(mean).first()[0] or 0.0


def statistics(docs: DataFrame, terms: Sequence[str], *, id_col: str = "doc_id", text_col: str = "text") -> Statistics:
    """Size, mean length and the terms' document frequencies of a corpus."""
    terms = _distinct(terms)
    counted = term_counts(docs, terms, id_col=id_col, text_col=text_col)
    n, length, *df = counted.agg(F.count(F.lit(1)), F.avg("dl"), *[F.count_if(F.col("tf")[i] > 0) for i in range(len(terms))]).first()
    found = Statistics(n, length or 0.0, dict(zip(terms, df, strict=True)))
    if any(found.raw_idf(t) < 0 for t in terms):
        found = Statistics(n, found.mean_length, found.df, mean_idf(docs, text_col, n))
    return found


def _weight(tf: Column, dl: Column, idf: float, mean_length: float, k1: float, b: float) -> Column:
    scale = F.lit(k1) * (F.lit(1 - b) + F.lit(b) * dl / F.lit(max(mean_length, 1e-9)))
    return F.lit(idf) * tf * (k1 + 1) / (tf + scale)


def bm25(docs: DataFrame, terms: Sequence[str], *, id_col: str = "doc_id", text_col: str = "text", k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25) -> DataFrame:
    """(id, score) of every document over the corpus that docs is."""
    terms = _distinct(terms)
    stats = statistics(docs, terms, id_col=id_col, text_col=text_col)
    counted = term_counts(docs, terms, id_col=id_col, text_col=text_col)
    score = F.lit(0.0)
    for i, t in enumerate(terms):
        score = score + _weight(F.col("tf")[i], F.col("dl"), stats.idf(t, epsilon), stats.mean_length, k1, b)
    return counted.select("id", score.alias("score"))


#: Bytes of text that a Python worker turns into postings at a time, about.
SLICE = 4 << 20
#: What bm25_tokens splits at. Arrow also splits at four separators that are no white space there.
_SPACE, _OTHER = re.compile("[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+"), "[\\x1c-\\x1f]"


def _words(lowered: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of lower-cased texts, those of bm25_tokens, one after the other, and the row of each."""
    if pc.any(pc.match_substring_regex(lowered, _OTHER)).as_py():
        lists = pa.array([None if t is None else _SPACE.split(t) for t in lowered.to_pylist()], pa.list_(pa.string()))
    else:
        lists = pc.utf8_split_whitespace(lowered)
    words, row = lists.flatten(), np.repeat(np.arange(len(lists)), pc.list_value_length(lists).fill_null(0))
    real = pc.not_equal(words, "")
    return words.filter(real), row[real.to_numpy(zero_copy_only=False)]


def lengths(lowered: pa.Array) -> np.ndarray:
    """How many words each text has, none for null."""
    found = [np.bincount(_words(b.column("text"))[1], minlength=len(b)) for b in slices([pa.RecordBatch.from_arrays([lowered], ["text"])], "text")]
    return np.concatenate([np.zeros(0), *found]).astype(np.int32)


def blocks(ids: pa.Array, lowered: pa.Array) -> dict[str, pa.Array]:
    """A row for each term: its documents (id, tf, dl), the largest tf and the least dl there, how many documents and occurrences."""
    words, row = _words(lowered)
    dl, coded = np.bincount(row, minlength=len(ids)), words.dictionary_encode()
    del words
    pair, tf = np.unique(coded.indices.to_numpy().astype(np.int64) * len(ids) + row, return_counts=True)
    term, doc = np.divmod(pair, max(1, len(ids)))
    starts, of = np.flatnonzero(np.diff(term, prepend=-1)), dl[doc]
    docs = pa.StructArray.from_arrays([ids.take(pa.array(doc)), pa.array(tf, pa.int32()), pa.array(of, pa.int32())], ["id", "tf", "dl"])
    ends = np.append(starts, len(pair))
    return {
        "term": coded.dictionary.take(pa.array(term[starts])), "docs": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), docs), "max_tf": pa.array(np.maximum.reduceat(tf, starts), pa.int32()),
        "min_dl": pa.array(np.minimum.reduceat(of, starts), pa.int32()), "n": pa.array(np.diff(ends), pa.int64()), "words": pa.array(np.add.reduceat(tf, starts), pa.int64())}


def slices(batches: Iterable[pa.RecordBatch], text: str) -> Iterator[pa.RecordBatch]:
    """The rows of the batches anew, by about SLICE bytes of text."""
    held, size = [], 0
    for batch in batches:
        ends = np.cumsum(pc.binary_length(batch.column(text)).fill_null(0).to_numpy(zero_copy_only=False))
        start = 0
        while start < len(batch):
            stop = max(start + 1, int(np.searchsorted(ends, SLICE - size + (ends[start - 1] if start else 0), "right")))
            held.append(batch.slice(start, stop - start))
            size += int(ends[stop - 1] - (ends[start - 1] if start else 0))
            start = stop
            if start < len(batch) or size >= SLICE:
                yield pa.concat_batches(held)
                held, size = [], 0
    if held:
        yield pa.concat_batches(held)


#: Documents that a task of build_index takes, at most about; it writes a file a bucket.
TASK_DOCS = 8192


def build_index(docs: DataFrame, path: str, *, buckets: int = 64, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes path/postings (bucket, term, docs, n, words), sorted by term within a bucket, and path/statistics.

    A row is a term in a slice of documents, or without a term the number of a task's texts. The
    texts are dealt to tasks, as their postings are many times larger; each task writes its own files,
    so that a frequent term's rows are in several.
    """
    columns = ["term", "docs", "n", "words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = 0
        for b in slices(batches, "text"):
            made = blocks(b.column("id"), b.column("text"))
            yield pa.RecordBatch.from_arrays([made[c] for c in columns], columns)
            known += len(b) - b.column("text").null_count
        if known:
            texts = [pa.array([x], made[c].type) for c, x in zip(columns, [None, None, known, 0], strict=True)]
            yield pa.RecordBatch.from_arrays(texts, columns)

    spark, n = docs.sparkSession, docs.count()
    texts = docs.select(F.col(id_col).alias("id"), F.lower(text_col).alias("text"))
    dealt = texts.repartition(max(1, min(n, max(spark.sparkContext.defaultParallelism, -(-n // TASK_DOCS)))), F.xxhash64("id", "text"))
    rows = dealt.mapInArrow(run, f"term string, docs array<struct<id:{dict(texts.dtypes)['id']},tf:int,dl:int>>, n long, words long")
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")).sortWithinPartitions("bucket", "term")
    rows.write.partitionBy("bucket").parquet(f"{path}/postings")
    df = spark.read.parquet(f"{path}/postings").groupBy("term").agg(F.sum("n").alias("n"), F.sum("words").alias("words"))
    idf = F.when(F.col("term").isNotNull(), F.log(F.lit(n) - F.col("n") + 0.5) - F.log(F.col("n") + 0.5))
    mean, words, known = df.agg(F.avg(idf), F.sum("words"), F.max(F.when(F.col("term").isNull(), F.col("n")))).first()
    spark.createDataFrame([(n, (words or 0) / max(known or 0, 1), float(mean or 0), buckets)], "n_docs long, mean_length double, mean_idf double, buckets int").coalesce(1).write.parquet(f"{path}/statistics")


def bm25_from_index(spark: SparkSession, path: str, terms: Sequence[str], *, k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25) -> DataFrame:
    """(id, score) of the documents that hold any of the terms; only the terms' buckets are read."""
    terms = _distinct(terms)
    s = spark.read.parquet(f"{path}/statistics").first()
    bucket = F.pmod(F.xxhash64("t"), F.lit(s["buckets"])).cast("int")
    wanted = [r[0] for r in spark.createDataFrame([(t,) for t in terms], "t string").select(bucket).distinct().collect()] if terms else []
    hits = spark.read.parquet(f"{path}/postings").where(F.col("bucket").isin(wanted) & F.col("term").isin(terms))
    df = {r["term"]: r["n"] for r in hits.groupBy("term").agg(F.sum("n").alias("n")).collect()}  # a row a term
    stats = Statistics(s["n_docs"], s["mean_length"], df, s["mean_idf"])
    part = F.lit(0.0)
    for t in terms:
        part = F.when(F.col("term") == t, _weight(F.col("tf"), F.col("dl"), stats.idf(t, epsilon), stats.mean_length, k1, b)).otherwise(part)
    return hits.select("term", F.explode("docs").alias("d")).select("term", "d.*").select("id", part.alias("part")).groupBy("id").agg(F.sum("part").alias("score"))


def matches_any(text: str | Column, terms: Sequence[str], *, stem: bool = False) -> Column:
    """True where the text has any of the terms as a word."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"[a-z0-9]+"), F.lit(0))
    wanted = [F.lit(t.lower()) for t in terms]
    return F.arrays_overlap(F.transform(words, light_stem), F.array(*map(light_stem, wanted))) if stem else F.arrays_overlap(words, F.array(*wanted))


def match_count(text: str | Column, terms: Sequence[str], *, stem: bool = False) -> Column:
    """How many of the terms occur: the rank of a full-text match."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"[a-z0-9]+"), F.lit(0))
    wanted = F.array(*[F.lit(t.lower()) for t in terms])
    return F.size(F.array_intersect(F.transform(words, light_stem), F.transform(wanted, light_stem)) if stem else F.array_intersect(words, wanted))


def keyword_search(docs: DataFrame, terms: Sequence[str], k: int, *, id_col: str = "doc_id", text_col: str = "text", stem: bool = False) -> DataFrame:
    """(id, score): the k best OR matches; the score is the number of terms, ties by id."""
    hit = docs.where(matches_any(text_col, terms, stem=stem))
    return hit.select(F.col(id_col).alias("id"), match_count(text_col, terms, stem=stem).cast("double").alias("score")).orderBy(F.desc("score"), "id").limit(k)
