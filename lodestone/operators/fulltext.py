"""English full text: stemmed lexemes with positions, OR matches ranked by the proximity of all terms.

A lexeme is the Porter2 stem of a word ([a-z0-9]+ of the lower-cased text) that is no stop word; its
positions count all words, stop words too. A text matches if it has any lexeme of the query. Its rank
is that of the query with AND: over all pairs of two lexemes' positions the weights
0.1 / sqrt(1.005 + 0.05 exp(distance / 1.5 - 2)) are joined as 1 - prod(1 - weight); pairs more than
100 words apart weigh nothing, and a text without any pair has the rank 1e-20. A query of one lexeme
ranks by its number of occurrences, with weights that fall with the square. All positions count.

`scan_hits` reads texts, `build_fulltext` stores postings with positions once and `index_hits` then
reads the files of the query's lexemes only; both give the same hits.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.stemming import STOP_WORDS, stem

_WORD = re.compile(r"[a-z0-9]+")
# Fixed values of the rank.
WEIGHT, NONE, REACH, ZETA = 0.1, 1e-20, 100, 1.64493406685


def lexemes(text: str) -> list[str]:
    """The distinct lexemes of a query, in order."""
    return list(dict.fromkeys(stem(w) for w in _WORD.findall(text.lower()) if w not in STOP_WORDS))


def _positions(text: str | None, wanted: frozenset | None = None) -> dict[str, list[int]]:
    found: dict[str, list[int]] = {}
    for i, w in enumerate(_WORD.findall((text or "").lower()), 1):
        if w not in STOP_WORDS and ((s := stem(w)) in wanted if wanted is not None else (s := stem(w))):
            found.setdefault(s, []).append(i)
    return found


def scan_hits(docs: DataFrame, wanted: Sequence[str], *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, positions array<array<int>>) of the texts that have any wanted lexeme; positions in the order of wanted. Null texts have none."""
    some = frozenset(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, out = [], []
            for k, t in enumerate(batch.column(1)):
                if found := _positions(t.as_py(), some):
                    at.append(k)
                    out.append([found.get(s, []) for s in wanted])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(out, pa.list_(pa.list_(pa.int32())))], names=["id", "positions"])

    rows = docs.select(F.col(id_col).alias("id"), text_col)
    return rows.mapInArrow(run, f"id {dict(rows.dtypes)['id']}, positions array<array<int>>")


def build_fulltext(docs: DataFrame, path: str, *, buckets: int = 64, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes postings (lexeme, id, positions) under path, in folders by a hash of the lexeme, sorted by lexeme; a frequent lexeme's are dealt over several files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, t in enumerate(batch.column(1)):
                if found := _positions(t.as_py()):
                    ids = batch.column(0).take(pa.array([k] * len(found)))
                    yield pa.RecordBatch.from_arrays([pa.array(list(found)), ids, pa.array(list(found.values()), pa.list_(pa.int32()))], names=["lexeme", "id", "positions"])

    rows = docs.select(F.col(id_col).alias("id"), text_col)
    posted = rows.mapInArrow(run, f"lexeme string, id {dict(rows.dtypes)['id']}, positions array<int>").withColumn("bucket", F.pmod(F.xxhash64("lexeme"), F.lit(buckets)).cast("int"))
    posted.repartition("bucket", F.pmod(F.xxhash64("id"), F.lit(8))).sortWithinPartitions("bucket", "lexeme").write.partitionBy("bucket").parquet(f"{path}/postings")
    docs.sparkSession.createDataFrame([(buckets,)], "buckets int").coalesce(1).write.parquet(f"{path}/size")


def index_hits(spark: SparkSession, path: str, wanted: Sequence[str]) -> DataFrame:
    """As scan_hits, from the stored postings; only the buckets of the wanted lexemes are read."""
    n = spark.read.parquet(f"{path}/size").first()["buckets"]
    bucket = F.pmod(F.xxhash64("lexeme"), F.lit(n)).cast("int")
    asked = spark.createDataFrame([(s,) for s in wanted], "lexeme string").select(bucket).distinct().collect() if wanted else []
    found = spark.read.parquet(f"{path}/postings").where(F.col("bucket").isin([r[0] for r in asked]) & F.col("lexeme").isin(list(wanted)))
    several = found.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("lexeme", "positions"))).alias("m"))  # an entry a wanted lexeme
    return several.select("id", F.array(*[F.coalesce(F.col("m")[s], F.array().cast("array<int>")) for s in wanted]).alias("positions"))


def _nearness(a: np.ndarray, b: np.ndarray) -> float:
    """Sum of log(1 - weight) over the pairs of two sorted lists of positions, at most REACH apart."""
    lo, hi = np.searchsorted(b, a - REACH), np.searchsorted(b, a + REACH, "right")
    n = hi - lo
    d = np.abs(np.repeat(a, n) - b[np.repeat(lo - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())]).astype(float)
    return float(np.log1p(-WEIGHT / np.sqrt(1.005 + 0.05 * np.exp(d[d > 0] / 1.5 - 2))).sum())


def rank(positions: Sequence[Sequence[int]]) -> float:
    """The rank of a text by the positions of each of the query's lexemes."""
    if len(positions) == 1:
        return WEIGHT * sum(1 / (j * j) for j in range(1, len(positions[0]) + 1)) / ZETA
    lists = [np.asarray(p, np.int64) for p in positions if len(p)]
    log = sum(_nearness(a, b) for i, a in enumerate(lists) for b in lists[:i])
    return -float(np.expm1(log)) if log else NONE


def fulltext_search(hits: DataFrame, k: int) -> DataFrame:
    """(id, score): the k best of the hits by rank, ties by id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = [rank(p.as_py()) for p in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score, pa.float64())], names=["id", "score"])

    ranked = hits.select("id", "positions").mapInArrow(run, f"id {dict(hits.dtypes)['id']}, score double")
    return ranked.orderBy(F.desc(F.round("score", 12)), "id").limit(k)
