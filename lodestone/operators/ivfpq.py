"""A stored vector index: inverted lists of product-quantised residuals, and exact re-ranking.

Centroids and codebooks are fitted on a bounded sample; every vector is then assigned to its nearest
centroid and stored in that list's folder with the code of what remains (a byte a part) and itself.
Lists of more than `longest` rows are split into slices. A search picks each query's nearest lists,
scores their codes by table look-ups (the files' code columns only; folders of other lists are pruned),
and fetches the vectors of the `rerank` best of each query, whose cosines decide.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.functions.vectors import cosine
from lodestone.storage import join_checked, written

#: Queries that one task scores against a slice of a list, at most about.
QUERIES = 4096


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def means(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    """k-means of a bounded sample; empty clusters stay where they were."""
    centres = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        near = _nearest(x, centres)
        order = np.argsort(near, kind="stable")
        first = np.flatnonzero(np.diff(near[order], prepend=-1))
        sums = np.add.reduceat(x[order], first)
        centres[near[order][first]] = sums / np.diff(np.append(first, len(x)))[:, None]
    return centres


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres * centres).sum(1) - 2 * x @ centres.T).argmin(1)


@dataclass(frozen=True)
class Model:
    centres: np.ndarray  # lists x size
    books: np.ndarray  # parts x codes x width

    def lists_of(self, x: np.ndarray) -> np.ndarray:
        return _nearest(x, self.centres)

    def codes_of(self, rest: np.ndarray) -> np.ndarray:
        cut = rest.reshape(len(rest), len(self.books), -1)
        return np.stack([_nearest(cut[:, p], b) for p, b in enumerate(self.books)], 1).astype(np.uint8)


def _vectors(column: pa.Array) -> np.ndarray:
    return unit(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1))


def build(vectors: DataFrame, path: str, *, lists: int | None = None, parts: int = 16, sample: int = 20_000, longest: int = 50_000, seed: int = 7, id_col: str = "vec_id", vector_col: str = "embedding") -> None:
    """Writes path/lists (list_id, slice, id, code, vector) and path/model.

    The sample is the `sample` rows of least id hash. lists: the square root of the rows unless given,
    at most a 40th of the sample. Null and zero vectors and those with a null or non-finite component
    are left out; all others have one length, which the parts divide.
    """
    spark, v = vectors.sparkSession, F.col(vector_col)
    fit = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.where(v.isNotNull() & fit).select(F.col(id_col).alias("id"), v.cast("array<float>").alias("vector"))
    n = rows.count()
    some = unit(np.array([r["vector"] for r in rows.orderBy(F.xxhash64("id"), "id").limit(sample).collect()], np.float64))
    rng = np.random.default_rng(seed)
    centres = means(some, max(1, min(lists or round(n**0.5), max(1, len(some) // 40))), 12, rng)
    rest = (some - centres[_nearest(some, centres)]).reshape(len(some), parts, -1)
    model = Model(centres, np.stack([means(rest[:, p], min(256, len(some)), 12, rng) for p in range(parts)]))
    spark.createDataFrame([(model.centres.ravel().tolist(), len(centres), model.books.ravel().tolist(), parts, model.books.shape[1])], "centres array<double>, lists int, books array<double>, parts int, codes int").coalesce(1).write.parquet(f"{path}/model")

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _vectors(batch.column(1))
                own = model.lists_of(x)
                code = model.codes_of(x - model.centres[own])
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own.astype(np.int32)), pa.array([c.tobytes() for c in code], pa.binary())], names=["id", "vector", "list_id", "code"])

    assigned = written(rows.mapInArrow(assign, f"id {dict(rows.dtypes)['id']}, vector array<float>, list_id int, code binary"), "assigned")
    size = assigned.groupBy("list_id").agg(F.ceil(F.count(F.lit(1)) / longest).cast("int").alias("_slices"))  # a row a list
    dealt = assigned.join(F.broadcast(size), "list_id").withColumn("slice", F.pmod(F.xxhash64("id"), F.col("_slices")).cast("int")).drop("_slices")
    dealt.repartition("list_id", "slice").write.partitionBy("list_id", "slice").parquet(f"{path}/lists")


def load_model(spark: SparkSession, path: str) -> Model:
    r = spark.read.parquet(f"{path}/model").first()
    return Model(np.array(r["centres"]).reshape(r["lists"], -1), np.array(r["books"]).reshape(r["parts"], r["codes"], -1))


def stored_lists(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/lists")


def search(spark: SparkSession, path: str, queries: DataFrame, k: int, *, probes: int, rerank: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, id, score): the k most similar stored vectors of each query, itself excepted, by cosine, ties by id.

    Each query scores the codes of its `probes` nearest lists and the vectors of the `rerank` best of
    those. Null queries have no neighbours.
    """
    model = load_model(spark, path)
    asked = queries.where(F.col(vector_col).isNotNull()).select(F.col(id_col).alias("query_id"), F.col(vector_col).cast("array<float>").alias("q"))
    kind = dict(asked.dtypes)["query_id"]

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                near = np.argsort(-(_vectors(batch.column(1)) @ model.centres.T - (model.centres**2).sum(1) / 2), 1)[:, :probes].astype(np.int32)
                at = pa.array(np.repeat(np.arange(batch.num_rows), near.shape[1]))
                yield pa.RecordBatch.from_arrays([*(c.take(at) for c in batch.columns), pa.array(near.ravel())], names=["query_id", "q", "list_id"])

    probed = written(asked.mapInArrow(pick, f"query_id {kind}, q array<float>, list_id int"), "probed")
    slices = stored_lists(spark, path).select("list_id", "slice").distinct()
    blocks = max(1, -(-asked.count() // QUERIES))
    probed = written(join_checked(probed, slices, "list_id", "inner").withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")), "probed")
    some = F.broadcast(probed.select("list_id").distinct())  # a row a list
    codes = stored_lists(spark, path).select("list_id", "slice", "id", "code").join(some, "list_id", "left_semi").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def scored(_: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["query_id", "list_id", "slice", "id", "near"]
        if not left.num_rows or not right.num_rows:
            return pa.table([pa.array([], left["query_id"].type), pa.array([], pa.int32()), pa.array([], pa.int32()), pa.array([], right["id"].type), pa.array([], pa.float64())], names=names)
        own = left["list_id"][0].as_py()
        code = np.frombuffer(b"".join(right["code"].to_pylist()), np.uint8).reshape(right.num_rows, -1)
        q = _vectors(left["q"].combine_chunks())
        who, what, near = [], [], []
        for at in range(0, len(q), 256):
            x = q[at : at + 256]
            cut = x.reshape(len(x), len(model.books), -1)
            s = np.repeat((x @ model.centres[own])[:, None], len(code), 1)
            for p, book in enumerate(model.books):
                s += (cut[:, p] @ book.T)[:, code[:, p]]
            n = min(rerank + 1, len(code))
            best = np.argpartition(-s, n - 1, 1)[:, :n]
            who.append(np.repeat(np.arange(at, at + len(x)), n))
            what.append(best.ravel())
            near.append(np.take_along_axis(s, best, 1).ravel())
        who, what = pa.array(np.concatenate(who)), pa.array(np.concatenate(what))
        return pa.table([left["query_id"].take(who), left["list_id"].take(who), left["slice"].take(who), right["id"].take(what), pa.array(np.concatenate(near))], names=names)

    keys = ["list_id", "slice", "block"]
    found = probed.groupBy(*keys).cogroup(codes.groupBy(*keys)).applyInArrow(scored, f"query_id {kind}, list_id int, slice int, id {dict(codes.dtypes)['id']}, near double")
    order = Window.partitionBy("query_id").orderBy(F.desc("near"), "id")
    best = found.where("id <> query_id").withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= rerank).select("query_id", "list_id", "slice", "id")
    met = best.join(stored_lists(spark, path).select("list_id", "slice", "id", "vector"), ["list_id", "slice", "id"]).join(asked, "query_id")
    exact = met.select("query_id", "id", cosine(F.col("vector"), F.col("q")).alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return exact.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= k).drop("_k")
