"""Exact and clustered nearest neighbours by cosine."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.functions.vectors import cosine
from lodestone.storage import written


def knn(vectors: DataFrame, query: Sequence[float], k: int, *, where: Column | None = None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, score): the k most similar vectors. The limit is a TakeOrdered per partition, no full sort."""
    rows = vectors if where is None else vectors.where(where)
    q = F.array(*[F.lit(float(x)) for x in query])
    scored = rows.select(F.col(id_col).alias("id"), cosine(F.col(vector_col), q).alias("score"))
    return scored.where("score is not null").orderBy(F.desc("score"), "id").limit(k)


def knn_batch(vectors: DataFrame, queries: DataFrame, k: int, *, block: int = 4096, tile: int = 65_536, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, id, score): the k most similar vectors of each query, ties by id.

    queries: (id, vector) under the same names; a vector is not its own neighbour. At most `block`
    queries go to the tasks whole, and each task keeps the k best of what it reads: no vector is
    shuffled. More queries meet the vectors in tiles of `tile` by `tile` rows, k rows per query and
    tile are merged, and the driver holds none of them. Null vectors and ids have no neighbours and are none.
    """
    import numpy as np

    rows, asked = _named(vectors, id_col, vector_col), _named(queries, id_col, vector_col)
    held = asked.limit(block + 1).collect()
    if len(held) > block:
        return _top(_in_tiles(rows.withColumn("list_id", F.lit(0)), asked.withColumn("list_id", F.lit(0)), k, block, tile), k)
    ids, q = np.array([r["id"] for r in held], np.int64), _unit(np.array([r["v"] for r in held], float).reshape(len(held), -1 if held else 0))

    def run(batches):
        best = _none()
        for batch in batches:
            if batch.num_rows and len(ids):
                best = _taken_in(best, ids, q, batch.column(0).to_numpy(), _matrix(batch.column(1)), k)
        yield _batch(ids, best)

    return _top(rows.mapInArrow(run, _FOUND), k)


_FOUND = "query_id long, id long, score double"
#: Scores that a task holds at once.
_SCORES = 4_000_000


def _named(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    given = F.col(vector_col).isNotNull() & F.col(id_col).isNotNull()
    return vectors.where(given).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))


def _unit(v):
    import numpy as np

    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)


def _matrix(column):
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _none():
    """No neighbours yet: (numbers of queries, ids, scores)."""
    import numpy as np

    return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)


def _taken_in(best, asked, q, own, v, k: int):
    """The k best of each query among `best` and the vectors (own, v); q are unit vectors of the queries `asked`."""
    import numpy as np

    step = max(k + 1, _SCORES // len(q))
    for at in range(0, len(own), step):
        ids = own[at : at + step]
        s = q @ _unit(v[at : at + step]).T
        s[asked[:, None] == ids[None]] = -np.inf
        edge = np.partition(s, -k, axis=1)[:, [-k]] if len(ids) > k else -np.inf
        r, c = np.nonzero((s >= edge) & (s > -np.inf))  # ties at the edge stay until ids decide
        r, ids, s = np.concatenate([best[0], r]), np.concatenate([best[1], ids[c]]), np.concatenate([best[2], s[r, c]])
        order = np.lexsort((ids, -s, r))
        r, ids, s = r[order], ids[order], s[order]
        near = np.arange(len(r)) - np.searchsorted(r, r) < k
        best = r[near], ids[near], s[near]
    return best


def _batch(asked, best):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array(asked[best[0]]), pa.array(best[1]), pa.array(best[2])], names=["query_id", "id", "score"])


def _in_tiles(rows: DataFrame, asked: DataFrame, k: int, block: int, tile: int) -> DataFrame:
    """(query_id, id, score): the k best of each query in each tile of its lists.

    rows, asked: (id, v, list_id). A list's rows and its queries are dealt by hashes of their ids
    to parts of about `tile`, and each part of rows meets each part of queries in a task of its
    own, so a list of any size is spread. A task scores `block` queries at a time.
    """
    import pyarrow as pa

    def dealt(df: DataFrame, parts: str) -> DataFrame:
        return df.groupBy("list_id").agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias(parts))

    def numbers(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    def part(n: str) -> Column:
        return F.pmod(F.xxhash64("id"), F.col(n)).cast("int")

    sizes = F.broadcast(written(dealt(rows, "row_parts").join(dealt(asked, "query_parts"), "list_id"), "tiles"))  # a row a list
    left = rows.join(sizes, "list_id").select("list_id", part("row_parts").alias("r"), numbers("query_parts").alias("q"), "id", "v")
    right = asked.join(sizes, "list_id").select("list_id", numbers("row_parts").alias("r"), part("query_parts").alias("q"), "id", "v")

    def scored(some: pa.Table, queries: pa.Table) -> pa.Table:
        found = []
        if some.num_rows:
            own, v = some.column("id").to_numpy(), _matrix(some.column("v").combine_chunks())
            for at in range(0, queries.num_rows, block):
                here = queries.slice(at, block)
                ids, q = here.column("id").to_numpy(), _unit(_matrix(here.column("v").combine_chunks()))
                found.append(_batch(ids, _taken_in(_none(), ids, q, own, v, k)))
        return pa.Table.from_batches(found, pa.schema([("query_id", pa.int64()), ("id", pa.int64()), ("score", pa.float64())]))

    keys = ["list_id", "r", "q"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(scored, _FOUND)


def _top(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= k).drop("_k")


def build_ivf(vectors: DataFrame, *, lists: int = 100, seed: int = 7, sample: int = 100_000, id_col: str = "vec_id", vector_col: str = "embedding"):
    """(assigned vectors with `list_id`, centroids). Fitted on a bounded sample; every row is assigned.

    Written with partitionBy('list_id'), a probe reads only its lists' folders. The sample is the
    rows whose id hash falls below the sample's share of all rows, about `sample` of them.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = vectors.where(F.col(vector_col).isNotNull()).withColumn("features", array_to_vector(F.col(vector_col).cast("array<double>")))
    share = int(1_000_000 * min(1.0, sample / max(rows.count(), 1)))
    some = rows.where(F.pmod(F.xxhash64(id_col), F.lit(1_000_000)) < share)
    model = KMeans(k=lists, seed=seed, distanceMeasure="cosine", maxIter=15, predictionCol="list_id").fit(some)
    return model.transform(rows).drop("features"), model.clusterCenters()


def probe_ivf(assigned: DataFrame, centroids, query: Sequence[float], k: int, *, probes: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, score): the k most similar vectors among those of the `probes` nearest lists."""
    import numpy as np

    c, q = np.array(centroids), np.array(query)
    near = np.argsort(-(c @ q) / (np.linalg.norm(c, axis=1) * np.linalg.norm(q) + 1e-12))[:probes]
    return knn(assigned, query, k, where=F.col("list_id").isin([int(i) for i in near]), id_col=id_col, vector_col=vector_col)


def probe_ivf_batch(assigned: DataFrame, centroids, queries: DataFrame, k: int, *, probes: int = 10, block: int = 4096, tile: int = 65_536, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, id, score): as knn_batch, each query against the rows of its `probes` nearest lists only.

    Queries and rows of a list meet in tiles of `tile` by `tile` rows, so a long list is several
    tasks' work; the k best of each query and tile are merged. `assigned` should be a written table.
    """
    import numpy as np

    c = np.array(centroids)
    c = c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-300)

    @F.pandas_udf("array<int>")
    def nearest(v: pd.Series) -> pd.Series:
        q = np.array(v.tolist(), float).reshape(len(v), -1)
        return pd.Series(list(np.argsort(-(q @ c.T), 1)[:, :probes].astype(np.int32)))

    asked = written(_named(queries, id_col, vector_col).withColumn("list_id", F.explode(nearest("v"))), "probes")
    given = F.col(vector_col).isNotNull() & F.col(id_col).isNotNull()
    rows = assigned.where(given).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), F.col("list_id").cast("int"))
    return _top(_in_tiles(rows, asked, k, block, tile), k)


def recall(found: DataFrame, exact: DataFrame, k: int) -> DataFrame:
    """(query_id, recall): the share of each query's k exact neighbours that were found."""
    hit = exact.join(found.select("query_id", "id", F.lit(1).alias("_hit")), ["query_id", "id"], "left")
    return hit.groupBy("query_id").agg((F.count("_hit") / F.least(F.count(F.lit(1)), F.lit(k))).alias("recall"))
