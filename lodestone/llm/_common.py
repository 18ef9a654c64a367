"""Small shared helpers: shared storage, checked broadcasts, hot-group joins, components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only if it is counted and has no more rows than this.
BROADCAST_ROWS = 200_000
#: The same for a side of nothing but long ids (about 24 bytes a row when hashed).
BROADCAST_IDS = 2_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Where it is unset (local tests) a temporary folder becomes the checkpoint folder.
    """
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get().rstrip("/")
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="lodestone-"))
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/lodestone-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it back: cuts the lineage."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def arrow_rows(spark: SparkSession, rows: int) -> None:
    """Rows per Arrow batch, so that a Python worker holds few long texts at a time."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def text_slices(texts: pa.Array, most: int, least: int = 1) -> Iterator[tuple[int, list[str | None]]]:
    """(number of the first, texts) of runs of a batch's texts, of about `most` characters; a text counts as `least` at least."""
    at, run, n = 0, [], 0
    for i, x in enumerate(texts):
        run.append(x.as_py())
        n += max(len(run[-1] or ""), least)
        if n >= most:
            yield at, run
            at, run, n = i + 1, [], 0
    if run:
        yield at, run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def join_checked(left: DataFrame, right: DataFrame, on, how: str, most: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcasts right if it has at most `most` rows, else shuffles. right should be cheap to count."""
    return left.join(F.broadcast(right) if right.limit(most + 1).count() <= most else right, on, how)


def join_groups(rows: DataFrame, groups: DataFrame, same: Column | str, size: str = "_n", hot: int = BROADCAST_ROWS) -> DataFrame:
    """Inner join of rows with groups, which has one row a group and the number of its rows in `size`; groups should be a written table.

    Groups of more than `hot` rows (one for every `hot` rows at most) are broadcast, so that no task gets all rows of
    one; the others are broadcast if they are few and meet in a shuffled join if not.
    """
    large, small = F.broadcast(groups.where(F.col(size) > hot)), groups.where(F.col(size) <= hot)
    most = rows.join(large, same)
    return most.unionByName(join_checked(rows.join(large, same, "left_anti"), small, same, "inner"))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value evaluated once however often use names it."""
    return F.element_at(F.transform(F.array(value), lambda x: use(x)), 1)


def parts_of(text: Column, spans: Column, block: int = 256) -> Column:
    """array<string>: the parts of the text at spans (structs with start and end in code points).

    A substring is looked for from the text's beginning; here the text is cut into blocks once, so
    that many spans of a long text cost no more than the text and what they hold.
    """

    def part(blocks: Column, s: Column) -> Column:
        at, end = s["start"].cast("int"), s["end"].cast("int")
        first = F.floor(at / block).cast("int")
        near = F.array_join(F.slice(blocks, first + 1, F.floor((end - 1) / block).cast("int") - first + 1), "")
        return F.when(end > at, F.substring(near, at % block + 1, end - at)).otherwise(F.lit(""))

    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{block}}}"), F.lit(0))
    return let(blocks, lambda b: F.transform(spans, lambda s: part(b, s)))


def _fold(values: Column, join: Callable[[Column, Column], Column]) -> Column:
    """Running values of a short array of longs; each step copies what there is so far."""
    start = F.struct(F.lit(None).cast("long").alias("last"), F.array().cast("array<long>").alias("out"))

    def step(acc: Column, v: Column) -> Column:
        now = F.when(acc["last"].isNull(), v).otherwise(join(acc["last"], v))
        return F.struct(now.alias("last"), F.concat(acc["out"], F.array(now)).alias("out"))

    return F.aggregate(values, start, step, lambda acc: acc["out"])


def scan(values: Column, join: Callable[[Column, Column], Column], block: int = 64, levels: int = 1) -> Column:
    """Running sums (or maxima, ...) of an array of longs, in blocks of blocks: n * block copies where a plain fold makes n * n."""
    if not levels:
        return _fold(values, join)

    def blocks(x: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / block).cast("int")), lambda b: _fold(F.slice(x, b * block + 1, F.lit(block)), join))

    def glued(parts: Column) -> Column:
        before = scan(F.transform(parts, lambda p: F.element_at(p, -1)), join, block, levels - 1)
        return let(before, lambda all_before: F.flatten(F.transform(parts, lambda p, i: F.when(i == 0, p).otherwise(F.transform(p, lambda v: join(F.get(all_before, i - 1), v))))))

    return let(values, lambda x: F.when(F.size(x) == 0, x).when(F.size(x) <= block, _fold(x, join)).otherwise(let(blocks(x), glued)))


def copies_of(rows: DataFrame, key: str, ident: str, pick, hot: int = 200_000) -> DataFrame:
    """(ident, representative) for the rows whose key occurs more than once.

    pick is the aggregate (F.min or F.max) that chooses the representative. The groups are
    pre-aggregated on the map side. Those of more than `hot` rows, a row for every `hot` rows of the
    input at most, are broadcast, so their rows are not shuffled; the others meet in a shuffled join.
    """
    groups = rows.groupBy(key).agg(pick(ident).alias("_rep"), F.count(F.lit(1)).alias("_n"))
    groups = written(groups.where("_n > 1"), "copies")
    large = F.broadcast(groups.where(F.col("_n") > hot).drop("_n"))
    small = groups.where(F.col("_n") <= hot).drop("_n")
    met = rows.join(large, key).unionByName(rows.join(large.select(key), key, "left_anti").join(small, key))
    return met.select(ident, "_rep")


def components(edges: DataFrame, a: str = "a", b: str = "b", most: int = 60) -> DataFrame:
    """(id, label): connected components of an edge list; label is the least id.

    Alternates a hop to the least label among the neighbours with pointer jumping, so the
    rounds grow with the logarithm of a component's diameter. Each round is checkpointed.
    """
    both = edges.select(F.col(a).alias("x"), F.col(b).alias("y"))
    both = checkpointed(both.unionByName(both.select(F.col("y").alias("x"), F.col("x").alias("y"))).where("x <> y").distinct())
    labels = checkpointed(both.groupBy("x").agg(F.min("y").alias("m")).select(F.col("x").alias("id"), F.least("x", "m").alias("label")))
    for _ in range(most):
        hop = both.join(labels, both.y == labels.id).groupBy("x").agg(F.min("label").alias("m"))
        # the old root of a group hears of the smaller label as well, else long chains pass it on one hop at a time
        near = labels.join(hop, labels.id == hop.x).select("id", "label", "m")
        root = near.where("m < label").groupBy("label").agg(F.min("m").alias("r")).select(F.col("label").alias("id"), "r")
        step = near.join(root, "id", "left").select("id", F.col("label").alias("old"), F.least("label", "m", F.coalesce("r", "label")).alias("label"))
        up = step.select(F.col("id").alias("label"), F.col("label").alias("upper"))
        new = checkpointed(step.join(up, "label", "left").select("id", "old", F.least("label", F.coalesce("upper", "label")).alias("label")))
        moved = new.where("old <> label").limit(1).count()
        labels = new.select("id", "label")
        if not moved:
            return labels
    raise RuntimeError("components did not settle")


def vector_matrix(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(row numbers, float64 matrix) of a list column's vectors of `size` components without nulls, NaN and infinities."""
    offsets = column.offsets.to_numpy()
    values = column.values.to_numpy(zero_copy_only=False).astype(np.float64)
    wrong = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
    valid = ~np.asarray(column.is_null())
    lengths = np.diff(offsets)
    rows = np.flatnonzero(valid & (wrong[offsets[1:]] == wrong[offsets[:-1]]) & (lengths == size))
    return rows, values[offsets[rows][:, None] + np.arange(size)]
