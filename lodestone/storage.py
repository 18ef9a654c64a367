"""Shared storage for intermediate tables, and joins that broadcast only what has been counted."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only if it is counted and has no more rows than this.
BROADCAST_ROWS = 200_000


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; in local mode without it, a temporary folder becomes the checkpoint folder."""
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    current = sc._jsc.sc().getCheckpointDir()
    if path or current.isDefined():
        if not current.isDefined():
            sc.setCheckpointDir(path)
        return (path or current.get()).rstrip("/")
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="lodestone-"))
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/lodestone-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as Parquet in the shared folder, read back: cuts the lineage and survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def join_checked(left: DataFrame, right: DataFrame, on, how: str, most: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcasts right if it has at most `most` rows, else shuffles. right should be cheap to count."""
    return left.join(F.broadcast(right) if right.limit(most + 1).count() <= most else right, on, how)


def arrow_rows(spark: SparkSession, rows: int) -> None:
    """At most so many rows in a batch that goes to Python, for the session: a worker holds few long texts or files at a time."""
    now = int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))
    if now <= 0 or now > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def exists(spark: SparkSession, path: str) -> bool:
    return _fs(spark, path).exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path))


def listed(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if there is no such folder."""
    return sorted(s.getPath().getName() for s in _fs(spark, path).listStatus(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path))) if exists(spark, path) else []


def _fs(spark: SparkSession, path: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
