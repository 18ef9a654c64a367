"""Ingestion as a stream of messages: hash first, parse only what is new, replace by source.

At-least-once: a batch is committed after its tables are written, and a repeated batch finds its
versions known and changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestone.operators.chunking import chunk_documents
from lodestone.operators.versions import new_versions, with_hash
from lodestone.sources.sinks import MESSAGE
from lodestone.sources.tables import StoredTable, record_versions
from lodestone.storage import written


def message_stream(spark: SparkSession, path: str, *, files_per_batch: int = 10) -> DataFrame:
    """Messages from JSON lines under path: a bounded number of files a batch is the back-pressure."""
    lines = spark.readStream.format("text").option("maxFilesPerTrigger", files_per_batch).load(path)
    return lines.select("value", F.from_json("value", MESSAGE).alias("m")).select("value", "m.*")


def split_poison(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good, poison): unreadable messages and those without a source go to the dead letters."""
    good = F.col("source_id").isNotNull() & F.col("source_type").isNotNull()
    return messages.where(good), messages.where(~good).select("value")


def run_ingest(docs: DataFrame, versions_path: str, chunks_path: str, checkpoint: str, *, available_now: bool = True) -> StreamingQuery:
    """Streams docs into version and chunk tables. Versions are appended; chunks carry their version,
    so the current chunks are those of current versions (see current_chunks)."""
    spark = docs.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        if _exists(spark, versions_path):
            known = spark.read.parquet(versions_path)
        else:
            known = spark.createDataFrame([], "version_id string, source_id string, content_hash string, ingested_at timestamp")
        fresh = new_versions(batch, known).persist()
        chunks = chunk_documents(fresh.select("version_id", "content"), id_col="version_id", text_col="content")
        chunks.withColumnRenamed("source_id", "version_id").write.mode("append").parquet(chunks_path)
        fresh.select("version_id", "source_id", "content_hash", "ingested_at").write.mode("append").parquet(versions_path)
        fresh.unpersist()

    q = docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (q.trigger(availableNow=True) if available_now else q).start()


def run_stored_ingest(docs: DataFrame, versions: StoredTable, chunks: StoredTable, checkpoint: str, *, available_now: bool = True) -> StreamingQuery:
    """Streams docs (source_id, content, ingested_at) into stored tables: only the buckets of a batch's sources are read and rewritten.

    Chunks are replaced by source before the versions are recorded, so a batch that is run again after a
    crash between the two ends in the same tables, and one that is merely repeated changes nothing. Of
    several contents of a source in a batch the newest is chunked.
    """

    def write(batch: DataFrame, number: int) -> None:
        given = written(with_hash(batch), "batch")
        seen = versions.read(buckets=[r[0] for r in given.select(versions.bucket()).distinct().collect()])
        new = given.join(seen.select("version_id"), "version_id", "left_anti")
        # a content counts from when it was first seen, as its version does
        new = new.groupBy("version_id", "source_id").agg(F.min("ingested_at").alias("ingested_at"), F.first("content").alias("content"))
        order = F.struct("ingested_at", "version_id")
        newest = new.groupBy("source_id").agg(F.max_by("content", order).alias("content"))
        made = chunk_documents(newest, id_col="source_id", text_col="content")
        chunks.replace(made.select("chunk_id", "source_id", "section", "content"))
        record_versions(versions, batch)

    q = docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (q.trigger(availableNow=True) if available_now else q).start()


def current_chunks(chunks: DataFrame, log: DataFrame) -> DataFrame:
    """Chunks of current versions, once each though a repeated batch may have written them twice."""
    return chunks.join(log.where("is_current").select("version_id", F.col("source_id")), "version_id").dropDuplicates(["chunk_id"])


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def with_retries(rows: DataFrame, handle: Callable[[DataFrame], DataFrame], most: int = 3) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(done, again, dead): handle adds an `error` column; failed rows are retried `most` times in all."""
    tried = handle(rows.withColumn("attempts", F.coalesce("attempts", F.lit(0)) + 1))
    failed = F.col("error").isNotNull()
    return tried.where(~failed), tried.where(failed & (F.col("attempts") < most)), tried.where(failed & (F.col("attempts") >= most))
