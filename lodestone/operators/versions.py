"""Versions, deduplication and upserts over plain Parquet tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import version_id
from lodestone.operators.ordering import with_next_in_group


def with_hash(rows: DataFrame, *, source: str = "source_id", content: str = "content") -> DataFrame:
    return rows.withColumn("content_hash", F.sha2(F.col(content).cast("binary"), 256)).withColumn("version_id", version_id(source, content))


def new_versions(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Rows whose version is not known yet; a content seen before stays unchanged."""
    return with_hash(rows).dropDuplicates(["version_id"]).join(known.select("version_id"), "version_id", "left_anti")


def version_log(versions: DataFrame) -> DataFrame:
    """is_current and superseded_by from the order of ingestion: the newest version of a source is current. A source may have any number of versions."""
    log = with_next_in_group(versions, "source_id", ["ingested_at", "version_id"], "version_id", "superseded_by")
    return log.withColumn("is_current", F.col("superseded_by").isNull())


def content_dedup(rows: DataFrame, *, source: str = "source_id", content: str = "content") -> DataFrame:
    """(source_id, content_hash): distinct contents per source."""
    return rows.select(source, F.sha2(F.col(content).cast("binary"), 256).alias("content_hash")).distinct()


def stale_sources(versions: DataFrame, chunks: DataFrame, reference: Column, days: int) -> DataFrame:
    """Sources whose current version is older than `days` and that still have chunks (a semi join)."""
    old = versions.where(F.col("is_current") & (F.col("ingested_at") < reference - F.make_interval(days=F.lit(days))))
    return old.join(chunks, "source_id", "left_semi").select("source_id").distinct()


def upsert_latest(current: DataFrame, incoming: DataFrame, key: str, order: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Latest row per key wins; the columns in keep stay as first seen. One shuffle on the key."""
    every = current.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1)))
    rank = F.struct("_new", F.col(order))
    cols = [c for c in current.columns if c != key]
    return every.groupBy(key).agg(*[(F.min_by(c, rank) if c in keep else F.max_by(c, rank)).alias(c) for c in cols]).select(*current.columns)


def replace_by_source(current: DataFrame, incoming: DataFrame, key: str = "source_id") -> DataFrame:
    """All rows of the incoming sources replace the old rows of those sources."""
    return current.join(incoming.select(key).distinct(), key, "left_anti").unionByName(incoming)


def delete_source(chunks: DataFrame, sources: DataFrame, key: str = "source_id") -> tuple[DataFrame, DataFrame]:
    """(what stays, deleted rows per source)."""
    return chunks.join(sources, key, "left_anti"), chunks.join(sources, key, "left_semi").groupBy(key).agg(F.count(F.lit(1)).alias("deleted"))
