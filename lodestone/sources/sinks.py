"""Sinks: audit records, queue messages, chunk and edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import edge_id
from lodestone.operators.ordering import numbered_in_group
from lodestone.operators.versions import upsert_latest

MESSAGE = "source_type string, source_id string, download_url string, metadata map<string,string>"


def write_audit(runs: DataFrame, path: str, *, agent: str = "agent", at: str = "started_at") -> None:
    """Appends run records as JSON under agent=/dt=."""
    runs.withColumn("dt", F.to_date(at)).write.mode("append").partitionBy(agent, "dt").json(path)


def messages(documents: DataFrame, source_type: str) -> DataFrame:
    """case documents -> (value): one JSON message per document, filing date and parties carried along."""
    meta = F.map_filter(F.create_map(F.lit("case_number"), F.col("case_number"), F.lit("title"), F.col("title"), F.lit("filing_date"), F.col("filed_date").cast("string")), lambda k, v: v.isNotNull())
    return documents.select(F.to_json(F.struct(F.lit(source_type).alias("source_type"), F.col("document_id").alias("source_id"), "download_url", meta.alias("metadata"))).alias("value"))


def in_batches(rows: DataFrame, by: str, order: str, size: int = 10) -> DataFrame:
    """Adds batch_no within each `by` group: queue calls take `size` messages at a time. A queue of any length is numbered in parts."""
    numbered = numbered_in_group(rows, by, [order], "_row")
    return numbered.withColumn("batch_no", F.ceil(F.col("_row") / size)).drop("_row")


def edges_upserted(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """Edges by id; the newest treatment and context (500 characters) win, the date stays as first cited."""
    new = incoming.withColumn("edge_id", edge_id("citing_id", "cited_id")).withColumn("context", F.left("context", F.lit(500)))
    return upsert_latest(current, new.select(*current.columns), "edge_id", "created_at", keep=("date_cited",))


def chunks_upserted(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """Chunks by id; on conflict only content, embedding and metadata change."""
    frozen = tuple(c for c in current.columns if c not in ("chunk_id", "content", "embedding", "metadata", "ingested_at"))
    return upsert_latest(current, incoming.select(*current.columns), "chunk_id", "ingested_at", keep=frozen)
