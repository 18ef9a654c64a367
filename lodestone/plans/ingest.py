"""The batch side of ingestion: which documents become messages."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.sources import records, sinks

log = logging.getLogger(__name__)


def _messages(cases: DataFrame, documents: DataFrame, dry_run: bool) -> DataFrame:
    found = documents.join(cases.select("case_number"), "case_number", "left_semi")
    return found.agg(F.count(F.lit(1)).alias("n")) if dry_run else sinks.messages(found, "court_case")


def ingest_recent(cases: DataFrame, documents: DataFrame, county: str, today: Column, days: int = 7, *, dry_run: bool = False) -> DataFrame:
    """Messages of the documents of recent cases of a county, or their number."""
    return _messages(records.recent_filings(cases, today, days, county), documents, dry_run)


def ingest_search(cases: DataFrame, documents: DataFrame, text: str, county: str | None = None, case_type: str | None = None, *, dry_run: bool = False) -> DataFrame:
    return _messages(records.search_cases(cases, text=text, county=county, case_type=case_type), documents, dry_run)


def ingest_case(cases: DataFrame, documents: DataFrame, number: str, *, dry_run: bool = False) -> DataFrame:
    return _messages(records.case_by_number(cases, number), documents, dry_run)


def union_of_courts(branches: dict[str, DataFrame | Callable[[], DataFrame]], failed: dict[str, str] | None = None) -> DataFrame | None:
    """The scans of several courts as one table with the court's name; columns that some lack are null.

    A branch may be a function that makes the scan. One that raises is logged, noted in `failed` and
    left out. None if no branch is left.
    """
    out = None
    for court, branch in branches.items():
        try:
            rows = (branch() if callable(branch) else branch).withColumn("court", F.lit(court))
        except Exception as e:  # noqa: BLE001  the other courts go on
            log.warning("court %s is left out: %s", court, e)
            if failed is not None:
                failed[court] = str(e)
            continue
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out


def statute_chunks(sections: DataFrame, titles: list[str] | None = None, room: int = 2000, least: int = 30) -> DataFrame:
    """Statute sections of the given titles as paragraph chunks with their ids; short sections drop out."""
    from lodestone.functions.text import chunk_key
    from lodestone.operators.chunking import paragraph_chunks

    rows = sections if titles is None else sections.where(F.col("title").isin(titles))
    rows = rows.where(F.char_length("text") >= least)
    chunks = paragraph_chunks(rows, room=room, id_col="source_id", text_col="text")
    return chunks.withColumn("chunk_id", chunk_key("source_id", "chunk_no"))
