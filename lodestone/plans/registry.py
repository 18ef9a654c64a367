"""The register of queries: each is a function (spark, sf_dir) with, where SQL can express it, its SQL."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import date

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Registers the decorated function under its name."""

    def add(f):
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            SQL[key] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def literal(x) -> str:
    """x as SQL."""
    if x is None:
        return "NULL"
    if isinstance(x, str):
        return "'" + x.replace("'", "''") + "'"
    if isinstance(x, date):
        return f"DATE '{x}'"
    if isinstance(x, list | tuple):
        return "[" + ", ".join(map(literal, x)) + "]"
    return str(x).lower() if isinstance(x, bool) else str(x)


def values(rows: Sequence[tuple], columns: str) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in rows) + f") AS v({columns})"
