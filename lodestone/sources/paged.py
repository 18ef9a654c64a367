"""A record service that answers in pages, as a Spark data source for batches and streams.

A service holds groups (courts, say) of numbered pages. The reader takes Spark's filters: groups that cannot match are
not asked, dates cut the range of pages by bisection, and the other filters drop records before they leave the task.
A partition is a range of pages of one group, so a group of any size is read by many tasks.
"""

from __future__ import annotations

import json
import re
import time
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import date
from operator import ge, gt, le, lt
from typing import Any
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual
from pyspark.sql.types import DateType, StructType
from pyspark.sql.window import Window

from lodestone.storage import exists, join_checked, written

#: Tasks of a read, about: where there are more ranges of pages, a task reads several, each as if it were alone.
TASKS = 2_000
CASES = "court string, case_number string, filing_date date, case_type string, county string, summary string, error string"
_COMPARED = {GreaterThan: gt, GreaterThanOrEqual: ge, LessThan: lt, LessThanOrEqual: le}


class LandedPages:
    """Pages as `land` writes them: path/<by>=<group>/page=<number>/*.json. The folder is one that all executors reach."""

    def __init__(self, path: str, by: str) -> None:
        from pyarrow.fs import FileSystem

        self.fs, self.root = FileSystem.from_uri(re.sub("^file:/+", "/", path))
        self.by = by

    def _names(self, path: str, prefix: str) -> list[str]:
        from pyarrow.fs import FileSelector

        return [i.base_name[len(prefix) :] for i in self.fs.get_file_info(FileSelector(path)) if i.base_name.startswith(prefix)]

    def groups(self) -> list[str | None]:
        return [None if n == "__HIVE_DEFAULT_PARTITION__" else unquote(n) for n in sorted(self._names(self.root, f"{self.by}="))]

    def _folder(self, group: str | None) -> str:
        for name in self._names(self.root, f"{self.by}="):
            if group == (None if name == "__HIVE_DEFAULT_PARTITION__" else unquote(name)):
                return f"{self.root}/{self.by}={name}"
        raise LookupError(f"no pages of {group}")

    def pages(self, group: str | None) -> int:
        """The number of pages of a group; they are numbered from 0 without gaps."""
        return len(self._names(self._folder(group), "page="))

    def page(self, group: str | None, number: int) -> list[dict[str, Any]]:
        folder, out = f"{self._folder(group)}/page={number}", []
        for name in sorted(self._names(folder, "part-")):
            with self.fs.open_input_stream(f"{folder}/part-{name}") as f:
                out += [json.loads(line) for line in f.read().splitlines() if line]
        return out


def land(rows: DataFrame, path: str, by: str, order: list[str], page_size: int = 1000) -> None:
    """Writes rows as pages of their group, in ascending order; later calls add pages behind those that are there.

    Rows are numbered within ranges of the order and by the ranges before them, so no task holds a whole group. Null
    groups are a group of their own. One writer at a time; a call that dies leaves pages that the next call follows.
    """
    spark = rows.sparkSession
    cut = rows.repartitionByRange(by, *order).withColumn("_part", F.spark_partition_id())
    cut = written(cut, "ranges")
    before = cut.groupBy(by, "_part").count()
    before = before.withColumn("_before", F.coalesce(F.sum("count").over(Window.partitionBy(by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    before = before.select(F.col(by).alias("_by"), F.col("_part").alias("_p"), "_before")  # a row for each range and group
    place = F.row_number().over(Window.partitionBy(by, "_part").orderBy(*order, F.to_json(F.struct(*rows.columns)))) - 1  # equal keys: the same places in a task that is run again
    numbered = join_checked(cut.withColumn("_place", place), before, F.col(by).eqNullSafe(F.col("_by")) & (F.col("_part") == F.col("_p")), "inner")
    paged = numbered.withColumn("page", ((F.col("_before") + F.col("_place")) / page_size).cast("long"))
    if exists(spark, path):
        known = LandedPages(path, by)
        there = spark.createDataFrame([(g, known.pages(g)) for g in known.groups()], f"_g {rows.schema[by].dataType.simpleString()}, _pages long")
        paged = join_checked(paged, there, F.col(by).eqNullSafe(F.col("_g")), "left").withColumn("page", F.col("page") + F.coalesce("_pages", F.lit(0)))
    # a number of parts, so that none is merged for its bytes: each page is a file to open and close
    paged = paged.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), by, "page").sortWithinPartitions(by, "page", *order)
    # tasks put their pages in place themselves; else the driver would, one after the other
    paged.select(*rows.columns, "page").write.mode("append").option("mapreduce.fileoutputcommitter.algorithm.version", "2").partitionBy(by, "page").json(path)


@dataclass
class PageRange(InputPartition):
    group: str | None
    start: int
    end: int
    error: str | None = None


class _Pages:
    """What the batch and the stream reader share."""

    def __init__(self, source: PagedRecords, schema: StructType) -> None:
        o = source.options
        self.source, self.schema, self.by = source, schema, o.get("by", "court")
        self.pages_each, self.tries, self.pause = int(o.get("pagesPerPartition", 16)), int(o.get("tries", 3)), float(o.get("pause", 0.5))
        self.date = o.get("orderedBy")
        self.skip = o.get("failures", "fail") == "skip"
        if self.skip and "error" not in schema.names:
            raise ValueError("failures=skip needs a column named error in the schema")
        self.kept: list[tuple[type, str, Any]] = []

    def _asked(self, call, *args):
        """The service's answer, asked for again after a pause."""
        for turn in range(self.tries):
            try:
                return call(*args)
            except Exception:
                if turn + 1 == self.tries:
                    raise
                time.sleep(self.pause * 2**turn)

    def _rows(self, part: PageRange, service) -> Iterator[tuple]:
        dates = {f.name for f in self.schema.fields if isinstance(f.dataType, DateType)}
        for number in range(part.start, part.end):
            for record in self._asked(service.page, part.group, number):
                row = {n: record.get(n) for n in self.schema.names} | {self.by: part.group}
                for n in dates:
                    row[n] = _day(row[n])
                if all(_holds(kind, row[n], value) for kind, n, value in self.kept):
                    yield tuple(row[n] for n in self.schema.names)

    def _failed(self, group: str | None, error: str) -> tuple:
        return tuple({self.by: group, "error": error}.get(n) for n in self.schema.names)

    def read(self, partition: PageRange) -> Iterator[tuple]:
        if partition.error is not None:
            yield self._failed(partition.group, partition.error)
            return
        for k in range(partition.start, partition.end, self.pages_each):
            try:
                yield from self._rows(PageRange(partition.group, k, min(k + self.pages_each, partition.end)), self.source.service())
            except Exception as e:
                if not self.skip:
                    raise
                yield self._failed(partition.group, f"{type(e).__name__}: {e}")

    def _cut(self, ranges: list[tuple[str | None, int, int]]) -> list[PageRange]:
        """Partitions of pagesPerPartition pages, or of a multiple if there were more than TASKS."""
        n = sum(-(-max(end - start, 0) // self.pages_each) for _, start, end in ranges)
        size = self.pages_each * max(1, -(-n // TASKS))
        return [PageRange(g, k, min(k + size, end)) for g, start, end in ranges for k in range(start, end, size)]


class _Reader(_Pages, DataSourceReader):
    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Keeps comparisons of single columns with values; the others are Spark's."""
        for f in filters:
            kind = type(f)
            if kind in (EqualTo, In, IsNotNull, *_COMPARED) and len(f.attribute) == 1 and f.attribute[0] in self.schema.names and f.attribute[0] != "error":
                self.kept.append((kind, f.attribute[0], getattr(f, "value", None)))
            else:
                yield f

    def _edge(self, service, group: str | None, pages: int, before) -> int:
        """The first page whose first record does not lie before the bound."""
        low, high = 0, pages
        while low < high:
            middle = (low + high) // 2
            records = self._asked(service.page, group, middle)
            if before(_day(records[0].get(self.date)) or date.min):
                low = middle + 1
            else:
                high = middle
        return low

    def _range(self, service, group: str | None) -> tuple[int, int]:
        start, end = 0, self._asked(service.pages, group)
        if self.date is None:
            return start, end
        for kind, name, value in self.kept:
            if name != self.date or not isinstance(value, date):
                continue
            if kind in (GreaterThan, GreaterThanOrEqual, EqualTo):  # the page before may still hold the bound
                start = max(start, self._edge(service, group, end, lambda d, v=value, k=kind: d <= v if k is GreaterThan else d < v) - 1)
            if kind in (LessThan, LessThanOrEqual, EqualTo):
                end = min(end, self._edge(service, group, end, lambda d, v=value, k=kind: d < v if k is LessThan else d <= v))
        return start, end

    def partitions(self) -> list[PageRange]:
        service, out, ranges = self.source.service(), [], []
        for group in self._asked(service.groups):
            if not all(_holds(kind, group, value) for kind, n, value in self.kept if n == self.by):
                continue
            try:
                start, end = self._range(service, group)
            except Exception as e:
                if not self.skip:
                    raise
                out.append(PageRange(group, 0, 0, f"{type(e).__name__}: {e}"))
                continue
            ranges.append((group, start, end))
        out += self._cut(ranges)
        return out or [PageRange(None, 0, 0)]


class _StreamReader(_Pages, DataSourceStreamReader):
    """Offsets are numbers of pages by group, so a batch that is repeated reads the same pages."""

    def initialOffset(self) -> dict:
        return {"pages": []}

    def latestOffset(self) -> dict:
        service = self.source.service()
        return {"pages": [[g, self._asked(service.pages, g)] for g in self._asked(service.groups)]}

    def partitions(self, start: dict, end: dict) -> list[PageRange]:
        done = {g: n for g, n in start["pages"]}
        return self._cut([(g, done.get(g, 0), n) for g, n in end["pages"]])

    def commit(self, end: dict) -> None:
        pass


class PagedRecords(DataSource):
    """spark.read.format("paged_records") and spark.readStream; a subclass may give another service and name.

    Options: path, by (column of the group, court), orderedBy (a date column by which the pages of each group ascend,
    nulls first; only then do dates cut the range of pages), pagesPerPartition (16), tries (3), pause (seconds before
    the second try, 0.5, doubled each time), failures (fail, or skip: a range of pages that cannot be read ends in a
    row with the group and `error`; Spark's own filters may drop such rows, those that the source takes do not).
    """

    @classmethod
    def name(cls) -> str:
        return "paged_records"

    def schema(self) -> str:
        return CASES

    def service(self):
        """Has groups(), pages(group) and page(group, number)."""
        return LandedPages(self.options["path"], self.options.get("by", "court"))

    def reader(self, schema: StructType) -> _Reader:
        return _Reader(self, schema)

    def streamReader(self, schema: StructType) -> _StreamReader:
        return _StreamReader(self, schema)


def register(spark: SparkSession, source: type[PagedRecords] = PagedRecords) -> str:
    """Makes the source known to the session, with filters pushed; returns its name."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(source)
    return source.name()


def answered(rows: DataFrame, by: str = "court") -> tuple[DataFrame, DataFrame]:
    """(rows of the groups that were read in full, (group, error) of the others). Null groups count as one.

    rows should be written first: both parts read them.
    """
    failed = rows.where("error is not null").groupBy(by).agg(F.min("error").alias("error"))
    bad = failed.select(F.col(by).alias("_bad"))
    return join_checked(rows, bad, F.col(by).eqNullSafe(F.col("_bad")), "left_anti").drop("error"), failed


def _day(value: Any) -> date | None:
    """An ISO date, or the date of an ISO time; null if it cannot be read."""
    try:
        return value if value is None or isinstance(value, date) else date.fromisoformat(str(value)[:10])
    except ValueError:
        return None


def _holds(kind: type, found: Any, value: Any) -> bool:
    """As in SQL: a null matches nothing."""
    if found is None:
        return False
    if kind is IsNotNull:
        return True
    if kind is EqualTo:
        return found == value
    return found in value if kind is In else _COMPARED[kind](found, value)
