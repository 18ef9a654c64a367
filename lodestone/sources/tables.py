"""Stored tables that are changed in place: keyed rows in buckets of Parquet files, one manifest a version.

A change finds, by key and digest alone, which rows are new or different, and rewrites only the
buckets that hold them, into folders of its own; a manifest then names the folder of every bucket.
The manifest is the commit: it counts once Spark's committer has marked it, so a run that dies before
that leaves the table as it was, and what it wrote is never read. A change that changes nothing makes
no version. One writer at a time.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lodestone.storage import exists, listed, written

_MANIFEST = "bucket int, folder string, n_rows long"


@dataclass
class StoredTable:
    """A table under path. key: its unique column; by: the column that rows are dealt to buckets by (the key unless given).

    keep: columns that a row keeps as first stored. Rows with a null key are refused.
    """

    spark: SparkSession
    path: str
    schema: str
    key: str
    by: str | None = None
    keep: Sequence[str] = ()
    buckets: int = 64
    columns: list[str] = field(init=False)

    def __post_init__(self) -> None:
        self.by = self.by or self.key
        self.columns = StructType.fromDDL(self.schema).fieldNames()

    def version(self) -> int:
        """The number of the last committed change; 0 for a table that has none."""
        done = [int(v) for v in listed(self.spark, f"{self.path}/manifest") if exists(self.spark, f"{self.path}/manifest/{v}/_SUCCESS")]
        return max(done, default=0)

    def manifest(self, version: int | None = None) -> dict[int, tuple[str, int]]:
        """bucket -> (folder, rows): a row for each bucket."""
        v = self.version() if version is None else version
        return {r["bucket"]: (r["folder"], r["n_rows"]) for r in self.spark.read.schema(_MANIFEST).parquet(f"{self.path}/manifest/{v:08d}").collect()} if v else {}

    def read(self, version: int | None = None, buckets: Sequence[int] | None = None) -> DataFrame:
        """The rows as of a version (the last unless given), or those of some buckets: other buckets' files are not opened."""
        return self._stored(self.manifest(version), buckets).select(*self.columns)

    def _stored(self, manifest: dict[int, tuple[str, int]], buckets: Sequence[int] | None = None) -> DataFrame:
        paths = [f"{self.path}/{folder}" for b, (folder, n) in manifest.items() if n and (buckets is None or b in set(buckets))]
        schema = StructType.fromDDL(self.schema).add("_digest", "string")
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def bucket(self) -> Column:
        """The bucket of a row."""
        return F.pmod(F.xxhash64(self.by), F.lit(self.buckets)).cast("int")

    def _digest(self) -> Column:
        told = [c for c in self.columns if c != self.key and c not in self.keep]
        return F.sha2(F.to_json(F.struct(*told), {"ignoreNullFields": "false"}), 256)

    def merge(self, rows: DataFrame, order: str | None = None) -> int:
        """Inserts rows whose key is new and updates the others; of equal keys in rows the last by `order` counts. Returns the version."""
        rows = rows.select(*self.columns)
        if order is not None:
            rest = [c for c in self.columns if c != self.key]
            rows = rows.groupBy(self.key).agg(F.max_by(F.struct(*rest), F.struct(order, self._digest())).alias("_r")).select(self.key, "_r.*").select(*self.columns)
        rows = written(rows.withColumns({"_digest": self._digest(), "_bucket": self.bucket(), "_key": F.when(F.col(self.key).isNotNull(), True)}), "incoming")
        if rows.where("_key is null").limit(1).count():
            raise ValueError(f"a row has no {self.key}")
        version, manifest = self.version(), self.manifest()
        near = [r[0] for r in rows.select("_bucket").distinct().collect()]  # at most one row a bucket
        known = self._stored(manifest, near).select(self.key, F.col("_digest").alias("_old"), *[F.col(c).alias(f"_kept_{c}") for c in self.keep])
        met = rows.drop("_key").join(known, self.key, "left")
        changed = met.where(~F.col("_old").eqNullSafe(F.col("_digest")))
        kept = {c: F.when(F.col("_old").isNull(), F.col(c)).otherwise(F.col(f"_kept_{c}")) for c in self.keep}
        changed = written(changed.withColumns(kept).select(*self.columns, "_digest", "_bucket"), "changed")
        touched = [r[0] for r in changed.select("_bucket").distinct().collect()]
        if not touched:
            return version
        rest = self._stored(manifest, touched).join(changed.select(self.key), self.key, "left_anti")
        return self._commit(rest.withColumn("_bucket", self.bucket()).unionByName(changed), touched, version, manifest)

    def replace(self, rows: DataFrame) -> int:
        """All rows of the `by` values in rows are replaced by rows, in one change. Returns the version."""
        rows = written(rows.select(*self.columns).dropDuplicates([self.key]).withColumns({"_digest": self._digest(), "_bucket": self.bucket()}), "incoming")
        version, manifest = self.version(), self.manifest()
        near = [r[0] for r in rows.select("_bucket").distinct().collect()]
        values = rows.select(self.by).distinct()
        old = self._stored(manifest, near).join(values, self.by, "left_semi").select(self.key, F.col("_digest").alias("_old"), self.bucket().alias("_at"))
        both = rows.select(self.key, "_digest", "_bucket").join(old, self.key, "full").where(~F.col("_old").eqNullSafe(F.col("_digest")))
        touched = [r[0] for r in both.select(F.coalesce("_bucket", "_at")).distinct().collect()]
        if not touched:
            return version
        rest = self._stored(manifest, touched).join(values, self.by, "left_anti").withColumn("_bucket", self.bucket())
        return self._commit(rest.unionByName(rows.where(F.col("_bucket").isin(touched))), touched, version, manifest)

    def delete(self, values: DataFrame, column: str | None = None) -> int:
        """Deletes the rows whose `column` (the bucketing one unless given) is among values; only buckets that hold such rows are rewritten. Returns how many."""
        column = column or self.by
        values = written(values.select(column).distinct(), "deleted")
        version, manifest = self.version(), self.manifest()
        near = [r[0] for r in values.select(self.bucket()).distinct().collect()] if column == self.by else None
        found = self._stored(manifest, near)
        gone = {r["_b"]: r["n"] for r in found.join(values, column, "left_semi").groupBy(self.bucket().alias("_b")).agg(F.count(F.lit(1)).alias("n")).collect()}
        if gone:
            rest = self._stored(manifest, list(gone)).join(values, column, "left_anti")
            self._commit(rest.withColumn("_bucket", self.bucket()), list(gone), version, manifest)
        return sum(gone.values())

    def _commit(self, rows: DataFrame, touched: Sequence[int], version: int, manifest: dict[int, tuple[str, int]]) -> int:
        new = f"data/{version + 1:08d}-{uuid.uuid4().hex[:8]}"  # what a run that died has left is never written over
        # a bucket's rows go to several tasks, so that a large one is not written by one
        dealt = rows.repartition("_bucket", F.pmod(F.xxhash64(self.key), F.lit(4))).sortWithinPartitions("_bucket", self.key)
        dealt.write.partitionBy("_bucket").parquet(f"{self.path}/{new}")
        counted = self.spark.read.parquet(f"{self.path}/{new}").groupBy("_bucket").count().collect() if any(x.startswith("_bucket") for x in listed(self.spark, f"{self.path}/{new}")) else []
        now = manifest | {b: ("", 0) for b in touched} | {r["_bucket"]: (f"{new}/_bucket={r['_bucket']}", r["count"]) for r in counted}
        self._publish(version + 1, now)
        return version + 1

    def _publish(self, version: int, manifest: dict[int, tuple[str, int]]) -> None:
        rows = [(b, folder, n) for b, (folder, n) in sorted(manifest.items())]
        self.spark.createDataFrame(rows, _MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/{version:08d}")


CHUNKS = "chunk_id string, source_id string, section string, content string"
VERSIONS = "version_id string, source_id string, content_hash string, ingested_at timestamp, effective_date date, is_current boolean"


def version_table(spark: SparkSession, path: str, buckets: int = 64) -> StoredTable:
    return StoredTable(spark, path, VERSIONS, key="version_id", by="source_id", buckets=buckets)


def chunk_table(spark: SparkSession, path: str, buckets: int = 64) -> StoredTable:
    return StoredTable(spark, path, CHUNKS, key="chunk_id", by="source_id", buckets=buckets)


def record_versions(table: StoredTable, rows: DataFrame) -> DataFrame:
    """Stores the versions of rows (source_id, content, ingested_at and, if there, effective_date) and returns those that are new.

    A content that its source has had before stays as it is. New versions supersede the source's
    current one; of several in one batch the newest is current. Only the sources' buckets are read.
    """
    from lodestone.operators.versions import with_hash

    dated = F.col("effective_date").cast("date") if "effective_date" in rows.columns else F.lit(None).cast("date")
    given = with_hash(rows).withColumn("effective_date", dated).select("version_id", "source_id", "content_hash", "ingested_at", "effective_date")
    given = given.groupBy("version_id", "source_id", "content_hash").agg(F.min("ingested_at").alias("ingested_at"), F.min_by("effective_date", "ingested_at").alias("effective_date"))
    given = written(given.withColumn("_bucket", table.bucket()), "versions")
    near = [r[0] for r in given.select("_bucket").distinct().collect()]
    stored = table.read(buckets=near)
    fresh = written(given.drop("_bucket").join(stored.select("version_id"), "version_id", "left_anti"), "fresh")
    newest = fresh.groupBy("source_id").agg(F.max_by("version_id", F.struct("ingested_at", "version_id")).alias("_newest"))
    old = stored.where("is_current").join(newest.select("source_id"), "source_id", "left_semi").withColumn("is_current", F.lit(False))
    new = fresh.join(newest, "source_id").withColumn("is_current", F.col("version_id") == F.col("_newest")).drop("_newest")
    table.merge(old.unionByName(new))
    return fresh
