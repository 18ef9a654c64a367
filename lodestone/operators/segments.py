"""BM25 over a stored index of segments: documents are added, deleted by source and merged without a rebuild.

A segment deals its documents to shards of about `block`, all of a shard to one task, and stores a row for each term and shard: the
postings as arrays, and beside them the largest count and the least length, which bound the score of
any document there under whatever statistics hold later. A search reads the bounds alone, sums them by
shard, scores the shards with the highest bounds for a threshold and then only those others whose
bound reaches it: the same k documents as scoring them all.

A deletion writes the ids that go. They are left out of results at once and count in the statistics
until the next merge, which writes one segment of what is left; they are told with their shards, so
that a merge takes them out of the blocks where those are. What is there is told by a log, an
entry a change, which counts once Spark's committer has marked it. One writer at a time.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import lexical
from lodestone.operators.lexical import Statistics, _distinct, _weight
from lodestone.storage import exists, join_checked, listed, written

_LOG = "kind string, folder string, n_docs long, length long"
_BLOCK = "shard long, term string, docs array<struct<id:long,tf:int,dl:int>>, max_tf int, min_dl int, n long"
#: Shards that a task writes, at most about.
SHARDS = 128
#: Deleted ids that a merge sends to all tasks; more of them meet the blocks in a shuffle.
BROADCAST_IDS = 2_000_000


def _without(blocks: DataFrame, deleted: DataFrame, few: bool) -> DataFrame:
    """The blocks without the deleted documents (id, segment, shard): a shard's are at most its own documents."""
    gone = deleted.groupBy("segment", "shard").agg(F.collect_list("id").alias("gone"))
    left = F.filter("docs", lambda d: ~F.array_contains("gone", d["id"]))
    met = blocks.join(F.broadcast(gone) if few else gone, ["segment", "shard"], "left")
    met = met.withColumn("docs", F.when(F.col("gone").isNull(), F.col("docs")).otherwise(left)).where(F.size("docs") > 0)
    fewer = F.size("docs") < F.col("n")
    return met.drop("gone").withColumns({
        "max_tf": F.when(fewer, F.array_max("docs.tf")).otherwise(F.col("max_tf")), "min_dl": F.when(fewer, F.array_min("docs.dl")).otherwise(F.col("min_dl")),
        "n": F.size("docs").cast("long")})


@dataclass
class SegmentedIndex:
    """An index under path. buckets: folders that terms are dealt to; block: documents of a shard, about."""

    spark: SparkSession
    path: str
    buckets: int = 32
    block: int = 128

    def log(self) -> list[tuple]:
        """(kind, folder, documents, words) of the changes since the last merge, which is the first: a row a change."""
        done = [n for n in listed(self.spark, f"{self.path}/log") if exists(self.spark, f"{self.path}/log/{n}/_SUCCESS")]
        rows = self.spark.read.schema(_LOG).parquet(*[f"{self.path}/log/{n}" for n in done]).select("*", F.col("_metadata.file_path").alias("_at")).orderBy("_at").collect() if done else []
        start = max((i for i, r in enumerate(rows) if r["kind"] == "merge"), default=0)
        return [tuple(r)[:4] for r in rows[start:]]

    def _record(self, kind: str, folder: str, n_docs: int = 0, length: int = 0) -> None:
        number = max([int(n) for n in listed(self.spark, f"{self.path}/log") if exists(self.spark, f"{self.path}/log/{n}/_SUCCESS")], default=0) + 1
        self.spark.createDataFrame([(kind, folder, n_docs, length)], _LOG).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/log/{number:08d}")

    def add(self, docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> None:
        """A segment of docs; their ids are new. Null texts have no words."""
        shards, block = max(1, -(-docs.count() // self.block)), [c.split()[0] for c in _BLOCK.split(", ")]
        shard = F.pmod(F.xxhash64("id"), F.lit(shards)).alias("shard")
        rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.lower(F.coalesce(F.col(text_col), F.lit(""))).alias("text")).select("*", shard)

        @F.arrow_udf("int")
        def length(text: pa.Array) -> pa.Array:
            return pa.array(lexical.lengths(text))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in lexical.slices(batches, "text"):
                made = lexical.blocks(b.column("id"), b.column("text"))
                made["shard"] = pa.repeat(b.column("shard")[0], len(made["term"]))
                yield pa.RecordBatch.from_arrays([made[c] for c in block], block)

        # the texts are dealt, as their postings are many times larger: all of a shard's, about `block` documents, are made at once
        blocks = rows.select("id", "text", "shard").repartition(self._tasks(shards), "shard").groupBy("shard").applyInArrow(run, _BLOCK.replace("id:long", f"id:{dict(rows.dtypes)['id']}"))
        self._segment("add", blocks, rows.select("id", "source", length("text").alias("dl"), "shard"))

    def _tasks(self, shards: int) -> int:
        """Tasks that write a segment of so many shards, each a file a bucket."""
        return max(1, min(shards, max(self.spark.sparkContext.defaultParallelism, -(-shards // SHARDS))))

    def _segment(self, kind: str, blocks: DataFrame, known: DataFrame) -> None:
        folder = f"segments/{uuid.uuid4().hex[:12]}"
        known.write.parquet(f"{self.path}/{folder}/docs")
        n, length = self.spark.read.parquet(f"{self.path}/{folder}/docs").agg(F.count(F.lit(1)), F.coalesce(F.sum("dl"), F.lit(0))).first()
        blocks = blocks.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(self.buckets)).cast("int"))
        blocks.sortWithinPartitions("bucket", "term", "shard").write.partitionBy("bucket").parquet(f"{self.path}/{folder}/blocks")
        self._record(kind, folder, n, length)

    def _blocks(self, terms: Sequence[str] | None) -> DataFrame:
        """The blocks of the terms (of all, if None) in all segments, with the segment's name."""
        rows = None
        buckets = None if terms is None else [r[0] for r in self.spark.createDataFrame([(t,) for t in terms], "t string").select(F.pmod(F.xxhash64("t"), F.lit(self.buckets)).cast("int")).distinct().collect()]
        for kind, folder, n, _ in self.log():
            if kind != "delete" and n and any(x.startswith("bucket=") for x in listed(self.spark, f"{self.path}/{folder}/blocks")):  # none: no words
                part = self.spark.read.parquet(f"{self.path}/{folder}/blocks")
                part = (part if terms is None else part.where(F.col("bucket").isin(buckets) & F.col("term").isin(list(terms)))).withColumn("segment", F.lit(folder))
                rows = part if rows is None else rows.unionByName(part)
        return rows

    def _deleted(self) -> DataFrame | None:
        paths = [f"{self.path}/{folder}" for kind, folder, _, _ in self.log() if kind == "delete"]
        return self.spark.read.parquet(*paths) if paths else None

    def _docs(self) -> DataFrame:
        """(id, source, dl, shard, segment) of all segments."""
        parts = [self.spark.read.parquet(f"{self.path}/{folder}/docs").withColumn("segment", F.lit(folder)) for kind, folder, _, _ in self.log() if kind != "delete"]
        return reduce(DataFrame.unionByName, parts)

    def _live(self, rows: DataFrame) -> DataFrame:
        gone = self._deleted()
        return rows if gone is None else join_checked(rows, gone.select("id"), "id", "left_anti")

    def delete_source(self, sources: DataFrame) -> int:
        """Documents of the sources (source) go; how many."""
        folder = f"deleted/{uuid.uuid4().hex[:12]}"
        self._live(self._docs().join(sources.select("source"), "source", "left_semi")).select("id", "segment", "shard").distinct().write.parquet(f"{self.path}/{folder}")
        n = self.spark.read.parquet(f"{self.path}/{folder}").count()
        if n:
            self._record("delete", folder, n)
        return n

    def merge(self) -> None:
        """One segment of all documents that are not deleted, from the stored blocks.

        Shards stay together under new numbers, so blocks go from files to files; only if fewer than
        half of `block` documents are left in a shard on average are several made into one.
        """
        log = self.log()
        if not log:
            return
        spans = {r["segment"]: r["n"] for r in self._docs().groupBy("segment").agg((F.max("shard") + 1).alias("n")).collect()}  # a row a segment
        gone = sum(r[2] for r in log if r[0] == "delete")
        shards, live = sum(spans.values()), sum(r[2] for r in log if r[0] != "delete") - gone
        if whole := 2 * live >= shards * self.block:
            starts = dict(zip(spans, accumulate(spans.values(), initial=0)))
            shard = F.col("shard") + F.create_map(*[F.lit(x) for pair in starts.items() for x in pair])[F.col("segment")]
        else:
            shards = max(1, -(-live // self.block))
            shard = F.pmod(F.xxhash64("segment", "shard"), F.lit(shards))
        blocks = self._blocks(None)
        if blocks is None:
            blocks = self.spark.createDataFrame([], f"{_BLOCK}, segment string")
        if gone:
            blocks = _without(blocks, self._deleted(), gone <= BROADCAST_IDS)
        blocks = blocks.withColumn("shard", shard).drop("segment", "bucket")
        if whole:
            blocks = blocks.coalesce(self._tasks(shards))
        else:
            blocks = blocks.repartition(self._tasks(shards), "shard").groupBy("shard", "term").agg(
                F.flatten(F.collect_list("docs")).alias("docs"), F.max("max_tf").alias("max_tf"), F.min("min_dl").alias("min_dl"), F.sum("n").alias("n"))
        self._segment("merge", blocks, self._live(self._docs()).withColumn("shard", shard).select("id", "source", "dl", "shard"))

    def statistics(self, terms: Sequence[str], bounds: DataFrame | None) -> Statistics:
        log = self.log()
        n, length = (sum(r[k] for r in log if r[0] != "delete") for k in (2, 3))
        df = {} if bounds is None else {r["term"]: r["n"] for r in bounds.groupBy("term").agg(F.sum("n").alias("n")).collect()}  # a row a term
        found = Statistics(n, length / max(n, 1), df)
        if any(found.raw_idf(t) < 0 for t in terms):  # needs the mean over the vocabulary; counts alone are read
            every = self._blocks(None).groupBy("term").agg(F.sum("n").alias("n"))
            mean = every.agg(F.avg(F.log(F.lit(n) - F.col("n") + 0.5) - F.log(F.col("n") + 0.5))).first()[0]
            found = Statistics(n, found.mean_length, df, mean or 0.0)
        return found

    def search(self, terms: Sequence[str], k: int, *, first: int = 8, k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25, counts: dict | None = None) -> DataFrame:
        """(id, score): the k best documents that hold any of the terms, ties by id. counts: gets the numbers of blocks and of those read."""
        terms = _distinct(terms)
        blocks = self._blocks(terms) if terms else None
        if blocks is None:
            return self.spark.createDataFrame([], "id long, score double")
        bounds = written(blocks.select("segment", "shard", "term", "n", "max_tf", "min_dl"), "bounds")
        stats = self.statistics(terms, bounds)

        def weight(tf: str, dl: str) -> Column:
            part = F.lit(0.0)
            for t in terms:
                part = F.when(F.col("term") == t, _weight(F.col(tf), F.col(dl), stats.idf(t, epsilon), stats.mean_length, k1, b)).otherwise(part)
            return part

        def scored(shards: DataFrame) -> DataFrame:
            rows = join_checked(blocks.select("segment", "shard", "term", "docs"), shards.select("segment", "shard"), ["segment", "shard"], "left_semi")
            rows = rows.select("term", F.explode("docs").alias("d")).select("term", "d.*")
            return self._live(rows.groupBy("id").agg(F.sum(weight("tf", "dl")).alias("score"))).orderBy(F.desc("score"), "id").limit(k)

        shards = written(bounds.groupBy("segment", "shard").agg(F.sum(F.greatest(weight("max_tf", "min_dl"), F.lit(0.0))).alias("most"), F.count(F.lit(1)).alias("blocks")), "shards")
        order = [F.desc("most"), "segment", "shard"]
        head = written(shards.orderBy(*order).limit(first), "head")
        best = written(scored(head), "best")
        low = [r["score"] for r in best.collect()]  # k rows
        rest = join_checked(shards, head.select("segment", "shard"), ["segment", "shard"], "left_anti")
        if len(low) == k:
            rest = rest.where(F.col("most") * (1 + 1e-9) >= low[-1])
        rest = written(rest, "rest")
        if counts is not None:
            counts |= {"blocks": bounds.count(), "read": head.unionByName(rest).agg(F.coalesce(F.sum("blocks"), F.lit(0))).first()[0]}
        return best.unionByName(scored(rest)).orderBy(F.desc("score"), "id").limit(k)
