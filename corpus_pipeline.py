"""The corpus pipeline: toxicity, near-duplicates, benchmark passages, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns what it keeps; run() writes each stage as
Parquet into the shared folder and reads it again as the next stage's docs.

In every stage a null text counts as empty, null and repeated ids are rows like others, texts of
any length are worked on whole, an empty table gives no rows, and further columns of docs, whatever
their names, are ignored. Stages set the session's rows per Arrow batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import decontaminate, neardup, packing, pii, toxicity
from lodestone.llm._common import arrow_rows, scratch_path, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score of 0.5 or more go; rows with null text score as empty and stay."""
    arrow_rows(spark, 200)
    model = toxicity.train_toxicity(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return toxicity.score_toxicity(docs.select(COLUMNS), model, out="_score").where("_score < 0.5").select(COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate class stays, that of the least doc_id (similarity of 0.8 on five-word shingles)."""
    arrow_rows(spark, 200)
    return neardup.one_of_each(docs.select(COLUMNS), threshold=0.8, width=5)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a ten-word window of a benchmark item go."""
    arrow_rows(spark, 200)
    docs = docs.select(COLUMNS)
    found = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"), size=10, keep=COLUMNS[1:])
    return found.where(F.size("spans") == 0).select(COLUMNS)


def mask_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and disclosing terms are replaced in the text; every document stays."""
    done = pii.sanitise(docs.select(COLUMNS), keep=["lang", "source"])
    return done.select("doc_id", F.col("clean").alias("text"), "lang", "source", F.char_length("clean").cast("long").alias("n_chars"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 tokens with their sequence and offset."""
    import public_tokenizers

    arrow_rows(spark, 200)
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), capacity=1024, end_id=2)


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates), ("decontamination", drop_contaminated), ("pii", mask_private), ("packing", pack)]

#: Model scores, similarity classes and token ids have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        out = scratch_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(out)
        if last is not None:
            _removed(spark, last)  # the next stage has read it
        docs, last = spark.read.parquet(out), out
    return docs


def _removed(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
