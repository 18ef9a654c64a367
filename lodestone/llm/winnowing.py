"""Winnowing fingerprints, in DataFrame functions only.

Tokens are runs of at most TOKEN letters or digits, lower-cased, counted from the start of each
word, so that short texts and scripts without blanks have enough of them. Every k-gram of tokens is
hashed to 64 bits by combining the hashes of its tokens; of every window of `window` consecutive
k-grams the least hash is kept, the rightmost one on ties, with its position. So two texts that
share a run of window + k - 1 tokens share a fingerprint, and any fingerprint can be traced to its
place. One window serves texts of every length.

Window minima are taken by doubling, array against shifted array, so the cost per token grows with
log(window).
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.llm._common import BROADCAST_ROWS

TOKEN, QUANTILES = 4, 1024


def _shifted(c: str, by: int) -> Column:
    return F.slice(F.col(c), F.lit(by + 1), F.lit(1 << 30))


def _least(a: Column, b: Column) -> Column:
    return F.least(a, b)  # a null beyond the end is skipped


def with_prints(df: DataFrame, text: str, out: str, *, k: int = 3, window: int = 4) -> DataFrame:
    """Adds `out`, array<struct<hash long, pos int>>: the winnowed fingerprints of the column `text` by position.

    A text of fewer than k tokens has one k-gram of all its tokens; one without tokens has the hash
    of the whole text, so equal texts always have equal fingerprints. A text of fewer k-grams than
    `window` has one window. The helper columns out_t, out_g and out_m replace columns of such names.
    """
    t, g, m = f"{out}_t", f"{out}_g", f"{out}_m"
    df = df.withColumn(t, F.regexp_extract_all(F.lower(text), F.lit(rf"[\p{{L}}\p{{N}}]{{1,{TOKEN}}}+"), F.lit(0)))
    df = df.withColumn(t, F.transform(t, lambda x: F.xxhash64(x)))
    df = df.withColumn(t, F.when(F.size(t) > 0, F.col(t)).otherwise(F.array(F.xxhash64(text))))
    df = df.withColumn(g, F.col(t))
    for j in range(1, k):
        df = df.withColumn(g, F.zip_with(g, _shifted(t, j), lambda a, b: F.xxhash64(a, b)))
    df = df.withColumn(g, F.slice(g, F.lit(1), F.greatest(F.size(t) - (k - 1), F.lit(1))))
    df = df.withColumn(m, F.col(g))
    done = 1
    while done < window:
        step = min(done, window - done)
        df = df.withColumn(m, F.zip_with(m, _shifted(m, step), _least))
        done += step
    df = df.withColumn(m, F.slice(m, F.lit(1), F.greatest(F.size(g) - (window - 1), F.lit(1))))

    def rightmost(least: Column, i: Column) -> Column:
        place = i
        for j in range(1, window):
            place = F.when(F.get(F.col(g), i + j) == least, i + j).otherwise(place)
        return place

    df = df.withColumn(t, F.array_distinct(F.transform(m, rightmost)))
    df = df.withColumn(out, F.transform(t, lambda p: F.struct(F.get(F.col(g), p).alias("hash"), p.alias("pos"))))
    return df.drop(t, g, m)


def hashes(prints: str) -> Column:
    """The distinct hashes of an array of fingerprints."""
    return F.array_distinct(F.transform(prints, lambda p: p["hash"]))


def written_out(prints: str) -> Column:
    """hash@position of each fingerprint, joined by commas."""
    return F.array_join(F.transform(prints, lambda p: F.concat(F.lower(F.hex(p["hash"])), F.lit("@"), p["pos"].cast("string"))), ",")


def likeness(a: str, b: str) -> Column:
    """Jaccard likeness of two arrays of distinct hashes; neither is empty."""
    common = F.size(F.array_intersect(a, b))
    return common / (F.size(a) + F.size(b) - common)


def fingerprints(docs: DataFrame, *, k: int = 3, window: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, prints, hashes) of every row; null text is empty. Other columns are ignored."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return with_prints(docs, "text", "prints", k=k, window=window).withColumn("hashes", hashes("prints"))


def _listed(values: list, kind: str) -> Column:
    return F.from_json(F.lit(json.dumps(values)), f"array<{kind}>")


def _interval(df: DataFrame, bounds: list[int], out: str) -> DataFrame:
    """Adds the number of bounds (sorted) that are at most doc_id, by bisection."""
    df = df.withColumn(out, F.lit(0))
    step = 1 << max(len(bounds).bit_length() - 1, 0)
    while step and bounds:
        df = df.withColumn(out, F.when(F.get(_listed(bounds, "long"), F.col(out) + step - 1) <= F.col("doc_id"), F.col(out) + step).otherwise(F.col(out)))
        step //= 2
    return df


def _bounds(quantiles: list[int]) -> list[int]:
    """Distinct quantiles; an id that is several of them gets an interval of its own."""
    own = {q + 1 for a, q in zip(quantiles, quantiles[1:], strict=False) if a == q and q < 2**63 - 1}
    return sorted({*quantiles, *own})


def with_buckets(docs: DataFrame, per_bucket: int = 1000) -> DataFrame:
    """Adds _hash and _bucket, ranges of the order (id, text hash) of about per_bucket rows; null ids come before all.

    Quantiles of the ids cut their range into intervals; an interval is cut into equal ranges of ids
    by its count, or of text hashes if it holds one id. So neither gaps nor outliers nor an id that
    many rows share makes a large bucket; there are BROADCAST_ROWS + 2 * QUANTILES + 1 buckets at most.
    """
    docs = docs.withColumn("_hash", F.xxhash64("text"))
    n, ids, low, high = docs.agg(F.count(F.lit(1)), F.count("doc_id"), F.min("doc_id"), F.max("doc_id")).first()
    per = max(per_bucket, -(-n // BROADCAST_ROWS))
    q = min(QUANTILES, ids // per)
    quantiles = docs.agg(F.percentile_approx("doc_id", [i / q for i in range(1, q)], 20_000)).first()[0] if q > 1 else []
    bounds = _bounds([int(x) for x in quantiles])
    placed = _interval(docs, bounds, "_interval")
    counts = {r["_interval"]: r["count"] for r in placed.where("doc_id is not null").groupBy("_interval").count().collect()}  # 2 * QUANTILES rows at most
    edges = [low or 0, *bounds, (high or 0) + 1]
    parts = [-(-counts.get(i, 1) // per) for i in range(len(edges) - 1)]
    of = lambda values, kind: F.get(_listed(values, kind), F.col("_interval"))
    wide = [float(b - a) for a, b in zip(edges, edges[1:], strict=False)]
    by_hash = F.col("_hash").cast("double") / F.lit(2.0**64) + 0.5
    by_id = (F.col("doc_id").cast("double") - of([float(x) for x in edges[:-1]], "double")) / of(wide, "double")
    sub = lambda share, parts: F.greatest(F.lit(0), F.least(F.floor(share * parts).cast("long"), parts - 1))
    inner = sub(F.when(of(wide, "double") > 1, by_id).otherwise(by_hash), of(parts, "long"))
    null_parts = max(1, -(-(n - ids) // per))
    bucket = F.when(F.col("doc_id").isNull(), sub(by_hash, F.lit(null_parts).cast("long")) - (1 << 20)).otherwise(F.col("_interval").cast("long") * (1 << 20) + inner)
    return placed.withColumn("_bucket", bucket).drop("_interval")


def with_next(docs: DataFrame, *, per_bucket: int = 1000) -> DataFrame:
    """Adds next_text and keeps the id order in buckets: the next row by descending doc_id.

    After the last row comes the first. Rows with a null id come last; rows with equal ids are
    ordered by the hash of their text. Each bucket also gets a copy of the row that follows its last
    one, so no task sees more than its bucket and that row. docs: (doc_id, text), ids any long.
    Adds _hash, _bucket and _copy (1 for such a copy) for later windows.
    """
    placed = with_buckets(docs, per_bucket)
    heads = placed.groupBy("_bucket").agg(F.max(F.struct("doc_id", "_hash")).alias("head"))
    down = Window.orderBy(F.desc("_bucket"))  # as many rows as there are buckets, a bounded number
    top = down.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    follow = heads.select(F.col("_bucket").alias("_for"), F.coalesce(F.lead("_bucket").over(down), F.first("_bucket").over(top)).alias("_bucket"))
    follow = follow.join(heads, "_bucket")
    here = (F.col("p._bucket") == F.col("f._bucket")) & F.col("p.doc_id").eqNullSafe(F.col("f.head.doc_id")) & (F.col("p._hash") == F.col("f.head._hash"))
    lead_row = placed.alias("p").join(F.broadcast(follow).alias("f"), here).groupBy("_for").agg(F.max("text").alias("text"), F.max("_hash").alias("_hash"))
    copies = lead_row.select(F.lit(None).cast(docs.schema["doc_id"].dataType).alias("doc_id"), "text", "_hash", F.col("_for").alias("_bucket"), F.lit(1).alias("_copy"))
    every = placed.withColumn("_copy", F.lit(0)).unionByName(copies)
    return every.withColumn("next_text", F.lead("text").over(in_order()))


def in_order():
    return Window.partitionBy("_bucket").orderBy("_copy", F.desc("doc_id"), F.desc("_hash"))


def edited(text: Column, n: Column, following: Column) -> Column:
    """The last half of the text (rounded down) replaced by as much of the following text."""
    half = F.floor(n / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - half), F.substring(following, F.lit(1), half))


def compare_with_edit_and_next(docs: DataFrame, *, k: int = 3, window: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next).

    One row per row of docs; null text is empty; an empty table gives none; a single row is followed
    by itself; repeated rows follow one another. Ids are whole numbers. A text of any length is one
    row. Other columns are ignored.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = with_prints(with_next(docs), "text", "prints", k=k, window=window).withColumn("hashes", hashes("prints"))
    rows = rows.withColumn("next_hashes", F.lead("hashes").over(in_order())).where("_copy = 0")
    rows = rows.withColumn("n", F.char_length("text"))
    rows = rows.withColumn("edited", edited(F.col("text"), F.col("n"), F.col("next_text")))
    rows = with_prints(rows, "edited", "edited_prints", k=k, window=window).withColumn("edited_hashes", hashes("edited_prints"))
    return rows.select(
        "doc_id", F.col("n").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), written_out("prints").alias("fingerprint"), written_out("edited_prints").alias("edited_fingerprint"),
        likeness("hashes", "edited_hashes").alias("near_edited"), likeness("hashes", "next_hashes").alias("near_next"))
