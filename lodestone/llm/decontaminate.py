"""Benchmark decontamination: a prefix-filtered join of item windows with document word sequences.

A window is `size` consecutive item words (a shorter item is one window). Containment has to be
exact, so the necessary prefix of a window, with its words ordered by rarity over all documents, is
its single rarest word: a document that holds the window holds that word at the same distance from
the window's start. The join is on that word; the length bound (the whole window must fit between
the document's ends) and the positional bound (word position minus its offset) give one candidate
start, and the words are then compared exactly.

A benchmark of at most BLOCK_WORDS words, which Spark counts first, is sent to the tasks as an
index, and the documents are read once and not shuffled. A larger one, of any size, is joined as a
table: document words that are a window's prefix, each with the words around it, meet the windows
in a shuffled join. Both ways find the same.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm._common import join_checked, written

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
BLOCK_WORDS = 500_000


def words(text: str | None) -> list[str]:
    return WORD.findall(text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")) if text else []  # bytes lower A-Z only


def windows(item: list[str], size: int) -> list[tuple[str, ...]]:
    """All runs of `size` words; a shorter item that has words is one window."""
    return [tuple(item[i : i + size]) for i in range(max(1, len(item) - size + 1))] if item else []


def _rarity(docs: DataFrame, wanted: frozenset[str]) -> dict[str, int]:
    """How often the wanted words occur in all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        for batch in batches:
            for text in batch.column(0):
                seen.update(filter(wanted.__contains__, words(text.as_py())))
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])

    counted = docs.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return {r["word"]: r["n"] for r in counted.collect()}  # at most as many rows as the items have words


def _index(items: list[tuple[str, list[str]]], size: int, docs: DataFrame) -> dict[str, list]:
    """Prefix word -> (its offset in the window, item words, window's start and length in them, ids of the items that have it)."""
    owners: dict[tuple[str, ...], set[str]] = {}
    place: dict[tuple[str, ...], tuple[list[str], int]] = {}
    for item_id, item in items:
        for i, w in enumerate(windows(item, size)):
            owners.setdefault(w, set()).add(item_id)
            place.setdefault(w, (item, i))
    count = _rarity(docs, frozenset(w for _, item in items for w in item))
    index: dict[str, list] = {}
    for w, ids in owners.items():
        rare, first, at = min((count.get(x, 0), x, i) for i, x in enumerate(w))
        if rare:  # else it is in no document
            item, start = place[w]
            index.setdefault(first, []).append((at, item, start, len(w), sorted(ids)))
    return index


def _hits(docs: DataFrame, index: dict[str, list], carry: list[str]) -> DataFrame:
    def found(w: list[str]) -> tuple[set, set]:
        spans, ids = set(), set()
        for i, x in enumerate(w):
            for at, item, start, n, owners in index.get(x, ()):
                a = i - at
                if a >= 0 and a + n <= len(w) and w[a : a + n] == item[start : start + n]:
                    spans.add((a, a + n))
                    ids.update(owners)
        return spans, ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, spans, items = [], [], []
            for text in batch.column(0):
                w = words(text.as_py())
                hit, ids = found(w)
                n_words.append(len(w))
                spans.append([{"start": a, "end": b} for a, b in _merged(sorted(hit))])
                items.append(sorted(ids))
            cols = [pa.array(n_words, pa.int64()), pa.array(spans, _SPANS), pa.array(items, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *cols], names=[*(batch.schema.names[1:]), "n_words", "spans", "items"])

    kept = docs.select("text", *carry)
    fields = ", ".join(f"`{c}` {kept.schema[c].dataType.simpleString()}" for c in carry)
    return kept.mapInArrow(run, f"{fields}, n_words long, spans array<struct<start:long,end:long>>, items array<string>")


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in spans:
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def word_array(text: str) -> Column:
    """The words of a text column, in DataFrame functions."""
    low = F.translate(F.coalesce(F.col(text), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_extract_all(low, F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), F.lit(0))


def window_table(items: DataFrame, size: int) -> DataFrame:
    """(window_id, window array<string>, item_id) of all items (item_id, w array<string>); window_id is the window's MD5."""
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - size, F.lit(0)))
    each = items.where(F.size("w") > 0).select("item_id", F.explode(F.transform(starts, lambda i: F.slice("w", i + 1, F.lit(size)))).alias("window"))
    return each.select(F.md5(F.concat_ws(" ", "window")).alias("window_id"), "window", "item_id").distinct()


def _joined(texts: DataFrame, owners: DataFrame, size: int) -> DataFrame:
    """(_key, spans, items) of the texts (_key, text) that hold a window. owners: as of window_table."""
    known = written(owners.groupBy("window_id").agg(F.first("window").alias("window")), "windows")
    parts = known.select("window_id", F.posexplode("window").alias("at", "word"))
    wanted = written(parts.select("word").distinct(), "wanted")
    said = texts.select(F.explode(word_array("text")).alias("word"))
    freq = join_checked(said, wanted, "word", "left_semi").groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    first = parts.join(freq, "word").groupBy("window_id").agg(F.min(F.struct("n", "word", "at")).alias("p"))
    prefix = written(first.join(known, "window_id").select("window_id", "window", F.col("p.word").alias("word"), F.col("p.at").alias("at")), "prefix")

    # each prefix word of a document takes along the words that a window around it could have
    w = texts.select("_key", word_array("text").alias("w"))
    near = lambda i: F.slice("w", F.greatest(i - size + 2, F.lit(1)), F.least(i, F.lit(size - 1)) + size)
    placed = w.select("_key", F.explode(F.transform("w", lambda x, i: F.struct(x.alias("word"), i.alias("pos"), near(i).alias("near")))).alias("t")).select("_key", "t.*")
    some = join_checked(placed, prefix.select("word").distinct(), "word", "left_semi")
    start = F.least(F.col("pos"), F.lit(size - 1)) - F.col("at")  # the window's place in near
    same = some.join(prefix, "word").where(start >= 0).where(F.slice("near", start + 1, F.size("window")) == F.col("window"))
    hits = written(same.select("_key", "window_id", (F.col("pos") - F.col("at")).cast("long").alias("start"), (F.col("pos") - F.col("at") + F.size("window")).cast("long").alias("end")), "hits")
    spans = hits.select("_key", F.struct("start", "end").alias("s")).distinct().groupBy("_key").agg(F.array_sort(F.collect_list("s")).alias("spans"))
    named = hits.select("_key", "window_id").distinct().join(owners.select("window_id", "item_id"), "window_id").select("_key", "item_id").distinct()
    return spans.join(named.groupBy("_key").agg(F.array_sort(F.collect_list("item_id")).alias("items")), "_key")


def contamination(docs: DataFrame, items: DataFrame, *, size: int = 10, id_col: str = "doc_id", keep: tuple | list = ()) -> DataFrame:
    """(doc_id, n_words, spans, items): word spans that occur in items, and those items' ids.

    keep: columns of docs that are carried into the result.

    One row per row of docs, repeated rows included. Null and empty texts have no words and no
    spans. An item without words has no window; items that share a window are all named; a null
    item id is named `null`. Spans may overlap. Other columns of docs and items are ignored. Ties in
    rarity fall to the least word, which changes no result. Documents and items may be of any length.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), "text", *[c for c in keep if c != "text"])
    back = ["doc_id", *keep, "n_words", "spans", "items"]
    worded = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item_id"), word_array("text").alias("w")).where(F.size("w") > 0)
    total = worded.agg(F.coalesce(F.sum(F.size("w")), F.lit(0))).first()[0]
    if total <= BLOCK_WORDS:
        known = [(r["item_id"], list(r["w"])) for r in worded.collect()]  # BLOCK_WORDS words at most
        carry = [c for c in docs.columns if c != "text"]
        if "text" in keep:
            docs, carry = docs.withColumn("_text", F.col("text")), [*carry, "_text"]
        found = _hits(docs, _index(known, size, docs), carry)
        return found.withColumnRenamed("_text", "text").select(back)
    # each text's findings are gathered by its content, the rows joined back to them
    keyed = docs.withColumn("_key", F.sha2(F.coalesce("text", F.lit("")), 256))
    texts = written(keyed.groupBy("_key").agg(F.first("text").alias("text")), "texts")
    every = written(_joined(texts, written(window_table(worded, size), "owners"), size), "contamination")
    plain = join_checked(keyed.withColumn("n_words", F.size(word_array("text")).cast("long")), every, "_key", "left")
    empty = lambda c: F.coalesce(c, F.array().cast(every.schema[c].dataType)).alias(c)
    return plain.withColumns({"spans": empty("spans"), "items": empty("items")}).select(back)


def hit_words(spans: F.Column) -> F.Column:
    """Words inside any of the spans, which may overlap."""
    step = lambda acc, s: F.struct(
        (acc["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(s["start"], acc["to"]))).alias("n"), F.greatest(acc["to"], s["end"]).alias("to"))
    return F.aggregate(F.array_sort(spans), F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("to")), step, lambda acc: acc["n"])


def digest(found: DataFrame) -> DataFrame:
    ids = F.array_sort("items")
    return found.select(
        "doc_id", "n_words", hit_words(F.col("spans")).alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", ids), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


def exact_words(items: list[str], doc: str | None, size: int = 10) -> tuple[int, int]:
    """Brute force for tests: (n_words, n_hit)."""
    w, hit = words(doc), set()
    for item in items:
        for win in windows(words(item), size):
            for a in range(len(w) - len(win) + 1):
                if tuple(w[a : a + len(win)]) == win:
                    hit.update(range(a, a + len(win)))
    return len(w), len(hit)


def items_digest(ids: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
