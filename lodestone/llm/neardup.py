"""Near-duplicate classes by DartMinHash signatures, banding and exact verification.

1. Rows with the same text collapse into one representative, keyed by the hash of the text.
2. DartMinHash: each unit of weight of each shingle throws Poisson(1) darts into every unit of
   rank; a dart lands on one of `size` coordinates, and the earliest dart per coordinate is kept.
   The number of rank units that a text needs falls with its weight, so a signature costs
   O(weight + size log size), and two signatures agree on a coordinate with the probability of
   their weighted Jaccard similarity.
3. Bands of `rows` coordinates are join keys. Within a bucket, all members are first compared
   with one pivot (a star, never all pairs). Members of a bucket that are then still in different
   classes are compared block by block, those outside the bucket's main class against all others:
   signatures are compared inside the task and only verified links leave it, so no link is lost
   and no group is squared.
4. Candidate pairs are verified by exact similarity of whole shingle sets; classes are the
   connected components of the verified links.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm._common import BROADCAST_IDS, components, join_checked, text_slices, written

WORD = re.compile(r"[^\W_]+")
BLOCK = 400
#: Characters of text that a task works on at a time; a text counts as LEAST at least, as its signature takes that long.
SLICE, LEAST = 1_000_000, 6_000
#: Elements whose darts are thrown at a time.
THROWN = 200_000
_U = np.uint64
_POISSON = np.cumsum(np.exp(-1) / np.concatenate([[1], np.cumprod(np.arange(1, 12))]))


def _mix(x: np.ndarray, salt: int) -> np.ndarray:
    """A 64-bit finaliser: well-spread values from x and a salt."""
    with np.errstate(over="ignore"):
        x = x + _U((salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % 2**64)
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


def _unit(x: np.ndarray) -> np.ndarray:
    return (x >> _U(11)).astype(np.float64) / 2.0**53


_letters: list[np.ndarray] = []


def _alnum() -> np.ndarray:
    """For every code point, whether it is a letter or digit; made once a worker."""
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalnum() for c in range(0x110000)), bool, 0x110000))
    return _letters[0]


def word_hashes(text: str) -> np.ndarray:
    """The hash of every word of a text (runs of letters and digits, in lower case), part by part."""
    out, at = [], 0
    low = text.lower()
    while at < len(low):
        end = at + SLICE
        while end < len(low) and low[end].isalnum():  # a word is not cut
            end += 1
        codes = np.frombuffer(low[at:end].encode("utf-32-le", "replace"), np.uint32)
        at = end
        where = np.flatnonzero(_alnum()[codes])
        if not len(where):
            continue
        new = np.flatnonzero(np.diff(where, prepend=-2) > 1)
        place = np.arange(len(where)) - np.repeat(new, np.diff(np.append(new, len(where))))
        each = _mix(codes[where].astype(_U) + (place.astype(_U) << _U(32)), 21)
        out.append(_mix(np.add.reduceat(each, new), 23))
    return np.concatenate(out) if out else np.zeros(0, _U)


def shingle_hashes(texts: list[str | None], width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(text index, shingle hash) of every word run of `width`; a shorter text is one shingle."""
    hashed = [word_hashes(t) if t else np.zeros(0, _U) for t in texts]
    sizes_ = np.array([len(x) for x in hashed], np.int64)
    h = np.concatenate(hashed) if hashed else np.zeros(0, _U)
    if not len(h):
        return np.zeros(0, np.int64), np.zeros(0, _U)
    begins = np.cumsum(sizes_) - sizes_
    doc = np.repeat(np.arange(len(texts)), sizes_)
    at = np.arange(len(h)) - begins[doc]
    runs = np.minimum(sizes_, width)[doc]
    with np.errstate(over="ignore"):
        acc = h * _U(0x9E3779B97F4A7C15)
        for j in range(1, width):
            nxt = np.append(h[j:], np.zeros(min(j, len(h)), _U))
            acc = np.where(j < runs, (acc ^ (acc >> _U(29)) ^ nxt) * _U(0xBF58476D1CE4E5B9), acc)
    first = at <= sizes_[doc] - runs
    return doc[first], _mix(acc[first], 1)


def weighted(doc: np.ndarray, h: np.ndarray, weights: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (doc, hash) with weight 1 ('set') or the number of occurrences ('count')."""
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
    n = np.diff(np.append(np.flatnonzero(new), len(h)))
    return doc[new], h[new], (n if weights == "count" else np.ones(len(n))).astype(float)


def dart_minhash(doc: np.ndarray, h: np.ndarray, weight: np.ndarray, docs: int, size: int) -> np.ndarray:
    """docs x size signature of sparse weighted sets (0 where a set is empty).

    An element of weight w is cut into unit regions of its weight axis (the last may be partial:
    darts beyond w are refused). Rank units are thrown until every coordinate has a dart.
    """
    levels = np.ceil(weight).astype(np.int64)
    own, level = _spread(levels)
    region = _mix(h[own] ^ (level.astype(_U) * _U(0xD6E8FEB86659FD93)), 11)
    limit, doc = weight[own] - level, doc[own]
    total = np.bincount(doc, minlength=docs)
    best_rank = np.full(docs * size, np.inf)
    best_dart = np.zeros(docs * size, _U)
    # rank units that make about size * (log size + 2) darts, the number after which few coordinates are empty
    units = np.ceil(size * (np.log(size) + 2) / np.maximum(total, 1)).astype(np.int64)
    start = np.zeros(docs, np.int64)
    open_docs = total > 0
    while open_docs.any():
        live = np.flatnonzero(open_docs[doc])
        own, k = _spread(units[doc[live]])
        for a in range(0, len(own), THROWN):
            e = live[own[a : a + THROWN]]
            unit = start[doc[e]] + k[a : a + THROWN]
            cell = _mix(region[e] ^ (unit.astype(_U) * _U(0x9FB21C651E98DF25)), 3)
            hit, nth = _spread(np.searchsorted(_POISSON, _unit(cell), "right"))
            dart = _mix(cell[hit] ^ ((nth.astype(_U) + _U(1)) * _U(0xA24BAED4963EE407)), 5)
            e = e[hit]
            inside = np.flatnonzero(_unit(_mix(dart, 7)) < limit[e])
            dart, e, rank = dart[inside], e[inside], unit[hit][inside] + _unit(_mix(dart[inside], 6))
            slot = doc[e] * size + (dart % _U(size)).astype(np.int64)
            better = rank < best_rank[slot]
            slot, rank, dart = slot[better], rank[better], dart[better]
            late = np.argsort(-rank)  # of equal slots the last one assigned, the earliest dart, stays
            best_rank[slot[late]], best_dart[slot[late]] = rank[late], dart[late]
        start += np.where(open_docs, units, 0)
        open_docs &= np.isinf(best_rank.reshape(docs, size)).any(1)
    return best_dart.reshape(docs, size)


def _spread(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each index i repeated n[i] times, and the number of each repeat from 0."""
    own = np.repeat(np.arange(len(n)), n)
    return own, np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)


def signatures(docs: DataFrame, *, size: int, bands: int, width: int, weights: str) -> DataFrame:
    """(id, n, keys array<long>, sketch binary): set size, band keys and one byte per coordinate."""
    rows = size // bands

    def part(ids: pa.Array, texts: list[str | None]) -> pa.RecordBatch:
        d, h, w = weighted(*shingle_hashes(texts, width), weights)
        n = np.bincount(d, w, len(texts)).astype(np.int32)
        sig = dart_minhash(d, h, w, len(texts), size)
        keys = np.zeros((len(sig), bands), _U)
        for j in range(rows):
            keys = _mix(keys ^ sig[:, j::rows][:, :bands], 31 + j)
        keys = _mix(keys ^ np.arange(bands, dtype=_U), 61)
        flat = pa.ListArray.from_arrays(np.arange(0, keys.size + 1, bands, dtype=np.int32), pa.array(keys.ravel().view(np.int64)))
        sketch = pa.array([x.tobytes() for x in (sig & _U(255)).astype(np.uint8)], pa.binary())
        return pa.RecordBatch.from_arrays([ids, pa.array(n), flat, sketch], names=["id", "n", "keys", "sketch"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, texts in text_slices(batch.column(1), SLICE, LEAST):
                yield part(batch.column(0).slice(a, len(texts)), texts)

    return docs.select("id", "text").mapInArrow(run, "id long, n int, keys array<long>, sketch binary").where("n > 0")


def shingle_sets(docs: DataFrame, width: int, weights: str) -> DataFrame:
    """(id, set array<int>): distinct shingle hashes of 32 bits; for 'count', one per occurrence."""

    def part(ids: pa.Array, texts: list[str | None]) -> pa.RecordBatch:
        d, h, w = weighted(*shingle_hashes(texts, width), weights)
        own, k = _spread(w.astype(np.int64))
        h = np.where(k > 0, _mix(h[own] ^ k.astype(_U), 77), h[own])
        ends = np.concatenate([[0], np.cumsum(np.bincount(d[own], minlength=len(texts)))])
        return pa.RecordBatch.from_arrays([ids, pa.ListArray.from_arrays(ends.astype(np.int32), pa.array((h >> _U(32)).astype(np.uint32).view(np.int32)))], names=["id", "set"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, texts in text_slices(batch.column(1), SLICE, 100):
                yield part(batch.column(0).slice(a, len(texts)), texts)

    return docs.select("id", "text").mapInArrow(run, "id long, set array<int>")


def verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose similarity, |A and B| / |A or B|, is at least the threshold."""
    left = sets.select(F.col("id").alias("a"), F.col("set").alias("sa"))
    right = sets.select(F.col("id").alias("b"), F.col("set").alias("sb"))
    both = pairs.select("a", "b").join(right, "b").join(left, "a")  # the many b of a pivot travel once each
    common = F.size(F.array_intersect("sa", "sb"))
    return both.where(common >= threshold * (F.size("sa") + F.size("sb") - common)).select("a", "b")


def agreement(a: Column, b: Column) -> Column:
    """Share of coordinates on which two sketches agree."""

    @F.pandas_udf("double")
    def share(a: pd.Series, b: pd.Series) -> pd.Series:
        if not len(a):
            return pd.Series([], dtype=float)
        x, y = (np.frombuffer(b"".join(s), np.uint8).reshape(len(a), -1) for s in (a, b))
        return pd.Series((x == y).mean(1))

    return share(a, b)


def _linked(threshold: float, least: float):
    """Verified links between the open members of a block and the bucket's block, one per other class.

    Sketches choose what is compared exactly, the most alike first; a member stops at a class once
    it has a link to it.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        left, right = pdf[pdf["side"] == 0], pdf[pdf["side"] == 1]
        out: list[tuple[int, int]] = []
        if len(left) and len(right):
            x, y = (np.frombuffer(b"".join(s["sketch"]), np.uint8).reshape(len(s), -1) for s in (left, right))
            labels, ids, sizes = right["label"].to_numpy(), right["id"].to_numpy(), right["n"].to_numpy()
            sets = [np.asarray(s) for s in right["set"]]
            for k, (own, label, n, mine) in enumerate(zip(left["id"], left["label"], left["n"], left["set"], strict=True)):
                able = (labels != label) & (np.minimum(sizes, n) >= threshold * np.maximum(sizes, n))
                score = (y == x[k]).mean(1)
                met: set[int] = set()
                mine = np.asarray(mine)
                for j in sorted(np.flatnonzero(able & (score >= least)), key=lambda j: -score[j]):
                    if labels[j] not in met:
                        common = len(np.intersect1d(mine, sets[j], assume_unique=True))
                        if common >= threshold * (len(mine) + len(sets[j]) - common):
                            met.add(labels[j])
                            out.append((min(own, ids[j]), max(own, ids[j])))
        return pd.DataFrame(out, columns=["a", "b"]).astype({"a": np.int64, "b": np.int64})

    return run


def _text_hash(text: Column, turn: int) -> Column:
    return F.xxhash64(text) if not turn else F.xxhash64(text, F.lit(turn))


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with _key, a number of the text (null and empty are the same), and _id, the id as long.

    The number is a 64-bit hash. Hashes that different texts share, told by the texts' SHA-256, are
    replaced by others until there are none: some hundred among 10**11 texts, which the driver gets.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    key, turn, shared = _text_hash(text, 0), 0, True
    while shared:
        told = docs.select(key.alias("_key"), F.sha2(text, 256).alias("_sha")).groupBy("_key").agg(F.min("_sha").alias("_a"), F.max("_sha").alias("_b"))
        shared = [r["_key"] for r in told.where("_a <> _b").select("_key").collect()]
        turn += 1
        key = F.when(key.isin(shared), _text_hash(text, turn)).otherwise(key) if shared else key
    return docs.withColumn("_key", key).withColumn("_id", F.col(id_col).cast("long"))


def text_groups(docs: DataFrame, *, threshold: float = 0.8, width: int = 5, size: int = 144, bands: int = 24, weights: str = "set", slack: float = 0.13, text_col: str = "text") -> DataFrame:
    """(_key, class_id, first): the groups of more than one row, by the keys of their texts.

    docs: as keyed. class_id: the least id of the class, null if it has none. first: the
    (no_id, id, key) of the least row of the class. Texts that only one row has and that are like
    no other are left out. slack: how far below the threshold a sketch's estimate may be for the
    pair to be verified (four standard errors at 144 coordinates).
    """
    docs = docs.select("_key", "_id", F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    least = written(docs.groupBy("_key").agg(F.min("_id").alias("_id"), F.count(F.lit(1)).alias("rows")), "keys")
    copied = least.where("rows > 1")
    single = join_checked(docs, copied.select("_key"), "_key", "left_anti", BROADCAST_IDS).select(F.col("_key").alias("id"), "text")
    few = copied.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    chosen = copied.select("_key", F.col("_id").alias("_rep"))
    one = docs.join(F.broadcast(chosen) if few else chosen, "_key").where(F.col("_id").eqNullSafe(F.col("_rep")))
    one = one.groupBy(F.col("_key").alias("id")).agg(F.first("text").alias("text"))
    reps = single.unionByName(written(one, "copied"))

    sigs = written(signatures(reps, size=size, bands=bands, width=width, weights=weights), "signatures")
    member = sigs.select("id", "n", F.explode("keys").alias("key"))
    shared = member.groupBy("key").agg(F.min_by(F.struct("id", "n"), "id").alias("pivot"), F.count(F.lit(1)).alias("m")).where("m > 1")
    member = written(member.join(shared, "key"), "buckets")
    close = F.least("n", "pivot.n") >= threshold * F.greatest("n", "pivot.n")
    stars = member.where(close).where("id <> pivot.id").select(F.col("pivot.id").alias("a"), F.col("id").alias("b")).distinct()
    sketch = sigs.select("id", "sketch")
    score = agreement(F.col("x.sketch"), F.col("y.sketch"))
    stars = stars.join(sketch.alias("x"), F.col("a") == F.col("x.id")).join(sketch.alias("y"), F.col("b") == F.col("y.id")).select("a", "b", score.alias("score"))
    stars = written(stars.where(F.col("score") >= threshold - slack), "stars")

    # each member's most alike pivot first; its other pivots only where they are in another class then
    involved = member.select("id").distinct()
    sets = written(shingle_sets(join_checked(reps, involved, "id", "left_semi", BROADCAST_IDS), width, weights), "shingles")
    best = stars.groupBy("b").agg(F.max_by("a", F.struct("score", -F.col("a"))).alias("a"))
    links = written(verified(best, sets, threshold), "links")
    label = components(links)
    classed = lambda df, c: df.join(label.select(F.col("id").alias(c), F.col("label").alias(f"label_{c}")), c, "left").withColumn(f"label_{c}", F.coalesce(f"label_{c}", c))
    other = classed(classed(stars.join(best, ["a", "b"], "left_anti"), "a"), "b").where("label_a <> label_b")
    links = written(links.unionByName(verified(other, sets, threshold)), "links")

    # what is still in several classes within a bucket of more than two
    label = components(links)
    member = classed(member.where("m > 2"), "id").withColumnRenamed("label_id", "label")
    mixed = member.groupBy("key", "label").count().groupBy("key").agg(F.max_by("label", F.struct("count", "label")).alias("main"), F.count(F.lit(1)).alias("labels"), F.sum("count").alias("m"), F.max("count").alias("most")).where("labels > 1")
    member = written(member.select("key", "id", "n", "label").join(mixed.select("key", "main", "m", "most"), "key"), "mixed")
    # blocks of the members outside the bucket's main class, against blocks of all its members
    few, all_ = F.ceil((F.col("m") - F.col("most")) / BLOCK).cast("int"), F.ceil(F.col("m") / BLOCK).cast("int")
    cell = lambda n: F.pmod(F.xxhash64("id"), n).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    minor = member.where("label <> main").select("key", "id", "n", "label", F.lit(0).alias("side"), cell(few).alias("i"), each(all_).alias("j"))
    every = member.select("key", "id", "n", "label", F.lit(1).alias("side"), each(few).alias("i"), cell(all_).alias("j"))
    cells = minor.unionByName(every).join(sketch.join(sets, "id"), "id")
    more = cells.groupBy("key", "i", "j").applyInPandas(_linked(threshold, threshold - slack), "a long, b long").distinct()
    label = components(written(links.unionByName(more).distinct(), "links"))

    label = label.withColumnRenamed("id", "_key")
    linked = least.join(label, "_key", "left").where("rows > 1 or label is not null").select("_key", "_id", F.coalesce("label", "_key").alias("label"))
    linked = written(linked, "linked")
    first = linked.groupBy("label").agg(F.min(F.struct(F.col("_id").isNull().alias("no_id"), F.col("_id").alias("id"), F.col("_key").alias("key"))).alias("first"))
    return written(join_checked(linked, written(first, "first"), "label", "inner").select("_key", F.col("first.id").alias("class_id"), "first"), "groups")


def near_duplicate_classes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(doc_id, class_id): class_id is the least id of the class. options: of text_groups.

    Rows without words match only rows with the same text (null and empty are the same).
    Repeated rows and ties fall into one class; rows with one id and different texts have their own
    classes. A row with a null id joins classes; its class_id is null where no row of the class has
    an id. One row per row of docs; an empty table gives none. A very long text is hashed part by
    part. Other columns are ignored.
    """
    rows = keyed(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))
    groups = text_groups(rows, **options).select("_key", "class_id")
    rows = rows.select("_key", F.col("_id").alias("doc_id"))
    return join_checked(rows, groups, "_key", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"))


def one_of_each(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs with exactly one row of each class: that of the least id, then the least text hash.

    Rows with a null id come last. Of identical rows any one stays. All columns are kept.
    """
    rows = keyed(docs, id_col, text_col)
    groups = text_groups(rows, text_col=text_col, **options)
    alone = join_checked(rows, groups.select("_key"), "_key", "left_anti", BROADCAST_IDS)
    chosen = groups.where("_key = first.key").select("_key", F.col("first.id").alias("_first"))
    kept = join_checked(rows, chosen, "_key", "inner").where(F.col("_id").eqNullSafe(F.col("_first")))
    kept = kept.groupBy("_key").agg(F.first(F.struct(*docs.columns)).alias("r")).select("r.*")
    return alone.select(docs.columns).unionByName(kept)
