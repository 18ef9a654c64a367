"""Vector code compression: product codes of integer vectors, found by exact early elimination.

Vectors become integers (floor of `scale` times a component) and are cut into equal consecutive
parts; each part has a codebook, refined for a fixed number of rounds. The nearest entry of a part
is found in the Walsh-Hadamard domain: zero-padded parts and entries are transformed in integers,
coefficients are taken in sequency order, and an entry is out as soon as the squared differences so
far exceed those of the best guess. The transform scales all squared distances by its size, so the
order of the entries and the distances are exact; nothing is rounded.

A round is one pass over the table: every task sums its parts by nearest entry and hands on
parts x entries x positions numbers, whatever its rows. Only those sums, and the `entries` first
vectors, come to the driver.

Rows whose vector is null or holds a null or non-finite component are dropped, and so are vectors
whose length is not that of the kept vector of least id (of those, the longest). If that length is
no multiple of the parts, the last part counts as filled up with zeros. Repeated ids are rows like
others (in the first codebook, by their components); null ids come last. Components of any finite
size are worked on, as Python integers where 64 bits do not hold the distances; an error beyond the
range of a long is given as the largest long. An empty table gives no rows, further columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm._common import BROADCAST_ROWS, join_groups, vector_matrix, written

#: Rows compared with a codebook at a time; coefficients taken at a time; values of one limb of a sum; the largest long.
ROWS, STEP, LIMB, MOST = 1024, 4, 1 << 60, (1 << 63) - 1


@dataclass(frozen=True)
class Codebooks:
    """books[part][entry][position], Python integers."""

    size: int
    scale: int
    books: list[list[list[int]]]

    @property
    def width(self) -> int:
        return -(-self.size // max(len(self.books), 1))

    def sha256(self) -> str:
        """Of all decimal components by part, entry and position, comma-joined; positions beyond the vectors' length are not components."""
        own = (x for p, book in enumerate(self.books) for entry in book for x in entry[: max(self.size - p * self.width, 0)])
        return hashlib.sha256(",".join(map(str, own)).encode()).hexdigest()


def integers(matrix: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) as int64, or as Python integers if one of them does not fit 48 bits."""
    if not matrix.size or np.abs(matrix).max() * scale < 1 << 48:
        return np.floor(matrix * scale).astype(np.int64)
    ratio = ((x.as_integer_ratio()) for x in matrix.ravel().tolist())
    return np.array([a * scale // b for a, b in ratio], dtype=object).reshape(matrix.shape)


@cache
def sequency(size: int) -> np.ndarray:
    """Rows of the natural-order transform of that size (a power of two) by their number of sign changes."""
    h = np.ones((1, 1), np.int64)
    while len(h) < size:
        h = np.block([[h, h], [h, -h]])
    return np.argsort((np.diff(h, axis=1) != 0).sum(1), kind="stable")


def walsh_hadamard(x: np.ndarray) -> np.ndarray:
    """Integer Walsh-Hadamard transform of the rows, zero-padded to a power of two, in sequency order."""
    size = 1 << max(x.shape[1] - 1, 0).bit_length()
    out = np.zeros((len(x), size), x.dtype)
    out[:, : x.shape[1]] = x
    half = 1
    while half < size:
        pairs = out.reshape(len(x), -1, 2, half)
        out = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], 2).reshape(len(x), size)
        half *= 2
    return out[:, sequency(size)]


def nearest(parts: np.ndarray, entries: np.ndarray, step: int = STEP) -> tuple[np.ndarray, np.ndarray]:
    """(index, scaled squared distance) of the nearest entry of every row; both transformed; ties to the lower index."""
    head = parts[:, None, :step] - entries[None, :, :step]
    so_far = (head * head).sum(2)
    guess = parts - entries[so_far.argmin(1)]
    bound = (guess * guess).sum(1)
    row, entry = np.nonzero((so_far <= bound[:, None]).astype(bool))
    d = so_far[row, entry]
    for at in range(step, parts.shape[1], step):
        diff = parts[row, at : at + step] - entries[entry, at : at + step]
        d = d + (diff * diff).sum(1)
        left = (d <= bound[row]).astype(bool)
        row, entry, d = row[left], entry[left], d[left]
    first = np.flatnonzero(np.diff(row, prepend=-1))  # the guess always stays, so every row is there
    best = np.minimum.reduceat(d, first)
    hit = np.flatnonzero((d == best[row]).astype(bool))
    hit = hit[np.flatnonzero(np.diff(row[hit], prepend=-1))]
    return entry[hit], best


class _Coder:
    """Codebooks made ready for comparing blocks of vectors."""

    def __init__(self, books: Codebooks):
        self.of, self.parts, self.width = books, len(books.books), books.width
        self.span = 1 << max(self.width - 1, 0).bit_length()
        self.limit = (1 << 30) // self.span
        self.big = [np.array(b, dtype=object).reshape(len(b), self.width) for b in books.books]
        self.most = max((abs(x) for b in books.books for e in b for x in e), default=0)
        self.coded = [walsh_hadamard(b if self.most >= self.limit else b.astype(np.int64)) for b in self.big]

    def blocks(self, column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(row numbers, parts of integers, indexes, distances), the last three by part."""
        rows, matrix = vector_matrix(column, self.of.size)
        for at in range(0, len(rows), ROWS):
            x = integers(matrix[at : at + ROWS], self.of.scale)
            if x.dtype == object or np.abs(x).max(initial=0) >= self.limit or self.most >= self.limit:
                x = x.astype(object)
            filled = np.zeros((len(x), self.parts * self.width), x.dtype)
            filled[:, : self.of.size] = x
            cut = filled.reshape(len(x), self.parts, self.width).swapaxes(0, 1)
            books = [b.astype(object) for b in self.coded] if x.dtype == object else self.coded
            found = [nearest(walsh_hadamard(p), b) for p, b in zip(cut, books, strict=True)]
            yield rows[at : at + ROWS], cut, np.stack([i for i, _ in found]), np.stack([d // self.span for _, d in found])


def _limbs(values: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(power, places, numbers below it) so that the values are the sums of numbers * LIMB ** power."""
    at, power = np.arange(len(values)), 0
    while len(at):
        fits = np.array([-LIMB <= v < LIMB for v in values], bool)
        yield power, at, np.array([v if f else v % LIMB for v, f in zip(values, fits, strict=True)], np.int64)
        values, at, power = values[~fits] // LIMB, at[~fits], power + 1


def _refined(rows: DataFrame, books: Codebooks) -> Codebooks:
    """One round: entries become the floored means of the parts nearest to them; unused entries stay."""
    parts, width = len(books.books), books.width
    entries = len(books.books[0])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, total, counts = _Coder(books), np.zeros((parts * entries, width), object), np.zeros(parts * entries, np.int64)
        for batch in batches:
            for _, cut, index, _ in coder.blocks(batch.column(0)):
                for p in range(parts):
                    order = np.argsort(index[p], kind="stable")
                    own = index[p][order]
                    first = np.flatnonzero(np.diff(own, prepend=-1))
                    total[p * entries + own[first]] += np.add.reduceat(cut[p][order], first)
                    counts[p * entries :][:entries] += np.bincount(own, minlength=entries)
        used = np.flatnonzero(counts)
        values = np.concatenate([counts[used].astype(object), total[used].ravel()])
        cell = np.concatenate([used * (width + 1), (used[:, None] * (width + 1) + 1 + np.arange(width)).ravel()])
        for power, at, v in _limbs(values):
            yield pa.RecordBatch.from_arrays([pa.array(cell[at], pa.int64()), pa.array(np.full(len(at), power, np.int32)), pa.array(v)], names=["cell", "power", "v"])

    found = rows.mapInArrow(sums, "cell long, power int, v long").groupBy("cell", "power").agg(F.sum(F.col("v").cast("decimal(19,0)")).alias("v"))
    got: dict[int, int] = {}
    for r in found.toLocalIterator():  # parts x entries x (width + 1) numbers, in one limb unless they are huge
        got[r["cell"]] = got.get(r["cell"], 0) + int(r["v"]) * LIMB ** r["power"]
    new = [[list(e) for e in b] for b in books.books]
    for k in range(parts * entries):
        if n := got.get(k * (width + 1)):
            new[k // entries][k % entries] = [got.get(k * (width + 1) + 1 + i, 0) // n for i in range(width)]
    return Codebooks(books.size, books.scale, new)


def train_codebooks(rows: DataFrame, *, parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024, id_col: str = "vec_id", vector: str = "embedding") -> Codebooks | None:
    """Codebooks of the kept vectors of `rows`, started from those of the `entries` least ids; None if no vector is kept."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    kept = rows.select(F.col(id_col).alias("id"), v.alias("v")).where(v.isNotNull() & finite & (F.size(v) > 0))
    by = [F.col("id").asc_nulls_last(), F.size("v").desc(), F.col("v")]
    first = kept.orderBy(*by).limit(1).collect()
    if not first:
        return None
    size = len(first[0]["v"])
    start = kept.where(F.size("v") == size).orderBy(*by).limit(entries).collect()
    width = -(-size // parts)
    x = integers(np.array([r["v"] for r in start], np.float64), scale).astype(object)
    filled = np.zeros((len(x), parts * width), object)
    filled[:, :size] = x
    books = Codebooks(size, scale, [[list(map(int, e)) for e in filled[:, p * width : (p + 1) * width]] for p in range(parts)])
    for _ in range(rounds):
        books = _refined(rows.select(vector), books)
    return books


def encode(rows: DataFrame, books: Codebooks, *, id_col: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(id, label, code, error) of every kept vector: two hex digits a part (four beyond 256 entries), and the squared distances summed."""
    digits = 2 if len(books.books[0]) <= 256 else 4
    kinds = dict(rows.dtypes)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _Coder(books)
        for batch in batches:
            for at, _, index, d in coder.blocks(batch.column(2)):
                code = ["".join(f"{i:0{digits}x}" for i in row) for row in index.T.tolist()]
                error = [min(e, MOST) for e in d.sum(0).tolist()]
                took = pa.array(at)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(took), batch.column(1).take(took), pa.array(code), pa.array(error, pa.int64())], names=[id_col, label, "code", "error"])

    return rows.select(id_col, label, vector).mapInArrow(coded, f"`{id_col}` {kinds[id_col]}, `{label}` {kinds[label]}, code string, error long")


def with_label_error(coded: DataFrame, label: str = "label", hot: int = BROADCAST_ROWS) -> DataFrame:
    """coded with `label_error`, its error summed over the rows of an equal label, nulls together."""
    cut = F.least(F.sum(F.col("error").cast("decimal(19,0)")), F.lit(MOST).cast("decimal(38,0)")).cast("long")
    sums = written(coded.groupBy(F.col(label).alias("_label")).agg(cut.alias("label_error"), F.count(F.lit(1)).alias("_n")), "labels")
    return join_groups(coded, sums, F.col(label).eqNullSafe(F.col("_label")), hot=hot).drop("_label", "_n")
