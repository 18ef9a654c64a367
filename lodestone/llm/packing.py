"""Best-fit packing: length patterns fitted to the length histogram by non-negative least squares.

1. Every document becomes pieces of at most `capacity` tokens (Spark, one pass).
2. The histogram of piece lengths (at most `capacity` rows, whatever the input) goes to the driver.
3. Patterns of one to three lengths that fill a sequence exactly are enumerated, their repeat
   counts fitted by non-negative least squares, rounded down, and the residual lengths packed
   by best fit decreasing, histogram bin by histogram bin.
4. Each piece gets its rank among the pieces of its length (salted ranks, no global sort) and
   looks up its sequence and offset in the plan, whose size depends on `capacity` only.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.llm._common import written

#: A length's ranks are dealt over salts of about PER_SALT rows, in all over MOST_SALTS and one for each length at most.
PER_SALT, MOST_SALTS = 4096, 100_000
#: Letters, numbers and white space of U+0000..U+024F, as in Unicode.
_L, _N, _S = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ɏ", "0-9\xb2\xb3\xb9\xbc-\xbe", "\t-\r \x85\xa0"
_LATIN = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
_OTHER = re.compile("[^\x00-ɏ]")


def _byte_letters() -> dict[str, int]:
    """The letter by which a byte-level vocabulary writes each byte: itself where it prints, else one from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class Encoder(dict):
    """Text piece -> its ids as little-endian uint32 bytes; the cache is emptied when full.

    Vocabulary and added tokens are those of a byte-level BPE file of the tokenizers library, and
    so are the ids: an added token's string in a text becomes its id.
    """

    def __init__(self, path: str, most: int = 60_000) -> None:
        super().__init__()
        import public_tokenizers
        import tiktoken

        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        added = {t["content"]: t["id"] for t in told["added_tokens"]}
        letters = _byte_letters()
        ranks = {bytes(letters[c] for c in token): i for token, i in told["model"]["vocab"].items() if token not in added}
        self.added = {k: np.array([i], "<u4").tobytes() for k, i in added.items()}
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self.most, self.bpe = most, tiktoken.Encoding("lodestone", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __missing__(self, piece: str) -> bytes:
        got = np.array(self.bpe.encode_ordinary(piece), "<u4").tobytes()
        if len(piece) <= 40:  # what is long seldom comes again
            if len(self) >= self.most:
                self.clear()
            self[piece] = got
        return got

    def encode(self, text: str) -> bytes:
        if self.split and any(t in text for t in self.added):
            return b"".join(self.added[part] if part in self.added else self.plain(part) for part in self.split.split(text))
        return self.plain(text)

    def plain(self, text: str) -> bytes:
        if _OTHER.search(text):
            return np.array(self.bpe.encode_ordinary(text.encode("utf-8", "replace").decode()), "<u4").tobytes()
        return b"".join(map(self.__getitem__, _LATIN.findall(text)))


_encoders: dict[str, Encoder] = {}


def tokenised_pieces(docs: DataFrame, tokenizer: str, *, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of every document.

    A document is its ids and then end_id. Only longer ones are cut, so that all pieces but the
    first are full. Null text counts as empty; repeated rows give repeated pieces; a null id stays.
    ids: little-endian uint32 bytes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoders.get(tokenizer) or _encoders.setdefault(tokenizer, Encoder(tokenizer))
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = enc.encode(text.as_py() or "") + end
                n, at, k = len(ids) // 4, 0, 0
                first = n % capacity or min(n, capacity)
                while at < n:
                    size = first if k == 0 else capacity
                    part = ids[4 * at : 4 * (at + size)]
                    for col, v in zip(out, (doc, k, at, size, zlib.crc32(part), part if with_ids else b""), strict=True):
                        col.append(v)
                    at, k = at + size, k + 1
            cols = [pa.array(out[0], batch.schema.field(0).type), pa.array(out[1], pa.int32()), *(pa.array(c, pa.int64()) for c in out[2:5])]
            if with_ids:
                cols.append(pa.array(out[5], pa.binary()))
            yield pa.RecordBatch.from_arrays(cols, names=names)

    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids)


def patterns(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """All multisets of one to three of the lengths that sum to capacity; rows padded with 0."""
    have = np.zeros(capacity + 1, bool)
    have[lengths] = True
    found = [np.array([[capacity, 0, 0]])] if have[capacity] else []
    a = np.flatnonzero(have[: capacity // 2 + 1])
    a = a[a > 0]
    pair = a[have[capacity - a]]
    found.append(np.stack([capacity - pair, pair, 0 * pair], 1))
    for c in a[a <= capacity // 3]:
        b = a[(a >= c) & (2 * a <= capacity - c)]
        b = b[have[capacity - c - b]]
        found.append(np.stack([capacity - c - b, b, 0 * b + c], 1))
    return np.concatenate(found)


def fit(pats: np.ndarray, hist: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Non-negative least squares of the repeat counts by accelerated projected gradients."""
    if not len(pats):
        return np.zeros(0)
    live = pats > 0
    rows, at = pats[live], np.nonzero(live)[0]
    used = lambda x: np.bincount(rows, x[at], len(hist))
    back = lambda r: np.bincount(at, r[rows], len(pats))
    v = np.ones(len(pats))
    for _ in range(20):
        v = back(used(v))
        top = np.linalg.norm(v)
        v /= top
    x = y = np.zeros(len(pats))
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(0, y - back(used(y) - hist) / (1.05 * top))
        t, old = (1 + (1 + 4 * t * t) ** 0.5) / 2, t
        x, y = new, new + (old - 1) / t * (new - x)
    return x


def rounded(pats: np.ndarray, counts: np.ndarray, hist: np.ndarray) -> np.ndarray:
    """Whole counts that use no length more often than there are pieces of it."""
    got = np.floor(counts + 1e-9)
    while True:
        used = np.bincount(pats.ravel(), np.repeat(got, 3), len(hist))
        used[0] = 0
        over = used > hist
        if not over.any():
            return got.astype(np.int64)
        share = np.where(over, hist / np.maximum(used, 1), 1.0)
        got = np.floor(got * share[pats].min(1))


def plan(hist: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of one sequence, repeats) for a histogram over 0..capacity; covers it exactly."""
    pats = patterns(np.flatnonzero(hist), capacity)
    counts = rounded(pats, fit(pats, hist.astype(float)), hist) if len(pats) else np.zeros(0, np.int64)
    done = [(tuple(int(v) for v in p if v), int(n)) for p, n in zip(pats[counts > 0], counts[counts > 0], strict=True)]
    rest = hist.copy()
    for p, n in done:
        for v in p:
            rest[v] -= n
    room: list[list[tuple[tuple[int, ...], int]]] = [[] for _ in range(capacity + 1)]
    for size in range(capacity, 0, -1):
        left = int(rest[size])
        slack = size
        while left:
            while slack <= capacity and not room[slack]:
                slack += 1
            if slack > capacity:
                many = capacity // size
                full, part = divmod(left, many)
                for k, n in ((many, full), (part, 1)):
                    if k and n:
                        room[capacity - k * size].append(((size,) * k, n))
                left = 0
            else:
                slots, n = room[slack].pop()
                take = min(n, left)
                if n > take:
                    room[slack].append((slots, n - take))
                room[slack - size].append(((*slots, size), take))
                left -= take
                slack = size
    return done + [g for groups in room for g in groups]


def pack_pieces(pieces: DataFrame, *, capacity: int = 1024, per_salt: int = PER_SALT) -> DataFrame:
    """Adds sequence_id and offset (both long) to rows with doc_id, piece and length (1..capacity).

    Pieces with the same doc_id and piece are ranked in any order. An empty table gives no rows.
    per_salt: about how many pieces of one length are ranked in one task.
    """
    hist = np.zeros(capacity + 1, np.int64)
    for r in pieces.groupBy("length").count().collect():  # at most `capacity` rows
        hist[r["length"]] = r["count"]
    groups = plan(hist, capacity)
    cursor, base, slots = np.zeros(capacity + 1, np.int64), 0, []
    for lengths, n in groups:
        at = 0
        for v in lengths:
            slots.append((v, cursor[v], base, at))
            cursor[v] += n
            at += v
        base += n
    slots.sort()
    lut = np.array(slots, np.int64).reshape(-1, 4)
    starts = (lut[:, 0] << 48) | lut[:, 1]

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        k = np.searchsorted(starts, (length.to_numpy().astype(np.int64) << 48) | rank.to_numpy(), "right") - 1
        return pd.DataFrame({"sequence_id": lut[k, 2] + rank.to_numpy() - lut[k, 1], "offset": lut[k, 3]})

    unit = max(per_salt, -(-int(hist.sum()) // MOST_SALTS))
    dealt = F.get(F.lit([int(x) for x in np.maximum(1, -(-hist // unit))]), F.col("length").cast("int"))
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece"), dealt).cast("int"))
    sizes = salted.groupBy("length", "_salt").count()  # at most MOST_SALTS and 2 * capacity rows
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("length", "_salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    ranked = salted.withColumn("_k", F.row_number().over(Window.partitionBy("length", "_salt").orderBy("doc_id", "piece")))
    ranked = ranked.join(F.broadcast(sizes), ["length", "_salt"]).withColumn("_rank", F.col("_before") + F.col("_k") - 1)
    out = ranked.withColumn("_at", place("length", "_rank"))
    return out.select(*pieces.columns, F.col("_at.sequence_id").alias("sequence_id"), F.col("_at.offset").alias("offset"))


def pack_documents(docs: DataFrame, tokenizer: str, *, capacity: int = 1024, end_id: int = 2, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenises, cuts and packs; the pieces are written once, as both the histogram and the result need them."""
    pieces = tokenised_pieces(docs, tokenizer, capacity=capacity, end_id=end_id, with_ids=with_ids, id_col=id_col, text_col=text_col)
    return pack_pieces(written(pieces, "pieces"), capacity=capacity)
