"""Periodic runs of words, by internal pattern matching.

The words of a text are ranked by their prefixes of 1, 2, 4, ... words (prefix doubling), which gives
the suffix array and, for every block of such a length, the interval of it that holds the block's
occurrences. A wavelet tree over the suffix array answers range-successor queries: the next
occurrence of a dyadic block in the window after it. Occurrences of a block in a window of its own
length are at most two or a progression; their distances are the candidate periods (of a progression
those that carry one end of the block's own run to the end of the other). Each candidate is extended
both ways by the ranks, which is exact. A run holds four periods at least, so the blocks of length
2**k that start at multiples of 2**(k + 1) meet all runs with periods from 2**k to 2**(k + 1) - 1.

Before that, words go that no run can hold: every three words in a row of a run occur in it at least
three times. They are counted in a table that may only count too many.

A task works on some texts at a time, of about SLICE bytes, and a longer one alone: about 200 bytes
of memory for every word of it that the count leaves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm._common import let

SLICE = 4_000_000


class WaveletTree:
    """Wavelet tree of numbers below 2**bits, a level of it after the other."""

    def __init__(self, values: np.ndarray, bits: int):
        self.bits, self.ones, self.zeros = bits, [], []
        for b in reversed(range(bits)):
            bit = (values >> b) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit)]).astype(np.int32))
            self.zeros.append(len(values) - int(self.ones[-1][-1]))
            values = np.concatenate([values[bit == 0], values[bit == 1]])

    def successor(self, lo: np.ndarray, hi: np.ndarray, x: np.ndarray) -> np.ndarray:
        """The least number of at least x in each places [lo, hi); 2**bits if there is none."""
        rank, a, b = np.zeros(len(lo), np.int64), lo, hi  # how many are below x
        for k, (ones, zeros) in enumerate(zip(self.ones, self.zeros, strict=True)):
            up = (x >> (self.bits - 1 - k)) & 1 == 1
            oa, ob = ones[a].astype(np.int64), ones[b].astype(np.int64)
            rank += np.where(up, (b - ob) - (a - oa), 0)
            a, b = np.where(up, zeros + oa, a - oa), np.where(up, zeros + ob, b - ob)
        none = (rank >= hi - lo) | (x >> self.bits > 0)
        out, a, b, rank = np.zeros(len(lo), np.int64), lo, hi, np.where(none, 0, rank)
        for k, (ones, zeros) in enumerate(zip(self.ones, self.zeros, strict=True)):
            oa, ob = ones[a].astype(np.int64), ones[b].astype(np.int64)
            low = (b - ob) - (a - oa)
            up = rank >= low
            rank = np.where(up, rank - low, rank)
            out |= np.where(up, 1 << (self.bits - 1 - k), 0)
            a, b = np.where(up, zeros + oa, a - oa), np.where(up, zeros + ob, b - ob)
        return np.where(none, 1 << self.bits, out)


def ranked(symbols: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """(suffix array, ranks by the first 2**k symbols for each k, repeated dyadic blocks for each k: start, interval of the suffix array).

    The last symbol must occur once. Ranks are places in the suffix array of a prefix's first suffix.
    """
    n = len(symbols)
    sa = np.argsort(symbols, kind="stable")
    new = np.diff(symbols[sa], prepend=symbols[sa[0]] - 1) != 0
    rank, own = np.zeros(n, np.int64), sa
    place = np.arange(n)
    ranks, blocks, size = [], [], 1
    while True:
        first = np.flatnonzero(new)
        count = np.diff(np.append(first, len(own)))
        rank = rank.copy()
        rank[own] = np.repeat(place[first], count)
        ranks.append(rank.astype(np.int32))
        many = np.repeat(count, count)
        own, many = own[many > 1], many[many > 1]
        whole = own % (2 * size) == 0
        blocks.append((own[whole], rank[own[whole]], rank[own[whole]] + many[whole]))
        if not len(own):
            return sa, ranks, blocks
        key = rank[own] * n + rank[own + size]  # a repeated prefix ends before the last symbol
        order = np.argsort(key, kind="stable")
        own, key = own[order], key[order]
        old = rank[own]
        head = np.flatnonzero(np.diff(old, prepend=-1))
        place = old + np.arange(len(own)) - np.repeat(head, np.diff(np.append(head, len(own))))
        sa[place] = own
        new = np.diff(key, prepend=-1) != 0
        size *= 2


def _ahead(ranks: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many symbols from i and from j on are equal."""
    n = np.zeros(len(i), np.int64)
    for k in reversed(range(len(ranks))):
        n += np.where(ranks[k][i + n] == ranks[k][j + n], 1 << k, 0)
    return n


def _behind(ranks: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many symbols before i and before j are equal; i < j."""
    n = np.zeros(len(i), np.int64)
    for k in reversed(range(len(ranks))):
        a, b = i - n - (1 << k), j - n - (1 << k)
        n += np.where((a >= 0) & (ranks[k][np.maximum(a, 0)] == ranks[k][np.maximum(b, 0)]), 1 << k, 0)
    return n


def _candidates(tree: WaveletTree, ranks: list[np.ndarray], size: int, p: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(block start, candidate period from size to 2 * size - 1)."""
    out = []
    after = p + size
    one = tree.successor(lo, hi, after)
    some = one < after + size
    p, lo, hi, one = p[some], lo[some], hi[some], one[some]
    out.append((p, one - p))
    two = tree.successor(lo, hi, one + 1)
    some = two < p + 2 * size
    p, lo, hi, one, two = p[some], lo[some], hi[some], one[some], two[some]
    out.append((p, two - p))
    some = tree.successor(lo, hi, two + 1) < p + 2 * size
    p, one, two = p[some], one[some], two[some]
    step = two - one
    out.append((p, one + _ahead(ranks, one, two) - p - _ahead(ranks, p, p + step)))
    out.append((p, one - _behind(ranks, one, two) - p + _behind(ranks, p, p + step)))
    p, d = np.concatenate([a for a, _ in out]), np.concatenate([b for _, b in out])
    fits = (d >= size) & (d < 2 * size)
    return p[fits], d[fits]


def _stretches(ids: np.ndarray, text: np.ndarray) -> Iterator[np.ndarray]:
    """Places of the words of each stretch that may hold runs; stretches of a text may overlap at their ends."""
    at, stretch = np.arange(len(ids)), text
    while len(at) >= 6:
        same = stretch[2:] == stretch[:-2]
        x = ids[at].astype(np.uint64)
        with np.errstate(over="ignore"):
            h = stretch[2:].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            for part in (x[:-2], x[1:-1], x[2:]):
                h = (h ^ part) * np.uint64(0xBF58476D1CE4E5B9)
                h ^= h >> np.uint64(29)
        bits = max(len(h) - 1, 1).bit_length() + 2
        h >>= np.uint64(64 - bits)
        h = h.astype(np.int64)
        good = same & (np.bincount(h[same], minlength=1 << bits)[h] >= 3)
        start = np.flatnonzero(good)
        cut = np.flatnonzero((np.diff(start) != 1) | (stretch[start[1:]] != stretch[start[:-1]]))
        first, last = start[np.append(0, cut + 1)] if len(start) else start, start[np.append(cut, len(start) - 1)] if len(start) else start
        long = last - first >= 3  # six words
        first, count = first[long], (last - first)[long] + 3
        before, at = len(at), at[np.repeat(first - np.append(0, np.cumsum(count)[:-1]), count) + np.arange(count.sum())] if len(first) else at[:0]
        stretch = np.repeat(np.arange(len(first)), count)
        if len(at) > 0.9 * before:
            break
    if len(at):
        yield from np.split(at, np.flatnonzero(np.diff(stretch)) + 1)


def find_runs(ids: np.ndarray, text: np.ndarray, least: int = 6, times: int = 4) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place of the first word, length, smallest period) of all runs, by start and period.

    ids: a number for each word; text: the number of its text, ascending. A run is as long as its
    period allows and has at least `least` (6 or more) words and `times` (4 or more) periods.
    """
    none = np.zeros(0, np.int64)
    stretches = list(_stretches(ids, text))
    if not stretches:
        return none, none, none
    length = np.array([len(s) for s in stretches])
    n = int(length.sum()) + len(stretches)
    ends = np.cumsum(length + 1) - 1
    word = np.ones(n, bool)
    word[ends] = False
    at = np.full(n, -1)
    at[word] = np.concatenate(stretches)
    own = np.repeat(np.arange(len(stretches)), length)
    symbols = np.empty(n, np.int64)
    symbols[word] = own * (int(ids.max()) + 1) + ids[at[word]]
    symbols[ends] = len(stretches) * (int(ids.max()) + 1) + np.arange(len(stretches))
    sa, ranks, blocks = ranked(symbols)
    tree = WaveletTree(sa, n.bit_length())
    found = [_candidates(tree, ranks, 1 << k, *b) for k, b in enumerate(blocks) if len(b[0])]
    if not found:
        return none, none, none
    p, d = np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])
    start, end = p - _behind(ranks, p, p + d), p + d + _ahead(ranks, p, p + d)
    fits = end - start >= np.maximum(least, times * d)
    runs = np.unique(np.stack([start, end, d], 1)[fits], axis=0)
    runs = runs[np.flatnonzero((np.diff(runs[:, :2], axis=0, prepend=-1) != 0).any(1))]  # of one place the smallest period
    start, length, period = at[runs[:, 0]], runs[:, 1] - runs[:, 0], runs[:, 2]
    order = np.unique(np.stack([start, period, length], 1), axis=0)
    return order[:, 0], order[:, 2], order[:, 1]


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(number of each word, text of each word); words end at ASCII white space."""
    split = pc.ascii_split_whitespace(texts.fill_null(""))
    text, words = pc.list_parent_indices(split), split.flatten()
    keep = pc.greater(pc.binary_length(words), 0)
    return words.filter(keep).dictionary_encode().indices.to_numpy().astype(np.int64), text.filter(keep).to_numpy().astype(np.int64)


def _slices(texts: pa.Array) -> Iterator[pa.Array]:
    size = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        end = max(int(np.searchsorted(size, (size[at - 1] if at else 0) + SLICE)), at + 1)
        yield texts.slice(at, end - at)
        at = end


_RUN = "struct<start:long,length:long,period:long>"


def periodic_runs(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, runs, collapsed): every run of a text's words (start, length, period; by start, then period), and its words without repetitions.

    A word is dropped if some run holds it after that run's first period; the others are joined by one
    space. A null text has no words. Null and repeated ids are rows like others, an empty table gives
    no rows, further columns are ignored, and texts are worked on whole, whatever their length.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for texts in _slices(batch.column(1)):
                ids, own = _words(texts)
                start, length, period = find_runs(ids, own)
                first = np.searchsorted(own, np.arange(len(texts) + 1))
                by_text = np.searchsorted(start, first)
                runs, collapsed = [], []
                for k, x in enumerate(texts):
                    words = (x.as_py() or "").encode().split()
                    s, n, p = (v[by_text[k] : by_text[k + 1]] for v in (start, length, period))
                    s = s - first[k]
                    if len(s):
                        edge = np.bincount(s + p, minlength=len(words) + 1) - np.bincount(s + n, minlength=len(words) + 1)
                        words = [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()]
                    runs.append([{"start": a, "length": b, "period": c} for a, b, c in zip(s.tolist(), n.tolist(), p.tolist(), strict=True)])
                    collapsed.append(b" ".join(words))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(texts)), pa.array(runs, pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))), pa.array(collapsed, pa.binary()).cast(pa.string())],
                    names=[id_col, "runs", "collapsed"])
                at += len(texts)

    return docs.select(id_col, text).mapInArrow(run, f"`{id_col}` {dict(docs.dtypes)[id_col]}, runs array<{_RUN}>, collapsed string")


def strongest(runs: Column) -> Column:
    """The run with the greatest length / period, compared exactly; of equals the first by start, then period."""
    better = lambda a, r: a.isNull() | (r["length"] * a["period"] > a["length"] * r["period"])
    return F.reduce(runs, F.lit(None).cast(_RUN), lambda a, r: F.when(better(a, r), r).otherwise(a))


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts, the strongest run and digests of the runs and of the collapsed text."""
    found = found.withColumn("best", strongest(F.col("runs")))
    listed = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    return found.select(
        id_col, F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.floor(1000 * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(listed, F.lit("\n"))).otherwise(F.lit("")), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def looped(ident: Column, text: Column) -> Column:
    """The text with its tail turned into a loop, for ids whose CRC-32 ends in 0: word i >= a becomes word a + (i - a) % p."""
    h = F.crc32(ident.cast("string").cast("binary"))
    g = F.floor(h / 10)

    def tail(words: Column) -> Column:
        n = F.size(words).cast("long")
        a = F.pmod(g, n)
        p = 1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))
        loop = F.transform(F.sequence(F.lit(0).cast("long"), n - a - 1), lambda i: F.get(words, (a + i % p).cast("int")))
        return F.when(n > 0, F.array_join(F.concat(F.slice(words, 1, a.cast("int")), loop), " ")).otherwise(F.lit(""))

    return F.when(h % 10 == 0, let(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)), tail)).otherwise(text)
