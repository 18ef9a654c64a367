"""Language identification as a mixture: expectation-maximisation over n-gram likelihoods.

Training counts hashed character trigrams per language over all learnable rows (one pass; the
model has languages x BUCKETS cells, whatever the corpus). A text is cut into segments of SEGMENT
trigrams; each segment has a likelihood under every language. EM finds the proportions of the
languages in the document; the set of its largest languages is grown by one language and refitted
as long as the penalised likelihood rises, and the best set wins. A set may hold any number of
languages.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKETS, SEGMENT, SLICE = 1 << 15, 24, 1_000_000
_letters: np.ndarray | None = None


def _is_letter(codes: np.ndarray) -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _letters[codes]


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text index, bucket) of the letter trigrams of each text, words padded by one blank."""
    joined = "\0".join(texts).lower()
    codes = np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)
    if not len(codes):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    doc = np.cumsum(codes == 0) - (codes == 0)  # a separator belongs to the text before it
    letter = _is_letter(codes)
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # the blank after a word
    codes, doc = np.where(letter, codes, 32)[keep].astype(np.uint32), doc[keep]
    before = np.concatenate([[np.uint32(32)], codes[:-1]])
    after = np.concatenate([codes[1:], [np.uint32(32)]])
    h = before * np.uint32(0x9E3779B1) + codes * np.uint32(0x85EBCA77) + after * np.uint32(0xC2B2AE3D)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    return doc, (h >> np.uint32(17)).astype(np.int64)


def sliced(texts: list[str | None]) -> Iterator[tuple[np.ndarray, list[str]]]:
    """Groups of (text numbers, parts) of about SLICE characters; a longer text comes in several parts, cut between words."""
    ids, parts, n = [], [], 0
    for i, t in enumerate(texts):
        t = (t or "").replace("\0", " ")
        at = 0
        while at < max(len(t), 1):
            end = at + SLICE
            while end < len(t) and t[end].isalpha():
                end += 1
            part = t[at:end]
            at = end
            ids.append(i)
            parts.append(part)
            n += len(part)
            if n >= SLICE:
                yield np.array(ids), parts
                ids, parts, n = [], [], 0
    if ids:
        yield np.array(ids), parts


@dataclass(frozen=True)
class LanguageModel:
    languages: list[str]
    logp: np.ndarray  # languages x BUCKETS


def train_languages(docs: DataFrame, *, smoothing: float = 0.5) -> LanguageModel:
    """docs: (text, lang); rows with a null text or lang teach nothing. Any number of languages, of BUCKETS floats each."""
    docs = docs.where("text is not null and lang is not null").select("lang", "text")
    langs = sorted(r["lang"] for r in docs.select("lang").distinct().collect())  # one short string a language
    place = {x: k for k, x in enumerate(langs)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            lang = batch.column(0).to_pylist()
            for ids, parts in sliced(batch.column(1).to_pylist()):
                doc, bucket = trigrams(parts)
                code = {x: k for k, x in enumerate(sorted({lang[i] for i in ids}))}
                own = np.array([code[lang[i]] for i in ids])[doc] if len(doc) else doc
                both = np.bincount(own * BUCKETS + bucket, minlength=len(code) * BUCKETS)
                for x, k in code.items():
                    counts[x] = counts.get(x, 0) + both[k * BUCKETS : (k + 1) * BUCKETS]
        for x, c in counts.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([x] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(c[at].astype(np.int64))], names=["lang", "bucket", "n"])

    total = np.full((len(langs), BUCKETS), smoothing, np.float32)
    cells = docs.mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    for r in cells.toLocalIterator():  # languages x BUCKETS rows at most
        total[place[r["lang"]], r["bucket"]] += r["n"]
    return LanguageModel(langs, np.log(total / total.sum(1, keepdims=True)) if langs else total)


def segment_likelihoods(texts: list[str | None], model: LanguageModel) -> tuple[np.ndarray, np.ndarray]:
    """(text number, log-likelihood under each language) of every segment, in text order."""
    docs, parts_ll = [], []
    for ids, parts in sliced(texts) if model.languages else ():
        doc, bucket = trigrams(parts)
        if not len(doc):
            continue
        new = np.flatnonzero(np.diff(doc, prepend=-1))
        at = np.arange(len(doc)) - np.repeat(new, np.diff(np.append(new, len(doc))))
        begin = np.flatnonzero(at % SEGMENT == 0)
        parts_ll.append(np.stack([np.add.reduceat(p[bucket], begin) for p in model.logp], 1))
        docs.append(ids[doc[begin]])
    if not docs:
        return np.zeros(0, np.int64), np.zeros((0, len(model.languages)))
    return np.concatenate(docs), np.concatenate(parts_ll)


def mixture(doc: np.ndarray, ll: np.ndarray, docs: int, *, rounds: int = 12, penalty: float = 3.0) -> np.ndarray:
    """docs x languages proportions; languages outside the chosen set are 0. All zero: no letters.

    doc: sorted text numbers of the segments; ll: their log-likelihoods.
    """
    n_lang = ll.shape[1]
    best = np.zeros((docs, n_lang))
    if not len(doc) or not n_lang:
        return best
    begin = np.flatnonzero(np.diff(doc, prepend=-1))
    have = doc[begin]
    size = np.diff(np.append(begin, len(doc)))
    like = np.exp(ll - ll.max(1, keepdims=True))

    def em(pi: np.ndarray, steps: int, like: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own, first = np.repeat(np.arange(len(size)), size), np.cumsum(size) - size
        for _ in range(steps):
            r = pi[own] * like
            r /= r.sum(1, keepdims=True) + 1e-300
            pi = np.add.reduceat(r, first, 0) / size[:, None]
        return pi, np.add.reduceat(np.log((pi[own] * like).sum(1) + 1e-300), first)

    full, _ = em(np.full((len(begin), n_lang), 1 / n_lang), rounds, like, size)
    rank = np.argsort(np.argsort(-full, 1, kind="stable"), 1)
    chosen, value, live = np.zeros_like(full), np.full(len(begin), -np.inf), np.arange(len(begin))
    for m in range(1, n_lang + 1):
        # only the texts for which the last language was worth its penalty grow on
        segments = np.repeat(np.isin(np.arange(len(begin)), live), size)
        start = np.where(rank[live] < m, np.maximum(full[live], 1e-6), 0)
        pi, fit = em(start / start.sum(1, keepdims=True), 5 if m > 1 else 0, like[segments], size[live])
        fit = fit - penalty * (m - 1) * np.log(size[live] + 1)
        better = fit > value[live]
        live = live[better]
        value[live], chosen[live] = fit[better], pi[better]
        if not len(live):
            break
    best[have] = chosen
    return best


def identify(docs: DataFrame, model: LanguageModel, *, id_col: str = "doc_id", text_col: str = "text", keep: tuple | list = ()) -> DataFrame:
    """(doc_id, *keep, languages array<struct<lang, share>>): the chosen set, largest share first.

    One row per row of docs, repeated rows and null ids included. Null texts and texts without a
    letter have an empty set; ties in share fall to the language that sorts first. A model without
    languages gives empty sets, an empty table no rows. Texts of any length are read whole, in
    slices. Other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            share = mixture(*segment_likelihoods(batch.column(0).to_pylist(), model), batch.num_rows)
            found = [[{"lang": model.languages[k], "share": float(row[k])} for k in np.argsort(-row, kind="stable") if row[k] > 0] for row in share]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(found, pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())])))], names=[*batch.schema.names[1:], "languages"])

    rows = docs.select(F.col(text_col).alias("text"), F.col(id_col).alias("doc_id"), *keep)
    fields = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in rows.columns[1:])
    return rows.mapInArrow(run, f"{fields}, languages array<struct<lang:string,share:double>>")
