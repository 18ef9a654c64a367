"""Toxicity by weak supervision.

1. A lexicon is mined from all labelled rows: words and word beginnings whose share of toxic rows
   is far above the base rate, beyond what chance makes among so many terms.
2. Voters: the lexicon words are dealt over LEXICON_VOTERS voters; pattern voters look at word
   beginnings, repeated hits and hit density, and, without any label, at shouting, exclamation,
   address in the second person, drawn-out letters and masked words. Each voter fires or not.
3. The votes of all documents give first and second moments (one pass, a V x V sum). The label
   model reads the voters' accuracies from them: with independent errors the covariance of two
   voters is p(1-p) d_i d_j, so d is the rank-one factor of the off-diagonal covariances, fitted
   robustly; pairs that stay far above the factor are correlated and share their weight.
4. Posterior labels of a bounded sample of the labelled rows (`sample` rows), given the votes and
   the annotator's label, train a logistic regression on lexicon, beginning and voter features,
   which scores every whole text.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm._common import join_checked, written

WORD = re.compile(r"[^\W\d_]+")
LEXICON_VOTERS, PREFIX = 12, 6
MOST_COUNTED = 100_000  # terms that a task counts before it hands them on
PATTERNS = ("beginning", "two_beginnings", "two_words", "three_hits", "density", "shouting", "exclaiming", "addressing", "drawn_out", "masked")
#: Second-person pronouns of four languages.
SECOND_PERSON = frozenset("you your yours yourself du dich dir dein deine deinen tu te toi ton ta tes tú ti tus tuyo".split())
DRAWN_OUT = tuple(4 * c for c in "abcdefghijklmnopqrstuvwxyz")
MASKS = "*@#$%"
MASKED = re.compile(r"[^\W\d_][*@#$%]+[^\W\d_]")
VOTERS = LEXICON_VOTERS + len(PATTERNS)


@dataclass(frozen=True)
class Lexicon:
    """words and beginnings -> feature index; a word's voter is its index modulo LEXICON_VOTERS."""

    words: dict[str, int]
    beginnings: dict[str, int]

    @property
    def size(self) -> int:
        return len(self.words) + len(self.beginnings)


def _deal(ranked: list[str], start: int = 0) -> dict[str, int]:
    return {w: start + i for i, w in enumerate(ranked)}


def mine_lexicon(train: DataFrame, *, strength: float = 3.0, chance: float = 1.0) -> Lexicon:
    """train: (text, toxic). Keeps every word and beginning that passes, the strongest first.

    strength: least log-odds of toxic rows among the rows with the term over the base rate.
    chance: how many of all the terms may pass by chance. n rows with the term of which t are toxic
    have, at base rate p, a probability of at most exp(-n KL(t/n, p)), so the rows that a term needs
    follow the base rate and the number of terms: few where toxic rows are rare, more where they are
    frequent. The lexicon comes to the driver and to each task; it holds the marked vocabulary of
    toxic text, which is small beside the corpus, but has no fixed bound.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        toxic, seen = Counter(), Counter()  # a frequent term is one row of many texts

        def counted() -> pa.RecordBatch:
            cols = [pa.array([x for _, x in seen], pa.string()), pa.array([k for k, _ in seen], pa.int32()), pa.array([toxic[k] for k in seen], pa.int64()), pa.array(list(seen.values()), pa.int64())]
            return pa.RecordBatch.from_arrays(cols, names=["term", "kind", "t", "n"])

        for batch in batches:
            for text, y in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                w = set(WORD.findall((text.as_py() or "").lower()))
                for kind, found in ((0, w), (1, {x[:PREFIX] for x in w if len(x) > PREFIX})):
                    keys = [(kind, x) for x in found]
                    seen.update(keys)
                    if y:
                        toxic.update(keys)
                if len(seen) >= MOST_COUNTED:
                    yield counted()
                    toxic.clear()
                    seen.clear()
        yield counted()

    base = train.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("t")).first()
    if not base["t"] or base["t"] == base["n"]:
        return Lexicon({}, {})
    prior = np.log(base["t"] / (base["n"] - base["t"]))
    stats = train.mapInArrow(run, "term string, kind int, t long, n long").groupBy("kind", "term").agg(F.sum("t").alias("t"), F.sum("n").alias("n"))
    stats = written(stats.where(F.col("t") > 0), "terms")
    p = float(base["t"] / base["n"])
    t, n = F.col("t").cast("double"), F.col("n").cast("double")
    odds = F.log((t + 0.1) / (n - t + 0.1)) - F.lit(float(prior))
    surprise = t * F.log(t / n / p) + F.when(n > t, (n - t) * F.log((n - t) / n / (1 - p))).otherwise(0.0)
    strong = stats.withColumn("odds", odds).where((F.col("odds") >= strength) & (surprise >= F.lit(float(np.log(max(stats.count(), 1) / chance)))))
    strong = written(strong, "lexicon")
    rank = lambda kind: [r["term"] for r in strong.where(F.col("kind") == kind).orderBy(F.desc(F.col("odds") * F.sqrt("t")), "term").collect()]
    words = rank(0)
    return Lexicon(_deal(words), _deal(rank(1), len(words)))


def _masked(text: str | None) -> bool:
    """Whether a word has signs inside it, as in f**k."""
    return bool(text) and any(m in text for m in MASKS) and bool(MASKED.search(text))


def features(text: str | None, lex: Lexicon) -> tuple[list[int], np.ndarray, float]:
    """Indices of the lexicon entries that occur, the votes, and the log of the number of hits."""
    raw = WORD.findall(text) if text else []
    low = [w.lower() for w in raw]
    seen = set(low)
    hit = lex.words.keys() & seen
    begun = lex.beginnings.keys() & {w[:PREFIX] for w in seen if len(w) > PREFIX}
    n = sum(w in hit for w in low) if hit else 0
    votes = np.zeros(VOTERS, np.int64)
    found = [lex.words[w] for w in hit]
    votes[[i % LEXICON_VOTERS for i in found]] = 1
    votes[LEXICON_VOTERS:] = (
        len(begun) >= 1, len(begun) >= 2, len(hit) >= 2, n >= 3, n >= 1 and n * 150 >= len(low),
        len(raw) >= 5 and 2 * sum(w.isupper() and len(w) > 1 for w in raw) >= len(raw), bool(text) and text.count("!") * 20 >= len(raw) + 20,
        not SECOND_PERSON.isdisjoint(seen) and 15 * sum(w in SECOND_PERSON for w in low) >= len(low), any(len(w) >= 4 and any(x in w for x in DRAWN_OUT) for w in seen if len(set(w)) <= len(w) - 3), _masked(text))
    return sorted(found + [lex.beginnings[b] for b in begun]), votes, float(np.log1p(n))


def vote_moments(docs: DataFrame, lex: Lexicon) -> tuple[int, np.ndarray]:
    """(rows, V x V counts of two voters firing together) over all rows; one row per task reaches the sum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, m = 0, np.zeros((VOTERS, VOTERS), np.int64)
        for batch in batches:
            v = np.array([features(t.as_py(), lex)[1] for t in batch.column(0)]).reshape(-1, VOTERS)
            n, m = n + len(v), m + v.T @ v
        cells = np.append(m.ravel(), n)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(cells))), pa.array(cells)], names=["cell", "n"])

    cells = docs.select("text").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    flat = np.zeros(VOTERS * VOTERS + 1)
    for r in cells:
        flat[r["cell"]] = r["n"]
    return int(flat[-1]), flat[:-1].reshape(VOTERS, VOTERS)


@dataclass(frozen=True)
class LabelModel:
    """Log-odds of the class when a voter fires or abstains, and the share of weight it keeps."""

    prior: float
    fire: np.ndarray
    rest: np.ndarray
    share: np.ndarray

    def posterior(self, votes: np.ndarray, given: np.ndarray | float = 0.0) -> np.ndarray:
        """Probability of class 1; given: log-odds from elsewhere, such as an annotator's label."""
        odds = self.prior + given + (np.where(votes > 0, self.fire, self.rest) * self.share).sum(1)
        return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))


def fit_label_model(n: int, together: np.ndarray, prior: float, tie: float = 3.0) -> LabelModel:
    """prior: share of class 1. Voters that never or always fire get no weight."""
    rate = np.diag(together) / max(n, 1)
    cov = together / max(n, 1) - np.outer(rate, rate)
    live = (rate > 1e-6) & (rate < 1 - 1e-6)
    mask = np.outer(live, live) & ~np.eye(len(rate), dtype=bool)
    v = np.sqrt(np.maximum(rate * (1 - rate), 1e-12)) * 0.5
    for round_ in range(6):
        for _ in range(60):
            for i in np.flatnonzero(live):
                m = mask[i]
                v[i] = max(0.0, (cov[i, m] * v[m]).sum() / max((v[m] ** 2).sum(), 1e-18))
        over = cov - np.outer(v, v)
        spread = np.median(np.abs(over[mask])) if mask.any() else 0
        tied = mask & (over > tie * spread + 0.25 * np.outer(v, v))
        if round_ < 5:
            keep = (np.outer(live, live) & ~np.eye(len(rate), dtype=bool)) & ~tied
            few = keep.sum(1) < 3
            mask = np.where(few[:, None] | few[None, :], np.outer(live, live) & ~np.eye(len(rate), dtype=bool), keep)
    d = v / np.sqrt(prior * (1 - prior))
    hit = np.clip(rate + (1 - prior) * d, 1e-4, 0.999)
    miss = np.clip(rate - prior * d, 1e-5, 0.98)
    fire = np.where(live, np.log(hit / miss), 0.0)
    rest = np.where(live, np.log((1 - hit) / (1 - miss)), 0.0)
    useful = d > 1e-4
    strength = np.where(tied, np.clip(over / np.sqrt(np.maximum(np.outer(rate * (1 - rate), rate * (1 - rate)), 1e-18)), 0, 1), 0)
    share = np.where(live & useful, 1 / (1 + strength.sum(1)), 0.0)
    return LabelModel(float(np.log(prior / (1 - prior))), fire, rest, share)


@dataclass(frozen=True)
class Classifier:
    lexicon: Lexicon
    weights: np.ndarray  # lexicon entries, voters, log hits, bias

    def score(self, texts: list[str | None]) -> np.ndarray:
        w, n = self.weights, self.lexicon.size
        out = np.empty(len(texts))
        for k, t in enumerate(texts):
            found, votes, hits = features(t, self.lexicon)
            out[k] = w[found].sum() + votes @ w[n : n + VOTERS] + hits * w[-2] + w[-1]
        return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def fit_classifier(rows: list[tuple[list[int], np.ndarray, float]], target: np.ndarray, lex: Lexicon, *, steps: int = 300, rate: float = 0.1, decay: float = 1e-4) -> Classifier:
    """Logistic regression on posterior labels by full-batch Adam; features are few and sparse.

    A lexicon entry that none of the rows holds gets the mean weight of the held entries of its kind.
    """
    n = lex.size
    own = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    at = np.array([i for r in rows for i in r[0]], np.int64)
    dense = np.array([[*r[1], r[2], 1.0] for r in rows]).reshape(len(rows), VOTERS + 2)
    w = np.zeros(n + VOTERS + 2)
    m, s = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        z = np.bincount(own, w[at], len(rows)) + dense @ w[n:]
        e = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target) / max(len(rows), 1)
        g = np.concatenate([np.bincount(at, e[own], n)[:n], dense.T @ e]) + decay * w
        m, s = 0.9 * m + 0.1 * g, 0.999 * s + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-8)
    held = np.bincount(at, minlength=n)[:n] > 0
    for kind in (slice(0, len(lex.words)), slice(len(lex.words), n)):
        if held[kind].any():
            w[kind] = np.where(held[kind], w[kind], w[kind][held[kind]].mean())
    return Classifier(lex, w)


def sampled(rows: DataFrame, by: Column, n: int, most: int) -> DataFrame:
    """The `most` of n rows with the least hash `by`, added as h; of rows with one hash, which are repetitions, any."""
    rows = rows.withColumn("h", by)
    if n <= most:
        return rows
    least = [r["h"] for r in rows.select("h").orderBy("h").limit(most).collect()]  # `most` longs
    below = sum(h < least[-1] for h in least)
    return rows.where(F.col("h") < least[-1]).unionByName(rows.where(F.col("h") == least[-1]).limit(most - below))


def train_toxicity(docs: DataFrame, labels: DataFrame, *, sample: int = 20_000, annotator: float = 0.9, id_col: str = "doc_id") -> Classifier:
    """docs (doc_id, text) and labels (doc_id, toxic) of the rows one may learn from.

    sample bounds the labelled rows that the classifier is fitted to, chosen by the hash of id and
    text; the lexicon and the prior cover all labelled rows, the label model's moments all of docs.
    annotator: how often the given labels are taken to be right; they are one more voter of the
    rows that have them.
    Null labels, ids and texts are allowed (null text: empty); an id with several labels is toxic if
    one of them says so; repeated rows count each. Without any toxic label, or with empty tables,
    every score is the prior. Texts of any length count whole; other columns are ignored.
    """
    marked = written(labels.where("toxic is not null").groupBy(id_col).agg(F.max("toxic").cast("int").alias("toxic")), "labels")
    docs = docs.select(id_col, F.coalesce("text", F.lit("")).alias("text"))
    train = join_checked(docs, marked, id_col, "inner").select(id_col, "text", "toxic")
    lex = mine_lexicon(train.select("text", "toxic"))
    n, toxic = train.agg(F.count(F.lit(1)), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    prior = (toxic + 0.5) / (n + 1)
    total, together = vote_moments(docs, lex)
    model = fit_label_model(total, together, prior)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [features(t.as_py(), lex) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.list_(pa.int32())), pa.array([g[1] for g in got], pa.list_(pa.int64())), pa.array([g[2] for g in got], pa.float64()), batch.column(1), batch.column(2)], names=["found", "votes", "hits", "toxic", "h"])

    rows = sampled(train, F.xxhash64(id_col, "text"), n, sample).select("text", "toxic", "h").mapInArrow(run, "found array<int>, votes array<long>, hits double, toxic int, h long").collect()
    rows.sort(key=lambda r: (r["h"], r["toxic"]))  # in one order, however the rows were dealt
    given = np.where([r["toxic"] for r in rows], 1.0, -1.0) * np.log(annotator / (1 - annotator)) if rows else np.zeros(0)
    rows = [(list(r["found"]), np.array(r["votes"]), r["hits"]) for r in rows]
    target = model.posterior(np.array([r[1] for r in rows]).reshape(-1, VOTERS), given) if rows else np.zeros(0)
    return fit_classifier(rows, target, lex)


def score_toxicity(docs: DataFrame, model: Classifier, *, text_col: str = "text", out: str = "score") -> DataFrame:
    """All columns of docs and the score (0 to 1); only the text is looked at."""
    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(model.score(list(texts)))

    return docs.withColumn(out, score(F.coalesce(text_col, F.lit(""))))
