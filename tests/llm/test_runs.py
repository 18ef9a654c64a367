import hashlib
import zlib
from fractions import Fraction

import numpy as np
import pytest

from lodestone.llm.runs import WaveletTree, digest, find_runs, looped, periodic_runs, ranked

SCHEMA = "doc_id long, text string, runs int, collapsed string, best string"


def brute(words):
    """(start, length, period) by comparing every word with every later one."""
    found = {}
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q):
                found.setdefault((i, j + q - i), q)
            i = max(j, i + 1)
    return sorted((s, n, q) for (s, n), q in found.items())


def sample(rng):
    """Words of small alphabets with loops in loops, in blocks that repeat."""
    out = []
    while len(out) < rng.integers(0, 120):
        base = rng.integers(0, rng.integers(1, 4) + 1, rng.integers(1, 9)).tolist()
        inner = base * int(rng.integers(1, 7)) + rng.integers(0, 3, rng.integers(0, 4)).tolist()
        out += inner * int(rng.integers(1, 6)) if rng.random() < 0.7 else rng.integers(0, 40, rng.integers(1, 9)).tolist()
    return out


@pytest.mark.parametrize("seed", range(40))
def test_runs_equal_brute_force(seed):
    rng = np.random.default_rng(seed)
    texts = [sample(rng) for _ in range(25)]
    flat, own = np.array([w for t in texts for w in t], np.int64), np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    first = np.searchsorted(own, np.arange(len(texts)))
    want = [(s + int(a), n, q) for a, t in zip(first, texts, strict=True) for s, n, q in brute(t)]
    assert list(zip(*(v.tolist() for v in find_runs(flat, own)), strict=True)) == sorted(want, key=lambda r: (r[0], r[2]))


def test_all_binary_words():
    for n in range(6, 13):
        words = (np.arange(1 << n)[:, None] >> np.arange(n)) & 1
        own = np.repeat(np.arange(1 << n), n)
        want = [(k * n + s, m, q) for k, w in enumerate(words.tolist()) for s, m, q in brute(w)]
        assert list(zip(*(v.tolist() for v in find_runs(words.ravel(), own)), strict=True)) == sorted(want, key=lambda r: (r[0], r[2]))


def test_suffix_array_and_successor():
    rng = np.random.default_rng(1)
    x = np.append(rng.integers(0, 3, 200), 99)
    sa, ranks, blocks = ranked(x)
    assert sa.tolist() == sorted(range(201), key=lambda i: x[i:].tolist())
    for k, (p, lo, hi) in enumerate(blocks):
        for a, b, c in zip(p, lo, hi, strict=True):
            assert sorted(sa[b:c].tolist()) == [i for i in range(201) if x[i : i + 2**k].tolist() == x[a : a + 2**k].tolist()]
    tree, lo = WaveletTree(sa, 8), rng.integers(0, 150, 300)
    hi, least = lo + rng.integers(0, 50, 300), rng.integers(0, 256, 300)
    assert tree.successor(lo, hi, least).tolist() == [min([v for v in sa[a:b].tolist() if v >= m], default=256) for a, b, m in zip(lo, hi, least, strict=True)]


def expected(ident, text):
    words = (text or "").encode().split()
    h, n = zlib.crc32(str(ident).encode()), len(words)
    if ident is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute(words)
    drop = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None, None, None))
    sha = lambda b: hashlib.sha256(b).hexdigest()
    listed = "".join(f"{s},{m},{q}\n" for s, m, q in sorted(runs, key=lambda r: (r[0], r[2])))
    return ident, len(runs), *best, None if best[0] is None else 1000 * best[1] // best[2], sha(listed.encode()), sha(b" ".join(w for i, w in enumerate(words) if i not in drop))


def test_operator_with_odd_rows(spark):
    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{w}" for w in sample(rng)) for _ in range(60)]
    texts += [None, "", " \t\n ", "a " * 700, " x y \x1f z\x85 " * 9, "one　two\x0bone\x0ctwo " * 5, "x", "lone words in a row"]
    rows = [(i, t, 1, "", "") for i, t in enumerate(texts)] + [(None, texts[0], 1, "", ""), (3, texts[3], 1, "", ""), (3, texts[4], 1, "", "")]
    docs = spark.createDataFrame(rows, SCHEMA)
    from pyspark.sql import functions as F

    docs = docs.withColumn("text", looped(F.col("doc_id"), F.col("text")))
    got = sorted(map(tuple, digest(periodic_runs(docs)).collect()), key=str)
    assert got == sorted((expected(r[0], r[1]) for r in rows), key=str)
    assert periodic_runs(docs.limit(0)).collect() == []
