import hashlib
from math import floor

import numpy as np
import pytest

from lodestone.llm.vector_codes import encode, nearest, train_codebooks, walsh_hadamard, with_label_error

SCHEMA = "vec_id long, embedding array<double>, label int, code string, error string"


def brute(rows, parts=4, entries=256, rounds=4):
    kept = [(i, [floor(1024 * x) for x in v], g) for i, v, g in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(kept[0][1]) // parts
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for _, v, _ in kept]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    pick = lambda x, b: min((dist(x, e), j) for j, e in enumerate(b))
    for _ in range(rounds):
        for p in range(parts):
            own = {}
            for c in cut:
                own.setdefault(pick(c[p], books[p])[1], []).append(c[p])
            books[p] = [[sum(x) // len(own[j]) for x in zip(*own[j], strict=True)] if j in own else e for j, e in enumerate(books[p])]
    out = []
    for (i, _, g), c in zip(kept, cut, strict=True):
        found = [pick(c[p], books[p]) for p in range(parts)]
        out.append((i, "".join(f"{j:02x}" for _, j in found), min(sum(d for d, _ in found), 2**63 - 1), g))
    return sorted(out, key=str), hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()


def ran(spark, rows, **options):
    table = spark.createDataFrame([(i, v, g, "taken", "taken") for i, v, g in rows], SCHEMA)
    books = train_codebooks(table, **options)
    return sorted(((r["vec_id"], r["code"], r["error"], r["label"]) for r in encode(table, books).collect()), key=str), books.sha256()


def vectors(n, size, seed=0, scale=1.0):
    return (np.random.default_rng(seed).standard_normal((n, size)) * scale).tolist()


def test_equals_brute_force_with_odd_rows(spark):
    rows = [(i, v, i % 3) for i, v in enumerate(vectors(90, 12))]
    rows += [(3, rows[3][1], None), (None, vectors(1, 12, 5)[0], None), (200, None, 1), (201, [None] + [0.0] * 11, 1), (202, [float("nan")] * 12, 1), (203, [float("inf")] + [0.0] * 11, 1)]
    assert ran(spark, rows, entries=16) == brute(rows, entries=16)
    assert ran(spark, rows) == brute(rows)


def test_ties_go_to_the_lower_index_and_unused_entries_stay(spark):
    rows = [(i, [1.0, 0.0, -1.0, 0.5], 0) for i in range(6)] + [(9, [0.0] * 4, 0)]
    assert ran(spark, rows, entries=4) == brute(rows, entries=4)


def test_components_of_any_size_are_exact(spark):
    rows = [(i, v, 0) for i, v in enumerate(vectors(12, 8, scale=1e5) + vectors(6, 8, 1, 1e12) + vectors(3, 8, 2, 1e300) + vectors(6, 8, 3))]
    assert ran(spark, rows, entries=5) == brute(rows, entries=5)


def test_other_lengths_go_and_parts_are_filled_up(spark):
    rows = [(i, v, 0) for i, v in enumerate(vectors(10, 6))]
    found, _ = ran(spark, [*rows, (50, [1.0], 0), (51, [], 0)], entries=3)
    filled = [(i, [*v[:2], *v[2:4], *v[4:6], 0.0, 0.0], g) for i, v, g in rows]
    assert found == brute(filled, entries=3)[0]


def test_no_vector_at_all(spark):
    assert train_codebooks(spark.createDataFrame([], SCHEMA)) is None
    assert train_codebooks(spark.createDataFrame([(1, None, 0, "", "")], SCHEMA)) is None


@pytest.mark.parametrize("hot", [2, 1000])
def test_label_errors(spark, hot):
    coded = spark.createDataFrame([(1, 0, "a", 5), (2, 0, "a", 6), (3, 0, "a", 1), (4, None, "a", 7), (5, None, "a", 8), (6, 2, "a", 9)], "vec_id long, label int, code string, error long")
    assert {r["vec_id"]: r["label_error"] for r in with_label_error(coded, hot=hot).collect()} == {1: 12, 2: 12, 3: 12, 4: 15, 5: 15, 6: 9}


def test_nearest_is_exact_in_the_transformed_domain():
    rng = np.random.default_rng(4)
    x, e = rng.integers(-50, 50, (200, 11)), rng.integers(-50, 50, (40, 11))
    e[7] = e[3]
    index, d = nearest(walsh_hadamard(x), walsh_hadamard(e))
    full = ((x[:, None] - e[None]) ** 2).sum(2)
    assert (index == full.argmin(1)).all() and (d == 16 * full.min(1)).all()


def test_transform_is_in_sequency_order():
    h = walsh_hadamard(np.eye(8, dtype=np.int64)).T
    assert [(np.diff(r) != 0).sum() for r in h] == list(range(8)) and (h @ h.T == 8 * np.eye(8)).all()
