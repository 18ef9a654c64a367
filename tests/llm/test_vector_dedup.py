import numpy as np
import pytest

from lodestone.llm.vector_dedup import forest, near_links, rotated, squares, units

SCHEMA = "vec_id long, embedding array<double>, label int, rep int, v string"


def brute(rows, threshold):
    able = [(k, np.array(v, float)) for k, (_, v) in enumerate(rows) if v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    unit = {k: v / np.abs(v).max() / np.linalg.norm(v / np.abs(v).max()) for k, v in able}
    n, root = [0] * len(rows), list(range(len(rows)))
    for k, v in unit.items():
        for m, w in unit.items():
            if k < m and len(v) == len(w) and v @ w >= threshold:
                n[k], n[m] = n[k] + 1, n[m] + 1
                a, b = root[k], root[m]
                root = [min(a, b) if r in (a, b) else r for r in root]
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[root[k]] = min(i, least.get(root[k], i))
    return sorted(((i, n[k], least.get(root[k]), None if i is None else i == least[root[k]]) for k, (i, _) in enumerate(rows)), key=str)


def ran(spark, rows, **options):
    table = spark.createDataFrame([(i, v, 0, 0, "taken") for i, v in rows], SCHEMA).repartition(3)
    return sorted(map(tuple, near_links(table, **options).collect()), key=str)


def clustered(n, size, groups, noise, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((groups, size))
    return (centres[rng.integers(0, groups, n)] + noise * rng.standard_normal((n, size)) * rng.random((n, 1))).tolist()


@pytest.mark.parametrize(("threshold", "size", "left", "right"), [(0.95, 64, 2048, 8192), (0.95, 48, 20, 50), (0.8, 20, 2048, 8192), (0.9, 5, 7, 11)])
def test_equals_brute_force(spark, threshold, size, left, right):
    rows = list(enumerate(clustered(150, size, 12, 0.4)))
    assert ran(spark, rows, threshold=threshold, left=left, right=right) == brute(rows, threshold)


def test_odd_rows(spark):
    v = clustered(6, 8, 2, 0.1)
    rows = [(5, v[0]), (4, v[0]), (4, v[0]), (None, v[0]), (9, v[1]), (7, None), (8, [0.0] * 8), (1, [None] * 8), (2, [float("nan")] * 8), (3, [float("inf")] * 8), (6, []), (10, v[0][:4]), (11, v[0][:4]),
            (12, [1e300] * 8), (13, [1e-300] * 8), (14, [-0.0] * 7 + [1.0]), (15, [0.0] * 7 + [2.0])]
    assert ran(spark, rows) == brute(rows, 0.95)
    assert ran(spark, []) == []
    assert ran(spark, [(1, None)]) == [(1, 0, 1, True)]


def test_chains_and_copies_in_many_tiles(spark):
    turn = [[float(np.cos(0.2 * k)), float(np.sin(0.2 * k)), 0.0, 0.0] for k in range(12)]
    rows = [(100 - i, turn[i % 12]) for i in range(60)] + [(200 + i, turn[3]) for i in range(40)]
    assert ran(spark, rows, left=3, right=5) == brute(rows, 0.95)


def test_rounded_rotation_keeps_distances_and_is_the_same_in_any_batch():
    u = units(np.random.default_rng(1).standard_normal((50, 33)))
    r = rotated(u)
    assert (rotated(u[7:8]) == r[7:8]).all() and (units(u[7:8] * 3) == units(u * 3)[7:8]).all()
    assert np.abs(squares(r, r) / 2.0**50 - squares(u, u)).max() < 1e-6
    assert (squares(r[:, :9], r[:, :9]) == ((r[:, None, :9] - r[None, :, :9]) ** 2).sum(2)).all()


def test_forest_joins_what_is_linked():
    rng = np.random.default_rng(2)
    for n, m in ((40, 30), (200, 190), (1, 0)):
        a, b = rng.integers(0, n, (2, m))
        root = list(range(n))
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            p, q = root[x], root[y]
            root = [min(p, q) if r in (p, q) else r for r in root]
        assert forest(n, a, b).tolist() == root
    assert forest(1000, np.arange(999), np.arange(1, 1000)).max() == 0
