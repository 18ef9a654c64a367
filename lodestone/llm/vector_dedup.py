"""Embedding near-dedup: all links of cosine at least a threshold, by a subspace pigeonhole join.

Unit vectors are rotated (random signs and Walsh-Hadamard transforms) and split into blocks of
`block` coordinates. A squared distance within the budget of the threshold is, in some block, within
the block's share of it, in proportion to its coordinates; so each block is range-joined under its
share, and what it finds is verified by the cosine of the whole vectors. Nothing is probabilistic.

The range join of a block: a vector is at home in the cell of the nearest of `pivots` vectors and
visits those cells of lower number whose border lies within the range, so a pair meets in one cell a
block. A cell is worked on in tiles of about `left` rows at home against `right` rows, so a task's
memory does not depend on the size of a cell. Tiles give sums of links and a spanning forest, at
most one row for each of their vectors, never pairs. A pair that several blocks find counts in the
first: rotated coordinates are rounded to integers whose distances are exact in any order of
summing, so all tasks agree on which block that is.

Equal vectors are counted first and joined once. The work grows with the vectors that a range
reaches: where vectors fill all directions evenly and the range is wide (64 coordinates, 0.95), a
vector still meets about a sixth of all others in each block.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm._common import components, join_groups, vector_matrix, written
from lodestone.llm.vector_codes import walsh_hadamard

#: Units of a rounded coordinate; rows of a comparison; vectors that pivots are taken from; cosines this near to the threshold are summed exactly.
UNIT, ROWS, SAMPLE, NEAR = 1 << 25, (512, 2048), 256, 1e-9


@cache
def _signs(size: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(size)
    return rng.choice([-1.0, 1.0], size), rng.choice([-1.0, 1.0], size)


def units(matrix: np.ndarray) -> np.ndarray:
    """Rows at length 1; the result for a row does not depend on the others."""
    x = np.ldexp(matrix, -np.frexp(np.abs(matrix).max(1))[1][:, None])
    square = np.zeros(len(x))
    for j in range(x.shape[1]):  # in a fixed order
        square += x[:, j] * x[:, j]
    return x / np.sqrt(square)[:, None]


def rotated(unit: np.ndarray) -> np.ndarray:
    """Unit rows, zero-padded and rotated, in rounded multiples of 1 / UNIT."""
    size = 1 << max(unit.shape[1] - 1, 0).bit_length()
    x = np.zeros((len(unit), size))
    x[:, : unit.shape[1]] = unit
    for s in _signs(size):
        x = walsh_hadamard(x * s) / math.sqrt(size)
    return np.rint(x * UNIT)


class _Blocks:
    """The blocks of vectors of one length: their places, ranges and pivots."""

    def __init__(self, size: int, threshold: float, block: int, pivots: np.ndarray | None):
        full = 1 << max(size - 1, 0).bit_length()
        slack = 8 * math.sqrt(full) / UNIT
        self.places = [slice(a, min(a + block, full)) for a in range(0, full, block)]
        self.budgets = [math.floor((2 - 2 * threshold + slack) * UNIT * UNIT * (p.stop - p.start) / full) for p in self.places]
        self.pivots = [np.zeros((1, p.stop - p.start)) if pivots is None else np.unique(pivots[:, p], axis=0) for p in self.places]

    def cells(self, x: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(block, home cell of every row, rows x cells: is it visited)."""
        for b, (at, budget, pivots) in enumerate(zip(self.places, self.budgets, self.pivots, strict=True)):
            d, between = squares(x[:, at], pivots), squares(pivots, pivots)
            home = d.argmin(1)
            reach = 2 * np.sqrt(between[home]) * (math.sqrt(budget) + 1)
            yield b, home, (np.arange(len(pivots)) < home[:, None]) & (d - d.min(1)[:, None] <= reach * (1 + 1e-9))


class _Lengths:
    """_Blocks by length of the vectors, made where they are first needed."""

    def __init__(self, threshold: float, block: int, pivots: dict[int, np.ndarray]):
        self.threshold, self.block, self.pivots, self.made = threshold, block, pivots, {}

    def __call__(self, size: int) -> _Blocks:
        if size not in self.made:
            self.made[size] = _Blocks(size, self.threshold, self.block, self.pivots.get(size))
        return self.made[size]


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows; exact for integers of at most UNIT, whatever the order of summing."""
    left = np.concatenate([a, (a * a).sum(1)[:, None], np.ones((len(a), 1))], 1)
    right = np.concatenate([-2 * b, np.ones((len(b), 1)), (b * b).sum(1)[:, None]], 1)
    return left @ right.T


def _cosine(a: np.ndarray, b: np.ndarray) -> float:
    """Summed without rounding errors, so that every task gets the same."""
    dot = lambda x, y: math.fsum((x * y).tolist())
    return dot(a, b) / math.sqrt(dot(a, a) * dot(b, b))


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least node of the component of each of n nodes, for edges a - b."""
    root = np.arange(n)
    while len(a):
        x, y = root[a], root[b]
        apart = x != y
        a, b = a[apart], b[apart]
        np.minimum.at(root, np.maximum(x, y)[apart], np.minimum(x, y)[apart])  # roots hang on smaller roots
        while (up := root[root] < root).any():
            root[up] = root[root[up]]
    return root


def _tile(blocks: _Blocks, block: int, threshold: float, left: tuple, right: tuple) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Linked (left row, right row) of a tile that no earlier block finds. A side: ids, at home, units, rotated."""
    at = blocks.places[block]
    for i in range(0, len(left[0]), ROWS[0]):
        rows = slice(i, i + ROWS[0])
        for j in range(0, len(right[0]), ROWS[1]):
            cols = slice(j, j + ROWS[1])
            found = squares(left[3][rows, at], right[3][cols, at]) <= blocks.budgets[block]
            if not found.any():
                continue
            r, c = np.flatnonzero(found.any(1)) + i, np.flatnonzero(found.any(0)) + j
            found = found[np.ix_(r - i, c - j)] & ((left[0][r][:, None] < right[0][c]) | ~right[1][c])
            for earlier in range(block):
                found &= squares(left[3][r, blocks.places[earlier]], right[3][c, blocks.places[earlier]]) > blocks.budgets[earlier]
            cosine = left[2][r] @ right[2][c].T
            for x, y in np.argwhere(found & (np.abs(cosine - threshold) < NEAR)):
                cosine[x, y] = _cosine(left[2][r[x]], right[2][c[y]])
            x, y = np.nonzero(found & (cosine >= threshold))
            yield r[x], c[y]


def _matrix(column: pa.Array, kind: str, size: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, size).astype(np.float64)


def near_links(rows: DataFrame, *, threshold: float = 0.95, id_col: str = "vec_id", vector: str = "embedding", block: int = 16, pivots: int = 16, left: int = 8192, right: int = 32768) -> DataFrame:
    """(id, n_links, component_id, kept) of every row: its direct links, the least id that links reach, whether it is that one.

    A null, empty or zero vector and one with a null or non-finite component link with nothing, as do
    vectors of different lengths. Rows that repeat an id are vectors of their own and link like
    others; rows with a null id take part, and `kept` is null for them. Equal vectors link with each
    other. An empty table gives no rows; further columns are ignored. threshold: 0.5 to 1.
    """
    if not 0.5 <= threshold <= 1:
        raise ValueError("threshold must be from 0.5 to 1")
    kind = "<f4" if dict(rows.dtypes)[vector] == "array<float>" else "<f8"
    ids = dict(rows.dtypes)[id_col]

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[bytes | None] = [None] * len(batch)
            for size in np.unique(np.diff(batch.column(2).offsets.to_numpy())):
                at, x = vector_matrix(batch.column(2), int(size))
                for i, v in zip(at, x, strict=True):
                    if v.any():
                        out[i] = (v + 0.0).astype(kind).tobytes()  # one sign of zero
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], names=["_row", "id", "v"])

    numbered = rows.select(F.monotonically_increasing_id().alias("_row"), F.col(id_col).alias("id"), F.col(vector).alias("v"))
    numbered = written(numbered.mapInArrow(packed, f"_row long, id {ids}, v binary"), "vectors")
    able = numbered.where("v is not null")
    groups = written(able.groupBy("v").agg(F.min("_row").alias("rep"), F.min("id").alias("low"), F.count(F.lit(1)).alias("_n")), "vector-groups")

    width = int(kind[-1])
    seen: dict[int, list[bytes]] = {}
    for r in groups.select("v").orderBy(F.xxhash64("v"), "v").limit(SAMPLE).collect():
        seen.setdefault(len(r["v"]) // width, []).append(bytes(r["v"]))
    chosen = {size: rotated(units(np.frombuffer(b"".join(vs[:pivots]), kind).reshape(-1, size).astype(np.float64))) for size, vs in seen.items()}

    of = _Lengths(threshold, block, chosen)

    def by_length(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        lengths = pc.binary_length(column).to_numpy() // width
        for size in np.unique(lengths).tolist():
            at = np.flatnonzero(lengths == size)
            for k in range(0, len(at), 4096):
                yield size, at[k : k + 4096], _matrix(column.take(pa.array(at[k : k + 4096])), kind, size)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int, int], np.ndarray] = {}
        for batch in batches:
            for size, _, x in by_length(batch.column(0)):
                for b, home, visited in of(size).cells(rotated(units(x))):
                    n = np.stack([np.bincount(home, minlength=visited.shape[1]), visited.sum(0)], 1)
                    for cell in np.flatnonzero(n.any(1)).tolist():
                        total[size, b, cell] = total.get((size, b, cell), 0) + n[cell]
        keys = np.array(list(total), np.int32).reshape(-1, 3)
        sums = np.array(list(total.values()), np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([*(pa.array(k) for k in keys.T), *(pa.array(s) for s in sums.T)], names=["size", "block", "cell", "home", "visiting"])

    sizes = groups.select("v").mapInArrow(counted, "size int, block int, cell int, home long, visiting long").groupBy("size", "block", "cell").agg(F.sum("home").alias("home"), F.sum("visiting").alias("visiting"))
    #: tiles of the cells that need more than one: a row for every `left` rows of a block at most
    tiles = {(r["size"], r["block"], r["cell"]): (-(-r["home"] // left) or 1, -(-(r["home"] + r["visiting"]) // right)) for r in sizes.where((F.col("home") > left) | (F.col("home") + F.col("visiting") > right)).collect()}

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for every tile that a vector is needed in; side: 0 visits, 1 at home on the left, 2 on the right, 3 on both."""
        for batch in batches:
            rep = batch.column(0).to_numpy()
            for size, at, x in by_length(batch.column(1)):
                for b, home, visited in of(size).cells(rotated(units(x))):
                    out: list[tuple[np.ndarray, ...]] = []
                    for cell in np.unique(np.concatenate([home, np.flatnonzero(visited.any(0))])).tolist():
                        here, there = at[home == cell], at[visited[:, cell]]
                        m, n = tiles.get((size, b, cell), (1, 1))
                        if m == n == 1:
                            out += [(here, cell, 0, 0, 3), (there, cell, 0, 0, 0)]
                            continue
                        mix = lambda rows: (rep[rows] * 0x9E3779B1 >> 7) & 0x7FFFFFFF
                        for j in range(n):
                            out.append((here, cell, mix(here) % m, j, 1))
                        for i in range(m):
                            out += [(here, cell, i, mix(here) % n, 2), (there, cell, i, mix(there) % n, 0)]
                    where = np.concatenate([o[0] for o in out])
                    full = [np.concatenate([np.broadcast_to(o[k], len(o[0])) for o in out]).astype(np.int32) for k in (1, 2, 3, 4)]
                    same = lambda v, n=len(where): pa.array(np.full(n, v, np.int32))
                    took = pa.array(where)
                    yield pa.RecordBatch.from_arrays([same(size), same(b), *map(pa.array, full), batch.column(0).take(took), batch.column(2).take(took), batch.column(1).take(took)], names=["size", "block", "cell", "i", "j", "side", "rep", "_n", "v"])

    def summed(key: tuple, table: pa.Table) -> pa.Table:
        rep, n, side = (table[c].to_numpy() for c in ("rep", "_n", "side"))
        size, b = key[0].as_py(), key[1].as_py()
        unit = units(_matrix(table["v"].combine_chunks(), kind, size))
        turned = rotated(unit)
        own, other = np.flatnonzero(side & 1), np.flatnonzero(side != 1)
        names, place = np.unique(rep, return_inverse=True)
        links, root = np.zeros(len(names), np.int64), np.arange(len(names))
        side_of = lambda rows: (rep[rows], side[rows] > 0, unit[rows], turned[rows])
        for x, y in _tile(of(size), b, threshold, side_of(own), side_of(other)):
            x, y = own[x], other[y]
            np.add.at(links, place[x], n[y])
            np.add.at(links, place[y], n[x])
            root = root[forest(len(names), np.concatenate([np.arange(len(names)), place[x]]), np.concatenate([root, place[y]]))]
        hit = np.flatnonzero(links)
        return pa.table({"rep": names[hit], "n_links": links[hit], "root": names[root[hit]]})

    tiled = groups.select("rep", "v", "_n").mapInArrow(dealt, "size int, block int, cell int, i int, j int, side int, rep long, _n long, v binary")
    found = written(tiled.groupBy("size", "block", "cell", "i", "j").applyInArrow(summed, "rep long, n_links long, root long"), "links")

    label = components(found.where("rep <> root").select(F.col("rep").alias("a"), F.col("root").alias("b")))
    sums = found.groupBy("rep").agg(F.sum("n_links").alias("n_links"))
    known = groups.select("rep", "low", "_n").join(sums, "rep", "left").where("_n > 1 or n_links is not null")
    known = written(known.join(label, known.rep == label.id, "left").select("rep", "low", "_n", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("label", "rep").alias("label")), "linked")
    least = written(known.groupBy("label").agg(F.min("low").alias("component_id"), F.count(F.lit(1)).alias("_m")), "components")
    known = written(join_groups(known, least, "label", size="_m").select("rep", "_n", (F.col("n_links") + F.col("_n") - 1).alias("n_links"), "component_id"), "known")

    several = written(groups.where("_n > 1").select("v", "rep", F.col("_n").alias("_c")), "copies")
    copies = join_groups(able.select("_row", "v"), several, "v", size="_c").select("_row", "rep")
    state = join_groups(copies, known.where("_n > 1"), "rep").select("_row", "n_links", "component_id")
    state = state.unionByName(known.where("_n = 1").select(F.col("rep").alias("_row"), "n_links", "component_id"))
    out = numbered.select("_row", "id").join(state, "_row", "left").select("id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))
