"""Joins within a distance: rows live in cells around sampled pivots and visit only cells that may hold a partner."""

from __future__ import annotations

import dataclasses
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coursewright.operators.blocks import block_pairs

#: Rows of a cell, about, and most cells, which is what each task and the driver hold of them.
CELL, MOST_CELLS = 512, 1024
#: Rows that one task compares with as many others; a cell of more is split.
BLOCK = 4096


def sampled(rows: DataFrame, key: str, column: str, cell: int | None = None, most: int | None = None) -> list:
    """Values of ``column`` of the rows with the smallest hashes of ``key``: one for about ``cell`` rows, ``most`` at most."""
    n = min(most or MOST_CELLS, math.ceil(rows.count() / (cell or CELL)))
    return [r[0] for r in rows.orderBy(F.xxhash64(key), key).limit(n).select(column).collect()]


def cell_join(visits: DataFrame, key: str, compare: Callable[[pa.Table, pa.Table, bool], pa.Table], schema: str) -> DataFrame:
    """``compare`` of the rows of each cell with each other and with its visitors.

    ``visits`` has ``cell``, ``visitor`` and what ``compare`` needs; it is
    evaluated twice, once to count. A cell of over ``BLOCK`` rows or visitors
    is dealt to pairs of blocks, so no task holds more than two. ``compare``
    gets two tables and whether they are the same one.
    """
    n = lambda c: F.ceil(F.count_if(c) / BLOCK).cast("int")
    counts = visits.groupBy("cell").agg(n(~F.col("visitor")).alias("homes"), n("visitor").alias("guests"))
    v = visits.join(F.broadcast(counts), "cell").withColumn("own", F.pmod(F.xxhash64(key), F.greatest(F.lit(1), F.when(F.col("visitor"), F.col("guests")).otherwise(F.col("homes")))).cast("int"))
    to = lambda c: F.explode(F.when(c > 0, F.sequence(F.lit(0), c - 1)))
    columns = [c for c in visits.columns if c not in ("cell", "visitor")]
    among = v.where("not visitor").withColumn("k", to(F.col("homes"))).select("cell", F.lit(False).alias("guest"), F.least("own", "k").alias("i"), F.greatest("own", "k").alias("j"), "visitor", "own", *columns)
    hosts = v.where("not visitor").withColumn("k", to(F.col("guests"))).select("cell", F.lit(True).alias("guest"), F.col("own").alias("i"), F.col("k").alias("j"), "visitor", "own", *columns)
    guests = v.where("visitor").withColumn("k", to(F.col("homes"))).select("cell", F.lit(True).alias("guest"), F.col("k").alias("i"), F.col("own").alias("j"), "visitor", "own", *columns)

    def run(ids: tuple, t: pa.Table) -> pa.Table:
        _, guest, i, j = (x.as_py() for x in ids)
        if not guest and i == j:
            return compare(t, t, True)
        second = t["visitor"].to_numpy() if guest else t["own"].to_numpy() == j
        return compare(t.filter(pa.array(~second)), t.filter(pa.array(second)), False)

    return among.union(hosts).union(guests).groupBy("cell", "guest", "i", "j").applyInArrow(run, schema)


def visiting(home: np.ndarray, may: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, cells and whether each is a visit, given each row's home and the cells that may hold a partner.

    Of two cells one visits the other, so no pair is met twice.
    """
    k = np.arange(may.shape[1])
    turn = np.where((home[:, None] + k) % 2 == 0, home[:, None] < k, home[:, None] > k)
    row, cell = np.nonzero(may & turn)
    return np.append(np.arange(len(home)), row), np.append(home, cell), np.append(np.zeros(len(home), bool), np.ones(len(row), bool))


def matrix(column: pa.ChunkedArray | pa.Array, dims: int) -> np.ndarray:
    c = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return c.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(c), dims)


def unit_rows(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


@dataclasses.dataclass(frozen=True)
class AngleCells:
    """Cells of vectors around pivots, with the largest angle of a member to its pivot."""

    pivots: np.ndarray
    radii: np.ndarray
    reach: float

    @classmethod
    def of(cls, vectors: DataFrame, threshold: float) -> AngleCells:
        """Cells of ``id, e`` for pairs with a cosine of at least ``threshold``."""
        pivots = unit_rows(np.array(sampled(vectors, "id", "e"), np.float64).reshape(-1, len(vectors.select("e").first()[0])))
        place, dims = cls(pivots, np.zeros(len(pivots)), 0.0).homes, pivots.shape[1]

        def largest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.full(len(pivots), -1.0)
            for b in batches:
                home, angle = place(matrix(b.column(0), dims))[:2]
                np.maximum.at(out, home, angle)
            some = np.flatnonzero(out >= 0)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(out[some])], names=["cell", "r"])

        radii = np.full(len(pivots), -np.inf)
        for r in vectors.select("e").mapInArrow(largest, "cell long, r double").groupBy("cell").agg(F.max("r").alias("r")).collect():
            radii[r["cell"]] = r["r"]
        return cls(pivots, radii, math.acos(max(-1.0, min(1.0, threshold))))

    def homes(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each vector's cell, its angle to that pivot and to all; the vector 0 is near everything and its cell reaches everywhere."""
        norm = np.linalg.norm(x, axis=1)
        angles = np.arccos(np.clip(unit_rows(x) @ self.pivots.T, -1, 1))
        angles[norm == 0] = 0.0
        home = angles.argmin(axis=1)
        return home, np.where(norm == 0, np.pi, angles[np.arange(len(x)), home]), angles

    def visits(self, vectors: DataFrame) -> DataFrame:
        """``cell, visitor, id, e``: every row at home, and where the angle to a pivot, less the cell's radius, allows a partner.

        A visitor's angle to a partner is at least its angle to the pivot less
        the partner's, so cells beyond that are not compared and no pair is lost.
        """
        homes, radii, reach, dims = self.homes, self.radii, self.reach, self.pivots.shape[1]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for s in range(0, b.num_rows, 1024):
                    part = b.slice(s, 1024)
                    home, _, angles = homes(matrix(part.column(1), dims))
                    row, cell, guest = visiting(home, angles <= reach + radii + 1e-7)
                    for k in range(0, len(row), 8192):
                        some = slice(k, k + 8192)
                        rows = part.take(pa.array(row[some]))
                        yield pa.RecordBatch.from_arrays([pa.array(cell[some]), pa.array(guest[some]), *rows.columns], names=["cell", "visitor", "id", "e"])

        return vectors.mapInArrow(run, f"cell long, visitor boolean, id {dict(vectors.dtypes)['id']}, e array<float>")


#: Vectors of a block, which is compared with every other.
VECTORS = 4096
#: How far a product of single precision may be off.
SLACK = 1e-4


def usable(vectors: DataFrame, threshold: float) -> DataFrame:
    """``id, e`` and other columns of the rows whose vector is not null and holds only finite entries; above 0, without those that have no direction."""
    v = vectors.where("embedding is not null").withColumn("e", F.col("embedding").cast("array<float>")).drop("embedding")
    v = v.where(F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))))
    return v.where(F.exists("e", lambda x: x != 0)) if threshold > 0 else v


@dataclasses.dataclass(frozen=True)
class _Block:
    """Unit vectors of a block, also in single precision, their mean direction and the largest angle to it (pi if a vector has no direction)."""

    rows: pa.Table
    unit: np.ndarray
    single: np.ndarray
    centre: np.ndarray
    radius: float

    @classmethod
    def of(cls, t: pa.Table, dims: int) -> _Block:
        unit = unit_rows(matrix(t["e"], dims))
        centre = unit_rows(unit.sum(axis=0, keepdims=True))[0]
        whole = bool((np.linalg.norm(unit, axis=1) > 0.5).all() and np.linalg.norm(centre) > 0.5)
        radius = float(np.arccos(np.clip((unit @ centre).min(), -1, 1))) if whole else math.pi
        return cls(t.drop_columns(["e"]), unit, unit.astype(np.float32), centre, radius)

    def far(self, other: _Block, threshold: float) -> bool:
        """Whether no pair of the two blocks can reach the threshold."""
        if math.pi in (self.radius, other.radius):
            return False
        return math.acos(max(-1.0, min(1.0, float(self.centre @ other.centre)))) - self.radius - other.radius > math.acos(max(-1.0, min(1.0, threshold))) + 1e-6


def _blocks(v: DataFrame, threshold: float, compare: Callable[[_Block, _Block, bool], Iterator[pa.RecordBatch]], schema: str, dims: int) -> DataFrame:
    """``compare`` of blocks of near vectors; those that are too far from each other do not meet."""
    cells = AngleCells.of(v.select("id", "e"), threshold)

    def house(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 1024):
                part = b.slice(k, 1024)
                home = cells.homes(matrix(part.column("e"), dims))[0]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(home.astype(np.int64))], names=[*part.schema.names, "home"])

    housed = v.mapInArrow(house, ", ".join(f"`{c}` {k}" for c, k in (*v.dtypes, ("home", "long"))))
    near = lambda x, y, same: iter(()) if not same and x.far(y, threshold) else compare(x, y, same)
    return block_pairs(housed, lambda t: _Block.of(t, dims), near, schema, VECTORS, ("home", "id"))


def _later(n: int, s: int, rows: int) -> np.ndarray:
    return np.arange(n) > np.arange(s, s + rows)[:, None]


def vector_pairs(vectors: DataFrame, threshold: float) -> DataFrame:
    """``id_1, id_2, score`` (id_1 < id_2) of ``id, embedding`` with a cosine of at least ``threshold``, to six digits; none is lost.

    Rows are ordered by cells around sampled pivots and packed into blocks;
    every two blocks meet in a task, unless the angle between them rules out
    a pair, and are multiplied as matrices in single precision. What may reach
    the threshold is multiplied in double precision. Pairs are not shuffled.
    Vectors without a direction have a cosine of 0 with all. Null vectors and
    those with null or non-finite entries are left out; all others must have
    one dimension. Further columns come along as ``c_1`` and ``c_2``.
    """
    v = usable(vectors, threshold)
    kinds = {c: k for c, k in v.dtypes if c != "e"}
    more = [c for c in kinds if c != "id"]
    first = v.select("e").first()
    if first is None:
        return vectors.sparkSession.createDataFrame([], ", ".join([f"id_1 {kinds['id']}, id_2 {kinds['id']}, score double", *[f"`{c}_{k}` {kinds[c]}" for c in more for k in (1, 2)]]))
    dims = len(first[0])

    def compare(x: _Block, y: _Block, same: bool) -> Iterator[pa.RecordBatch]:
        for s in range(0, len(x.single), 256):
            may = x.single[s : s + 256] @ y.single.T >= threshold - SLACK
            if same:
                may &= _later(len(y.single), s, len(may))
            p, q = np.divmod(np.flatnonzero(may), len(y.single))
            for k in range(0, len(p), 1 << 16):
                a, b = p[k : k + (1 << 16)] + s, q[k : k + (1 << 16)]
                score = np.round(np.einsum("ij,ij->i", x.unit[a], y.unit[b]), 6)
                hit = score >= threshold
                sides = [t.rows.take(pa.array(c[hit])) for t, c in ((x, a), (y, b))]
                columns = [t[c].combine_chunks() for t in sides for c in kinds]
                yield pa.RecordBatch.from_arrays([pa.array(score[hit]), *columns], names=["score", *[f"{c}_{z}" for z in "ab" for c in kinds]])

    schema = ", ".join(["score double", *[f"`{c}_{z}` {kind}" for z in "ab" for c, kind in kinds.items()]])
    found = _blocks(v, threshold, compare, schema, dims)
    lower = F.col("id_a") < F.col("id_b")
    side = lambda c, a, b: F.when(lower, F.col(f"{c}_{a}")).otherwise(F.col(f"{c}_{b}"))
    return found.select(side("id", "a", "b").alias("id_1"), side("id", "b", "a").alias("id_2"), "score", *[side(c, *z).alias(f"{c}_{k}") for c in more for k, z in ((1, "ab"), (2, "ba"))])


def vector_bands(vectors: DataFrame, edges: tuple[float, ...]) -> DataFrame:
    """``least, n``: how many pairs have a cosine, to six digits, of at least each edge and below the next; ``edges`` rise.

    Tasks count, so no pair leaves them. What single precision cannot tell
    from an edge is multiplied in double precision.
    """
    v = usable(vectors.select("id", "embedding"), edges[0])
    first = v.select("e").first()
    if first is None:
        return vectors.sparkSession.createDataFrame([], "least double, n long")
    dims = len(first[0])

    def compare(x: _Block, y: _Block, same: bool) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(edges), np.int64)
        for s in range(0, len(x.single), 256):
            score = x.single[s : s + 256] @ y.single.T
            if same:
                score[~_later(len(y.single), s, len(score))] = -2
            score = score.ravel()
            score = score[k] if len(k := np.flatnonzero(score >= edges[0] - SLACK)) else score[:0]
            for e, edge in enumerate(edges):
                close = np.abs(score - np.float32(edge)) <= SLACK
                total[e] += np.count_nonzero((score >= edge) & ~close)
                p, q = np.divmod(k[close], len(y.single))
                for c in range(0, len(p), 1 << 16):
                    exact = np.einsum("ij,ij->i", x.unit[p[c : c + (1 << 16)] + s], y.unit[q[c : c + (1 << 16)]])
                    total[e] += np.count_nonzero(np.round(exact, 6) >= edge)
        yield pa.RecordBatch.from_arrays([pa.array(edges), pa.array(total - np.append(total[1:], 0))], names=["least", "n"])

    return _blocks(v, edges[0], compare, "least double, n long", dims).groupBy("least").agg(F.sum("n").alias("n"))
