"""Embedding whitening: principal components by Chebyshev-filtered subspace iteration.

The covariance is never formed: each pass over the table multiplies it into a
thin block, and only blocks of ``dimensions x width`` reach the driver.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coursewright.llm.common import arrow_map, table
from coursewright.llm.vectors import sum_vectors

SCALE, OFFSET = 1024, 100_000
#: Larger entries count as this, so that integers stay exact in a double.
MOST = 2.0**45
COMPONENTS = 8
#: Columns of the iterated block, and degree of the polynomial of a round.
BLOCK, DEGREE = 16, 4
#: Residual of an eigenpair over the largest eigenvalue at which it is certified, and rounds to reach it.
TOLERANCE, ROUNDS = 1e-13, 100
#: Elements of a slice of rows that a task centres at once.
SLICE = 1 << 19


def _integers(column: pa.Array, dims: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Which rows remain, and their integer vectors; shorter ones are filled up with zeros."""
    size = np.diff(column.offsets.to_numpy()) if len(column) else np.zeros(0, int)
    there = np.asarray(column.is_valid())
    size = np.where(there, size, 0)
    entries = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    row = np.repeat(np.arange(len(column)), size)
    keep = there & (np.bincount(row[~np.isfinite(entries)], minlength=len(column)) == 0)
    dims = int(size[keep].max(initial=0)) if dims is None else dims
    with np.errstate(invalid="ignore", over="ignore"):
        x = (np.clip(np.floor(SCALE * np.where(np.isfinite(entries), entries, 0.0)), -MOST, MOST)).astype(np.int64) + OFFSET
    if keep.all() and (size == dims).all():
        return keep, x.reshape(len(column), dims)
    out = np.full((len(column), dims), OFFSET, np.int64)
    place = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
    used = keep[row]
    out[row[used], place[used]] = x[used]
    return keep, out[keep]


def _slices(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[np.ndarray]:
    step = max(1, SLICE // max(dims, 1))
    for b in batches:
        for k in range(0, b.num_rows, step):
            yield _integers(b.column(0).slice(k, step), dims)[1]


@dataclasses.dataclass(frozen=True)
class Passes:
    """Passes over one table of vectors: its size, its exact sums, and products with its covariance."""

    vectors: DataFrame
    tasks: int
    dims: int
    n: int
    sums: np.ndarray

    @classmethod
    def over(cls, vectors: DataFrame) -> Passes:
        """Two passes: the dimension, which is that of the longest remaining vector, then count and sums."""
        finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
        c = vectors.columns[0]
        longest = vectors.where(F.col(c).isNotNull() & F.forall(c, finite)).agg(F.max(F.size(c))).first()[0]
        dims, tasks = longest or 0, vectors.rdd.getNumPartitions()

        def fn(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
            total = np.zeros(dims + 1, np.int64)
            for x in _slices(batches, dims):
                total += np.concatenate([[len(x)], x.sum(axis=0)])
            return total

        total = sum_vectors(vectors, fn, dims + 1, "int64", tasks=max(tasks, 1))
        return cls(vectors, max(tasks, 1), dims, int(total[0]), total[1:])

    @property
    def centred(self) -> Callable[[np.ndarray], np.ndarray]:
        """x - S/n as a function of x; the whole part of the mean is taken off as an integer."""
        mean = self.sums // self.n if self.n else self.sums
        rest = (self.sums - mean * self.n) / max(self.n, 1)
        return lambda x: (x - mean) - rest

    def covariance_times(self, q: np.ndarray) -> tuple[np.ndarray, float]:
        """V q and the trace of V, in one pass."""
        dims, width, centred, n = *q.shape, self.centred, self.n

        def fn(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
            total, squares = np.zeros((dims, width)), 0.0
            for x in _slices(batches, dims):
                y = centred(x)
                total += y.T @ (y @ q)
                squares += np.einsum("ij,ij->", y, y)
            return np.append(total.ravel(), squares)

        out = sum_vectors(self.vectors, fn, dims * width + 1, tasks=self.tasks) / n
        return out[:-1].reshape(dims, width), float(out[-1])

    def projected_covariance(self, w: np.ndarray) -> np.ndarray:
        """Covariance of the centred vectors times ``w``."""
        dims, centred, k = self.dims, self.centred, w.shape[1]

        def fn(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
            total = np.zeros(k * k + k)
            for x in _slices(batches, dims):
                z = centred(x) @ w
                total += np.concatenate([(z.T @ z).ravel(), z.sum(axis=0)])
            return total

        out = sum_vectors(self.vectors, fn, k * k + k, tasks=self.tasks) / self.n
        return out[: k * k].reshape(k, k) - np.outer(out[k * k :], out[k * k :])


def _orthonormal(blocks: list[np.ndarray]) -> np.ndarray:
    """An orthonormal basis of the blocks' columns, in decreasing weight; dependent directions go."""
    y = np.hstack([b / np.maximum(np.linalg.norm(b, axis=0), 1e-300) for b in blocks])
    u, s, _ = np.linalg.svd(y, full_matrices=False)
    return np.linalg.qr(u[:, s > 1e-11 * max(s[0], 1e-300)])[0]


def _ritz(z: np.ndarray, vz: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rayleigh-Ritz: values, falling, vectors, and V times the vectors."""
    h = z.T @ vz
    e, w = np.linalg.eigh((h + h.T) / 2)
    w = w[:, ::-1]
    return e[::-1], z @ w, vz @ w


@dataclasses.dataclass(frozen=True)
class Components:
    """Certified components: eigenvalues, unit vectors as columns, trace, largest relative residual, rounds."""

    values: np.ndarray
    vectors: np.ndarray
    trace: float
    residual: float
    rounds: int


def principal_components(p: Passes, components: int = COMPONENTS, block: int = BLOCK, degree: int = DEGREE, seed: int = 0) -> Components:
    """The ``components`` largest eigenpairs of the covariance of the vectors of ``p``.

    A round applies Chebyshev polynomials up to ``degree`` to a block of Ritz
    vectors by the three-term recurrence, one pass a degree. The interval that
    they keep small reaches from 0, as a covariance has no negative
    eigenvalue, to the block's smallest Ritz value, so the rest of the
    spectrum is damped. All polynomials' blocks are orthonormalised by QR, at
    most ``block * (degree + 1)`` columns, and Rayleigh-Ritz on them gives the
    next block. It ends when the residual of each wanted pair is at most
    ``TOLERANCE`` times the largest eigenvalue, or when rounding keeps it from
    falling below 1e-11; else it is an error.

    Fewer come back where the vectors span fewer dimensions: pairs of less
    than 1e-12 of the largest eigenvalue count as zero.
    """
    width = min(block, p.dims)
    if not p.n or not width:
        return Components(np.zeros(0), np.zeros((p.dims, 0)), 0.0, 0.0, 0)
    start = np.linalg.qr(np.random.default_rng(seed).standard_normal((p.dims, width)))[0]
    vq, trace = p.covariance_times(start)
    e, q, vq = _ritz(start, vq)
    done, last = 0, np.inf
    while True:
        e, q, vq = e[:width], q[:, :width], vq[:, :width]
        wanted = slice(0, min(components, width))
        residual = float(np.linalg.norm(vq[:, wanted] - q[:, wanted] * e[wanted], axis=0).max() / e[0]) if e[0] > 0 else 0.0
        if residual <= TOLERANCE or (residual <= 1e-11 and residual > last / 2) or (done == 0 and width == p.dims):
            break
        if done == ROUNDS:
            raise RuntimeError(f"no certificate after {ROUNDS} rounds: relative residual {residual:.2g}")
        done, last = done + 1, residual
        half = max(e[-1], 1e-9 * e[0]) / 2
        blocks = [q, (vq - half * q) / half]
        for _ in range(degree - 1):
            v, _ = p.covariance_times(blocks[-1])
            blocks.append(2 / half * (v - half * blocks[-1]) - blocks[-2])
        z = _orthonormal(blocks)
        e, q, vq = _ritz(z, p.covariance_times(z)[0])
    some = e[wanted] > 1e-12 * max(e[0], 0.0)
    values, vectors = e[wanted][some], q[:, wanted][:, some]
    vectors = vectors / np.linalg.norm(vectors, axis=0)
    signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])]) if len(values) else 1.0
    return Components(values, vectors * signs, trace, residual, done)


def _deviations(x: np.ndarray, sums: np.ndarray, n: int) -> list[int]:
    """Sum over dimensions of (n x - S)^2 of each row, in whole numbers of any size."""
    mean = sums // n
    rest = sums - mean * n
    d = x - mean
    if not d.size:
        return [0] * len(x)
    if (int(np.abs(d).max()) + 1) * n >= 1 << 47 or x.shape[1] > 1 << 12:
        return [sum((n * int(a) - int(b)) ** 2 for a, b in zip(r, rest)) for r in d]
    y = np.abs(n * d - rest)
    high, low = y >> 24, y & ((1 << 24) - 1)
    parts = ((a * b).sum(axis=1).tolist() for a, b in ((high, high), (high, low), (low, low)))
    return [(hh << 48) + (hl << 25) + ll for hh, hl, ll in zip(*parts)]


def whiten(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """``id, component, n, deviation, whitened, explained, identity_error`` of every vector and component.

    Entries c become whole numbers x = floor(1024 c) + 100000. Rows whose
    vector is null or holds a null or non-finite entry are dropped; all others
    are the fit list, repeated rows as often as they occur. ``whitened`` is
    the centred x along a component over the root of its eigenvalue,
    ``explained`` the eigenvalue's share of the trace, ``deviation``, exact in
    38 digits (null beyond), the sum of (n x - S)^2, and ``identity_error``
    how far the covariance of ``whitened`` is from the identity, from a pass
    of its own.

    Defined cases: vectors shorter than the longest are filled up with zeros,
    and entries beyond 2^35 count as that. Components without variance are
    left out; if all vectors are equal, or none is left, there are no rows.
    Null ids stay. Other columns are not read. Each pass rereads the table,
    so a lost executor costs its part of one pass.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"))
    if rows.schema["v"].dataType.elementType.typeName() not in ("float", "double"):
        rows = rows.withColumn("v", F.col("v").cast("array<double>"))
    p = Passes.over(rows.select("v"))
    found = principal_components(p, components)
    w = found.vectors / np.sqrt(found.values)
    k, dims, n, sums, centred = w.shape[1], p.dims, p.n, p.sums, p.centred
    explained = found.values / found.trace if k else found.values
    error = float(np.abs(p.projected_covariance(w) - np.eye(k)).max()) if k else 0.0
    names = ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"]

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        keep, x = _integers(batch.column(1), dims)
        m = len(x)
        if not m or not k:
            return
        each = np.repeat(np.arange(m), k)
        z = centred(x) @ w
        deviation = pa.array([Decimal(v) if v < 10**38 else None for v in _deviations(x, sums, n)], pa.decimal128(38, 0))
        ids = batch.column(0).take(pa.array(np.flatnonzero(keep)[each]))
        number = np.tile(np.arange(1, k + 1, dtype=np.int32), m)
        yield pa.RecordBatch.from_arrays(
            [ids, pa.array(number), pa.array(np.full(m * k, n, np.int64)), deviation.take(pa.array(each)), pa.array(z.ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error))],
            names=names,
        )

    kind = dict(rows.dtypes)["id"]
    return arrow_map(rows, run, f"id {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double", rows=max(1, min(512, SLICE // max(dims, 1))))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitened coordinates of every remaining embedding along the eight largest components.

    ``deviation`` is null where it is beyond 64 bits; ``deviation_exact`` has it as a decimal.
    """
    out = whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return out.select(F.col("id").alias("vec_id"), "component", "n", F.col("deviation").try_cast("long").alias("deviation"), "whitened", "explained", "identity_error", F.col("deviation").alias("deviation_exact"))
