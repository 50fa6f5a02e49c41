"""Whitening of embeddings: centred rows to a triangle, a bidiagonal, singular values, directions.

Every task folds its centred rows into one triangle by QR; triangles are folded in groups of a fixed
number until one is left. Only that triangle, of the size of one vector squared, reaches the driver.
There Householder reflections make it bidiagonal, differential qd steps with shifts find its singular
values, and twisted factorisations of the shifted product give a vector for each of the largest.
Rows are then projected where they are scanned. Nothing the driver holds grows with the table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import staged

FAN = 16  # triangles folded together
ROWS = 1024  # rows folded at once
SCALE, OFFSET = 64, 1_000_000
EPS = np.finfo(np.float64).eps


def usable(embedding: str) -> Column:
    """Neither null nor holding null or non-finite entries."""
    c = F.col(embedding).cast("array<double>")
    return F.coalesce(F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def integers(column: pa.ListArray, width: int) -> np.ndarray:
    """Rows of whole numbers floor(64 c) + 1000000."""
    entries = np.asarray(column.flatten()).astype(np.float64)
    return (np.floor(SCALE * entries).astype(np.int64) + OFFSET).reshape(-1, width)


@dataclass(frozen=True)
class Moments:
    """Number of vectors and the exact sum of each dimension."""

    n: int
    sums: np.ndarray

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x minus its mean, rounded once after an exact difference of whole numbers."""
        whole, rest = np.divmod(self.sums, self.n)
        return (x - whole).astype(np.float64) - rest / self.n

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Exact sums over dimensions of (n x - S) squared; null where no 64-bit number holds them."""
        bound = self.n * self.centred(x)
        if (bound * bound).sum(axis=1).max(initial=0) < 2.0**62 and np.abs(x).max(initial=0) < 2.0**62 / self.n:
            whole = self.n * x - self.sums
            return (whole * whole).sum(axis=1).tolist()
        sums = self.sums.tolist()
        exact = (sum((self.n * int(v) - s) ** 2 for v, s in zip(row, sums, strict=True)) for row in x)
        return [e if e < 2**63 else None for e in exact]


def moments(rows: DataFrame, embedding: str, width: int) -> Moments:
    """One row per dimension and task is summed up; one per dimension reaches the driver."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, np.zeros(width, dtype=np.int64)
        for batch in batches:
            n += len(batch)
            sums += integers(batch.column(0), width).sum(axis=0)
        yield pa.RecordBatch.from_pydict({"at": np.arange(width, dtype=np.int32), "n": np.full(width, n), "s": sums})

    added = rows.select(embedding).mapInArrow(add, "at int, n long, s long")
    found = added.groupBy("at").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).orderBy("at").collect()
    return Moments(found[0]["n"] if found else 0, np.array([r["s"] for r in found], dtype=np.int64))


def folded(triangle: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The triangle of both: the same inner products between columns."""
    for low in range(0, len(rows), ROWS):
        triangle = np.linalg.qr(np.concatenate([triangle, rows[low : low + ROWS]]), mode="r")
    return triangle


def _triangle_rows(part: int, triangle: np.ndarray) -> pa.RecordBatch:
    flat = pa.FixedSizeListArray.from_arrays(pa.array(np.ascontiguousarray(triangle).reshape(-1)), max(1, triangle.shape[1]))
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(triangle), part)), flat.cast(pa.list_(pa.float64()))], ["part", "row"])


def triangle(rows: DataFrame, embedding: str, width: int, made) -> np.ndarray:
    """R of the QR factorisation of all rows that ``made`` gives for arrays of vectors."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.empty((0, width))
        for batch in batches:
            for low in range(0, len(batch), ROWS):
                found = folded(found, made(batch.column(0).slice(low, ROWS)))
        yield _triangle_rows(TaskContext.get().partitionId(), found)

    def fold_some(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.sort_by("part")
        rows = np.asarray(table["row"].combine_chunks().flatten()).reshape(-1, width)
        return pa.Table.from_batches([_triangle_rows(key[0].as_py(), folded(np.empty((0, width)), rows))])

    schema = "part long, row array<double>"
    level = staged(rows.select(embedding).mapInArrow(fold, schema), "triangles")
    last = level.agg(F.max("part")).first()[0]
    while last:
        level = level.groupBy(F.expr(f"part div {FAN}").alias("group")).applyInArrow(fold_some, schema)
        last //= FAN
    found = np.array([r["row"] for r in level.select("row").collect()], dtype=np.float64).reshape(-1, width)
    return folded(np.empty((0, width)), found)


def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, upper diagonal and right reflections V of B with r = U B V'."""
    a, n = r.copy(), r.shape[1]
    if len(a) < n:
        a = np.concatenate([a, np.zeros((n - len(a), n))])
    v = np.eye(n)

    def reflector(x: np.ndarray) -> tuple[np.ndarray, float]:
        norm = np.linalg.norm(x)
        u = x.copy()
        u[0] += np.copysign(norm, x[0])
        length = np.linalg.norm(u)
        return (u / length if length else u), -np.copysign(norm, x[0])

    for k in range(n):
        u, a_kk = reflector(a[k:, k])
        a[k:, k:] -= 2 * np.outer(u, u @ a[k:, k:])
        a[k, k] = a_kk
        if k < n - 1:
            u, a_next = reflector(a[k, k + 1 :])
            a[k:, k + 1 :] -= 2 * np.outer(a[k:, k + 1 :] @ u, u)
            v[:, k + 1 :] -= 2 * np.outer(v[:, k + 1 :] @ u, u)
            a[k, k + 1] = a_next
    return np.diag(a).copy(), np.diag(a, 1).copy(), v


def _step(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float], float]:
    """One differential qd step; the least remainder is negative when the shift was too large."""
    qs, es = [0.0] * len(q), [0.0] * len(e)
    d = least = q[0] - shift
    for k in range(len(e)):
        qs[k] = d + e[k]
        if qs[k] <= 0:
            return qs, es, -1.0
        t = q[k + 1] / qs[k]
        es[k] = e[k] * t
        d = d * t - shift
        least = min(least, d)
    qs[-1] = d
    return qs, es, least


def _block_values(q: list[float], e: list[float]) -> list[float]:
    """Eigenvalues of one unreduced block from squared diagonals ``q`` and upper diagonals ``e``."""
    found: list[float] = []
    work = [(q, e, 0.0)]
    negligible = (4 * EPS) ** 2
    while work:
        q, e, moved = work.pop()
        while q:
            if len(q) == 1:
                found.append(moved + q[0])
                break
            cut = next((k for k in reversed(range(len(e))) if e[k] <= negligible * (moved + min(q[k], q[k + 1]))), None)
            if cut is not None:
                work.append((q[cut + 1 :], e[cut + 1 :], moved))
                q, e = q[: cut + 1], e[:cut]
                continue
            if 1.5 * q[0] < q[-1]:  # shifts take hold at the small end; read backwards the values are the same
                q, e = q[::-1], e[::-1]
            # The smaller root of the last two rows bounds the least value from above.
            a, b, c = q[-2] + (e[-2] if len(e) > 1 else 0.0), q[-1] + e[-1], q[-2] * e[-1]
            root = (a + b) / 2 - math.sqrt(((a - b) / 2) ** 2 + c)
            shift = max(0.0, min(root, q[-1]))
            for _ in range(6):
                qs, es, least = _step(q, e, shift)
                if least >= 0:
                    break
                shift *= 0.25 if shift > EPS * q[-1] else 0.0
            else:
                shift = 0.0
                qs, es, least = _step(q, e, 0.0)
            q, e, moved = qs, es, moved + shift
    return found


def singular_squares(diagonal: np.ndarray, upper: np.ndarray) -> np.ndarray:
    """Squares of all singular values of a bidiagonal, largest first."""
    q, e, found, low = (diagonal**2).tolist(), (upper**2).tolist(), [], 0
    for k in range(len(q)):
        if k == len(q) - 1 or e[k] == 0:
            found += _block_values(q[low : k + 1], e[low:k])
            low = k + 1
    return np.sort(np.array(found))[::-1]


def twisted(d: np.ndarray, low: np.ndarray, value: float) -> tuple[np.ndarray, float]:
    """A unit vector of L D L' near ``value`` and the correction of the value.

    Factorisations from the top and from the bottom meet at the row where the pivot is least.
    """
    n, tiny = len(d), EPS * EPS * max(value, float(d.max(initial=0)), np.finfo(float).tiny)

    def safe(x: float) -> float:
        return x if abs(x) > tiny else np.copysign(tiny, x)

    top, bottom = np.zeros(n), np.zeros(n)
    down, up = np.zeros(max(0, n - 1)), np.zeros(max(0, n - 1))
    top[0] = -value
    for i in range(n - 1):
        down[i] = d[i] * low[i] / safe(top[i] + d[i])
        top[i + 1] = down[i] * low[i] * top[i] - value
    bottom[n - 1] = d[n - 1] - value
    for i in reversed(range(n - 1)):
        t = d[i] / safe(d[i] * low[i] * low[i] + bottom[i + 1])
        up[i] = low[i] * t
        bottom[i] = bottom[i + 1] * t - value
    pivots = top + bottom + value
    r = int(np.abs(pivots).argmin())
    z = np.zeros(n)
    z[r] = 1
    for i in reversed(range(r)):
        z[i] = -down[i] * z[i + 1]
    for i in range(r, n - 1):
        z[i + 1] = -up[i] * z[i]
    square = float(z @ z)
    return z / np.sqrt(square), float(pivots[r]) / square


def _inverse_steps(d: np.ndarray, low: np.ndarray, value: float, others: np.ndarray, seed: int) -> np.ndarray:
    """A vector for ``value`` apart from ``others`` of nearly the same value, by inverse iteration."""
    n, tiny = len(d), EPS * max(float(d.max()), np.finfo(float).tiny)
    z = np.random.default_rng(seed).standard_normal(n)
    pivots, down, s = np.zeros(n), np.zeros(max(0, n - 1)), -value
    for i in range(n):
        pivots[i] = s + d[i]
        if abs(pivots[i]) < tiny:
            pivots[i] = np.copysign(tiny, pivots[i])
        if i < n - 1:
            down[i] = d[i] * low[i] / pivots[i]
            s = down[i] * low[i] * s - value
    for _ in range(4):
        for _ in range(2):
            z = z - others @ (others.T @ z)
        z /= np.linalg.norm(z)
        for i in range(n - 1):
            z[i + 1] -= down[i] * z[i]
        z /= pivots
        for i in reversed(range(n - 1)):
            z[i] -= down[i] * z[i + 1]
        z /= np.linalg.norm(z)
    for _ in range(2):
        z = z - others @ (others.T @ z)
    return z / np.linalg.norm(z)


def directions(r: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Squared singular values of ``r`` and its right singular vectors as columns, at most ``most``, largest first.

    Values that are zero to rounding have no direction and are left out.
    """
    diagonal, upper, v = bidiagonal(r)
    size = max(np.abs(diagonal).max(initial=0), np.abs(upper).max(initial=0))
    if not size:
        return np.empty(0), np.empty((r.shape[1], 0))
    diagonal, upper = diagonal / size, upper / size
    # Below the rounding of the reflections: keeps every pivot above zero.
    diagonal = np.where(np.abs(diagonal) < EPS**2, EPS**2, diagonal)
    upper = np.where(np.abs(upper) < EPS**2, 0.0, upper)
    values = singular_squares(diagonal, upper)
    values = values[values > (len(values) * EPS) ** 2 * 16 * values[0]][:most]
    d, low = diagonal**2, upper / diagonal[:-1] if len(upper) else upper
    vectors = np.zeros((len(d), len(values)))
    for k, value in enumerate(values):
        z, moved = twisted(d, low, value)
        if 0 < abs(moved) < 1e-8 * value:
            z, moved = twisted(d, low, value + moved)
        near = np.flatnonzero(np.abs(values[:k] - value) <= 1e-3 * values[:k])
        others = vectors[:, near]
        apart = z - others @ (others.T @ z)
        if np.linalg.norm(apart) < 0.9:
            apart = _inverse_steps(d, low, value, others, k)
        else:
            apart = apart - others @ (others.T @ apart)
        vectors[:, k] = apart / np.linalg.norm(apart)
    return values * size * size, v @ vectors


def whitened(vectors: DataFrame, *, components: int = 32, embedding: str = "embedding") -> DataFrame:
    """One row per usable vector and component.

    vec_id, component (from 1, largest variance first), n (usable vectors), deviation (exact sum of
    (n x - S) squared), whitened, explained (share of the whole variance) and identity_error (largest
    entry by which the covariance of all whitened rows differs from the identity, found by a pass
    over them). Vectors that are null or hold null or non-finite entries take no part, nor do those
    with another number of entries than most (ties: the smaller number). Repeated rows count as often
    as they stand; null ids keep their rows. Components without variance do not exist: a table whose
    vectors are all equal, or an empty one, gives no rows. A deviation beyond 64 bits is null; entries
    of 2**56 and more have no whole number of 64 bits and are not supported.
    """
    clean = vectors.where(usable(embedding)).select("vec_id", embedding)
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    usual = clean.groupBy(F.size(embedding).alias("width")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "width").first()
    nothing = vectors.sparkSession.createDataFrame([], schema)
    if usual is None or not usual["width"]:
        return nothing
    width = usual["width"]
    rows = clean.where(F.size(embedding) == width)
    found = moments(rows, embedding, width)
    r = triangle(rows, embedding, width, lambda column: found.centred(integers(column, width)))
    squares, basis = directions(r, components)
    if not len(squares):
        return nothing
    explained = squares / (r * r).sum()
    scaled = basis * np.sqrt(found.n / squares)

    def projected(column: pa.ListArray) -> np.ndarray:
        return found.centred(integers(column, width)) @ scaled

    def beside_ones(column: pa.ListArray) -> np.ndarray:
        w = projected(column)
        return np.concatenate([np.ones((len(w), 1)), w], axis=1)

    # The column of ones takes up the mean; what is left below it is centred.
    check = triangle(rows, embedding, len(squares) + 1, beside_ones)[1:, 1:]
    error = float(np.abs(check.T @ check / found.n - np.eye(len(squares))).max())

    def give(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, len(batch), ROWS):
                part = batch.slice(low, ROWS)
                x = integers(part.column(1), width)
                w, n = found.centred(x) @ scaled, len(part)
                of = np.repeat(np.arange(n), len(squares))
                yield pa.RecordBatch.from_pydict({
                    "vec_id": part.column(0).cast(pa.int64()).take(pa.array(of)), "component": np.tile(np.arange(1, len(squares) + 1, dtype=np.int32), n),
                    "n": np.full(len(of), found.n), "deviation": pa.array(found.deviation(x), pa.int64()).take(pa.array(of)),
                    "whitened": w.reshape(-1), "explained": np.tile(explained, n), "identity_error": np.full(len(of), error),
                })

    return rows.mapInArrow(give, schema)
