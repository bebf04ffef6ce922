"""Whitening of embeddings by the eigenvectors of their covariance, found by cyclic Jacobi.

Components become whole numbers, so sums and each vector's deviation are exact. A first
pass adds up every dimension; a second makes each block's scatter about the mean (centred
before multiplying) and adds the blocks up by rows of the matrix; only that matrix goes to
the driver, a number of rows that depends on the dimensions alone. There symmetric
rotations run over all pairs of axes, sweep after sweep, until every off-diagonal entry is
lost beside its two diagonal ones: this relative test is what keeps small eigenvalues
accurate. Pairs are taken in rounds of disjoint ones, as in a tournament, so that a round
is one step over the matrix. The sorted axes, each divided by the root of its eigenvalue,
are sent to the tasks. A third pass measures the covariance of what comes out.

Cases: rows whose vector is null or empty, or holds null or non-finite entries, go; zero
vectors, repeated rows and rows without an id stay and count; vectors of every length are
whitened among themselves, however many lengths there are; axes along which nothing varies
(eigenvalue below 1e-12 of the largest) have no whitened form and give no rows, so a lone
vector or a table of equal ones gives none; entries whose whole number passes 2^40 are cut
to it; a deviation past 64 bits is null; equal eigenvalues come in the order of their axes;
other columns are not read, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE, SHIFT = 64, 1_000_000
MOST_COMPONENTS = 32
#: Rows that are worked on at once.
BLOCK = 4096
MOST_ENTRY = 1 << 40
#: Off-diagonal entries below this part of the root of their diagonal ones are gone.
GONE = 1e-15
#: Axes with less than this part of the largest eigenvalue carry nothing.
FLAT = 1e-12
COLUMNS = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whole(v: np.ndarray, scale: int, shift: int) -> np.ndarray:
    return np.clip(np.floor(v * float(scale)), -MOST_ENTRY, MOST_ENTRY).astype(np.int64) + shift


def blocks(batches: Iterator[pa.RecordBatch], scale: int, shift: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Ids and whole-number vectors of rows of one length at a time."""
    for b in batches:
        for at in range(0, b.num_rows, BLOCK):
            part = b.slice(at, BLOCK)
            size = part.column(1).value_lengths().to_numpy()
            for d in np.unique(size).tolist():
                of = part.filter(pa.array(size == d)) if (size != d).any() else part
                yield of.column(0), whole(of.column(1).flatten().to_numpy().reshape(-1, d), scale, shift)


def rotations(d: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """All pairs of axes in rounds of disjoint pairs."""
    ring = [*range(d), *[-1] * (d % 2)]
    out = []
    for _ in range(len(ring) - 1):
        pairs = [(min(a, b), max(a, b)) for a, b in zip(ring[: len(ring) // 2], ring[::-1]) if min(a, b) >= 0]
        if pairs:
            out.append((np.array([a for a, _ in pairs]), np.array([b for _, b in pairs])))
        ring = [ring[0], ring[-1], *ring[1:-1]]
    return out


def jacobi(matrix: np.ndarray, most_sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, largest first, and unit eigenvectors as columns of a symmetric matrix."""
    a = np.array(matrix, np.float64)
    d = len(a)
    axes = np.eye(d)
    for _ in range(most_sweeps):
        turned = False
        for p, q in rotations(d):
            off, x, y = a[p, q], a[p, p], a[q, q]
            live = np.abs(off) > GONE * np.sqrt(np.abs(x * y))
            if not live.any():
                continue
            turned = True
            p, q, off, x, y = p[live], q[live], off[live], x[live], y[live]
            # the smaller of the two angles that clear the entry
            t = (y - x) / (2 * off)
            t = np.where(t >= 0, 1.0, -1.0) / (np.abs(t) + np.hypot(t, 1.0))
            c = 1 / np.hypot(t, 1.0)
            s = t * c
            for m in (a, axes):
                u, v = m[:, p].copy(), m[:, q].copy()
                m[:, p], m[:, q] = c * u - s * v, s * u + c * v
            u, v = a[p].copy(), a[q].copy()
            a[p], a[q] = c[:, None] * u - s[:, None] * v, s[:, None] * u + c[:, None] * v
            a[p, p], a[q, q] = x - t * off, y + t * off
            a[p, q] = a[q, p] = 0.0
        if not turned:
            break
    value = a.diagonal().copy()
    order = np.argsort(-value, kind="stable")
    return value[order], axes[:, order]


class Space:
    """How vectors of one length are whitened."""

    def __init__(self, n: int, sums: np.ndarray, scatter: np.ndarray, most: int) -> None:
        self.n, self.sums = n, sums
        self.mean = np.array([float(s // n) + float(s % n) / n for s in sums])
        value, axes = jacobi(scatter / n)
        some = value[:most] > FLAT * max(value[0], 0.0)
        value_, axes = value[:most][some], axes[:, :most][:, some]
        self.turn, self.explained = axes / np.sqrt(value_), value_ / value.sum()

    def whiten(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) @ self.turn

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n x - S)^2, exactly."""
        low, rest = np.array([int(s) // self.n for s in self.sums], np.int64), np.array([int(s) % self.n for s in self.sums], np.int64)
        y = x - low
        most = self.n * (int(np.abs(y).max(initial=0)) + 1)
        if most * most * len(low) < 1 << 62:
            y = self.n * y - rest
            return (y * y).sum(1).tolist()
        y = self.n * y.astype(object) - rest.astype(object)
        return [s if s < 1 << 63 else None for s in (y * y).sum(1).tolist()]


def scatter_of(rows: DataFrame, scale: int, shift: int, centred: Callable[[np.ndarray], np.ndarray]) -> dict[int, np.ndarray]:
    """For every length of vectors the sum of outer products of ``centred`` rows. A task
    adds its blocks up first; rows of the matrix are then added across tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for _, x in blocks(batches, scale, shift):
            z = centred(x)
            held[x.shape[1]] = held.get(x.shape[1], 0.0) + z.T @ z
        for d, m in held.items():
            i, j = np.triu_indices(len(m))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), d), pa.int32()), pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(m[i, j])], names=["d", "i", "j", "s"])

    out: dict[int, np.ndarray] = {}
    entries = rows.mapInArrow(run, "d int, i int, j int, s double").groupBy("d", "i", "j").agg(F.sum("s").alias("s"))
    by: dict[int, list] = defaultdict(list)
    for r in entries.collect():  # half the square of the dimensions
        by[r["d"]].append((r["i"], r["j"], r["s"]))
    for d, found in by.items():
        i, j, s = (np.array(c) for c in zip(*found))
        m = np.zeros((i.max() + 1, i.max() + 1))
        m[i, j] = m[j, i] = s
        out[d] = m
    return out


def fit(rows: DataFrame, scale: int, shift: int, most: int) -> dict[int, Space]:
    """The space of every length of vectors."""

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[int, list[int]]] = {}
        for _, x in blocks(batches, scale, shift):
            n, sums = held.get(d := x.shape[1], (0, [0] * d))
            held[d] = n + len(x), [a + int(b) for a, b in zip(sums, x.sum(0))]
        for d, (n, sums) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([d] * d, pa.int32()), pa.array(range(d), pa.int32()), pa.array([n] * d, pa.int64()), pa.array(map(str, sums), pa.string())], names=["d", "i", "n", "s"])

    total = F.sum(F.col("s").cast("decimal(38,0)")).alias("s")
    sums: dict[int, list] = defaultdict(list)
    for r in rows.mapInArrow(add_up, "d int, i int, n long, s string").groupBy("d", "i").agg(F.sum("n").alias("n"), total).orderBy("d", "i").collect():  # a row a dimension
        sums[r["d"]].append((r["n"], int(r["s"])))
    mean = {d: np.array([float(s // n) + float(s % n) / n for n, s in found]) for d, found in sums.items()}
    scatter = scatter_of(rows, scale, shift, lambda x: x - mean[x.shape[1]])
    return {d: Space(found[0][0], np.array([s for _, s in found], object), scatter[d], most) for d, found in sums.items()}


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE, shift: int = SHIFT, components: int = MOST_COMPONENTS) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error``: a row for
    every vector and component, components numbered from 1 by falling eigenvalue."""
    inf = float("inf")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).where("size(v) > 0")
    rows = rows.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (x < inf) & (x > -inf)))
    spaces = fit(rows, scale, shift, components)
    # whitened vectors have mean zero up to rounding
    found = scatter_of(rows, scale, shift, lambda x: spaces[x.shape[1]].whiten(x)) if spaces else {}
    error = {d: float(np.abs(m / spaces[d].n - np.eye(len(m))).max()) for d, m in found.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x in blocks(batches, scale, shift):
            d = x.shape[1]
            space = spaces[d]
            y = space.whiten(x)
            rows_, k = y.shape
            each = lambda values, kind: pa.array(np.tile(values, rows_), kind)
            place = pa.array(np.repeat(np.arange(rows_), k))
            deviation = pa.array(space.deviation(x), pa.int64()).take(place)
            yield pa.RecordBatch.from_arrays(
                [ids.take(place), each(np.arange(1, k + 1), pa.int32()), pa.array(np.full(rows_ * k, space.n), pa.int64()), deviation, pa.array(y.ravel()), each(space.explained, pa.float64()), pa.array(np.full(rows_ * k, error.get(d, 0.0)))],
                names=[c.split()[0] for c in COLUMNS.split(", ")],
            )

    return rows.mapInArrow(run, COLUMNS)
