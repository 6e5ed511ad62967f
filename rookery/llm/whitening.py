"""Whitening of embedding vectors by their leading principal components.

Vectors become whole numbers, and the fit counts each distinct vector once. Sums and the
centred covariance are partial sums of blocks in the tasks, added up by Spark; only the
matrix of d x d numbers reaches the driver. There it is brought to tridiagonal form by
Householder reflections; its leading eigenvalues are found by bisection on Sturm counts,
its vectors by inverse iteration, with vectors of clustered eigenvalues made orthogonal
again. The mean and the few components go to all tasks, which project every row.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from rookery.session import materialise

#: Entries are kept in steps of one part of this many.
STEPS = 256
#: Rows that a task turns into one block of doubles.
_BLOCK = 4096
_EPS = float(np.finfo(float).eps)


# --- symmetric eigenproblem -----------------------------------------------------


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal, off-diagonal and unit reflectors of ``matrix`` (symmetric) brought to
    tridiagonal form; reflector k acts on the entries after k."""
    a = np.array(matrix, float)
    d = len(a)
    reflectors = []
    for k in range(d - 2):
        x = a[k + 1 :, k].copy()
        rest = np.abs(x[1:]).max()
        if rest == 0.0:
            reflectors.append(np.zeros(len(x)))
            continue
        x /= np.abs(x).max()
        x[0] += np.copysign(np.linalg.norm(x), x[0])
        v = x / np.linalg.norm(x)
        reflectors.append(v)
        block = a[k + 1 :, k + 1 :]
        p = block @ v
        p -= (v @ p) * v
        block -= 2.0 * (np.outer(v, p) + np.outer(p, v))
        column = a[k + 1 :, k]
        column -= 2.0 * v * (v @ column)
        a[k, k + 1 :] = column
    return np.diag(a).copy(), np.diag(a, -1).copy(), reflectors


def sturm_count(diagonal: np.ndarray, squares: np.ndarray, at: np.ndarray, least: float) -> np.ndarray:
    """How many eigenvalues of the tridiagonal matrix lie below each value of ``at``."""
    below, q = np.zeros(len(at), int), np.ones(len(at))
    for k in range(len(diagonal)):
        q = diagonal[k] - at - (squares[k - 1] / q if k else 0.0)
        q = np.where(np.abs(q) < least, -least, q)
        below += q < 0
    return below


def leading_values(diagonal: np.ndarray, off: np.ndarray, most: int) -> np.ndarray:
    """The ``most`` largest eigenvalues, falling, by bisection of the Gershgorin range."""
    d = len(diagonal)
    reach = np.zeros(d)
    reach[1:] += np.abs(off)
    reach[:-1] += np.abs(off)
    low, high = (diagonal - reach).min(), (diagonal + reach).max()
    scale = max(abs(low), abs(high))
    if scale == 0.0:
        return np.zeros(min(most, d))
    least = max(scale * _EPS * _EPS, float(np.finfo(float).tiny))
    rank = d - 1 - np.arange(min(most, d))  # eigenvalues below the wanted one
    lows = np.full(len(rank), low - scale * 4 * _EPS)
    highs = np.full(len(rank), high + scale * 4 * _EPS)
    for _ in range(1100):
        middle = lows + (highs - lows) / 2
        if np.all((middle <= lows) | (middle >= highs) | (highs - lows <= scale * _EPS * _EPS)):
            break
        more = sturm_count(diagonal, off * off, middle, least) > rank
        highs = np.where(more, middle, highs)
        lows = np.where(more, lows, middle)
    return lows + (highs - lows) / 2


def _solver(diagonal: np.ndarray, off: np.ndarray, shift: float, least: float):
    """Solves ``(T - shift) y = b`` by elimination with row exchanges; pivots of zero
    become ``least``."""
    d = len(diagonal)
    u, v, w = diagonal - shift, np.append(off, 0.0), np.zeros(d)
    swapped, factor = np.zeros(d, bool), np.zeros(d)
    for k in range(d - 1):
        below, next_u, next_v = off[k], u[k + 1], v[k + 1]
        if abs(below) > abs(u[k]):
            swapped[k] = True
            factor[k] = u[k] / below
            old = v[k]
            u[k], v[k], w[k] = below, next_u, next_v
            u[k + 1], v[k + 1] = old - factor[k] * next_u, -factor[k] * next_v
        else:
            pivot = u[k] if abs(u[k]) >= least else np.copysign(least, u[k])
            u[k], factor[k] = pivot, below / pivot
            u[k + 1] = next_u - factor[k] * v[k]
    if abs(u[-1]) < least:
        u[-1] = np.copysign(least, u[-1])

    def solve(b: np.ndarray) -> np.ndarray:
        y = b.copy()
        for k in range(d - 1):
            if swapped[k]:
                y[k], y[k + 1] = y[k + 1], y[k] - factor[k] * y[k + 1]
            else:
                y[k + 1] -= factor[k] * y[k]
        for k in range(d - 1, -1, -1):
            more = (v[k] * y[k + 1] if k + 1 < d else 0.0) + (w[k] * y[k + 2] if k + 2 < d else 0.0)
            y[k] = (y[k] - more) / u[k]
        return y

    return solve


def _vectors(diagonal: np.ndarray, off: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit eigenvectors (rows) of the tridiagonal matrix, by inverse iteration. Vectors
    whose eigenvalues lie close together are kept orthogonal to each other."""
    d = len(diagonal)
    scale = max(np.abs(diagonal).max(), np.abs(off).max() if d > 1 else 0.0)
    least = max(scale * _EPS, float(np.finfo(float).tiny))
    draw = np.random.default_rng(17)
    found = np.zeros((len(values), d))
    for j, value in enumerate(values):
        cluster = [i for i in range(j) if abs(values[i] - value) <= 1e-3 * scale]
        # Equal eigenvalues: a little apart, so that the solutions differ.
        tied = sum(values[i] - value <= 10 * _EPS * scale for i in cluster)
        solve = _solver(diagonal, off, value - tied * 10 * _EPS * scale, least)
        y = draw.standard_normal(d)
        for _ in range(6):
            y = solve(y / np.abs(y).max())
            y /= np.abs(y).max()
            for _ in range(2):  # once more against what rounding leaves
                for i in cluster:
                    y -= (found[i] @ y) * found[i]
            if np.abs(y).max() == 0.0:
                y = draw.standard_normal(d)
            y /= np.linalg.norm(y)
        found[j] = y
    return found


def leading(matrix: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``most`` largest eigenvalues of a symmetric matrix, falling, and their unit
    eigenvectors (rows), whose largest entry is positive."""
    size = np.abs(matrix).max()
    if size == 0.0:
        return np.zeros(min(most, len(matrix))), np.eye(len(matrix))[:most]
    # Squares of entries must neither pass the range of doubles nor vanish.
    half = int(np.frexp(size)[1]) // 2
    diagonal, off, reflectors = tridiagonal(np.ldexp(np.ldexp(matrix, -half), -half))
    values = leading_values(diagonal, off, most)
    rows = _vectors(diagonal, off, values)
    for k in range(len(reflectors) - 1, -1, -1):
        v = reflectors[k]
        rows[:, k + 1 :] -= 2.0 * np.outer(rows[:, k + 1 :] @ v, v)
    for j in range(len(rows)):
        for i in range(j):  # what the way back has added
            if abs(rows[i] @ rows[j]) > 4 * _EPS:
                rows[j] -= (rows[i] @ rows[j]) * rows[i]
        rows[j] /= np.linalg.norm(rows[j])
    at = np.abs(rows).argmax(1)
    return np.ldexp(np.ldexp(values, half), half), rows * np.sign(rows[np.arange(len(rows)), at])[:, None]


# --- distributed sums ----------------------------------------------------------


@dataclass(frozen=True)
class Whitening:
    """What projects a row: the number and sums of the fit list, components with their
    eigenvalues, the trace of the covariance, and the largest error of the identity."""

    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    components: np.ndarray
    trace: float
    error: float | None

    @property
    def width(self) -> int:
        return len(self.sums)

    def centred(self, x: np.ndarray) -> np.ndarray:
        """``x - sums / n`` as doubles, however far the sums lie from zero."""
        whole = np.array([s // self.n for s in self.sums], np.int64)
        part = np.array([(s % self.n) / self.n for s in self.sums])
        if np.abs(whole).max(initial=0) < 1 << 61 and max(-x.min(initial=0), x.max(initial=0)) < 1 << 61:
            return (x - whole).astype(float) - part
        return (x.astype(object) - whole.astype(object)).astype(float) - part

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ (self.components / np.sqrt(self.values)[:, None]).T


def _block(column: pa.Array, width: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(-1, width)


def _covariance(fit: DataFrame, width: int, to_doubles) -> np.ndarray:
    """Mean of the outer products of ``to_doubles(block)``, which are centred vectors: a
    partial sum of each task, one row for each row of the matrix, added up by Spark."""

    def products(batches):
        total, n = 0.0, 0
        for batch in batches:
            for start in range(0, batch.num_rows, _BLOCK):
                z = to_doubles(_block(batch.column(0).slice(start, _BLOCK), width))
                total, n = total + z.T @ z, n + len(z)
        if n:
            values = pa.array(list(total), pa.list_(pa.float64()))
            numbers = [pa.array(np.arange(len(total), dtype=np.int32)), pa.array([n] * len(total), pa.int64())]
            yield pa.RecordBatch.from_arrays([*numbers, values], ["i", "n", "row"])

    parts = fit.mapInArrow(products, "i int, n long, row array<double>")
    cells = parts.select("i", "n", F.posexplode("row").alias("j", "value"))
    added = cells.groupBy("i", "j").agg(F.sum("n").alias("n"), F.sum("value").alias("value")).toArrow()
    size = max(added.column("j").to_pylist()) + 1
    out = np.zeros((size, size))
    i, j = (added.column(c).to_numpy() for c in ("i", "j"))
    out[i, j] = added.column("value").to_numpy() / added.column("n").to_numpy()
    return (out + out.T) / 2


def steps(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """``vectors`` with ``x`` (each entry's step as a whole number), without rows whose
    vector is null or holds null or non-finite entries."""
    if not isinstance(vectors.schema[vector].dataType, ArrayType):
        raise TypeError(f"{vector} holds no arrays")
    entries = F.transform(vector, lambda c: c.cast("double"))
    bad = F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    x = F.transform(entries, lambda c: F.floor(c * STEPS).cast("long"))
    return vectors.filter(F.col(vector).isNotNull() & ~bad).withColumn("x", x)


def _width(fit: DataFrame) -> int:
    """The most frequent length of the distinct vectors, the shortest of several."""
    lengths = fit.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n"))
    first = lengths.filter("d > 0").orderBy(F.desc("n"), "d").first()
    return first.d if first else 0


def fitted(kept: DataFrame, most: int = 4) -> Whitening | None:
    """Fit on the distinct vectors ``x`` of ``kept``; None if there are none."""
    fit = materialise(kept.select("x").distinct(), "vectors")
    width = _width(fit)
    if not width:
        return None
    fit = fit.filter(F.size("x") == width)

    def add(batches):
        total, n = np.zeros(width, object), 0
        for batch in batches:
            for start in range(0, batch.num_rows, _BLOCK):
                x = _block(batch.column(0).slice(start, _BLOCK), width)
                small = max(-x.min(), x.max()) < 1 << 50
                total = total + (x.sum(0) if small else x.astype(object).sum(0))
                n += len(x)
        if n:
            arrays = [pa.array(np.arange(width, dtype=np.int32)), pa.array([n] * width, pa.int64())]
            totals = pa.array([Decimal(int(t)) for t in total], pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays([*arrays, totals], ["i", "n", "total"])

    parts = fit.mapInArrow(add, "i int, n long, total decimal(38,0)").groupBy("i")
    sums = sorted(parts.agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect())
    n, totals = sums[0].n, tuple(int(r.total) for r in sums)
    plain = Whitening(n, totals, np.ones(0), np.zeros((0, width)), 0.0, None)
    covariance = _covariance(fit, width, plain.centred)
    trace = float(np.trace(covariance))
    values, rows = leading(covariance, most)
    there = values > trace * width * _EPS
    model = Whitening(n, totals, values[there], rows[there], trace, None)
    if not there.any():
        return model
    identity = _covariance(fit, width, model.whitened)
    error = float(np.abs(identity - np.eye(len(identity))).max())
    return Whitening(n, totals, model.values, model.components, trace, error)


def _deviations(x: np.ndarray, n: int, sums: tuple[int, ...]) -> list[int]:
    """Exact sums of ``(n * x - sums) ** 2`` of each row."""
    far = n * max(-int(x.min(initial=0)), int(x.max(initial=0))) + max(map(abs, sums))
    if far * far * len(sums) < 1 << 63:
        return ((n * x - np.array(sums, np.int64)) ** 2).sum(1).tolist()
    wide = x.astype(object) * n - np.array(sums, object)
    return (wide * wide).sum(1).tolist()


def whitened(vectors: DataFrame, most: int = 4, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """``key, component, n, deviation, whitened, explained, identity_error`` of each row of
    ``vectors`` and each of up to ``most`` components, numbered from 1.

    Rows whose vector is null, or holds null or non-finite entries, give no rows. Repeated
    vectors count once in the fit and give a row each. Lengths that differ: the most
    frequent one of the distinct vectors holds (of several the shortest), other rows give
    none. Components without variance beyond rounding give none, so equal vectors alone
    give no rows; empty tables neither. ``deviation`` is null where it passes 64 bits and
    ``deviation_exact`` null beyond 38 digits. Other columns are not looked at.
    """
    kept = steps(vectors.select(key, vector), vector)
    kind = kept.schema[key].dataType.simpleString()
    schema = (
        f"{key} {kind}, component int, n long, deviation long, deviation_exact decimal(38,0), "
        "whitened double, explained double, identity_error double"
    )
    model = fitted(kept, most)
    if model is None or not len(model.values):
        return kept.sparkSession.createDataFrame([], schema)
    shared = kept.sparkSession.sparkContext.broadcast(model)

    def project(batches):
        model = shared.value
        k = len(model.values)
        explained = model.values / model.trace
        for batch in batches:
            x = _block(batch.column(1), model.width)
            deviation = _deviations(x, model.n, model.sums)
            longs = [d if d < 1 << 63 else None for d in deviation]
            wide = [Decimal(d) if d < 10**38 else None for d in deviation]
            # Each row as often as there are components, then the columns in order.
            again = pa.array(np.repeat(np.arange(len(x)), k))
            of_row = [batch.column(0), pa.array(longs, pa.int64()), pa.array(wide, pa.decimal128(38, 0))]
            ids, longs, wide = (column.take(again) for column in of_row)
            numbers = pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x)))
            same = [pa.array(np.full(len(again), v)) for v in (np.int64(model.n), float(model.error))]
            values = [pa.array(model.whitened(x).ravel()), pa.array(np.tile(explained, len(x)))]
            arrays = [ids, numbers, same[0], longs, wide, *values, same[1]]
            yield pa.RecordBatch.from_arrays(arrays, [f.split()[0] for f in schema.split(", ")])

    return kept.filter(F.size("x") == model.width).select(key, "x").mapInArrow(project, schema)
