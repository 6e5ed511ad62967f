"""Embedding whitening: against numpy's eigensolver, and whole numbers without bounds."""

import math
from fractions import Fraction

import numpy as np
import pytest

from rookery.llm import whitening
from rookery.llm.common import prepared
from rookery.llm.queries import QUERIES


def matrices():
    rng = np.random.default_rng(1)
    yield np.eye(5)
    yield np.zeros((3, 3))
    yield np.array([[2.5]])
    yield np.array([[1.0, 2.0], [2.0, 1.0]])
    yield np.diag([1.0, 5.0, 5.0, 5.0, 5.0, 0.0])
    yield np.ones((7, 7))
    for d in (3, 20, 64):
        x = rng.standard_normal((d, d))
        yield x @ x.T
        turn, _ = np.linalg.qr(x)
        for near in (0.0, 1e-15, 1e-12, 1e-8):  # clustered eigenvalues
            yield turn @ np.diag(1 + near * np.arange(d)) @ turn.T
            yield turn @ np.diag(np.r_[9 + near * np.arange(3), np.linspace(0, 1, d - 3)]) @ turn.T
        yield 1e300 * turn @ np.diag(np.arange(d) / d) @ turn.T
        yield 1e-300 * turn @ np.diag(np.arange(d) + 1.0) @ turn.T


@pytest.mark.parametrize("matrix", list(matrices()))
def test_leading_eigenpairs(matrix):
    matrix = (matrix + matrix.T) / 2
    values, rows = whitening.leading(matrix, 4)
    want = np.linalg.eigvalsh(matrix)[::-1][:4]
    scale = max(np.abs(want).max(), np.abs(matrix).max(), 1e-320)
    assert np.abs(values - want).max() <= 1e-13 * scale
    assert np.abs(rows @ rows.T - np.eye(len(rows))).max() < 1e-13
    assert np.abs(rows @ (matrix / scale) - (values / scale)[:, None] * rows).max() < 1e-13


def test_sturm_counts_are_numbers_of_smaller_eigenvalues():
    rng = np.random.default_rng(2)
    diagonal, off = rng.standard_normal(30), rng.standard_normal(29)
    off[[4, 11]] = 0.0
    all_values = np.linalg.eigvalsh(np.diag(diagonal) + np.diag(off, 1) + np.diag(off, -1))
    at = np.linspace(-5, 5, 101)
    found = whitening.sturm_count(diagonal, off**2, at, 1e-300)
    assert found.tolist() == [(all_values < x).sum() for x in at]


def brute(rows, most=4):
    """The contract on Python's fractions and numpy's solver: ``(id, component)`` to values."""
    kept = [(k, v) for k, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    whole = [(k, tuple(math.floor(256 * c) for c in v)) for k, v in kept]
    lengths = [len(x) for x in {x for _, x in whole} if x]
    d = min(set(lengths), key=lambda n: (-lengths.count(n), n))
    whole = [(k, x) for k, x in whole if len(x) == d]
    fit = sorted({x for _, x in whole})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    centred = {x: [float(Fraction(n * a - s, n)) for a, s in zip(x, sums)] for x in fit}
    z = np.array([centred[x] for x in fit])
    v = z.T @ z / n
    values, vectors = np.linalg.eigh(v)
    out = []
    for k, x in whole:
        deviation = sum((n * a - s) ** 2 for a, s in zip(x, sums))
        for c in range(1, min(most, d) + 1):
            e, u = values[-c], vectors[:, -c]
            if e > 1e-9:
                out.append((k, c, n, deviation, abs(np.dot(centred[x], u)) / math.sqrt(e), e / np.trace(v)))
    return out


def check(found, want, close=1e-7):
    key = lambda r: (repr(r[0]), r[1], r[4])
    found = sorted(((*r[:4], abs(r[5]), r[6]) for r in found), key=key)
    want = sorted(want, key=key)
    assert [r[:4] for r in found] == [r[:4] for r in want]
    assert np.allclose([r[4:] for r in found], [r[4:] for r in want], rtol=close, atol=close)


@pytest.fixture(scope="module")
def table(spark):
    """Far from zero, repeated rows, ids that repeat or are null, bad entries, other
    lengths, and extra columns with clashing names."""
    rng = np.random.default_rng(3)
    spread = rng.standard_normal((6, 6)) * np.array([4, 3, 2, 1, 0.5, 0.2])[:, None]
    good = (rng.standard_normal((150, 6)) @ spread + np.array([1e4, -1e4, 0, 3, 0, 1e3])).tolist()
    rows = [(k % 140, v) for k, v in enumerate(good)] + [(900 + k, good[7]) for k in range(80)]
    bad = [None, [], [1.0], [1.0] * 5 + [None], [math.nan] * 6, [math.inf] + [0.0] * 5, [1.0] * 7]
    rows += [(1000 + k, v) for k, v in enumerate(bad)] + [(None, good[3]), (None, [-0.0] * 6)]
    full = [(k, v, 1, "n", 2.0) for k, v in rows]
    schema = "vec_id long, embedding array<double>, n int, x string, component double"
    return prepared(spark).createDataFrame(full, schema).repartition(5).cache()


def test_whitening_equals_brute_force(table):
    got = whitening.whitened(table).collect()
    check(got, brute([(r.vec_id, r.embedding) for r in table.collect()]))
    assert {r.deviation for r in got} == {int(r.deviation_exact) for r in got}
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-10


def test_few_rows_equal_rows_and_no_rows(spark, table):
    schema = "vec_id long, embedding array<float>"
    make = lambda rows: prepared(spark).createDataFrame(rows, schema)
    assert whitening.whitened(make([])).count() == 0
    assert whitening.whitened(make([(1, None), (2, [])])).count() == 0
    assert whitening.whitened(make([(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0
    two = [(1, [0.0, 2.0]), (2, [1.0, 2.0]), (3, [1.0, 2.0])]
    found = whitening.whitened(make(two)).collect()
    check(found, brute(two))
    assert {r.component for r in found} == {1} and all(abs(abs(r.whitened) - 1) < 1e-12 for r in found)
    assert whitening.whitened(table.limit(0)).columns == whitening.whitened(table).columns


def test_huge_entries_keep_exact_deviations(spark):
    rows = [(k, [float(k * 2**50), -float(k)]) for k in range(5)] + [(9, [1e300, 0.0])]
    found = whitening.whitened(prepared(spark).createDataFrame(rows, "vec_id long, embedding array<double>"))
    by_id = {r.vec_id: r for r in found.filter("component = 1").collect()}
    assert by_id.keys() == {0, 1, 2, 3, 4, 9} and all(math.isfinite(r.whitened) for r in by_id.values())
    assert all(r.deviation is None for r in by_id.values())


def test_query_returns_every_vector(spark):
    got = QUERIES["op11_whitening"](spark, "/root/testdata/sf0.001").collect()
    given = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()
    check([(r.vec_id, r.component, r.n, r.deviation, None, r.whitened, r.explained) for r in got],
          brute([(r.vec_id, r.embedding) for r in given]), 1e-6)
