"""Whitening against a full eigendecomposition, and its defined cases."""

from __future__ import annotations

import math

import numpy as np
import pytest

from assayer.llm import spectrum_whitening as sw

SCHEMA = "vec_id long, embedding array<float>, component string, n string"


def _frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA)


def _vectors(count, size, seed=1):
    r = np.random.default_rng(seed)
    return (r.standard_normal((count, size)) * np.linspace(3, 0.2, size)).astype(np.float32)


def _check(got, rows):
    x = {k: [math.floor(256 * float(c)) for c in v] for k, v in rows.items()}
    points = np.array(sorted(set(map(tuple, x.values()))), np.int64)
    n, sums = len(points), points.sum(0)
    centred = points - sums / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    for comp in range(1, 5):
        mine = {r.vec_id: r for r in got if r.component == comp}
        assert set(mine) == set(rows)
        value, vector = values[-comp], vectors[:, -comp]
        want = np.array([(np.array(x[k]) - sums / n) @ vector / math.sqrt(value) for k in rows])
        have = np.array([mine[k].whitened for k in rows])
        assert min(np.abs(have - want).max(), np.abs(have + want).max()) < 1e-9
        for k in rows:
            assert mine[k].n == n and int(mine[k].deviation) == sum((n * a - int(s)) ** 2 for a, s in zip(x[k], sums, strict=True))
            assert mine[k].explained == pytest.approx(value / values.sum(), rel=1e-9) and mine[k].identity_error < 1e-9


def test_against_eigendecomposition(spark):
    v = _vectors(120, 12)
    rows = {k: row.tolist() for k, row in enumerate(v)} | {200: v[3].tolist(), 201: v[3].tolist()}
    _check(sw.whiten(_frame(spark, list(rows.items()))).collect(), rows)


def test_unusable_vectors_go_and_repeated_rows_stay(spark):
    good = {k: row.tolist() for k, row in enumerate(_vectors(40, 6, 2))}
    bad = [(90, None), (91, []), (92, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (93, [float("nan")] * 6), (94, [float("inf")] + [0.0] * 5), (95, [1.0, 2.0])]
    got = sw.whiten(_frame(spark, [*good.items(), *bad])).collect()
    _check(got, good)
    twice = sw.whiten(_frame(spark, [*good.items(), (0, good[0]), (None, good[0])])).collect()
    assert len(twice) == 4 * 42 and twice[0].n == 40
    assert sum(r.vec_id is None for r in twice) == 4


def test_tables_without_variance(spark):
    for rows in ([], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, None)]):
        got = sw.whiten(_frame(spark, rows))
        assert got.count() == 0 and got.columns[:3] == ["vec_id", "component", "n"]
    line = sw.whiten(_frame(spark, [(k, [float(k), 2.0 * k, 5.0]) for k in range(9)])).collect()
    assert {r.component for r in line} == {1} and all(r.explained == pytest.approx(1) for r in line)


def test_grid_steps_floor_and_saturate(spark):
    rows = [(1, [-0.001, -0.0, 0.0039, 0.004]), (2, [3e38, 1.0, -3e38, 0.0])]
    got = {r.vec_id: list(r.x) for r in sw.gridded(_frame(spark, rows)).collect()}
    assert got[1] == [-1, 0, 0, 1] and got[2] == [2**63 - 1, 256, -(2**63), 0]


def test_inertia_counts_and_certified_numbers():
    r = np.random.default_rng(7)
    for size in (1, 2, 5, 17):
        for _ in range(20):
            raw = r.standard_normal((size, size))
            matrix = raw + raw.T
            values = np.linalg.eigvalsh(matrix)
            for shift in [0.0, *((values[1:] + values[:-1]) / 2)]:
                assert sw.eigenvalues_above(matrix, shift) == (values > shift).sum()
    basis, _ = np.linalg.qr(r.standard_normal((8, 8)))
    for values in ([5, 5, 5, 1, 1, 0, 0, 0], [9, 9 - 1e-9, 3, 3 - 1e-12, 1, 1, 1, 1], [4] * 8, [1e9, 1, 1e-2, 0, 0, 0, 0, 0], [2, 0, 0, 0, 0, 0, 0, 0]):
        matrix = basis @ np.diag(np.array(values, float)) @ basis.T
        matrix = (matrix + matrix.T) / 2
        found = sw.leading(matrix, 4)
        assert len(found) == min(4, sum(v > 1e-12 * max(values) for v in values))
        assert np.allclose([e for e, _ in found], sorted(values, reverse=True)[: len(found)], rtol=1e-9, atol=1e-6 * 1e-9 * max(values))
        vectors = np.array([v for _, v in found])
        assert np.allclose(vectors @ vectors.T, np.eye(len(found)), atol=1e-12)
        for e, v in found:
            assert np.linalg.norm(matrix @ v - e * v) < 1e-12 * max(values)
