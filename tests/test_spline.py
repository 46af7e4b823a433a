"""Splines against a dense solve, and volumes read through them."""

import numpy as np
import pytest

from voxelgrove.functions import spline
from voxelgrove.operators import grids, labels


def basis(t):
    t = abs(t)
    return (4 - 6 * t**2 + 3 * t**3) / 6 if t < 1 else (2 - t) ** 3 / 6 if t < 2 else 0.0


def mirrored(k, n):
    return 0 if n == 1 else abs((k + n - 1) % (2 * n - 2) - (n - 1))


def matrix(points, n):
    """What each point of a line of n coefficients reads, by the definition of the basis."""
    out = np.zeros((len(points), n))
    for r, p in enumerate(points):
        for k in range(int(np.floor(p)) - 3, int(np.floor(p)) + 5):
            out[r, mirrored(k, n)] += basis(p - k)
    return out


@pytest.mark.parametrize("n", [1, 2, 3, 4, 7, 60])
def test_coefficients_equal_a_dense_solve(n):
    x = np.random.default_rng(n).normal(size=n) * 100
    assert np.allclose(spline.coefficients(x), np.linalg.solve(matrix(range(n), n), x), atol=1e-9)


def test_points_and_lines_equal_the_definition():
    x = np.random.default_rng(3).normal(size=(3, 1, 5))
    lines = [np.linspace(-0.5, s - 0.51, 4) for s in x.shape]
    want = x
    for axis, at in enumerate(lines):
        n = x.shape[axis]
        want = np.moveaxis(np.tensordot(matrix(at, n) @ np.linalg.inv(matrix(range(n), n)), want, (1, axis)), 0, axis)
    c = spline.coefficients(x)
    assert np.allclose(spline.on_lines(c, lines), want, atol=1e-9)
    points = np.stack(np.meshgrid(*lines, indexing="ij")).reshape(3, -1)
    assert np.allclose(spline.at_points(c, points), want.ravel(), atol=1e-9)
    assert np.allclose(spline.at_points(c, np.indices(x.shape).reshape(3, -1).astype(float)), x.ravel(), atol=1e-9)


def test_a_ramp_stays_a_ramp_away_from_the_ends():
    out = labels.resample_array(np.arange(60.0), (100,), (0.59,), "bspline")
    at = np.arange(100) * 0.59
    inner = (at > 15) & (at < 44)
    assert np.allclose(out[inner], at[inner], atol=1e-6)


def test_volumes_reach_half_a_step_out():
    x, turn = np.random.default_rng(5).normal(size=(4, 5)), np.array([[0.0, 0.5, -1], [0.5, 0, -1], [0, 0, 1]])
    for order in grids.ORDERS:
        got = grids.onto(x, np.eye(3), (13, 11), turn, order, -9.0)
        for i, j in np.ndindex(got.shape):
            p, q = 0.5 * j - 1, 0.5 * i - 1
            if not (-0.5 <= p < 3.5 and -0.5 <= q < 4.5):
                assert got[i, j] == -9
            elif order == "linear":
                p, q = min(max(p, 0), 3), min(max(q, 0), 4)
                a, b = int(p), int(q)
                rows = [(1 - q + b) * x[r, b] + (q - b) * x[r, min(b + 1, 4)] for r in (a, min(a + 1, 3))]
                assert np.isclose(got[i, j], (1 - p + a) * rows[0] + (p - a) * rows[1])
            elif order == "bspline":
                want = matrix([p], 4) @ np.linalg.inv(matrix(range(4), 4)) @ x @ (matrix([q], 5) @ np.linalg.inv(matrix(range(5), 5))).T
                assert np.isclose(got[i, j], want[0, 0], atol=1e-9)
        straight = np.diag([0.5, 0.5, 1.0])
        assert np.allclose(grids.onto(x, np.eye(3), (9, 11), straight, order), labels.resample_array(x, (9, 11), (0.5, 0.5), order), atol=1e-9)


def test_volumes_of_whole_numbers_become_float32(spark):
    x = np.random.default_rng(1).integers(0, 50, (4, 5, 6)).astype(float)
    affine = lambda s: [float(v) for v in np.diag([s, s, s, 1.0]).ravel()]
    df = spark.createDataFrame([("a", [4, 5, 6], "int16", affine(1.0), x.ravel().tolist()), ("none", [4, 5, 6], "int16", affine(1.0), None)], "sample_id string, shape array<bigint>, dtype string, affine array<double>, data array<double>")
    got = {r["sample_id"]: r for r in grids.resample_to(df, spark.createDataFrame([("a", [7, 9, 11], affine(0.5)), ("none", [7, 9, 11], affine(0.5))], "sample_id string, shape array<bigint>, affine array<double>"), "bspline").collect()}
    assert got["a"]["dtype"] == "float32" and np.allclose(np.array(got["a"]["data"]).reshape(7, 9, 11)[::2, ::2, ::2], x, atol=1e-9) and got["none"]["data"] is None
