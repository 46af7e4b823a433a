"""Cubic B-splines through the points of an array, mirrored at its ends."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

#: The pole of the recursive filter whose inverse is the cubic B-spline at whole numbers: (1, 4, 1) / 6.
POLE = np.sqrt(3.0) - 2.0


def coefficients(x: np.ndarray) -> np.ndarray:
    """The coefficients of the spline that takes the values of x at whole numbers: one pass forth and one back along each axis.

    The start of the pass forth is the sum over a whole period of the mirrored line, so short axes are exact too."""
    c = np.array(x, dtype=float)
    for axis in range(c.ndim):
        line = np.moveaxis(c, axis, 0)
        n = len(line)
        if n < 2:
            continue
        power = POLE ** np.arange(2 * n - 2, dtype=float)
        weight = power[:n].copy()
        weight[1 : n - 1] += power[: n - 1 : -1]
        line[0] = np.tensordot(weight, line, 1) / (1 - POLE ** (2 * n - 2))
        for k in range(1, n):
            line[k] += POLE * line[k - 1]
        line[-1] = POLE / (POLE * POLE - 1) * (line[-1] + POLE * line[-2])
        for k in range(n - 2, -1, -1):
            line[k] = POLE * (line[k + 1] - line[k])
        line *= 6
    return c


def taps(at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The four places and weights (4 x len(at) each) that a coordinate on an axis of n points reads, places mirrored into it."""
    low = np.floor(at)
    f = at - low
    weight = np.stack([(1 - f) ** 3, 4 - 6 * f**2 + 3 * f**3, 1 + 3 * f + 3 * f**2 - 3 * f**3, f**3]) / 6
    place = low.astype(int) + np.arange(-1, 3)[:, None]
    if n == 1:
        return np.zeros_like(place), weight
    place = place % (2 * n - 2)
    return np.where(place > n - 1, 2 * n - 2 - place, place), weight


def at_points(c: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The spline of coefficients c at the points at (axes x points)."""
    axes = [taps(a, n) for a, n in zip(at, c.shape)]
    total = np.zeros(at.shape[1])
    for corner in np.ndindex(*(4,) * c.ndim):
        weight = np.prod([w[k] for k, (_, w) in zip(corner, axes)], axis=0)
        total += weight * c[tuple(p[k] for k, (p, _) in zip(corner, axes))]
    return total


def on_lines(c: np.ndarray, at: Sequence[np.ndarray]) -> np.ndarray:
    """The spline of coefficients c at all combinations of the coordinates of each axis: an axis at a time."""
    for axis, a in enumerate(at):
        place, weight = taps(a, c.shape[axis])
        line = np.moveaxis(c, axis, 0)
        spread = weight.reshape(*weight.shape, *[1] * (c.ndim - 1))
        c = np.moveaxis(sum(spread[k] * line[place[k]] for k in range(4)), 0, axis)
    return c
