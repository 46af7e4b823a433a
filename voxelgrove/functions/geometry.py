"""Geometry as column functions on spacing and origin (ARRAY<DOUBLE>) and direction (ARRAY<ARRAY<DOUBLE>>, row-major)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _at(a: Column, *index: int) -> Column:
    for i in index:
        a = F.get(a, F.lit(i))
    return a


def all_close(a: Column, b: Column, atol: float = 1e-5, rtol: float = 1e-5) -> Column:
    """Whether two arrays of one length agree: |a - b| <= atol + rtol * |b| everywhere."""
    near = F.zip_with(a, b, lambda x, y: F.abs(x - y) <= atol + rtol * F.abs(y))
    return (F.size(a) == F.size(b)) & F.forall(near, lambda t: F.coalesce(t, F.lit(False)))


def affine(spacing: Column, origin: Column, direction: Column, ndim: int = 3) -> Column:
    """The (ndim + 1)-square matrix [direction * diag(spacing) | origin]."""
    rows = [F.array(*(_at(direction, r, c) * _at(spacing, c) for c in range(ndim)), _at(origin, r)) for r in range(ndim)]
    return F.array(*rows, F.array(*(F.lit(float(c == ndim)) for c in range(ndim + 1))))


def as_affine(spacing: Column, origin: Column, direction: Column, ndim: int = 3) -> Column:
    """affine(), or null without a direction or where it is the identity, near enough.

    A spacing or origin of another length than ndim counts as absent, and so does a direction that isn't square."""
    spacing, origin = (F.when(F.size(x) == ndim, x) for x in (spacing, origin))
    direction = F.when((F.size(direction) == ndim) & F.forall(direction, lambda r: F.size(r) == ndim), direction)
    m = affine(F.coalesce(spacing, F.array(*[F.lit(1.0)] * ndim)), F.coalesce(origin, F.array(*[F.lit(0.0)] * ndim)), direction, ndim)
    eye = F.array(*(F.lit(float(r == c)) for r in range(ndim + 1) for c in range(ndim + 1)))
    return F.when(direction.isNotNull() & ~all_close(F.flatten(m), eye, 1e-8), m)


def decompose(matrix: Column, ndim: int = 3) -> dict[str, Column]:
    """spacing (column norms), origin and direction of an affine; a zero column divides by 1."""
    norm = [F.sqrt(sum((_at(matrix, r, c) * _at(matrix, r, c) for r in range(ndim)), F.lit(0.0))) for c in range(ndim)]
    unit = [F.when(n == 0, F.lit(1.0)).otherwise(n) for n in norm]
    return {
        "spacing": F.array(*norm),
        "origin": F.array(*(_at(matrix, r, ndim) for r in range(ndim))),
        "direction": F.array(*(F.array(*(_at(matrix, r, c) / unit[c] for c in range(ndim))) for r in range(ndim))),
    }


def flip_geometry(spacing: Column, origin: Column, direction: Column, shape: list[int], axes: list[int], ndim: int = 3) -> tuple[Column, Column]:
    """(origin, direction) after mirroring: origin moves to the far end of each axis, whose direction turns round.

    Without a direction both stay as they are."""
    o = [_at(origin, r) for r in range(ndim)]
    for a in axes:
        o = [o[r] + _at(direction, r, a) * _at(spacing, a) * (shape[a] - 1) for r in range(ndim)]
    d = F.array(*(F.array(*(-_at(direction, r, c) if c in axes else _at(direction, r, c) for c in range(ndim))) for r in range(ndim)))
    return F.when(direction.isNull(), origin).otherwise(F.array(*o)), F.when(direction.isNotNull(), d)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def unit(a: Column) -> Column:
    n = F.sqrt(dot(a, a))
    return F.transform(a, lambda x: x / n)


def cross(a: Column, b: Column) -> Column:
    def part(i: int, j: int) -> Column:
        return _at(a, i) * _at(b, j) - _at(a, j) * _at(b, i)

    return F.array(part(1, 2), part(2, 0), part(0, 1))


def slice_normal(row: Column, col: Column) -> Column:
    """The normal of a slice from its row and column directions; directions of length 0 or parallel ones fail the query.

    Written on the three numbers of each direction: functions over arrays would be evaluated anew for every use of an element."""

    def scaled(a: Column) -> Column:
        x = [_at(a, i) for i in range(3)]
        n = F.sqrt(x[0] * x[0] + x[1] * x[1] + x[2] * x[2])
        return F.array(*(v / n for v in x))

    normal = cross(scaled(row), scaled(col))
    x = [_at(normal, i) for i in range(3)]
    size = F.sqrt(x[0] * x[0] + x[1] * x[1] + x[2] * x[2])
    return F.when((size > 1e-6) | row.isNull() | col.isNull(), normal).otherwise(F.raise_error(F.lit("slice directions of length 0 or parallel")).cast("array<double>"))


def slice_position(position: Column, normal: Column) -> Column:
    return dot(position, normal)
