"""Volumes on other grids: affine to affine."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import ValidationError
from ..functions import spline
from ..functions.geometry import all_close

ORDERS = ("nearest", "linear", "bspline")


def same_grid(shape_a: Column, affine_a: Column, shape_b: Column, affine_b: Column) -> Column:
    """Whether two volumes lie on one grid: equal shapes, and affines that agree within 1e-5."""
    return shape_a.eqNullSafe(shape_b) & F.coalesce(all_close(affine_a, affine_b), F.lit(False))


def onto(x: np.ndarray, source: np.ndarray, shape: tuple[int, ...], target: np.ndarray, order: str, fill: float = 0.0) -> np.ndarray:
    """x, whose points lie in space by the affine `source`, read at the points of a grid of `shape` and the affine `target`.

    A slab of the first axis at a time, so that the coordinates of a whole volume are never held. A point reaches half a step to
    all sides: what is further out than that is fill, and between the outermost points and there a linear read takes the outermost
    values, a spline goes on mirrored. NaN in x spreads along its lines in a spline."""
    n = x.ndim
    step = np.linalg.inv(source) @ target
    out = np.full(shape, fill, dtype=float)
    rest = np.indices(shape[1:], dtype=float).reshape(n - 1, -1)
    limit = np.array(x.shape, dtype=float)[:, None] - 1
    coefficients = spline.coefficients(x) if order == "bspline" else None
    for k in range(shape[0]):
        at = step[:n, 1:n] @ rest + (step[:n, 0] * k + step[:n, n])[:, None]
        at = np.where(np.abs(at - np.rint(at)) < 1e-9, np.rint(at), at)
        near = np.floor(at + 0.5)
        ok = ((near >= 0) & (near <= limit)).all(axis=0)
        if order == "nearest":
            out[k].reshape(-1)[ok] = x[tuple(near[:, ok].astype(int))]
            continue
        if order == "bspline":
            out[k].reshape(-1)[ok] = spline.at_points(coefficients, at[:, ok])
            continue
        at = np.clip(at[:, ok], 0, limit)
        low = np.minimum(np.floor(at), np.maximum(limit - 1, 0)).astype(int)
        part, total = at - low, np.zeros(int(ok.sum()))
        for corner in np.ndindex(*(2,) * n):
            c = np.array(corner)[:, None]
            weight = np.where(c == 1, part, 1 - part).prod(axis=0)
            total += weight * x[tuple(np.minimum(low + c, limit.astype(int)))]
        out[k].reshape(-1)[ok] = total
    return out


def resample_to(volumes: DataFrame, targets: DataFrame, order: str = "linear", fill: float = 0.0, key: str = "sample_id") -> DataFrame:
    """volumes (key, shape, dtype, affine, data, ...) on the grids of targets (key, shape, affine).

    data and affines are flat, in C order. Masks take order `nearest`, which keeps the dtype; whole numbers that are mixed
    (`linear`, `bspline`) become float32. A volume without a target stays as it is. One volume is one row's work."""
    if order not in ORDERS:
        raise ValidationError(f"{order}: only {', '.join(ORDERS)} are built")
    rows = volumes.join(targets.select(F.col(key), F.col("shape").alias("__shape"), F.col("affine").alias("__affine")), key, "left")
    there = rows.schema.names

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = b.copy()
            for i, r in b.iterrows():
                if r["__shape"] is None or r["data"] is None:
                    continue
                x = np.asarray(r["data"], dtype=float).reshape([int(s) for s in r["shape"]])
                square = x.ndim + 1
                source, target = (np.asarray(r[c], dtype=float).reshape(square, square) for c in ("affine", "__affine"))
                out.at[i, "data"] = onto(x, source, tuple(int(s) for s in r["__shape"]), target, order, fill).ravel()
                out.at[i, "shape"], out.at[i, "affine"] = r["__shape"], r["__affine"]
                if order != "nearest" and np.dtype(r["dtype"]).kind in "iub":
                    out.at[i, "dtype"] = "float32"
            yield out[there]

    return rows.mapInPandas(run, rows.schema).drop("__shape", "__affine")
