"""Label volumes and masks, and resampling between grids."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import ValidationError
from ..functions import spline


def label_map(declared: Mapping[str, int], value: Column) -> Column:
    """The declared name of a value, null if there is none; maps are small, so they are part of the plan."""
    return F.try_element_at(F.create_map(*(F.lit(x) for k, v in declared.items() for x in (int(v), k))), value)


def undeclared(volume: DataFrame, declared: Mapping[str, int]) -> DataFrame:
    """(value): the distinct values of a label volume that no name has, or that aren't whole."""
    v = F.col("value")
    return volume.where((v != F.floor(v)) | label_map(declared, v.cast("int")).isNull()).select("value").distinct()


def split_labels(volume: DataFrame, declared: Mapping[str, int], background: int = 0, check: bool = True) -> DataFrame:
    """(…, mask): the mask of each voxel whose value isn't the background; others aren't stored."""
    if check and not undeclared(volume.where(F.col("value") != background), declared).isEmpty():
        raise ValidationError("the volume has undeclared values")
    return volume.where(F.col("value") != background).withColumn("mask", label_map(declared, F.col("value").cast("int"))).drop("value")


def merge_labels(masks: DataFrame, declared: Mapping[str, int], keys: Sequence[str] = ("sample_id", "pos")) -> DataFrame:
    """(keys, lab) of rows (keys, mask, inside): the largest declared value of the masks a voxel is in, else 0."""
    of = F.try_element_at(F.create_map(*(F.lit(x) for k, v in declared.items() for x in (k, int(v)))), F.col("mask"))
    return masks.groupBy(*keys).agg(F.coalesce(F.max(F.when(F.col("inside"), of)), F.lit(0)).alias("lab"))


def label_dtype(declared: Mapping[str, int]) -> str:
    return "uint8" if max(declared.values(), default=0) <= 255 else "uint16"


def resample_array(x: np.ndarray, size: Sequence[int], factor: Sequence[float], order: str, fill: float = 0.0) -> np.ndarray:
    """x on a grid of `size` whose point i lies at i * factor of x; nearest, linear or bspline; fill from half a step outside x."""
    lines = [np.arange(s) * f for s, f in zip(size, factor)]
    at = np.meshgrid(*lines, indexing="ij")
    inside = np.all([(a >= -0.5) & (a < s - 0.5) for a, s in zip(at, x.shape)], axis=0)
    if order == "bspline":
        return np.where(inside, spline.on_lines(spline.coefficients(x), lines), fill)
    if order == "nearest":
        idx = [np.clip(np.floor(a + 0.5).astype(int), 0, s - 1) for a, s in zip(at, x.shape)]
        return np.where(inside, x[tuple(idx)], fill)
    out = np.zeros(tuple(size))
    at = [np.clip(a, 0, s - 1) for a, s in zip(at, x.shape)]
    low = [np.clip(np.floor(a).astype(int), 0, s - 1) for a, s in zip(at, x.shape)]
    part = [a - i for a, i in zip(at, low)]
    for corner in np.ndindex(*(2,) * x.ndim):
        w = np.ones(tuple(size))
        idx = []
        for c, i, p, s in zip(corner, low, part, x.shape):
            w = w * (p if c else 1 - p)
            idx.append(np.clip(i + c, 0, s - 1))
        out += w * x[tuple(idx)]
    return np.where(inside, out, fill)


def resample(volumes: DataFrame, shape: Sequence[int], size: Sequence[int], factor: Sequence[float], order: str = "linear", fill: float = 0.0, key: str = "sample_id", data: str = "data") -> DataFrame:
    """(key, data): each volume (flat C order, one per row) on another grid; a numpy kernel over Arrow batches."""
    if order not in ("nearest", "linear", "bspline"):
        raise ValidationError(f"{order}: only nearest, linear and bspline are built")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [resample_array(np.asarray(v, dtype=float).reshape(shape), size, factor, order, fill).ravel() for v in b[data]]
            yield pd.DataFrame({key: b[key], data: out})

    kind = volumes.schema[key].dataType.simpleString()
    return volumes.select(key, data).mapInPandas(run, f"{key} {kind}, {data} array<double>")
