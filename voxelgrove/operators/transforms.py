"""Voxel transforms on rows (sample_id, modality, ..., value)."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .patches import draw


def _only(modalities: Sequence[str] | None, new: Column) -> Column:
    return new if modalities is None else F.when(F.col("modality").isin(list(modalities)), new).otherwise(F.col("value"))


def clip(voxels: DataFrame, low: float | None = None, high: float | None = None, modalities: Sequence[str] | None = None) -> DataFrame:
    """Values within [low, high]; NaN stays NaN."""
    v = F.col("value")
    out = v
    if low is not None:
        out = F.when(v < low, F.lit(float(low))).otherwise(out)
    if high is not None:
        out = F.when((v > high) & ~F.isnan(v), F.lit(float(high))).otherwise(out)
    return voxels.withColumn("value", _only(modalities, out))


def normalize(voxels: DataFrame, mean: float | Mapping[str, float], std: float | Mapping[str, float]) -> DataFrame:
    """(value - mean) / std in float32; a modality without both, or with std 0, stays as it is."""

    def pick(x: float | Mapping[str, float]) -> Column:
        if not isinstance(x, Mapping):
            return F.lit(float(x)).cast("float")
        table = F.create_map(*(F.lit(y) for k, v in x.items() for y in (k, float(v))))
        return F.try_element_at(table, F.col("modality")).cast("float")

    m, s = pick(mean), pick(std)
    return voxels.withColumn("value", F.when(m.isNull() | s.isNull() | (s == 0), F.col("value").cast("float")).otherwise((F.col("value").cast("float") - m) / s))


def zscore(voxels: DataFrame, eps: float = 1e-6, modalities: Sequence[str] | None = None) -> DataFrame:
    """(value - mean) / (std + eps) of each sample and modality, population std, in doubles."""
    by = Window.partitionBy("sample_id", "modality")
    v = F.col("value")
    return voxels.withColumn("value", _only(modalities, (v - F.avg(v).over(by)) / (F.stddev_pop(v).over(by) + eps)))


def flip_voxels(voxels: DataFrame, size: Sequence[int], axes: Sequence[int]) -> DataFrame:
    """Coordinates mirrored: c becomes (s - 1) - c. No shuffle."""
    return voxels.withColumns({f"c{a}": F.lit(size[a] - 1) - F.col(f"c{a}") for a in axes})


def random_flips(samples: DataFrame, axes: Sequence[int], p: float = 0.5, seed: int = 0, key: str = "sample_id") -> DataFrame:
    """(key, flips array<int>): the axes along which each sample is mirrored, each with probability p, by hashes of seed, sample and axis."""
    if not 0 <= p <= 1:
        raise ValueError("p is a probability")
    return samples.select(key, F.array_compact(F.array(*(F.when(draw(seed, key, F.lit(f"flip{a}")) < p, F.lit(int(a))) for a in axes))).alias("flips"))


def random_flip(rows: DataFrame, flips: DataFrame, size: Sequence[int], key: str = "sample_id") -> DataFrame:
    """Voxels or masks (c0, c1, ...) mirrored along their sample's flips; give both the same flips, so that they stay together."""
    out = rows.join(flips, key, "left")
    return out.withColumns({f"c{a}": F.when(F.coalesce(F.array_contains("flips", a), F.lit(False)), F.lit(s - 1) - F.col(f"c{a}")).otherwise(F.col(f"c{a}")) for a, s in enumerate(size)}).select(*rows.columns)


def compose(*steps: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
    def run(df: DataFrame) -> DataFrame:
        for step in steps:
            df = df.transform(step)
        return df

    return run


def apply_lut(value: Column, slope: Column | float, intercept: Column | float) -> Column:
    """Stored values to modality values."""
    return value * slope + intercept
