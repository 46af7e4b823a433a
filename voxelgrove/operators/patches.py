"""Patches: where they start, what they hold, padding and oversampling.

Random numbers are hashes of seed, sample and axis, so that a draw is the same wherever and whenever it is made."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .boxes import in_patches


def draw(seed: int, *keys: Column | str) -> Column:
    """A number in [0, 1) from the first 52 bits of an MD5."""
    text = F.concat_ws(":", F.lit(str(seed)), *(F.col(k).cast("string") if isinstance(k, str) else k.cast("string") for k in keys))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") / float(1 << 52)


def patch_size(size: int | Sequence[int], ndim: int) -> list[int]:
    """One number for all axes, or one for each."""
    out = [int(size)] * ndim if isinstance(size, int) else [int(s) for s in size]
    if len(out) != ndim or min(out) <= 0:
        raise ValueError(f"a patch needs {ndim} positive sizes")
    return out


def uniform_start(shape: Sequence[int], patch: Sequence[int], seed: int, key: str) -> list[Column]:
    return [F.floor(draw(seed, key, F.lit(a)) * (max(s - p, 0) + 1)).cast("int") for a, (s, p) in enumerate(zip(shape, patch))]


def foreground_start(voxels: DataFrame, shape: Sequence[int], patch: Sequence[int], seed: int, key: str = "sample_id") -> DataFrame:
    """(key, s0, s1, ...): the patch around one foreground voxel of each sample, clamped to the volume.

    voxels has key and coordinates c0, c1, ...; the voxel with the least hash is picked by an aggregate."""
    at = F.struct(*(f"c{a}" for a in range(len(shape))))
    rank = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"), *(F.col(f"c{a}").cast("string") for a in range(len(shape)))).cast("binary"))
    one = voxels.groupBy(key).agg(F.min_by(at, rank).alias("c"))
    return one.select(key, *(F.least(F.greatest(F.col(f"c.c{a}") - p // 2, F.lit(0)), F.lit(max(s - p, 0))).cast("int").alias(f"s{a}") for a, (s, p) in enumerate(zip(shape, patch))))


def starts(samples: DataFrame, voxels: DataFrame, shape: Sequence[int], patch: Sequence[int], seed: int, strategy: str = "uniform", foreground_prob: float = 0.5, key: str = "sample_id") -> DataFrame:
    """(key, s0, s1, ...) by strategy: uniform, foreground (uniform where a sample has none) or balanced."""
    axes = range(len(shape))
    rows = samples.select(key, *(c.alias(f"u{a}") for a, c in enumerate(uniform_start(shape, patch, seed, key))))
    if strategy == "uniform":
        return rows.select(key, *(F.col(f"u{a}").alias(f"s{a}") for a in axes))
    if strategy not in ("foreground", "balanced"):
        raise ValueError(strategy)
    rows = rows.join(foreground_start(voxels, shape, patch, seed, key), key, "left")
    use = F.lit(True) if strategy == "foreground" else draw(seed, key, F.lit("balanced")) < foreground_prob
    return rows.select(key, *(F.when(use, F.coalesce(f"s{a}", f"u{a}")).otherwise(F.col(f"u{a}")).alias(f"s{a}") for a in axes))


def coordinates(pos: Column, shape: Sequence[int]) -> list[Column]:
    """The coordinates of a flat C-order position."""
    out, rest = [], pos
    for a in range(len(shape)):
        step = 1
        for s in shape[a + 1 :]:
            step *= s
        out.append(F.floor(rest / step).cast("int") if step > 1 else rest.cast("int"))
        rest = rest % step if step > 1 else rest
    return out


def slice_volume(voxels: DataFrame, lo: Sequence[int], hi: Sequence[int]) -> DataFrame:
    """Voxels c0, c1, ... in [lo, hi) of every axis: bare comparisons, which reach the scan of a tile table."""
    for a, (x, y) in enumerate(zip(lo, hi)):
        voxels = voxels.where((F.col(f"c{a}") >= x) & (F.col(f"c{a}") < y))
    return voxels


def pad(voxels: DataFrame, samples: DataFrame, size: Sequence[int], value: float, key: str = "sample_id") -> DataFrame:
    """The whole grid of each sample, trailing places filled with value. Grids are generated, not shuffled."""
    grid = samples.select(key)
    for a, s in enumerate(size):
        grid = grid.withColumn(f"c{a}", F.explode(F.sequence(F.lit(0), F.lit(s - 1))))
    on = [key, *(f"c{a}" for a in range(len(size)))]
    return grid.join(voxels.select(*on, "value"), on, "left").withColumn("value", F.coalesce("value", F.lit(float(value))))


def oversample(samples: DataFrame, per_volume: int, ordinal: str = "ordinal") -> DataFrame:
    """Each sample per_volume times with idx = k * n + ordinal, so that idx modulo n gives the ordinal back."""
    n = samples.agg(F.count("*").alias("__n"))
    rows = samples.crossJoin(F.broadcast(n))  # one number
    return rows.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(per_volume - 1)))).withColumn("idx", F.col("k") * F.col("__n") + F.col(ordinal)).drop("__n", "k")


def sample_patches(
    samples: DataFrame, voxels: DataFrame, shape: Sequence[int], size: int | Sequence[int], seed: int = 0, strategy: str = "uniform", masks: DataFrame | None = None, foreground: str | None = None,
    foreground_prob: float = 0.5, boxes: DataFrame | None = None, pad_value: float = 0.0, key: str = "sample_id",
) -> dict[str, DataFrame]:
    """One patch of each sample: starts (key, s0, s1, ...), images, masks and boxes, in the patch's own coordinates.

    voxels: (key, modality, c0, c1, ..., value); masks: the inside voxels (key, mask, c0, c1, ...); boxes: (key, lo, hi, ...). The
    strategies foreground and balanced need the name of a mask. Where a patch reaches beyond its volume, images are padded with
    pad_value; masks hold inside voxels only, so their padding is outside. Voxels are cut by an equi-join on the sample with
    comparisons of coordinates; patches are generated, not gathered."""
    patch = patch_size(size, len(shape))
    if strategy in ("foreground", "balanced") and (foreground is None or masks is None):
        raise ValueError(f"{strategy} needs masks and the name of one")
    axes, inside = range(len(shape)), masks.where(F.col("mask") == foreground) if foreground is not None and masks is not None else None
    at = starts(samples, inside, shape, patch, seed, strategy, foreground_prob, key)

    def cut(rows: DataFrame) -> DataFrame:
        out = rows.join(at, key)
        for a in axes:
            out = out.where((F.col(f"c{a}") >= F.col(f"s{a}")) & (F.col(f"c{a}") < F.col(f"s{a}") + patch[a]))
        return out.withColumns({f"c{a}": (F.col(f"c{a}") - F.col(f"s{a}")).cast("int") for a in axes}).select(*rows.columns)

    named = voxels.select(key, "modality").distinct()
    grid = named
    for a in axes:
        grid = grid.withColumn(f"c{a}", F.explode(F.sequence(F.lit(0), F.lit(patch[a] - 1))))
    on = [key, "modality", *(f"c{a}" for a in axes)]
    images = grid.join(cut(voxels).select(*on, "value"), on, "left").withColumn("value", F.coalesce("value", F.lit(float(pad_value))))
    out = {"starts": at, "images": images}
    if masks is not None:
        out["masks"] = cut(masks)
    if boxes is not None:
        out["boxes"] = in_patches(boxes, at.select(key, F.array(*(f"s{a}" for a in axes)).alias("start")), patch, key)
    return out
