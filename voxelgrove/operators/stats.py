"""Dataset statistics over voxels (sample_id, modality, value, and a mask column where one is used)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import ValidationError
from ..session import settle
from . import quantiles


def unpivot(wide: DataFrame, keys: Sequence[str], modalities: dict[str, str]) -> DataFrame:
    """One row per voxel and modality from a table with a column per modality (name -> column)."""
    pairs = ", ".join(f"'{m}', cast(`{c}` as double)" for m, c in modalities.items())
    return wide.select(*keys, F.expr(f"stack({len(modalities)}, {pairs}) as (modality, value)"))


def foreground(voxels: DataFrame, mask: str, fallback: bool = True) -> DataFrame:
    """Voxels inside the mask. A sample without one (null throughout) is kept whole if fallback; a mask that is
    there but empty leaves nothing of its sample."""
    inside = F.col(mask)
    return voxels.where(F.coalesce(inside, F.lit(True))) if fallback else voxels.where(inside)


def masked(voxels: DataFrame, masks: DataFrame, mask: str, shapes: DataFrame, on: Sequence[str] = ("sample_id", "pos")) -> DataFrame:
    """voxels of (sample_id, modality, pos, value) inside a named mask; the whole of a volume that has none of its shape.

    masks: the inside voxels (sample_id, mask, pos); shapes: (sample_id, modality or null, mask or null, shape), the shape of
    each image and of each mask, in one table. Voxels are joined by sample to the names of the volumes that fit, then by sample and place to masks."""
    own = shapes.where("mask is null").select("sample_id", "modality", F.col("shape").alias("__image"))
    its = shapes.where(F.col("mask") == mask).select("sample_id", F.col("shape").alias("__mask"))
    fits = own.join(its, "sample_id").where("__image = __mask").groupBy("sample_id").agg(F.collect_set("modality").alias("__fits"))
    inside = masks.where(F.col("mask") == mask).select(*on).distinct().withColumn("__in", F.lit(True))
    fit = F.coalesce(F.array_contains("__fits", F.col("modality")), F.lit(False))
    rows = voxels.join(fits, "sample_id", "left").withColumn("__fits", fit).join(inside, list(on), "left")
    return rows.where(~F.col("__fits") | F.coalesce("__in", F.lit(False))).select(*voxels.columns)


#: The percentiles that statistics hold.
QUANTILES = {"p01": 0.01, "p99": 0.99}


def modality_stats(voxels: DataFrame, keys: Sequence[str] = ("modality",), exact: bool = True, pool: DataFrame | None = None) -> DataFrame:
    """n_voxels, mean, population std, vmin, vmax, p01 and p99 per modality, in doubles.

    One shuffle of partial aggregates, then exact percentiles by rounds of counts (quantiles.exact_quantiles). Each of them reads keys and values
    again, which are settled first, so that joins and windows below voxels (and below pool) run once; exact=False takes a sketch of bounded size in the one shuffle instead. With pool (keys, value, weight), as
    sample_with_replacement() gives it, percentiles are the pool's. NaN in a modality makes all but n_voxels NaN. An empty table has no rows."""
    v = F.col("value")
    aggs = [F.count(v).alias("n_voxels"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.min(v).alias("vmin"), F.max(v).alias("vmax"), F.max(F.isnan(v)).alias("nan")]
    sketch = not exact and pool is None
    if not sketch and pool is None:
        voxels = settle(voxels.select(*keys, "value"))
    if sketch:
        aggs += [F.percentile_approx(v, F.lit(q), 10000).alias(c) for c, q in QUANTILES.items()]
    agg = voxels.groupBy(*keys).agg(*aggs).where("n_voxels > 0")
    nan = F.lit(float("nan"))
    if sketch:
        return agg.withColumns({c: F.when(F.col("nan"), nan).otherwise(F.col(c)) for c in ("vmin", *QUANTILES)}).drop("nan")
    agg = settle(agg)
    if pool is None:
        ends = agg.where("not nan").select(*keys, F.col("n_voxels").alias("n"), F.col("vmin").alias("lo"), F.col("vmax").alias("hi"))
        found = quantiles.exact_quantiles(voxels, ends, QUANTILES, keys)
    else:
        fit = F.col("value").isNotNull()
        pool = settle(pool.select(*keys, "value", "weight"))
        ends = pool.where(fit).groupBy(*keys).agg(F.sum("weight").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"), F.max(F.isnan("value")).alias("nan")).where("not nan").drop("nan")
        found = quantiles.exact_quantiles(pool, ends, QUANTILES, keys, weight="weight")
    found = found.withColumnsRenamed({c: f"__{c}" for c in keys})
    same = F.lit(True)
    for c in keys:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    out = agg.join(found, same, "left").withColumns({"vmin": F.when(F.col("nan"), nan).otherwise(F.col("vmin")), **{c: F.when(F.col("nan"), nan).otherwise(F.col(c)) for c in QUANTILES}})
    return out.select(*keys, "n_voxels", "mean", "std", "vmin", "vmax", *QUANTILES)


#: Up to so many draws of a group are carried beside each of its rows; more are sorted among the rows.
FEW_DRAWS = 16


def sample_with_replacement(voxels: DataFrame, cap: int, seed: int = 0, by: Sequence[str] = ("sample_id", "modality"), pos: str = "pos") -> DataFrame:
    """voxels plus weight: all of a group of at most cap voxels, once each; of a larger one cap draws with replacement, as the voxels that were
    drawn and how often.

    Draw i of a group takes the place (in the order of pos) that MD5 of seed, group and i gives, so it is the same wherever it is made. A large group counts
    for no more than cap in a pool of groups. A group's first row makes its draws: a few of them (FEW_DRAWS) are carried to each row of the group, which counts its own, so that
    voxels are sorted once; many are sorted among the voxels and counted beside the voxel at their place. All of it is
    dealt to tasks by group, so the voxels travel once, and not at all where they are dealt by columns of `by` already. A null in `by` is a group."""
    group = Window.partitionBy(*by)

    def drawn(i: Column) -> Column:
        text = F.concat_ws(":", F.lit(str(seed)), *(F.col(c).cast("string") for c in by), i.cast("string"))
        return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long") % F.col("__n")

    rows = voxels.withColumns({"__place": (F.row_number().over(group.orderBy(pos)) - 1).cast("long"), "__n": F.count("*").over(group)})
    first = (F.col("__place") == 0) & (F.col("__n") > cap)
    if 0 < cap <= FEW_DRAWS:
        draws = F.when(first, F.transform(F.sequence(F.lit(0), F.lit(cap - 1)), drawn))
        rows = rows.withColumn("__draws", F.first(draws, ignorenulls=True).over(group))
        rows = rows.withColumn("__drawn", F.size("__draws") - F.size(F.array_remove("__draws", F.col("__place"))))
        rows = rows.where((F.col("__n") <= cap) | (F.col("__drawn") > 0))
    else:
        rows = rows.withColumn("__i", F.explode(F.when(first, F.sequence(F.lit(-1), F.lit(cap - 1))).otherwise(F.array(F.lit(-1)))))
        rows = rows.withColumn("__place", F.when(F.col("__i") < 0, F.col("__place")).otherwise(drawn(F.col("__i"))))
        rows = rows.withColumn("__drawn", F.count_if(F.col("__i") >= 0).over(Window.partitionBy(*by, "__place")))
        rows = rows.where((F.col("__i") < 0) & ((F.col("__n") <= cap) | (F.col("__drawn") > 0)))
    return rows.select(*voxels.columns, F.when(F.col("__n") <= cap, F.lit(1)).otherwise(F.col("__drawn")).cast("long").alias("weight"))


def partials(voxels: DataFrame) -> DataFrame:
    """n, mean, m2, vmin and vmax per sample and modality: what merge() combines."""
    v = F.col("value")
    return voxels.groupBy("sample_id", "modality").agg(F.count(v).alias("n"), F.avg(v).alias("mean"), (F.var_pop(v) * F.count(v)).alias("m2"), F.min(v).alias("vmin"), F.max(v).alias("vmax"))


def merge(parts: DataFrame) -> DataFrame:
    """Statistics of the union from partials: m2 = sum of m2 + sum of n * (mean - grand mean)^2.

    The grand means come first, by an aggregate of their own, so that nothing large is subtracted from something large. The partials are settled,
    so that they are made once."""
    parts = settle(parts.select("modality", "n", "mean", "m2", "vmin", "vmax"))
    grand = parts.groupBy(F.col("modality").alias("__m")).agg(F.try_divide(F.sum(F.col("n") * F.col("mean")), F.sum("n")).alias("mean_all"))
    rows = parts.join(F.broadcast(grand), F.col("modality").eqNullSafe(F.col("__m")))
    off = F.col("mean") - F.col("mean_all")
    agg = rows.groupBy("modality").agg(
        F.sum("n").alias("n_voxels"), F.first("mean_all").alias("mean"), F.sum(F.coalesce("m2", F.lit(0.0)) + F.coalesce(F.col("n") * off * off, F.lit(0.0))).alias("m2"), F.min("vmin").alias("vmin"), F.max("vmax").alias("vmax")
    )
    return agg.select("modality", "n_voxels", "mean", F.sqrt(F.try_divide("m2", "n_voxels")).alias("std"), "vmin", "vmax").where("n_voxels > 0")


def label_counts(samples: DataFrame, label: str = "label") -> DataFrame:
    """(label string, n); null labels are left out."""
    return samples.where(F.col(label).isNotNull()).groupBy(F.col(label).cast("string").alias("label")).agg(F.count("*").alias("n"))


def shape_key(shape: Column) -> Column:
    """A shape as text: (8, 16, 16), and (8,) for one axis."""
    return F.concat(F.lit("("), F.array_join(shape, ", "), F.when(F.size(shape) == 1, ",").otherwise(""), F.lit(")"))


def shape_histogram(samples: DataFrame, shape: str = "shape") -> DataFrame:
    return samples.where(F.col(shape).isNotNull()).groupBy(shape_key(F.col(shape)).alias("shape_key")).agg(F.count("*").alias("n"))


def seg_coverage(masks: DataFrame) -> DataFrame:
    """(mask, coverage) of rows (sample_id, mask, inside): the mean over samples of the share inside."""
    share = masks.groupBy("sample_id", "mask").agg(F.avg(F.col("inside").cast("double")).alias("share"))
    return share.groupBy("mask").agg(F.avg("share").alias("coverage"))


def sample_cap(voxels: DataFrame, cap: int, order: Column, by: Sequence[str] = ("sample_id",)) -> DataFrame:
    """At most cap voxels of each sample (or each value of by), the first by a hash order: a bounded pool for percentiles."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(order))
    return voxels.withColumn("__rank", rank).where(F.col("__rank") <= cap).drop("__rank")


def save(stats: dict[str, DataFrame], folder: str, mode: str = "errorifexists") -> None:
    """Statistics as JSON, a folder for each table."""
    for name, df in stats.items():
        df.write.mode(mode).json(f"{folder.rstrip('/')}/{name}")


#: The tables of saved statistics, with their types.
SAVED = {
    "modalities": "modality string, n_voxels long, mean double, std double, vmin double, vmax double, p01 double, p99 double",
    "labels": "label string, n long",
    "shapes": "shape_key string, n long",
    "n_files": "n_files long",
    "coverage": "mask string, coverage double",
}


def load(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """Saved statistics by name; tables that weren't saved are left out."""
    out = {}
    for name, schema in SAVED.items():
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/{name}")
        if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            out[name] = spark.read.schema(schema).json(f"{folder.rstrip('/')}/{name}")
    return out


def compute_stats(
    samples: DataFrame, voxels: DataFrame, masks: DataFrame | None = None, modalities: Sequence[str] | None = None, mask: str | None = None, exact: bool = True, cap: int | None = None, seed: int = 0,
    inside: DataFrame | None = None, shapes: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """All statistics of a dataset as tables: modalities, labels, shapes, coverage, n_files.

    mask restricts the modalities' statistics to a mask: to the voxels of inside (sample_id, mask, pos) where that and shapes are given, as
    masked() does, with whole volumes where a sample's mask is absent or of another shape; else by a column of voxels of that name.
    With cap, percentiles are those of a pool in which a sample and modality of more voxels has cap draws with replacement (voxels need a
    column pos); the other statistics are of all voxels."""
    if modalities is not None:
        voxels = voxels.where(F.col("modality").isin(list(modalities)))
    if mask is not None and inside is not None:
        if shapes is None:
            raise ValidationError("a mask by its voxels needs the shapes of images and masks")
        voxels = masked(voxels, inside, mask, shapes)
    elif mask is not None:
        voxels = foreground(voxels, mask)
    if cap is not None:
        voxels = settle(voxels.select("sample_id", "modality", "pos", "value"))
    pool = sample_with_replacement(voxels, cap, seed) if cap is not None else None
    out = {"modalities": modality_stats(voxels, exact=exact, pool=pool), "labels": label_counts(samples), "shapes": shape_histogram(samples), "n_files": samples.agg(F.count("*").alias("n_files"))}
    if masks is not None:
        out["coverage"] = seg_coverage(masks)
    return out
