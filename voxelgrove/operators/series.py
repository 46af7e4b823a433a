"""Volumes from series of slices: choice of the series, order, spacing, stack, modality values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import ValidationError
from ..functions.geometry import cross, dot, unit
from . import cases
from .transforms import apply_lut

NO_UID = "<missing-series-uid>"


def choose(slices: DataFrame, wanted: str | None = None, uid: str = "uid") -> DataFrame:
    """The slices of the wanted series, or else of the one with most slices (ties: the smaller uid); null uids are one series.

    A wanted series that isn't there, and no slices at all, are errors."""
    one = cases.largest_series(slices, uid, wanted).first()
    if one is None:
        raise ValidationError("there are no slices with pixels" if wanted is None else f"there is no series {wanted}")
    return slices.where(F.coalesce(F.col(uid).cast("string"), F.lit(NO_UID)) == one["uid"])


def problems(slices: DataFrame) -> DataFrame:
    """(series, path, problem) of slices that can't be placed: no orientation or position, directions of length 0 or parallel, or
    another shape or orientation than the first path's of their series."""
    key = F.coalesce(F.col("uid").cast("string"), F.lit(NO_UID))
    first = slices.groupBy(key.alias("series")).agg(F.min_by(F.struct("shape", "row_dir", "col_dir"), "path").alias("first"))
    rows = slices.withColumn("series", key).join(first, "series")
    return rows.select("series", "path", _problem().alias("problem")).where("problem is not null")


def _problem() -> Column:
    """What keeps a slice from being placed, held against the struct first of its series; else null."""
    normal = cross(F.col("row_dir"), F.col("col_dir"))

    def far(a: str):
        return F.exists(F.zip_with(F.col(a), F.col(f"first.{a}"), lambda x, y: F.abs(x - y) > 1e-4), lambda t: t)

    return (
        F.when(F.col("row_dir").isNull() | F.col("col_dir").isNull(), "no orientation")
        .when(F.col("position").isNull(), "no position")
        .when(F.sqrt(dot(normal, normal)) <= 1e-6, "directions of length 0 or parallel")
        .when(F.col("shape") != F.col("first.shape"), "another shape")
        .when(far("row_dir") | far("col_dir"), "another orientation")
    )


def volumes(slices: DataFrame, lut: bool = True) -> DataFrame:
    """(uid, n, shape, spacing, origin, direction, data, tags, problem): a volume of each series, slices in order along their normal.

    slices: the columns of dicom.SLICES. Spacing between slices is that of their positions, which must be even (1e-4) and
    apart (1e-5); of a single slice it is its thickness, or 1. With lut, values are slope * stored + intercept of each slice.
    A series that can't be put together has its first problem, by path, and no data. Null uids are one series. All series go
    through one plan, dealt to tasks by uid in one shuffle; a series is one volume, so it is one group. Files are parsed once."""
    own = slices.withColumn("uid", F.coalesce(F.col("uid").cast("string"), F.lit(NO_UID)))
    # The directions are scaled before their product, as functions over arrays are evaluated anew for every use of an element.
    placed = own.withColumns({"along_rows": unit(F.col("row_dir")), "along_columns": unit(F.col("col_dir"))})
    placed = placed.withColumn("normal", cross(F.col("along_rows"), F.col("along_columns"))).withColumn("along", dot(F.col("position"), F.col("normal")))
    its = Window.partitionBy("uid")
    placed = placed.withColumn("first", F.min_by(F.struct("shape", "row_dir", "col_dir"), "path").over(its))
    placed = placed.withColumns({"gap": F.col("along") - F.lag("along").over(its.orderBy("along")), "why": _problem()})
    slope, intercept = F.coalesce("slope", F.lit(1.0)), F.coalesce("intercept", F.lit(0.0))
    value = F.transform("data", lambda x: apply_lut(x, slope, intercept)) if lut else F.col("data")
    one = F.array_sort(F.collect_list(F.struct("along", "path", value.alias("data"))))
    first = F.min_by(F.struct("position", "row_dir", "col_dir", "normal", "pixel_spacing", "thickness", "shape", "tags"), F.struct("along", "path"))
    bad = F.min(F.when(F.col("why").isNotNull(), F.struct("path", "why")))
    rows = placed.groupBy("uid").agg(F.count("*").alias("n"), first.alias("f"), F.flatten(F.transform(one, lambda s: s["data"])).alias("data"), bad.alias("bad"), *cases.gap_measures("along"))
    rows = rows.withColumns({"bad": F.concat("bad.path", F.lit(": "), "bad.why"), "status": cases.gap_status()})
    uneven = F.when(F.col("status") == "duplicate", "slices with the same position").when(F.col("status") == "uneven", "slices with uneven spacing")
    rows = rows.withColumn("problem", F.coalesce("bad", uneven))
    between = F.coalesce("first_gap", "f.thickness", F.lit(1.0))
    pixel = F.coalesce("f.pixel_spacing", F.array(F.lit(1.0), F.lit(1.0)))
    turn = [F.col("f.normal"), unit(F.col("f.col_dir")), unit(F.col("f.row_dir"))]
    return rows.select(
        "uid", "n", F.concat(F.array(F.col("n")), F.col("f.shape")).alias("shape"), F.concat(F.array(between), pixel).alias("spacing"), F.col("f.position").alias("origin"),
        F.array(*(F.array(*(F.get(t, F.lit(r)) for t in turn)) for r in range(3))).alias("direction"), F.when(F.col("problem").isNull(), F.col("data")).alias("data"), F.col("f.tags").alias("tags"), "problem",
    )


def assemble(slices: DataFrame, wanted: str | None = None, lut: bool = True) -> DataFrame:
    """The volume of one series, as volumes() has it, without the column problem: the wanted one, or the one with most slices. What volumes()
    calls a problem is an error."""
    out = volumes(choose(slices, wanted), lut)
    if bad := out.where("problem is not null").select("uid", "problem").first():
        raise ValidationError(f"series {bad['uid']}: {bad['problem']}")
    return out.drop("problem")
