"""Records of a dataset: one row per sample with its metadata, the stamps of its file and its review status."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import SourceError
from . import manifest

#: The metadata of a record, with their types; those that a samples table lacks are null.
META = {
    "label": "string", "label_name": "string", "image_names": "array<string>", "shape": "array<bigint>", "spacing": "array<double>", "coord_system": "string", "patch_size": "array<bigint>",
    "has_seg": "boolean", "seg_names": "array<string>", "has_bbox": "boolean", "extra": "string", "schema_version": "string",
}


def build(samples: DataFrame, files: DataFrame | None = None, skip_invalid: bool = False) -> DataFrame:
    """Records of samples (path, metadata columns, open_error): META, review_status, file_size and mtime, in the order of their paths.

    files: (path, file_size, mtime), as list_files() gives them. Samples with an open_error are left out if skip_invalid,
    else the first of them is an error. Only metadata columns are read, no arrays."""
    if "open_error" in samples.columns:
        if not skip_invalid and (bad := samples.where("open_error is not null").orderBy("path").select("path", "open_error").first()):
            raise SourceError(f"{bad['path']}: {bad['open_error']}")
        samples = samples.where("open_error is null")
    rows = samples.select("path", *((F.col(c) if c in samples.columns else F.lit(None)).cast(t).alias(c) for c, t in META.items()))
    rows = rows.withColumns({
        "image_names": F.coalesce("image_names", F.array().cast("array<string>")),
        "has_seg": F.coalesce("has_seg", F.lit(False)),
        "has_bbox": F.coalesce("has_bbox", F.lit(False)),
        "schema_version": F.coalesce("schema_version", F.lit("1")),
        "review_status": manifest.review_status("extra"),
    })
    stamps = files.select("path", "file_size", "mtime") if files is not None else samples.select("path", F.lit(None).cast("long").alias("file_size"), F.lit(None).cast("double").alias("mtime"))
    return rows.join(stamps, "path", "left").orderBy("path")


def from_paths(spark: SparkSession, paths: Sequence[str], samples: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Records of the given paths, in their order, each once for each time it is given; a path without a sample is an error."""
    wanted = spark.createDataFrame(list(enumerate(paths)), "place long, path string")
    lost = wanted.join(samples.select("path"), "path", "left_anti").orderBy("place").first()
    if lost:
        raise SourceError(f"no such sample: {lost['path']}")
    found = build(samples.join(wanted.select("path").distinct(), "path", "left_semi"), files)
    return wanted.join(found, "path").orderBy("place").drop("place")


def paths(records: DataFrame) -> DataFrame:
    return records.select("path").orderBy("path")


def at(records: DataFrame, index: int) -> DataFrame:
    """The record at a place of the order by path, as a table of one row; negative places count from the end."""
    order = F.col("path") if index >= 0 else F.desc("path")
    out = records.orderBy(order).offset(index if index >= 0 else -index - 1).limit(1)
    if out.isEmpty():
        raise IndexError(index)
    return out


def info(samples: DataFrame, storage: DataFrame | None = None) -> DataFrame:
    """(path, payload): what there is to say of each sample, as JSON with 17 keys.

    samples: path and the columns of META with origin; storage: (path, dtype, chunks, filters) of each sample's first image."""
    columns = {**META, "origin": "array<double>"}
    rows = samples.select("path", *((F.col(c) if c in samples.columns else F.lit(None)).cast(t).alias(c) for c, t in columns.items()))
    if storage is not None:
        rows = rows.join(storage.select("path", "dtype", "chunks", "filters"), "path", "left")
    else:
        rows = rows.withColumns({c: F.lit(None).cast(t) for c, t in (("dtype", "string"), ("chunks", "array<bigint>"), ("filters", "string"))})
    keys = (
        "schema_version", "image_names", "shape", "dtype", "chunks", "filters", "label", "label_name", "seg_names", "has_bbox", "spacing", "origin", "coord_system", "patch_size",
    )
    extra = F.try_parse_json("extra")
    payload = F.struct(F.col("path").alias("file"), *keys, manifest.review_status("extra").alias("review_status"), extra.alias("extra"))
    return rows.select("path", F.to_json(payload, {"ignoreNullFields": "false"}).alias("payload"))
