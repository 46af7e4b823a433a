"""Validation of samples: one expression per rule, one row per issue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCHEMA_VERSION = 1


def _same(a: str, b: str) -> Column:
    return F.array_sort(F.coalesce(F.col(a), F.array().cast("array<string>"))).eqNullSafe(F.array_sort(F.coalesce(F.col(b), F.array().cast("array<string>"))))


def rules() -> list[tuple[str, str, Column, Column]]:
    """(code, severity, broken, location) over the columns of samples that issues() names.

    A rule that stops the check (no images, an unreadable version) hides those after it."""
    c, none = F.col, F.lit(None).cast("string")
    images = F.coalesce(F.size("images"), F.lit(0))
    no_group, empty = c("images").isNull(), c("images").isNotNull() & (images == 0)
    version = F.try_to_number(c("schema_version"), F.lit("999999"))
    unreadable = c("schema_version").isNotNull() & (version.isNull() | (version > SCHEMA_VERSION))
    open_ = c("open_error").isNotNull()
    go = ~open_ & ~no_group & ~empty
    on = go & ~F.coalesce(unreadable, F.lit(False))
    segs = F.coalesce(F.size("seg"), F.lit(0))
    return [
        ("file_open_failed", "error", open_, none),
        ("missing_images_group", "error", ~open_ & no_group, F.lit("images")),
        ("empty_images_group", "error", ~open_ & empty, F.lit("images")),
        ("image_shape_mismatch", "error", go & (F.size(F.array_distinct("image_shapes")) > 1), F.lit("images")),
        ("missing_schema_version", "error", go & c("schema_version").isNull(), none),
        ("metadata_read_failed", "error", go & unreadable, none),
        ("metadata_invalid", "error", on & (F.size(F.array_compact(F.array(*metadata_problems()))) > 0), none),
        ("missing_image_names", "warning", on & c("image_names").isNull(), none),
        ("image_names_mismatch", "error", on & c("image_names").isNotNull() & ~_same("image_names", "images"), F.lit("images")),
        ("shape_mismatch", "error", on & c("shape").isNotNull() & ~F.array_contains(F.transform("image_shapes", lambda s: s), F.array_join("shape", "x")), F.lit("images")),
        ("seg_presence_mismatch", "error", on & (c("has_seg") != (segs > 0)), F.lit("seg")),
        ("seg_names_mismatch", "error", on & (segs > 0) & ~_same("seg_names", "seg"), F.lit("seg")),
        ("seg_shape_mismatch", "error", on & F.coalesce(F.exists("seg_shapes", lambda s: s != F.get("image_shapes", F.lit(0))), F.lit(False)), F.lit("seg")),
        ("bbox_presence_mismatch", "error", on & (c("has_bbox") != c("n_boxes").isNotNull()), F.lit("bboxes")),
        ("bbox_shape_invalid", "error", on & F.coalesce(c("box_axes") != F.size(F.split(F.get("image_shapes", F.lit(0)), "x")), F.lit(False)), F.lit("bboxes")),
        ("bbox_scores_mismatch", "error", on & F.coalesce(c("n_scores") != c("n_boxes"), F.lit(False)), F.lit("bbox_scores")),
        ("bbox_labels_mismatch", "error", on & F.coalesce(c("n_box_labels") != c("n_boxes"), F.lit(False)), F.lit("bbox_labels")),
        ("bbox_dependents_without_bboxes", "error", on & c("n_boxes").isNull() & (c("n_scores").isNotNull() | c("n_box_labels").isNotNull()), F.lit("bboxes")),
        ("missing_checksum", "warning", on & c("checksum").isNull(), none),
        ("checksum_mismatch", "error", on & F.coalesce(c("checksum") != c("computed"), F.lit(False)), none),
    ]


#: Columns that the rules read, with their types; issues() adds the absent ones as null.
COLUMNS = {
    "open_error": "string", "images": "array<string>", "image_shapes": "array<string>", "schema_version": "string", "shape": "array<bigint>", "spacing": "array<double>", "image_names": "array<string>",
    "has_seg": "boolean", "seg": "array<string>", "seg_names": "array<string>", "seg_shapes": "array<string>", "has_bbox": "boolean", "n_boxes": "bigint", "box_axes": "bigint", "n_scores": "bigint", "n_box_labels": "bigint",
    "checksum": "string", "computed": "string", "origin": "array<double>", "direction": "array<array<double>>", "direction_flat": "array<double>", "axis_labels": "array<string>", "patch_size": "array<bigint>",
}


def issues(samples: DataFrame, key: str = "path") -> DataFrame:
    """(key, severity, code, location): all issues, made in one pass without a shuffle."""
    absent = {name: F.lit(None).cast(kind) for name, kind in COLUMNS.items() if name not in samples.columns}
    samples = samples.withColumns(absent) if absent else samples
    found = [F.when(broken, F.struct(F.lit(sev).alias("severity"), F.lit(code).alias("code"), where.alias("location"))) for code, sev, broken, where in rules()]
    return samples.select(key, F.inline(F.array_compact(F.array(*found))))


def observed(samples: DataFrame, images: DataFrame | None = None, masks: DataFrame | None = None, boxes: DataFrame | None = None, key: str = "sample_id") -> DataFrame:
    """samples with the columns that issues() holds against the metadata, as the tables have them; without a table its columns stay as they are.

    images (key, modality, shape), masks (key, mask, shape) and boxes (key, lo, optionally score and label) are narrowed to those columns
    before they are grouped, so no array of values is read. A sample without images, masks or boxes has nulls; columns of those names are replaced."""
    out = samples

    def join(columns: list[str], found: DataFrame) -> DataFrame:
        return out.drop(*columns).join(found, key, "left")

    for rows, name, own, shapes in ((images, "modality", "images", "image_shapes"), (masks, "mask", "seg", "seg_shapes")):
        if rows is not None:
            shape = F.array_join("shape", "x") if "shape" in rows.columns else F.lit(None).cast("string")
            each = rows.groupBy(key).agg(F.array_sort(F.collect_set(F.struct(F.col(name).alias("n"), shape.alias("s")))).alias("each"))
            out = join([own, shapes], each.select(key, F.array_distinct(F.transform("each", lambda e: e["n"])).alias(own), F.array_compact(F.transform("each", lambda e: e["s"])).alias(shapes)))
    if boxes is not None:
        counted = [F.nullif(F.count(c), F.lit(0)).alias(n) for c, n in (("score", "n_scores"), ("label", "n_box_labels")) if c in boxes.columns]
        names = ["n_boxes", "box_axes", *(n for c, n in (("score", "n_scores"), ("label", "n_box_labels")) if c in boxes.columns)]
        out = join(names, boxes.groupBy(key).agg(F.count("*").alias("n_boxes"), F.max(F.size("lo")).cast("bigint").alias("box_axes"), *counted))
    return out


def write_issues(inputs: DataFrame, key: str = "path") -> DataFrame:
    """(key, code) for samples that may not be written.

    inputs: image_shapes and seg_shapes (arrays of texts like 4x4x4), level, n_boxes, box_axes, n_scores and
    n_box_labels; a null of the last five is absent."""
    c = F.col
    shape = F.get("image_shapes", F.lit(0))
    ndim = F.size(F.split(shape, "x"))
    found = F.array(
        F.when(F.coalesce(F.size("image_shapes"), F.lit(0)) <= 0, "no images"),
        F.when(F.size(F.array_distinct("image_shapes")) > 1, "image shapes differ"),
        F.when(~F.coalesce(c("level").between(0, 9), F.lit(True)), "compression level"),
        F.when(F.exists(F.coalesce("seg_shapes", F.array().cast("array<string>")), lambda x: x != shape), "mask shape"),
        F.when(F.coalesce(c("box_axes") != ndim, F.lit(False)), "box shape"),
        F.when(c("n_scores").isNotNull() & ~c("n_scores").eqNullSafe(c("n_boxes")), "score count"),
        F.when(c("n_box_labels").isNotNull() & ~c("n_box_labels").eqNullSafe(c("n_boxes")), "box label count"),
    )
    return inputs.select(key, F.explode(F.array_compact(found)).alias("code"))


def summary(samples: DataFrame, found: DataFrame, key: str = "path", strict: bool = False) -> DataFrame:
    """(checked, invalid); strict: warnings count too."""
    bad = (found if strict else found.where("severity = 'error'")).select(key).distinct().agg(F.count("*").alias("invalid"))
    return samples.agg(F.count("*").alias("checked")).crossJoin(bad)


def first_failures(found: DataFrame, key: str = "path", limit: int = 1) -> DataFrame:
    """Fail-fast: the first paths in order that have an error, a top-k and no full sort."""
    return found.where("severity = 'error'").groupBy(key).agg(F.min("code").alias("code")).orderBy(key).limit(limit)


def extra_warnings(samples: DataFrame, key: str, extra: str = "extra") -> DataFrame:
    """(key, warning) for malformed or newer parts of the JSON extra."""
    v = F.try_parse_json(extra)

    def kind(path: str) -> Column:
        return F.schema_of_variant(F.try_variant_get(v, path, "variant"))

    def there(path: str) -> Column:
        return F.try_variant_get(v, path, "variant").isNotNull()

    out = [F.when(v.isNull() & F.col(extra).isNotNull(), "extra is not JSON")]
    for part in ("review", "nnunetv2", "checksum"):
        obj = kind(f"$.{part}").startswith("OBJECT")
        version = F.try_variant_get(v, f"$.{part}.schema_version", "int")
        out += [F.when(there(f"$.{part}") & ~obj, f"{part} is not an object"), F.when(obj & (kind(f"$.{part}.schema_version") == "BIGINT") & (version > 1), f"{part} has a newer version")]
    out += [
        F.when(there("$.review.status") & (kind("$.review.status") != "STRING"), "review.status is not a string"),
        F.when(there("$.nnunetv2.labels") & ~kind("$.nnunetv2.labels").rlike("^OBJECT<([^:]+: BIGINT(, )?)*>$"), "nnunetv2.labels is not a map to integers"),
    ]
    return samples.select(key, F.explode(F.array_compact(F.array(*out))).alias("warning"))


def metadata_problems() -> list[Column]:
    """One expression for each way in which metadata may not fit the axes, the number of which is the shape's: a text, or null."""
    n = F.size("shape")

    def bad(x: Column) -> Column:
        return x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))

    def length(c: str) -> Column:
        return F.when(F.coalesce(F.size(c) != n, F.lit(False)), F.concat(F.lit(f"{c} has "), F.size(c).cast("string"), F.lit(" entries; the axes are "), n.cast("string")))

    def numbers(c: str, x: Column) -> Column:
        return F.when(F.coalesce(F.exists(x, bad), F.lit(False)), f"{c} has entries that aren't numbers")

    square = F.coalesce((F.size("direction") != n) | F.exists("direction", lambda r: F.size(r) != n), F.lit(False))
    return [
        length("spacing"), length("origin"), length("axis_labels"), length("patch_size"), numbers("spacing", F.col("spacing")), numbers("origin", F.col("origin")), numbers("direction", F.flatten("direction")),
        F.when(square, "direction isn't a square of the axes"), F.when(F.coalesce(F.size("direction_flat") != n * n, F.lit(False)), "direction isn't a square of the axes"),
        F.when(F.coalesce(F.exists("axis_labels", lambda x: x.isNull()), F.lit(False)), "axis_labels has entries that aren't texts"),
        F.when(F.coalesce(F.exists("patch_size", lambda x: x.isNull() | (x <= 0)), F.lit(False)), "patch_size has entries that aren't positive"),
    ]


def metadata_issues(samples: DataFrame, key: str = "path") -> DataFrame:
    """(key, problem) of metadata that doesn't fit its sample's axes.

    Columns: shape, spacing, origin, direction (array of rows, or flat in direction_flat), axis_labels, patch_size and extra; those
    that are absent or null are no problem. Numbers that aren't finite, and patches that aren't positive, are."""
    kinds = {"shape": "array<bigint>", "spacing": "array<double>", "origin": "array<double>", "direction": "array<array<double>>", "direction_flat": "array<double>", "axis_labels": "array<string>", "patch_size": "array<bigint>", "extra": "string"}
    rows = samples.select(key, *((F.col(c) if c in samples.columns else F.lit(None)).cast(t).alias(c) for c, t in kinds.items()))
    found = F.array(*metadata_problems(), F.when(F.col("extra").isNotNull() & F.try_parse_json("extra").isNull(), "extra is not JSON"))
    return rows.select(key, F.explode(F.array_compact(found)).alias("problem"))


def validity(samples: DataFrame, found: DataFrame, key: str = "path", strict: bool = False) -> DataFrame:
    """(key, valid) of each sample: without errors, and if strict without warnings too."""
    bad = (found if strict else found.where("severity = 'error'")).select(key).distinct().withColumn("__bad", F.lit(True))
    return samples.select(key).join(bad, key, "left").select(key, F.col("__bad").isNull().alias("valid"))


def is_valid(samples: DataFrame, key: str = "path", strict: bool = False) -> bool:
    """Whether no sample has an issue that counts."""
    return validity(samples, issues(samples, key), key, strict).where("not valid").isEmpty()
