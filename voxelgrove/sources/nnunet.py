"""Folders of channel images and label volumes with a dataset.json."""

from __future__ import annotations

import json
import re
from collections.abc import Mapping

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ValidationError
from ..operators import cases, grids, labels
from ..session import settle
from . import nifti

REQUIRED = ("channel_names", "labels", "numTraining", "file_ending")


def check_dataset(text: str) -> dict:
    """dataset.json, read and checked: a small file, so on the driver."""
    try:
        d = json.loads(text)
    except ValueError as e:
        raise ValidationError("dataset.json is not JSON") from e
    if missing := [k for k in REQUIRED if k not in d]:
        raise ValidationError(f"dataset.json lacks {', '.join(missing)}")
    if sorted(d["channel_names"], key=str) != [str(i) for i in range(len(d["channel_names"]))]:
        raise ValidationError("channels must be numbered from 0 without gaps")
    values = d["labels"].values()
    if any(isinstance(v, (list, tuple)) for v in values):
        raise ValidationError("regions aren't supported")
    if any(isinstance(v, bool) or not isinstance(v, int) for v in values) or sorted(values) != list(range(len(d["labels"]))):
        raise ValidationError("labels must be the integers from 0 on")
    if d["labels"].get("background") != 0:
        raise ValidationError("background must be 0")
    if not str(d["file_ending"]).startswith("."):
        raise ValidationError("file_ending must start with a dot")
    return d


def list_cases(spark: SparkSession, root: str, folder: str = "imagesTr", ending: str = ".nii.gz") -> DataFrame:
    """(path, name, case_id, channel) of the channel images."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*{ending}").load(f"{root.rstrip('/')}/{folder}").select("path")
    return cases.case_files(files.withColumn("name", F.regexp_extract("path", "([^/]+)$", 1)), ending)


def with_labels(found: DataFrame, label_files: DataFrame) -> DataFrame:
    """Cases with label_path; check() of those without one is up to the caller."""
    one = label_files.select(F.regexp_extract("path", "([^/]+?)\\.nii(\\.gz)?$", 1).alias("case_id"), F.col("path").alias("label_path"))
    return found.join(one, "case_id", "left")


def channel_order(stored: Mapping[str, str] | None, modalities: list[str]) -> list[str]:
    """The stored order of channels, else alphabetical."""
    return [stored[k] for k in sorted(stored, key=int)] if stored else sorted(modalities)


def label_values(stored: Mapping[str, int] | None, masks: list[str]) -> dict[str, int]:
    """The stored values, else 1, 2, ... for the masks by name, with background 0."""
    return dict(stored) if stored else {"background": 0} | {m: i + 1 for i, m in enumerate(sorted(masks))}


#: The version of what is kept of dataset.json beside the samples.
KEPT_VERSION = 1


def read_dataset(spark: SparkSession, root: str) -> dict:
    """dataset.json of a folder, checked: one small file."""
    rows = spark.read.text(f"{root.rstrip('/')}/dataset.json", wholetext=True).collect()
    return check_dataset(rows[0][0])


def kept_json(dataset: Mapping) -> str:
    """What a sample keeps of dataset.json: all of it, with texts as channel numbers, and a version."""
    channels = {str(k): v for k, v in sorted(dataset["channel_names"].items(), key=lambda x: int(x[0]))}
    return json.dumps({**dataset, "channel_names": channels, "labels": dict(dataset["labels"]), "schema_version": KEPT_VERSION})


def stem(path: str | Column) -> Column:
    """The case of a file: its name without folders and its last ending, or without .nii.gz."""
    return F.regexp_replace(F.regexp_extract(path, "([^/]+)$", 1), "(\\.nii\\.gz|\\.[^.]+)$", "")


def collect_samples(paths: DataFrame, root: str) -> DataFrame:
    """(path, part, case_id) of sample files under root: imagesTr and imagesTs if there is an imagesTr, else those right under root, all for training."""
    inner = F.regexp_replace(F.col("path"), f"^(file:)?/*{re.escape(root.rstrip('/').removeprefix('file:').lstrip('/'))}/", "")
    rows = paths.select("path", F.regexp_extract(inner, "^(?:(imagesTr|imagesTs)/)?[^/]+$", 0).alias("name"), F.regexp_extract(inner, "^(imagesTr|imagesTs)/[^/]+$", 1).alias("folder")).where("name <> ''")
    split = not rows.where("folder = 'imagesTr'").isEmpty()
    part = F.when(F.col("folder") == "imagesTr", "train").when(F.col("folder") == "imagesTs", "test") if split else F.when(F.col("folder") == "", "train")
    return rows.select("path", part.alias("part"), stem("path").alias("case_id")).where("part is not null").orderBy("path")


def import_dataset(spark: SparkSession, root: str, include_test: bool = True) -> dict[str, DataFrame]:
    """samples, images and masks of a dataset folder.

    samples: (sample_id, part, modalities, extra) and the metadata of records; images: (sample_id, part, modality, shape, dtype, affine, data); masks:
    (sample_id, mask, shape, affine, data array<boolean>), one for each label but the background. Every case must have each channel
    once and nothing else, training cases a label volume too, and all volumes of a case one grid; a label volume has declared
    values only. What doesn't hold is an error that names the first such case. Files are read and parsed in tasks; the driver sees dataset.json."""
    d = read_dataset(spark, root)
    names = {int(k): v for k, v in d["channel_names"].items()}
    ending, base = d["file_ending"], root.rstrip("/")
    images, parts = None, [("train", "imagesTr")] + ([("test", "imagesTs")] if include_test and _exists(spark, f"{base}/imagesTs") else [])
    modality = F.create_map(*(F.lit(x) for k, v in names.items() for x in (k, v)))
    for part, folder in parts:
        found = list_cases(spark, root, folder, ending)
        wrong = cases.discover(found, channels=len(names)).where("missing <> '' or extra <> '' or duplicates > 0").orderBy("case_id").first()
        if wrong:
            raise ValidationError(f"{part} case {wrong['case_id']}: channels missing {wrong['missing'] or 'none'}, extra {wrong['extra'] or 'none'}, repeated {wrong['duplicates']}")
        rows = found.select("path", F.col("case_id").alias("sample_id"), F.try_element_at(modality, F.col("channel")).alias("modality"), F.lit(part).alias("part"))
        rows = rows.join(nifti.read(spark, f"{base}/{folder}", f"*{ending}"), "path")
        images = rows if images is None else images.union(rows)
    # Written once: every check below, and each table that is given back, would parse the files again.
    images = settle(images)
    labels_read = nifti.read(spark, f"{base}/labelsTr", f"*{ending}").withColumn("sample_id", F.regexp_replace(F.regexp_extract("path", "([^/]+)$", 1), f"{re.escape(ending)}$", ""))
    labels_read = settle(labels_read)
    if bad := images.select("path", "error").union(labels_read.select("path", "error")).where("error is not null").orderBy("path").first():
        raise ValidationError(f"{bad['path']}: {bad['error']}")
    train = images.where("part = 'train'").select("sample_id").distinct()
    for have, want, what in ((train, labels_read, "no label volume"), (labels_read, train, "a label volume but no images")):
        if lost := have.select("sample_id").join(want.select("sample_id"), "sample_id", "left_anti").orderBy("sample_id").first():
            raise ValidationError(f"case {lost['sample_id']}: {what}")
    volumes = images.select("sample_id", "modality", "shape", "affine").union(labels_read.select("sample_id", F.lit("~label"), "shape", "affine"))
    first = volumes.groupBy("sample_id").agg(F.min_by(F.struct("shape", "affine"), "modality").alias("f"))
    if off := volumes.join(first, "sample_id").where(~grids.same_grid(F.col("shape"), F.col("affine"), F.col("f.shape"), F.col("f.affine"))).orderBy("sample_id", "modality").first():
        raise ValidationError(f"case {off['sample_id']}: {off['modality'].lstrip('~')} lies on another grid")
    declared = F.array(*(F.lit(float(v)) for v in d["labels"].values()))
    if odd := labels_read.where(F.size(F.array_except("data", declared)) > 0).orderBy("sample_id").first():
        raise ValidationError(f"case {odd['sample_id']}: undeclared label values")
    each = F.array(*(F.struct(F.lit(k).alias("mask"), F.lit(float(v)).alias("value")) for k, v in d["labels"].items() if v))
    masks = labels_read.select("sample_id", F.explode(each).alias("m"), "shape", "affine", "data")
    masks = masks.select("sample_id", F.col("m.mask").alias("mask"), "shape", "affine", F.transform("data", lambda x: x == F.col("m.value")).alias("data"))
    segs = F.when(F.col("part") == "train", F.array(*(F.lit(k) for k in sorted(k for k, v in d["labels"].items() if v))).cast("array<string>"))
    samples = images.groupBy("sample_id", "part").agg(F.array_sort(F.collect_set("modality")).alias("modalities"), F.min_by("shape", "modality").alias("shape"))
    samples = samples.withColumns({
        "path": F.col("sample_id"), "image_names": F.col("modalities"), "has_seg": F.coalesce(F.size(segs) > 0, F.lit(False)), "seg_names": segs, "has_bbox": F.lit(False), "schema_version": F.lit("1"),
        "extra": F.lit(json.dumps({"nnunetv2": json.loads(kept_json(d))})),
    })
    return {"samples": samples, "images": images.select("sample_id", "part", "modality", "shape", "dtype", "affine", "data"), "masks": masks}


def _exists(spark: SparkSession, folder: str) -> bool:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


def label_volumes(masks: DataFrame, values: Mapping[str, int]) -> DataFrame:
    """(sample_id, shape, affine, data) of masks as one label volume each: the largest value of the masks a voxel is in, else 0.

    A mask without a value is an error; a volume is one row, its masks are few and meet by an aggregate."""
    if odd := masks.where(~F.col("mask").isin([k for k, v in values.items() if v])).select("sample_id", "mask").orderBy("sample_id", "mask").first():
        raise ValidationError(f"case {odd['sample_id']}: mask {odd['mask']} has no label value")
    value = F.try_element_at(F.create_map(*(F.lit(x) for k, v in values.items() for x in (k, float(v)))), F.col("mask"))
    rows = masks.withColumn("data", F.transform("data", lambda x: F.when(x, value).otherwise(F.lit(0.0))))
    whole = F.reduce(F.slice(F.collect_list("data"), 2, 1 << 30), F.get(F.collect_list("data"), F.lit(0)), lambda acc, x: F.zip_with(acc, x, lambda p, q: F.greatest(p, q)))
    return rows.groupBy("sample_id").agg(F.first("shape").alias("shape"), F.first("affine").alias("affine"), whole.alias("data"))


def kept_dataset(samples: DataFrame) -> dict:
    """What samples keep of the dataset.json they came from; {} if none keeps anything. Two that differ are an error, as a folder has one."""
    if "extra" not in samples.columns:
        return {}
    kept = F.get_json_object("extra", "$.nnunetv2")
    rows = samples.select(*(F.get_json_object(kept, f"$.{k}").alias(k) for k in ("channel_names", "labels"))).where("channel_names is not null or labels is not null").distinct().limit(2).collect()
    if len(rows) > 1:
        raise ValidationError("samples of datasets with other channels or labels can't share a folder")
    return {k: json.loads(v) for k, v in rows[0].asDict().items() if v is not None} if rows else {}


def export_dataset(tables: Mapping[str, DataFrame], folder: str, channels: Mapping[str, str] | None = None, values: Mapping[str, int] | None = None, ending: str = ".nii.gz", name: str | None = None) -> dict[str, int]:
    """samples, images and masks, as import_dataset() and nifti.import_folder() give them, as a dataset folder.

    Channels and label values are those given, else those that the samples keep of their dataset.json, else the modalities by name and
    1, 2, ... for the masks by name. The part is that of samples, where they have one, else train. A training sample without a mask gets a label
    volume of zeros. Names of modalities and masks come to the driver, volumes don't. Otherwise as export()."""
    samples, images, masks = tables["samples"], tables["images"], tables.get("masks")
    kept = kept_dataset(samples)
    if channels is None:
        have = [r[0] for r in images.select("modality").distinct().collect()]
        channels = {str(i): m for i, m in enumerate(channel_order(kept.get("channel_names"), have))}
    if values is None:
        have = [r[0] for r in masks.select("mask").distinct().collect()] if masks is not None and "labels" not in kept else []
        values = label_values(kept.get("labels"), have)
    part = samples.select("sample_id", F.coalesce("part", F.lit("train")).alias("part") if "part" in samples.columns else F.lit("train").alias("part"))
    images = images.drop("part").join(part, "sample_id")
    first = images.where("part = 'train'").groupBy("sample_id").agg(F.min_by(F.struct("shape", "affine"), "modality").alias("g")).select("sample_id", "g.shape", "g.affine")
    size = F.aggregate("shape", F.lit(1).cast("bigint"), lambda a, x: a * x).cast("int")
    empty = first.select("sample_id", "shape", "affine", F.array_repeat(F.lit(0.0), size).alias("data"))
    if masks is not None:
        whole = label_volumes(masks.join(first.select("sample_id"), "sample_id", "left_semi"), values)
        empty = whole.unionByName(empty.join(masks.select("sample_id").distinct(), "sample_id", "left_anti"))
    case = stem(F.col("sample_id").cast("string"))
    image = images.select(case.alias("case_id"), F.lit("image").alias("kind"), "modality", "shape", "dtype", "affine", "data", "part")
    lab = empty.select(case.alias("case_id"), F.lit("label").alias("kind"), F.lit(None).cast("string").alias("modality"), "shape", F.lit("uint8").alias("dtype"), "affine", "data", F.lit("train").alias("part"))
    return export(image.unionByName(lab), folder, channels, values, ending, name)


def export(volumes: DataFrame, folder: str, channels: Mapping[str, str], values: Mapping[str, int], ending: str = ".nii.gz", name: str | None = None) -> dict[str, int]:
    """volumes (case_id, kind image or label, modality, shape, dtype, affine, data, optionally part train or test) as a dataset folder; (numTraining, numTest) as a dict.

    Every case must have each channel once and no other, and training cases a label volume; else it is an error and nothing is written."""
    of = {v: int(k) for k, v in channels.items()}
    volumes = volumes if "part" in volumes.columns else volumes.withColumn("part", F.lit("train"))
    image = volumes.where("kind = 'image'")
    per_case = image.groupBy("case_id").agg(F.array_sort(F.collect_list("modality")).alias("have"), F.first("part").alias("part"))
    want = F.array(*(F.lit(m) for m in sorted(of)))
    if odd := per_case.where(F.col("have") != want).orderBy("case_id").first():
        raise ValidationError(f"case {odd['case_id']}: channels {', '.join(odd['have'])} instead of {', '.join(sorted(of))}")
    lab = volumes.where("kind = 'label'")
    if lost := per_case.where("part = 'train'").join(lab.select("case_id"), "case_id", "left_anti").orderBy("case_id").first():
        raise ValidationError(f"case {lost['case_id']}: no label volume")
    number = F.try_element_at(F.create_map(*(F.lit(x) for k, v in of.items() for x in (k, v))), F.col("modality"))
    place = F.when(F.col("part") == "test", "imagesTs/").otherwise("imagesTr/")
    image = image.withColumn("name", F.concat(place, cases.channel_name(F.col("case_id"), number, ending)))
    lab = lab.where("part <> 'test'").withColumn("name", F.concat(F.lit("labelsTr/"), F.col("case_id").cast("string"), F.lit(ending))).withColumn("dtype", F.lit(labels.label_dtype(values)))
    nifti.export(image.unionByName(lab), folder)
    n = {r["part"]: r["count"] for r in per_case.groupBy("part").count().collect()}
    spark = volumes.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/dataset.json")
    out = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(path, True)
    told = {"channel_names": dict(channels), "labels": dict(values), "numTraining": n.get("train", 0), "file_ending": ending} | ({"name": name} if name else {})
    out.write(bytearray(json.dumps(told).encode()))
    out.close()
    return {"numTraining": n.get("train", 0), "numTest": n.get("test", 0)}


def split_masks(data: np.ndarray, values: Mapping[str, int]) -> dict[str, np.ndarray]:
    """One mask for each label but the background of a small volume."""
    return {k: data == v for k, v in values.items() if v}
