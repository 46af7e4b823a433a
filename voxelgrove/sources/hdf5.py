"""Samples in HDF5 files: groups images/ and seg/ of arrays, boxes beside them, metadata as attributes. Needs h5py on the executors."""

from __future__ import annotations

import contextlib
import functools
import importlib.util
import json
from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from ..errors import EngineError, SchemaError, SourceError
from .nifti_format import place
from .samples import check_version

SUFFIX = ".h5"


def need(module: str) -> None:
    if importlib.util.find_spec(module) is None:
        raise SourceError(f"this source needs {module}, which isn't installed")


META_SCHEMA = (
    "path string, schema_version string, images array<string>, image_shapes array<string>, image_names array<string>, shape array<bigint>, dtype string, chunks array<bigint>, spacing array<double>, origin array<double>, "
    "direction array<array<double>>, axis_labels array<string>, coord_system string, patch_size array<bigint>, label string, label_name string, has_seg boolean, seg array<string>, seg_names array<string>, has_bbox boolean, "
    "n_boxes bigint, n_scores bigint, n_box_labels bigint, checksum string, extra string, open_error string"
)
_FIELDS = [x.strip().split(" ")[0] for x in META_SCHEMA.split(",")]


def _text(value: object) -> str | None:
    return value.decode() if isinstance(value, bytes) else None if value is None else str(value)


def _numbers(attrs: Mapping, name: str, kind: type) -> list | None:
    return [kind(v) for v in np.asarray(attrs[name]).ravel()] if name in attrs else None


def metadata(f: Mapping) -> dict:
    """The metadata of an open file: attributes and the names and shapes of its arrays, whose contents aren't read."""
    attrs, out = f.attrs, dict.fromkeys(_FIELDS)
    out["schema_version"] = str(check_version(_text(attrs.get("schema_version", "1"))))
    if "images" in f:
        group = f["images"]
        names = sorted(group)
        out |= {"images": names, "image_shapes": ["x".join(map(str, group[n].shape)) for n in names]}
        if names:
            first = group[names[0]]
            out |= {"shape": [int(s) for s in first.shape], "dtype": str(first.dtype), "chunks": [int(c) for c in first.chunks] if getattr(first, "chunks", None) else None}
        own = group.attrs
        out |= {c: _numbers(own, c, float) for c in ("spacing", "origin")}
        out |= {"patch_size": _numbers(own, "patch_size", int), "shape": _numbers(own, "shape", int) or out["shape"]}
        if "direction" in own:
            flat, n = _numbers(own, "direction", float), len(group[names[0]].shape) if names else 0
            if len(flat) != n * n:
                raise SchemaError(f"direction has {len(flat)} numbers; {n} axes need {n * n}")
            out["direction"] = [flat[n * k : n * k + n] for k in range(n)]
        if "axis_labels" in own:
            out["axis_labels"] = [_text(x) for x in own["axis_labels"]]
        out["coord_system"] = _text(own.get("coord_system"))
    for name in ("image_names", "seg_names"):
        out[name] = json.loads(_text(attrs[name])) if name in attrs else None
    masks = sorted(f["seg"]) if "seg" in f else []
    out |= {"seg": masks, "has_seg": bool(attrs.get("has_seg", False)) and bool(masks), "has_bbox": bool(attrs.get("has_bbox", False))}
    out["seg_names"] = out["seg_names"] if out["has_seg"] else None
    for name, column in (("bboxes", "n_boxes"), ("bbox_scores", "n_scores"), ("bbox_labels", "n_box_labels")):
        out[column] = int(f[name].shape[0]) if name in f else None
    return out | {"label": _text(attrs.get("label")), "label_name": _text(attrs.get("label_name")), "checksum": _text(attrs.get("checksum_sha256")), "extra": _text(attrs.get("extra"))}


def boxes(f: Mapping) -> list[tuple[list[float], list[float], float | None, str | None]]:
    """(lo, hi, score, label) of an open file's boxes; scores and labels that it lacks are null."""
    if "bboxes" not in f:
        return []
    ends = np.asarray(f["bboxes"][...], dtype=float)
    scores = np.asarray(f["bbox_scores"][...], dtype=float).tolist() if "bbox_scores" in f else [None] * len(ends)
    labels = [_text(x) for x in f["bbox_labels"][...]] if "bbox_labels" in f else [None] * len(ends)
    return [(e[:, 0].tolist(), e[:, 1].tolist(), s, x) for e, s, x in zip(ends, scores, labels, strict=True)]


@contextlib.contextmanager
def _opened(path: str) -> Iterator[Mapping]:
    """A file opened where it lies: the library seeks in it and reads the ranges that it needs."""
    import h5py

    fs, place_in = place(path)
    with fs.open_input_file(place_in) as raw, h5py.File(raw, "r") as f:
        yield f


def _each(spark: SparkSession, root: str, suffix: str, rows_of, schema: str) -> DataFrame:
    """rows_of(path, open) for each file below root. Spark lists the files and reads none of them: tasks open paths, so metadata cost no read of arrays
    and files may be longer than a row. Paths are those of pyarrow.fs."""
    need("h5py")
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").option("recursiveFileLookup", "true").load(root)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path in b["path"]:
                yield pd.DataFrame(rows_of(path, functools.partial(_opened, path)), columns=[x.strip().split(" ")[0] for x in schema.split(", ")])

    return files.select("path").mapInPandas(run, schema)


def read_meta(spark: SparkSession, root: str, suffix: str = SUFFIX) -> DataFrame:
    """The metadata of each file under root, one row per file. A file that can't be opened or read has its open_error and nulls."""

    def rows(path, opened):
        try:
            with opened() as f:
                return [tuple((metadata(f) | {"path": path}).values())]
        except (OSError, KeyError, ValueError, EngineError) as e:
            return [tuple((dict.fromkeys(_FIELDS) | {"path": path, "open_error": str(e)}).values())]

    return _each(spark, root, suffix, rows, META_SCHEMA)


def read_images(spark: SparkSession, root: str, suffix: str = SUFFIX) -> DataFrame:
    """(path, modality, shape, dtype, data) of the arrays under images/."""

    def rows(path, opened):
        with opened() as f:
            return [(path, n, list(x.shape), str(x.dtype), np.asarray(x[...], dtype=float).ravel().tolist()) for n, x in sorted(f["images"].items())]

    return _each(spark, root, suffix, rows, "path string, modality string, shape array<bigint>, dtype string, data array<double>")


def read_masks(spark: SparkSession, root: str, suffix: str = SUFFIX) -> DataFrame:
    """(path, mask, shape, data) of the arrays under seg/; a file with none, or with an empty group, has no rows."""

    def rows(path, opened):
        with opened() as f:
            return [(path, n, list(x.shape), np.asarray(x[...], dtype=bool).ravel().tolist()) for n, x in sorted(f["seg"].items())] if "seg" in f else []

    return _each(spark, root, suffix, rows, "path string, mask string, shape array<bigint>, data array<boolean>")


def read_boxes(spark: SparkSession, root: str, suffix: str = SUFFIX) -> DataFrame:
    """(path, box, lo, hi, score, label) of each file's boxes, numbered from 0."""

    def rows(path, opened):
        with opened() as f:
            return [(path, k, *b) for k, b in enumerate(boxes(f))]

    return _each(spark, root, suffix, rows, "path string, box bigint, lo array<double>, hi array<double>, score double, label string")
