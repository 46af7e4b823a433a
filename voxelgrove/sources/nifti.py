"""NIfTI-1 files, read and written without other libraries: a 348-byte header and C-order voxels in a row."""

from __future__ import annotations

import gzip
import os
import struct
import uuid
from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import SourceError
from ..operators import grids
from ..session import settle

#: Data type codes of the format and numpy's names: fixed values.
DTYPES = {2: "u1", 4: "i2", 8: "i4", 16: "f4", 64: "f8", 256: "i1", 512: "u2", 768: "u4"}
HEADER, OFFSET = 348, 352


def header(content: bytes) -> dict:
    """shape, dtype, affine (row-major list of 16), and kind, offset, slope and inter of the values, from a file's first 348 bytes."""
    if len(content) < HEADER:
        raise SourceError("too short for a NIfTI header")
    end = "<" if struct.unpack("<i", content[:4])[0] == HEADER else ">"
    if struct.unpack(end + "i", content[:4])[0] != HEADER or content[344:347] not in (b"n+1", b"ni1"):
        raise SourceError("not a NIfTI-1 file")
    dim = struct.unpack(end + "8h", content[40:56])
    code = struct.unpack(end + "h", content[70:72])[0]
    if code not in DTYPES or not 1 <= dim[0] <= 7:
        raise SourceError(f"unsupported data type {code} or dimension {dim[0]}")
    shape = [int(x) for x in dim[1 : dim[0] + 1]]
    pixdim = struct.unpack(end + "8f", content[76:108])
    offset, slope, inter = struct.unpack(end + "3f", content[108:120])
    qform, sform = struct.unpack(end + "2h", content[252:256])
    if sform > 0:
        affine = np.vstack([np.array(struct.unpack(end + "12f", content[280:328]), dtype=float).reshape(3, 4), [0, 0, 0, 1]])
    elif qform > 0:
        affine = _from_quaternion(np.array(struct.unpack(end + "6f", content[256:280]), dtype=float), pixdim)
    else:
        affine = np.diag([*(float(x) for x in pixdim[1:4]), 1.0])
    kind = np.dtype(end + DTYPES[code])
    return {"shape": shape, "dtype": kind.name, "affine": affine.ravel().tolist(), "kind": kind, "offset": int(offset), "slope": slope, "inter": inter}


def stored(content: bytes) -> tuple[dict, np.ndarray]:
    """A file's header and its values as they are stored, before slope and intercept."""
    if content[:2] == b"\x1f\x8b":
        content = gzip.decompress(content)
    head = header(content)
    count, kind = int(np.prod(head["shape"])), head["kind"]
    if len(content) - head["offset"] < count * kind.itemsize or min(head["shape"]) < 0:
        raise SourceError("the file ends before its data")
    return head, np.frombuffer(content, kind, count, head["offset"]).reshape(head["shape"], order="F")


def scaled(head: dict) -> bool:
    """Whether a file's values are numbers on another scale than they are stored on."""
    return head["slope"] not in (0.0, 1.0) or (head["slope"] != 0 and head["inter"] != 0)


def parse(content: bytes) -> dict:
    """shape, dtype, affine (row-major list of 16) and data (float64, C order) of a file's bytes."""
    head, values = stored(content)
    data = values.astype(float)
    if scaled(head):
        data = data * head["slope"] + head["inter"]
    return {c: head[c] for c in ("shape", "dtype", "affine")} | {"data": data.ravel()}


def _from_quaternion(q: np.ndarray, pixdim: tuple[float, ...]) -> np.ndarray:
    b, c, d = q[:3]
    a = np.sqrt(max(0.0, 1 - b * b - c * c - d * d))
    turn = np.array([
        [a * a + b * b - c * c - d * d, 2 * (b * c - a * d), 2 * (b * d + a * c)],
        [2 * (b * c + a * d), a * a + c * c - b * b - d * d, 2 * (c * d - a * b)],
        [2 * (b * d - a * c), 2 * (c * d + a * b), a * a + d * d - b * b - c * c],
    ])
    out = np.eye(4)
    out[:3, :3] = turn * np.array([pixdim[1], pixdim[2], (-1.0 if pixdim[0] < 0 else 1.0) * pixdim[3]])
    out[:3, 3] = q[3:]
    return out


def build(data: np.ndarray, affine: np.ndarray, compress: bool = True) -> bytes:
    """A NIfTI-1 file of an array, with its affine as sform."""
    codes = {v: k for k, v in DTYPES.items()}
    kind = data.dtype.str[1:] if data.dtype.itemsize > 1 else ("i1" if data.dtype.kind == "i" else "u1")
    if data.dtype == bool:
        data, kind = data.astype("u1"), "u1"
    if kind not in codes:
        raise SourceError(f"{data.dtype} has no NIfTI type")
    head = bytearray(OFFSET)
    struct.pack_into("<i", head, 0, HEADER)
    struct.pack_into("<8h", head, 40, data.ndim, *data.shape, *[1] * (7 - data.ndim))
    struct.pack_into("<2h", head, 70, codes[kind], data.dtype.itemsize * 8)
    norm = np.sqrt((affine[:3, :3] ** 2).sum(axis=0))
    struct.pack_into("<8f", head, 76, 1.0, *norm, 1.0, 1.0, 1.0, 1.0)
    struct.pack_into("<3f", head, 108, float(OFFSET), 1.0, 0.0)
    struct.pack_into("<2h", head, 252, 0, 1)
    struct.pack_into("<12f", head, 280, *affine[:3].ravel())
    head[344:348] = b"n+1\0"
    out = bytes(head) + data.astype("<" + kind).tobytes(order="F")
    return gzip.compress(out, mtime=0) if compress else out


SCHEMA = "path string, shape array<bigint>, dtype string, affine array<double>, data array<double>, error string"


def read(spark: SparkSession, root: str, pattern: str = "*.nii*", skip_invalid: bool = False) -> DataFrame:
    """(path, shape, dtype, affine, data, error): one row per file, parsed on the executors.

    A file that can't be parsed has its error and nulls; with skip_invalid it is left out."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(root)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, content in zip(b["path"], b["content"]):
                try:
                    x = parse(bytes(content))
                    rows.append((path, x["shape"], x["dtype"], x["affine"], x["data"].tolist(), None))
                except (SourceError, struct.error, OSError, EOFError) as e:
                    rows.append((path, None, None, None, None, str(e)))
            yield pd.DataFrame(rows, columns=["path", "shape", "dtype", "affine", "data", "error"])

    out = files.select("path", "content").mapInPandas(run, SCHEMA)
    return out.where(F.col("error").isNull()) if skip_invalid else out


def _built(b: pd.DataFrame) -> Iterator[bytes]:
    for s, t, a, x in zip(b["shape"], b["dtype"], b["affine"], b["data"]):
        yield build(np.asarray(x, dtype=float).reshape(s).astype(t), np.asarray(a, dtype=float).reshape(4, 4))


def encode(volumes: DataFrame) -> DataFrame:
    """(name, content) of rows (name, shape, dtype, affine, data): files as bytes, made on the executors."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"name": b["name"], "content": list(_built(b))})

    return volumes.select("name", "shape", "dtype", "affine", "data").mapInPandas(run, "name string, content binary")


def _put(path: str, content: bytes) -> None:
    """A whole file under a hidden name, then renamed, so that a task that is run again does no harm."""
    folder, name = os.path.split(path)
    os.makedirs(folder, exist_ok=True)
    part = f"{folder}/.{uuid.uuid4().hex}.tmp"
    try:
        with open(part, "wb") as f:
            f.write(content)
        # The checksum that Hadoop keeps of a file it wrote here before.
        if os.path.exists(old := f"{folder}/.{name}.crc"):
            os.remove(old)
        os.replace(part, path)
    except BaseException:
        if os.path.exists(part):
            os.remove(part)
        raise


def export(volumes: DataFrame, folder: str) -> None:
    """Writes encode()'s files into a folder that all executors see: in the tasks, one volume at a time.

    Other file systems are written by the data source `nifti` (nifti_format), which needs pyarrow's access to them."""
    spark = volumes.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    top = jvm.org.apache.hadoop.fs.Path(folder)
    place = top.getFileSystem(conf).makeQualified(top).toUri()
    if place.getScheme() == "file":
        root = place.getPath().rstrip("/")

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                sizes = []
                for name, content in zip(b["name"], _built(b)):
                    _put(f"{root}/{name}", content)
                    sizes.append(len(content))
                yield pd.DataFrame({"name": b["name"], "bytes": sizes})

        rows = volumes.select("name", "shape", "dtype", "affine", "data")
        rows.mapInPandas(run, "name string, bytes long").write.format("noop").mode("overwrite").save()
        return
    from . import nifti_format

    nifti_format.register(spark)
    volumes.select("name", "shape", "dtype", "affine", "data").write.format("nifti").mode("overwrite").save(folder)


def import_samples(images: DataFrame, files: DataFrame, same_grid: bool = True, onto: str | None = None, order: str = "linear") -> DataFrame:
    """(sample_id, modality, shape, dtype, affine, data, problem) of images (sample_id, modality, path) joined with read files.

    With onto, the name of a modality, all others are read on that one's grid. With same_grid each modality must then have
    the shape and, within 1e-5, the affine of the sample's first modality by name; those that don't have a non-null problem."""
    rows = images.join(files, "path", "left")
    if onto is not None:
        target = rows.where((F.col("modality") == onto) & F.col("data").isNotNull()).select("sample_id", "shape", "affine")
        rows = grids.resample_to(rows.where(F.col("modality") != onto), target, order).unionByName(rows.where(F.col("modality") == onto))
    first = rows.groupBy("sample_id").agg(F.min_by(F.struct("shape", "affine"), "modality").alias("f"))
    rows = rows.join(first, "sample_id")
    problem = F.when(F.col("data").isNull(), "unreadable or missing")
    if same_grid:
        problem = problem.when(~F.col("shape").eqNullSafe(F.col("f.shape")), "shape differs").when(~grids.same_grid(F.col("shape"), F.col("affine"), F.col("f.shape"), F.col("f.affine")), "affine differs")
    return rows.select("sample_id", "modality", "shape", "dtype", "affine", "data", problem.alias("problem"))


def import_masks(masks: DataFrame, files: DataFrame, grid: DataFrame, resample: bool = False) -> DataFrame:
    """(sample_id, mask, shape, affine, data array<boolean>) of masks (sample_id, mask, path) joined with read files.

    grid: (sample_id, shape, affine) of the images. A mask on another grid is read on the images', to the nearest point, if
    resample, else it is an error; so is a file that can't be read. What isn't 0 is inside."""
    rows = masks.join(files, "path", "left")
    if bad := rows.where("data is null").select("sample_id", "mask", "path").orderBy("sample_id", "mask").first():
        raise SourceError(f"{bad['sample_id']}, {bad['mask']}: {bad['path']} is unreadable or missing")
    if resample:
        rows = grids.resample_to(rows, grid, "nearest")
    else:
        own = grid.select("sample_id", F.col("shape").alias("__s"), F.col("affine").alias("__a"))
        odd = rows.join(own, "sample_id", "left").where(~grids.same_grid(F.col("shape"), F.col("affine"), F.col("__s"), F.col("__a"))).orderBy("sample_id", "mask").first()
        if odd:
            raise SourceError(f"{odd['sample_id']}, {odd['mask']}: another grid than the images'; resample it")
    return rows.select("sample_id", "mask", "shape", "affine", F.transform("data", lambda x: x != 0).alias("data"))


def import_folder(
    spark: SparkSession, root: str, images: Mapping[str, str] | None = None, masks: Mapping[str, str] | None = None, resample_to: str | None = None, order: str = "linear", resample_masks: bool = False,
    same_grid: bool = True, skip_invalid: bool = False, label: str | None = None, label_name: str | None = None,
) -> dict[str, DataFrame]:
    """samples, images and masks of a folder that has a subfolder for each sample.

    images and masks give the name of each modality and mask the name of its file ({"CT": "ct.nii.gz"}); without images both are
    known by the names that export_volumes() gives. A sample is a subfolder with an image; it must have each image named, and may lack
    masks. With resample_to, the name of a modality, the others are read on its grid in the given order, and masks, with
    resample_masks, on the images' to the nearest point. What can't be read, or lies on another grid, is an error that names the first
    sample, or, with skip_invalid, leaves that sample out. Files are parsed once, in tasks."""
    files = settle(read(spark, root))
    file, sample = (F.regexp_extract("path", "([^/]+)/([^/]+)$", k) for k in (2, 1))
    if images is None:
        names = {kind: F.regexp_extract(file, f"^{kind}_(.+?)\\.nii(\\.gz)?$", 1) for kind in ("image", "seg")}
        names = {kind: F.when(c != "", c) for kind, c in names.items()}
    else:
        named = {kind: [F.lit(x) for k, v in (given or {}).items() for x in (v, k)] for kind, given in (("image", images), ("seg", masks))}
        names = {kind: F.try_element_at(F.create_map(*pairs), file) if pairs else F.lit(None).cast("string") for kind, pairs in named.items()}
    found = files.select("path", sample.alias("sample_id"), names["image"].alias("modality"), names["seg"].alias("mask"))
    image_files = found.where("modality is not null").select("sample_id", "modality", "path")
    ids = image_files.select("sample_id").distinct()
    want = ids.withColumn("modality", F.explode(F.array(*map(F.lit, images or ())).cast("array<string>")))
    out = import_samples(want.join(image_files, ["sample_id", "modality"], "full") if images else image_files, files, same_grid, resample_to, order)
    if resample_to is not None:
        # A sample that lacks the target has nothing to be read on.
        target = out.where((F.col("modality") == resample_to) & F.col("data").isNotNull()).select("sample_id", F.lit(True).alias("there"))
        out = out.join(target, "sample_id", "left").withColumn("problem", F.coalesce("problem", F.when(F.col("there").isNull(), f"no {resample_to} to resample to"))).drop("there")
    out = settle(out)
    bad = out.where("problem is not null")
    if not skip_invalid and (first := bad.orderBy("sample_id", "modality").select("sample_id", "modality", "problem").first()):
        raise SourceError(f"{first['sample_id']}, {first['modality']}: {first['problem']}")
    out = out.join(bad.select("sample_id").distinct(), "sample_id", "left_anti").drop("problem")
    grid = out.groupBy("sample_id").agg(F.min_by(F.struct("shape", "affine"), "modality").alias("g"), F.array_sort(F.collect_set("modality")).alias("image_names"))
    grid = settle(grid.select("sample_id", "g.shape", "g.affine", "image_names"))
    mask_files = found.where("mask is not null").select("sample_id", "mask", "path").join(grid.select("sample_id"), "sample_id", "left_semi")
    inside = settle(import_masks(mask_files, files, grid, resample_masks))
    segs = inside.groupBy("sample_id").agg(F.array_sort(F.collect_set("mask")).alias("seg_names"))
    spacing = F.array(*(F.sqrt(sum((F.get("affine", F.lit(4 * r + c)) * F.get("affine", F.lit(4 * r + c)) for r in range(3)), F.lit(0.0))) for c in range(3)))
    samples = grid.join(segs, "sample_id", "left").select(
        "sample_id", F.col("sample_id").alias("path"), F.lit(label).cast("string").alias("label"), F.lit(label_name).cast("string").alias("label_name"), "image_names", "shape", spacing.alias("spacing"),
        F.transform(F.sequence(F.lit(0), F.lit(2)), lambda r: F.get("affine", 4 * r + 3)).alias("origin"), F.col("seg_names").isNotNull().alias("has_seg"), "seg_names", F.lit(False).alias("has_bbox"), F.lit("1").alias("schema_version"),
    )
    return {"samples": samples, "images": out, "masks": inside}


def export_volumes(images: DataFrame, masks: DataFrame | None = None, modalities: list[str] | None = None, names: list[str] | None = None, suffix: str = ".nii.gz") -> DataFrame:
    """(name, shape, dtype, affine, data) for export(): <sample>/image_<modality> and <sample>/seg_<mask> (uint8).

    modalities and names restrict the two; one that a sample lacks is an error. Without an affine a volume has the unit one."""
    def only(rows: DataFrame, column: str, wanted: list[str] | None) -> DataFrame:
        if wanted is None:
            return rows
        ids = images.select("sample_id").distinct().withColumn(column, F.explode(F.array(*map(F.lit, wanted)).cast("array<string>")))
        if lost := ids.join(rows.select("sample_id", column), ["sample_id", column], "left_anti").orderBy("sample_id", column).first():
            raise SourceError(f"{lost['sample_id']} has no {column} {lost[column]}")
        return rows.where(F.col(column).isin(wanted))

    unit = F.array(*(F.lit(float(r == c)) for r in range(4) for c in range(4)))
    out = only(images, "modality", modalities).select(F.concat(F.col("sample_id").cast("string"), F.lit("/image_"), "modality", F.lit(suffix)).alias("name"), "shape", "dtype", F.coalesce("affine", unit).alias("affine"), "data")
    if masks is not None:
        rows = only(masks, "mask", names)
        out = out.union(rows.select(F.concat(F.col("sample_id").cast("string"), F.lit("/seg_"), "mask", F.lit(suffix)), "shape", F.lit("uint8"), F.coalesce("affine", unit), F.transform("data", lambda x: x.cast("double"))))
    return out
