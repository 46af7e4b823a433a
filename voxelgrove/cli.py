"""Command line over sample tables: python -m voxelgrove.cli COMMAND ... Exit codes: 0 well, 1 a known error, 2 bad usage.

A dataset is a folder of Parquet tables: samples, tiles, images, voxels, masks, boxes and review_events, as far as a command needs them."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import EngineError, ValidationError
from .operators import checksum, grids, manifest, records, review, series, split, stats, validation
from .session import session, settle
from .sources import dicom, hdf5, nifti, samples


def _table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root.rstrip('/')}/{name}")


def _tables(spark: SparkSession, root: str, *more: str) -> dict[str, DataFrame]:
    """The tables of a dataset that hold its samples' content, and others, as far as they are there."""
    out = {}
    for name in ("samples", *checksum.PARTS, *more):
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{name}")
        if name == "samples" or path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            out[name] = _table(spark, root, name)
    return out


def _key(tables: dict[str, DataFrame]) -> str:
    return "sample_id" if "sample_id" in tables["samples"].columns else "path"


def _show(df: DataFrame) -> None:
    """Prints every row; the driver holds one partition at a time."""
    for row in df.toJSON().toLocalIterator():
        print(row)


def parse_ratios(text: str) -> dict[str, float]:
    """Two or three numbers: train,val or train,val,test."""
    try:
        values = [float(x) for x in text.split(",")]
    except ValueError as e:
        raise ValidationError(f"ratios must be numbers: {text}") from e
    if len(values) not in (2, 3):
        raise ValidationError("give two or three ratios")
    return dict(zip(("train", "val", "test"), values))


def info(spark, a):
    rows = _table(spark, a.root, "samples")
    for row in records.info(rows.where(F.col("path") == a.path) if a.path else rows).orderBy("path").toLocalIterator():
        print(row["payload"])


def _observed(spark: SparkSession, root: str) -> tuple[DataFrame, str]:
    """The table of samples beside what the dataset's other tables hold of each, as far as there are any, and the column that names a sample."""
    tables = _tables(spark, root)
    rows, key, seen = tables["samples"], _key(tables), {n: tables[n] for n in ("images", "masks", "boxes") if n in tables}
    if seen and "checksum" in rows.columns:
        rows = checksum.computed(tables, key)
    return validation.observed(rows, **seen, key=key), "path" if "path" in rows.columns else key


def validate(spark, a):
    rows, key = _observed(spark, a.root)
    found = validation.issues(rows.where(F.col(key) == a.path) if getattr(a, "path", None) else rows, key)
    if getattr(a, "fail_fast", False):
        found = validation.first_failures(found, key)
    _show(found)
    bad = found if getattr(a, "strict", False) or "severity" not in found.columns else found.where("severity = 'error'")
    return 0 if bad.isEmpty() else 1


def validate_all(spark, a):
    code = validate(spark, a)
    rows, key = _observed(spark, a.root)
    _show(validation.summary(rows, validation.issues(rows, key), key, strict=a.strict))
    return code


def audit(spark, a):
    tables = _tables(spark, a.root)
    if a.stamp:
        checksum.stamped(tables, _key(tables)).write.parquet(a.stamp)
        return 0
    rows = settle(checksum.audited(tables, _key(tables)))
    _show(rows.where("status = 'mismatch'"))
    out = checksum.audit(rows)
    _show(out)
    return 1 if out.first()["failed"] else 0


def recompress(spark, a):
    samples.recompress(spark, a.source, a.target, a.preset)


def index(spark, a):
    if a.files:
        samples_read = hdf5.read_meta(spark, a.root, a.suffix)
        found = records.build(samples_read, manifest.list_files(spark, a.root, a.suffix), skip_invalid=a.skip_invalid)
    else:
        found = records.build(_table(spark, a.root, "samples"), skip_invalid=a.skip_invalid)
    manifest.save(found, a.out)


def do_split(spark, a):
    rows = manifest.load(spark, a.manifest)
    kw = {"stratum": a.stratify, "seed": a.seed, "ordinal": "ordinal" if "ordinal" in rows.columns else "path"}
    out = split.make_splits(rows, a.group, parse_ratios(a.ratios) if a.ratios else None, a.k_folds, **kw)
    out.orderBy("path").write.partitionBy("part" if a.ratios else "fold").json(a.out)


def do_stats(spark, a):
    modal = a.modalities.split(",") if a.modalities else None
    voxels, found = _table(spark, a.root, "voxels"), _tables(spark, a.root, "shapes")
    by_voxel = a.foreground and a.foreground not in voxels.columns and {"masks", "shapes"} <= set(found)
    inside = {"inside": found["masks"], "shapes": found["shapes"]} if by_voxel else {}
    out = stats.compute_stats(found["samples"], voxels, modalities=modal, mask=a.foreground, exact=a.exact, cap=a.sample_voxels, **inside)
    if a.out:
        stats.save(out, a.out)
    else:
        for name, df in out.items():
            print(json.dumps({"table": name}))
            _show(df)


def _named(given: list[str] | None) -> dict[str, str] | None:
    """NAME=FILE arguments."""
    if any("=" not in x or not all(x.split("=", 1)) for x in given or ()):
        raise ValidationError("images and masks are given as NAME=FILE")
    return dict(x.split("=", 1) for x in given) if given else None


def _write(tables: dict[str, DataFrame], root: str) -> None:
    for name, df in tables.items():
        samples.write(df, f"{root.rstrip('/')}/{name}")


def import_nifti(spark, a):
    if a.volumes:
        nifti.read(spark, a.source, skip_invalid=a.skip_invalid).write.parquet(a.target)
        return
    images, masks = _named(a.image), _named(a.seg)
    if masks and not images:
        raise ValidationError("name the images too")
    out = nifti.import_folder(spark, a.source, images, masks, a.resample_to, a.interpolator, a.resample_seg, not a.any_grid, a.skip_invalid, a.label, a.label_name)
    _write(out, a.target)


def import_dicom(spark, a):
    rows = settle(dicom.read_dicom(spark, a.source))
    _show(rows.where("problem is not null and problem not in ('not a DICOM file', 'no pixels')").select("path", "problem"))
    if a.all_series:
        out = settle(series.volumes(dicom.slices(rows), lut=not a.stored_values))
        _show(out.where("problem is not null").select("uid", "problem"))
        out = out.where("problem is null").drop("problem")
    else:
        out = series.assemble(dicom.slices(rows), a.series_uid, lut=not a.stored_values)
    out.withColumn("modality", F.lit(a.modality)).write.parquet(a.target)


def import_nnunetv2(spark, a):
    from .sources import nnunet

    _write(nnunet.import_dataset(spark, a.source, not a.no_test), a.target)


def export_nifti(spark, a):
    modalities, masks = (x.split(",") if x else None for x in (a.modalities, a.masks))
    found = samples.SampleSet(spark, a.source)
    if found.images is None:
        nifti.export(spark.read.parquet(a.source), a.target)
    else:
        nifti.export(nifti.export_volumes(found.images, found.masks, modalities, masks), a.target)


def export_nnunetv2(spark, a):
    from .sources import nnunet

    channels, values = (json.loads(x) if x else None for x in (a.channels, a.labels))
    found = samples.SampleSet(spark, a.source)
    if found.images is None:
        if channels is None or values is None:
            raise ValidationError("a table of volumes needs --channels and --labels")
        print(json.dumps(nnunet.export(spark.read.parquet(a.source), a.target, channels, values)))
    else:
        print(json.dumps(nnunet.export_dataset({"samples": found.samples, "images": found.images, "masks": found.masks}, a.target, channels, values, a.file_ending, a.dataset_name)))


def review_set(spark, a):
    events = _table(spark, a.root, "review_events")
    known = _table(spark, a.root, "samples")
    key = "sample_id" if "sample_id" in known.columns else "path"
    new = review.set_status(events, a.sample, a.status, a.annotator, a.notes, a.timestamp, known, key)
    new.join(events.select("sample_id", "seq"), ["sample_id", "seq"], "left_anti").select(*events.columns).write.mode("append").parquet(f"{a.root.rstrip('/')}/review_events")


def review_get(spark, a):
    samples_of = _table(spark, a.root, "samples")
    if samples_of.where(F.col("sample_id" if "sample_id" in samples_of.columns else "path") == a.sample).isEmpty():
        raise ValidationError(f"no such sample: {a.sample}")
    row = review.current(_table(spark, a.root, "review_events").where(F.col("sample_id") == a.sample)).first()
    print(row["status"] if row else "pending")


def review_list(spark, a):
    rows = review.status_of(_table(spark, a.root, "samples").select(F.col("path").alias("sample_id")), _table(spark, a.root, "review_events"))
    _show(rows.where(F.col("review_status") == a.status) if a.status else rows)


def review_import_seg(spark, a):
    from .operators import edit

    which = spark.createDataFrame([(a.sample, a.name)], "sample_id string, mask string")
    one = nifti.read(spark, a.source)
    if (n := one.select("path").distinct().limit(2).count()) != 1:
        raise ValidationError(f"{a.source} holds {'no file' if n == 0 else 'several files'}; a mask is one")
    images = _table(spark, a.root, "images").where(F.col("sample_id") == a.sample)
    grid = images.groupBy("sample_id").agg(F.min_by(F.struct("shape", "affine"), "modality").alias("g")).select("sample_id", "g.shape", "g.affine")
    new = nifti.import_masks(which.crossJoin(F.broadcast(one.select("path"))), one, grid, a.resample)
    masks = _table(spark, a.root, "masks")
    new = new.select(*masks.columns)
    out = edit.seg_replace(masks, new) if a.replace else edit.seg_add(masks, new)
    out.write.parquet(a.target)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="voxelgrove")
    sub = p.add_subparsers(required=True)

    def add(to, name, f, *args):
        q = to.add_parser(name)
        for names, kw in args:
            q.add_argument(*names.split(), **kw)
        q.set_defaults(run=f)

    root, path, flag = ("root", {}), ("--path", {}), {"action": "store_true"}
    two = (("source", {}), ("target", {}))
    add(sub, "info", info, root, path)
    add(sub, "validate", validate, root, ("path", {}), ("--strict", flag))
    add(sub, "validate-all", validate_all, root, ("--strict", flag), ("--fail-fast", flag))
    add(sub, "audit", audit, root, ("--stamp", {"help": "write the table of samples there, with digests of what the tables hold now"}))
    add(sub, "recompress", recompress, *two, ("--preset", {"default": "balanced", "choices": sorted(samples.PRESETS)}))
    add(sub, "index", index, root, ("out", {}), ("--suffix", {"default": manifest.SUFFIX}), ("--files", flag), ("--skip-invalid", flag))
    add(sub, "split", do_split, ("manifest", {}), ("out", {}), ("--ratios", {}), ("--k-folds", {"type": int}), ("--group", {"default": "path"}), ("--stratify", {}), ("--seed", {"type": int, "default": 0}))
    add(sub, "stats", do_stats, root, ("--out", {}), ("--modalities", {}), ("--foreground", {}), ("--exact", flag), ("--sample-voxels", {"type": int}))
    imp = sub.add_parser("import").add_subparsers(required=True)
    names = {"action": "append", "metavar": "NAME=FILE"}
    add(
        imp, "nifti", import_nifti, *two, ("--image", names), ("--seg", names), ("--resample-to", {}), ("--interpolator", {"default": "linear", "choices": grids.ORDERS}), ("--resample-seg", flag), ("--any-grid", flag),
        ("--label", {}), ("--label-name", {}), ("--skip-invalid", flag), ("--volumes", {**flag, "help": "a table of the files alone, whatever folders they are in"}),
    )
    add(imp, "dicom", import_dicom, *two, ("--series-uid", {}), ("--all-series", flag), ("--modality", {"default": "image"}), ("--stored-values", flag))
    add(imp, "nnunetv2", import_nnunetv2, *two, ("--no-test", flag))
    exp = sub.add_parser("export").add_subparsers(required=True)
    add(exp, "nifti", export_nifti, *two, ("--modalities", {}), ("--masks", {}))
    add(exp, "nnunetv2", export_nnunetv2, *two, ("--channels", {}), ("--labels", {}), ("--file-ending", {"default": ".nii.gz"}), ("--dataset-name", {}))
    rev = sub.add_parser("review").add_subparsers(required=True)
    add(rev, "set", review_set, root, ("sample", {}), ("status", {"choices": review.STATUSES}), ("--annotator", {}), ("--notes", {}), ("--timestamp", {}))
    add(rev, "get", review_get, root, ("sample", {}))
    add(rev, "list", review_list, root, ("--status", {"choices": review.STATUSES}))
    add(rev, "import-seg", review_import_seg, root, ("sample", {}), ("source", {}), ("name", {}), ("target", {}), ("--replace", flag), ("--resample", flag))
    return p


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        return args.run(session(), args) or 0
    except EngineError as e:
        print(e, file=sys.stderr)
        return 1
    except AnalysisException as e:
        # A table, a folder or a column that isn't there.
        print(str(e).splitlines()[0], file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
