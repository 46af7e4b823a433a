"""Closed-form cases of the dataset operators."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelgrove.errors import SchemaError, ValidationError
from voxelgrove.functions import geometry as geo
from voxelgrove.functions import tiles
from voxelgrove.operators import boxes, cases, edit, labels, manifest, patches, review, split, stats, transforms, validation
from voxelgrove.sources import nifti, samples


def test_foreground_and_empty_masks(spark):
    rows = [(1, "CT", 5.0, True), (1, "CT", 100.0, False), (2, "CT", 7.0, None), (3, "CT", 50.0, False)]
    df = spark.createDataFrame(rows, "sample_id long, modality string, value double, m boolean")
    r = stats.modality_stats(stats.foreground(df, "m")).first()
    assert (r["n_voxels"], r["mean"], r["std"], r["vmin"]) == (2, 6.0, 1.0, 5.0)


def test_percentiles_and_nan(spark):
    df = spark.createDataFrame([("CT", float(i)) for i in range(1000)] + [("PT", float("nan")), ("PT", 1.0)], "modality string, value double")
    got = {r["modality"]: r for r in stats.modality_stats(df).collect()}
    assert got["CT"]["p01"] == pytest.approx(9.99) and got["CT"]["p99"] == pytest.approx(989.01) and np.isnan(got["PT"]["vmin"])


def test_merged_partials_equal_numpy(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(1000, 50, 3000)
    df = spark.createDataFrame([(i % 7, "CT", float(v)) for i, v in enumerate(x)], "sample_id long, modality string, value double")
    r = stats.merge(stats.partials(df)).first()
    assert r["mean"] == pytest.approx(x.mean(), abs=1e-9) and r["std"] == pytest.approx(x.std(), abs=1e-9)


def test_shape_keys(spark):
    df = spark.createDataFrame([([8, 16, 16],), ([8],), (None,)], "shape array<bigint>")
    assert {r["shape_key"] for r in stats.shape_histogram(df).collect()} == {"(8, 16, 16)", "(8,)"}


def records(spark, n=20):
    return spark.createDataFrame([(i, i % 2, f"P{i // 2:02d}") for i in range(n)], "ordinal long, label int, patient string")


def test_ratio_split_sizes_and_groups(spark):
    df = split.ratio_split(records(spark), {"train": 0.7, "val": 0.3}, "ordinal", "label")
    assert {(r["part"], r["label"]): r["count"] for r in df.groupBy("part", "label").count().collect()} == {("train", 0): 7, ("train", 1): 7, ("val", 0): 3, ("val", 1): 3}
    by_patient = split.ratio_split(records(spark), {"train": 0.7, "val": 0.3}, "patient")
    assert by_patient.groupBy("patient").agg(F.count_distinct("part").alias("k")).where("k > 1").isEmpty() and by_patient.count() == 20


def test_folds_partition_the_data(spark):
    df = split.k_fold(records(spark), 4, "ordinal", "label", seed=1)
    assert {r["count"] for r in df.groupBy("fold").count().collect()} == {4, 6} and split.fold_train(df, 1).count() + df.where("fold = 1").count() == 20
    for bad in (lambda: split.k_fold(df, 1, "ordinal"), lambda: split.ratio_split(df, {"a": 0.5}, "ordinal"), lambda: split.make_splits(df, "ordinal")):
        with pytest.raises(ValidationError):
            bad()


def test_null_groups_are_one_group(spark):
    df = spark.createDataFrame([(0, None), (1, None), (2, "a")], "ordinal long, g string")
    got = split.ratio_split(df, {"x": 0.5, "y": 0.5}, "g").collect()
    assert len(got) == 3 and len({r["part"] for r in got if r["g"] is None}) == 1


def test_boxes(spark):
    df = spark.createDataFrame([(1, [-1, 0, 20], [3, 9, 30])], "id int, lo array<bigint>, hi array<bigint>")
    r = boxes.clamp(df, (8, 8, 8)).first()
    assert (r["lo"], r["hi"], r["issues"]) == ([0, 0, 8], [3, 8, 20], "min_below_zero;max_above_shape;min_above_max")
    lo, hi = boxes.flip(F.col("lo"), F.col("hi"), (32, 64, 64), [0])
    got = spark.createDataFrame([([2, 5, 5], [10, 20, 20]), ([12, 40, 30], [28, 55, 50])], "lo array<bigint>, hi array<bigint>").select(lo.alias("a"), hi.alias("b")).collect()
    assert [(r["a"][0], r["b"][0]) for r in got] == [(21, 29), (3, 19)]


def test_boxes_in_patches(spark):
    df = spark.createDataFrame([(0, 1, [2, 8, 8], [3, 9, 9]), (1, 1, [6, 8, 8], [7, 9, 9]), (2, 1, [0, 0, 0], [2, 8, 8])], "box int, sample_id int, lo array<int>, hi array<int>")
    got = boxes.in_patches(df, spark.createDataFrame([(1, [2, 8, 8])], "sample_id int, start array<int>"), (4, 16, 16)).collect()
    assert {r["box"]: r["lo"] for r in got} == {0: [0, 0, 0], 2: [-2, -8, -8]}


def test_patch_starts_fall_back_and_stay_inside(spark):
    ids = spark.createDataFrame([(i,) for i in range(50)], "sample_id long")
    fg = spark.createDataFrame([(1, 7, 31, 31), (2, 0, 0, 0)], "sample_id long, c0 int, c1 int, c2 int")
    got = {r["sample_id"]: tuple(r)[1:] for r in patches.starts(ids, fg, (8, 32, 32), (4, 16, 16), 3, "foreground").collect()}
    assert got[1] == (4, 16, 16) and got[2] == (0, 0, 0) and all(0 <= a <= 4 and 0 <= b <= 16 and 0 <= c <= 16 for a, b, c in got.values()) and len(set(got.values())) > 20
    with pytest.raises(ValueError):
        patches.patch_size([1, 2], 3)


def test_transforms(spark):
    df = spark.createDataFrame([(1, "CT", float(v)) for v in (-5, 0, 5)] + [(1, "PT", float("nan"))], "sample_id long, modality string, value double")
    assert [r["value"] for r in transforms.clip(df.where("modality = 'CT'"), 0, 1).collect()] == [0, 0, 1]
    assert np.isnan(transforms.clip(df, 0, 1).where("modality = 'PT'").first()["value"])
    z = [r["value"] for r in transforms.zscore(df.where("modality = 'CT'")).orderBy("value").collect()]
    assert z[1] == 0 and z[2] == pytest.approx(-z[0]) and z[2] == pytest.approx(1.2247, abs=1e-3)


def test_affine_of_a_rotation(spark):
    arr = lambda *x: F.array(*(F.lit(float(v)) for v in x))
    turn = F.array(arr(0, -1, 0), arr(1, 0, 0), arr(0, 0, 1))
    df = spark.range(1).select(geo.as_affine(arr(2, 3, 4), arr(10, 20, 30), turn).alias("m"), geo.as_affine(arr(1, 1, 1), arr(0, 0, 0), F.array(arr(1, 0, 0), arr(0, 1, 0), arr(0, 0, 1))).alias("eye"))
    r = df.first()
    assert r["m"] == [[0, -3, 0, 10], [2, 0, 0, 20], [0, 0, 4, 30], [0, 0, 0, 1]] and r["eye"] is None
    o, d = geo.flip_geometry(arr(2, 3, 4), arr(10, 20, 30), F.array(arr(1, 0, 0), arr(0, 1, 0), arr(0, 0, 1)), [4, 5, 6], [0, 2])
    assert spark.range(1).select(o.alias("o")).first()["o"] == [16, 20, 50]


def test_labels_and_resampling(spark):
    df = spark.createDataFrame([(1, 0, 0.0), (1, 1, 2.0), (1, 2, 1.5)], "sample_id int, pos int, value double")
    assert [r["value"] for r in labels.undeclared(df, {"background": 0, "edema": 2}).collect()] == [1.5]
    with pytest.raises(ValidationError):
        labels.split_labels(df, {"edema": 2})
    x = np.full((4, 4, 4), 3.0)
    assert (labels.resample_array(x, (2, 2, 2), (2, 2, 2), "linear") == 3).all() and (labels.resample_array(x, (8, 4, 4), (1, 1, 1), "linear")[4:] == 0).all()
    y = np.arange(4.0)
    assert labels.resample_array(y, (7,), (0.5,), "linear").tolist() == [0, 0.5, 1, 1.5, 2, 2.5, 3]


def test_cases_and_series(spark):
    names = ["c001_0000.nii.gz", "c001_0001.nii.gz", "c002_0001.nii.gz", "c003_0000.nii.gz", "c003_0000.nii.gz", "c003_0001.nii.gz", "readme.txt"]
    got = {r["case_id"]: (r["n"], r["duplicates"], r["missing"], r["extra"]) for r in cases.discover(cases.case_files(spark.createDataFrame([(n,) for n in names], "name string")), channels=2).collect()}
    assert got == {"c001": (2, 0, "", ""), "c002": (1, 0, "0", ""), "c003": (2, 1, "", "")}
    rows = [("a", 0.0), ("a", 1.5), ("a", 3.0), ("b", 0.0), ("b", 1.5), ("b", 10.0), ("c", 1.0), ("c", 1.0), ("d", 4.0)]
    got = {r["k"]: r["status"] for r in cases.slice_spacing(spark.createDataFrame(rows, "k string, p double"), "k", "p").collect()}
    assert got == {"a": "ok", "b": "uneven", "c": "duplicate", "d": "single"}
    assert tuple(cases.largest_series(spark.createDataFrame([(None,), (None,), ("x",)], "uid string")).first()) == ("<missing-series-uid>", 2)


def test_review_trail(spark):
    events = spark.createDataFrame([], "sample_id string, seq long, status string, annotator string, ts string, notes string")
    events = review.set_status(events, "s", "reviewed", "a")
    events = review.set_status(events, "s", "flagged", "b", "recheck")
    assert [(r["status"], r["prev"]) for r in review.history(events).orderBy("seq").collect()] == [("reviewed", "pending"), ("flagged", "reviewed")]
    assert review.current(events).first()["status"] == "flagged"
    with pytest.raises(ValidationError):
        review.set_status(events, "s", "great")


def test_validation_stops_early(spark):
    df = spark.createDataFrame([("a", None, ["CT"], "1", ["CT"], True, ["x"]), ("b", None, None, "1", None, False, None), ("c", "bad", None, None, None, None, None)], "path string, open_error string, images array<string>, schema_version string, image_names array<string>, has_seg boolean, seg array<string>")
    got = {(r["path"], r["code"]) for r in validation.issues(df).collect()}
    assert ("b", "missing_images_group") in got and {c for p, c in got if p == "c"} == {"file_open_failed"} and ("a", "seg_names_mismatch") in got and ("a", "missing_checksum") in got
    assert samples.check_version("0") == 0
    for v in ("2", "x"):
        with pytest.raises(SchemaError):
            samples.check_version(v)


def test_manifest_lookups(spark):
    df = spark.createDataFrame([('{"review": {"status": "flagged"}, "a": {"b": 3}}',), ('{"review": 1}',), ("{bad",), (None,), ('{"review": {"status": ""}}',)], "extra string")
    got = df.select(manifest.review_status("extra").alias("s"), manifest.lookup("extra", "a.b").alias("v")).collect()
    assert [r["s"] for r in got] == ["flagged"] + ["pending"] * 4 and [r["v"] for r in got] == ["3", None, None, None, None]


def test_edits_check_first(spark):
    m = spark.createDataFrame([(1, "a", 5)], "sample_id int, mask string, voxels int")
    with pytest.raises(ValidationError):
        edit.seg_add(m, m)
    with pytest.raises(ValidationError):
        edit.seg_remove(m, m.withColumn("mask", F.lit("b")))
    s = spark.createDataFrame([(1, "x"), (2, "y")], "sample_id int, label string")
    got = edit.update_meta(s, spark.createDataFrame([(1, None)], "sample_id int, v string"), {"label": "v"}).collect()
    assert {tuple(r) for r in got} == {(1, None), (2, "y")}


def test_nifti_round_trip(spark, tmp_path):
    x = np.arange(24, dtype=np.int16).reshape(2, 3, 4)
    affine = np.array([[0, -3.0, 0, 10], [2, 0, 0, 20], [0, 0, 4, 30], [0, 0, 0, 1]])
    (tmp_path / "a.nii.gz").write_bytes(nifti.build(x, affine))
    (tmp_path / "b.nii").write_bytes(nifti.build(x.astype(np.float32), affine, compress=False))
    (tmp_path / "c.nii").write_bytes(b"not an image")
    rows = {r["path"][-7:]: r for r in nifti.read(spark, str(tmp_path)).collect()}
    assert len(rows) == 3 and sum(r["error"] is None for r in rows.values()) == 2 and nifti.read(spark, str(tmp_path), skip_invalid=True).count() == 2
    for r in rows.values():
        if r["error"] is None:
            assert r["shape"] == [2, 3, 4] and r["affine"] == affine.ravel().tolist() and r["data"] == x.ravel().tolist()
    vol = spark.createDataFrame([("o.nii.gz", [2, 3, 4], "int16", affine.ravel().tolist(), x.ravel().astype(float).tolist())], "name string, shape array<bigint>, dtype string, affine array<double>, data array<double>")
    nifti.export(vol, str(tmp_path / "out"))
    assert nifti.parse((tmp_path / "out" / "o.nii.gz").read_bytes())["data"].tolist() == x.ravel().tolist()


def test_review_stream(spark, tmp_path):
    from voxelgrove.streaming import reviews

    schema = "sample_id long, ts timestamp, seq long, status string"
    spark.createDataFrame([(1, 1, 1, "reviewed"), (1, 2, 2, "flagged"), (2, 1, 3, "pending")], "sample_id long, t long, seq long, status string").select("sample_id", F.timestamp_seconds("t").alias("ts"), "seq", "status").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    q = reviews.latest_status(stream).writeStream.outputMode("update").format("memory").queryName("latest").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {(r["sample_id"], r["status"], r["n"]) for r in spark.table("latest").collect()} == {(1, "flagged", 2), (2, "pending", 1)}


def test_command_line(spark, tmp_path, capsys):
    from voxelgrove import cli

    root = str(tmp_path / "ds")
    spark.createDataFrame([("a", ["CT"], "1", ["CT"], "x", "x"), ("b", ["CT"], "9", ["CT"], "x", "y")], "path string, images array<string>, schema_version string, image_names array<string>, checksum string, computed string").write.parquet(root + "/samples")
    spark.createDataFrame([("a", 0, "flagged", None, "t", None)], "sample_id string, seq long, status string, annotator string, ts string, notes string").write.parquet(root + "/review_events")
    assert cli.main(["validate-all", root]) == 1 and "metadata_read_failed" in capsys.readouterr().out
    assert cli.main(["audit", root]) == 1
    assert cli.main(["review", "set", root, "b", "reviewed", "--annotator", "n"]) == 0
    assert cli.main(["review", "get", root, "b"]) == 0 and "reviewed" in capsys.readouterr().out
    assert cli.main(["import", "dicom", root, root + "/x"]) == 1
    with pytest.raises(SystemExit) as e:
        cli.main(["nothing"])
    assert e.value.code == 2
