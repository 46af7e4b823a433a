"""Records, grids, importers and exporters, edits and patches, against plain versions."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelgrove.errors import EngineError, SchemaError, SourceError, ValidationError
from voxelgrove.functions import tiles
from voxelgrove.functions.geometry import as_affine, flip_geometry, slice_normal
from voxelgrove.operators import edit, grids, patches, records, review, series, stats, transforms, validation
from voxelgrove.sources import dicom, hdf5, nifti, nnunet


def test_merge_keeps_small_deviations_of_large_values(spark):
    rng = np.random.default_rng(3)
    parts = [1e8 + rng.random(50 + 10 * k) for k in range(5)]
    voxels = spark.createDataFrame([(k, m, float(v)) for m in ("CT", "MR") for k, x in enumerate(parts) for v in x], "sample_id int, modality string, value double")
    whole = np.concatenate(parts)
    for r in stats.merge(stats.partials(voxels)).collect():
        assert r["n_voxels"] == len(whole) and r["std"] == pytest.approx(whole.std(), rel=1e-6) and r["mean"] == pytest.approx(whole.mean(), rel=1e-12)
    assert stats.merge(stats.partials(voxels.limit(0))).collect() == []


def test_masked_takes_whole_volumes_without_a_fitting_mask(spark):
    voxels = spark.createDataFrame([(s, "CT", p, float(p)) for s in "abcd" for p in range(4)], "sample_id string, modality string, pos int, value double")
    shapes = spark.createDataFrame([(s, "CT", None, [4]) for s in "abcd"] + [("a", None, "t", [4]), ("b", None, "t", [2]), ("d", None, "t", [4])], "sample_id string, modality string, mask string, shape array<int>")
    masks = spark.createDataFrame([("a", "t", 1), ("a", "t", 2), ("a", "x", 3), ("b", "t", 1)], "sample_id string, mask string, pos int")
    got = {}
    for r in stats.masked(voxels, masks, "t", shapes).collect():
        got.setdefault(r["sample_id"], set()).add(r["pos"])
    assert got == {"a": {1, 2}, "b": {0, 1, 2, 3}, "c": {0, 1, 2, 3}}  # another shape, no mask; d's is empty


def test_saved_statistics_and_capped_percentiles(spark, tmp_path):
    samples = spark.createDataFrame([("a", "x", [2, 3]), ("b", None, [2, 3])], "sample_id string, label string, shape array<int>")
    voxels = spark.range(400).select(F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("sample_id"), F.lit("CT").alias("modality"), F.col("id").alias("pos"), F.col("id").cast("double").alias("value"))
    out = stats.compute_stats(samples, voxels, cap=10)
    one = out["modalities"].first()
    assert one["n_voxels"] == 400 and one["mean"] == 199.5 and 0 <= one["p01"] < one["p99"] <= 399
    stats.save(out, str(tmp_path / "s"))
    back = stats.load(spark, str(tmp_path / "s"))
    assert sorted(back) == ["labels", "modalities", "n_files", "shapes"] and back["shapes"].first()["shape_key"] == "(2, 3)" and back["modalities"].first()["n_voxels"] == 400


def test_tiles_grow_by_steps_of_the_patch():
    assert tiles.tile_shape((128, 256, 256), 64) == [128, 64, 64]
    assert tiles.tile_shape((10, 10), 3) == [4, 4]
    assert tiles.tile_shape((40, 512, 512), (1, 64, 64))[0] == 1
    assert tiles.tile_shape((3, 64, 64), 32, spatial=[False, True, True])[0] == 3
    assert tiles.mask_tile([128, 64, 64], (100, 256, 32)) == [100, 64, 32]
    for bad in (((8,), 4), ((2, 3, 8, 8), 4), ((8, 8), (4,)), ((0, 8), 4)):
        with pytest.raises(ValueError):
            tiles.tile_shape(*bad)


SAMPLES = "path string, label string, image_names array<string>, shape array<bigint>, extra string, open_error string"


def test_records_paths_and_info(spark):
    samples = spark.createDataFrame([("b", "1", ["CT"], [4, 4], '{"review":{"status":"flagged"}}', None), ("a", None, None, None, None, None), ("c", None, None, None, None, "broken")], SAMPLES)
    files = spark.createDataFrame([("a", 10, 1.5), ("b", 20, 2.5)], "path string, file_size long, mtime double")
    with pytest.raises(SourceError, match="c: broken"):
        records.build(samples, files)
    found = records.build(samples, files, skip_invalid=True)
    rows = found.collect()
    assert [r["path"] for r in rows] == ["a", "b"] and [r["review_status"] for r in rows] == ["pending", "flagged"] and rows[1]["file_size"] == 20 and rows[0]["image_names"] == []
    assert records.at(found, 0).first()["path"] == "a" and records.at(found, -1).first()["path"] == "b"
    with pytest.raises(IndexError):
        records.at(found, 2)
    good = samples.where("open_error is null")
    assert [r["path"] for r in records.from_paths(spark, ["b", "a", "b"], good, files).collect()] == ["b", "a", "b"]
    with pytest.raises(SourceError, match="no such sample: z"):
        records.from_paths(spark, ["z"], good)
    told = [json.loads(r["payload"]) for r in records.info(good).orderBy("path").collect()]
    assert all(len(t) == 17 for t in told) and told[1]["review_status"] == "flagged" and told[1]["extra"] == {"review": {"status": "flagged"}} and told[0]["shape"] is None


class Part(dict):
    """Stands in for a group of a file."""

    def __init__(self, *a, attrs=None, **k):
        super().__init__(*a, **k)
        self.attrs = attrs or {}


def test_metadata_of_hdf5_files():
    a = np.zeros((2, 3, 4), np.int16)
    f = Part({"images": Part({"b": a, "a": a}, attrs={"spacing": np.array([1.0, 2, 3]), "direction": np.eye(3).ravel(), "axis_labels": [b"z", "y", "x"], "patch_size": np.array([1, 1, 1])}), "seg": Part({"t": a}), "bboxes": np.array([[[0, 1], [0, 2], [0, 3]]]), "bbox_labels": np.array([b"one"], object)}, attrs={"schema_version": b"1", "image_names": '["a", "b"]', "has_seg": True, "seg_names": b'["t"]', "has_bbox": True, "label": 3})
    m = hdf5.metadata(f)
    assert m["images"] == ["a", "b"] and m["shape"] == [2, 3, 4] and m["dtype"] == "int16" and m["direction"] == np.eye(3).tolist() and m["axis_labels"] == ["z", "y", "x"]
    assert (m["has_seg"], m["seg_names"], m["n_boxes"], m["n_scores"], m["label"], m["image_names"]) == (True, ["t"], 1, None, "3", ["a", "b"])
    assert hdf5.boxes(f) == [([0.0, 0.0, 0.0], [1.0, 2.0, 3.0], None, "one")] and hdf5.boxes(Part()) == []
    f["images"].attrs["direction"] = np.zeros(4)
    with pytest.raises(SchemaError):
        hdf5.metadata(f)
    assert hdf5.metadata(Part(attrs={"has_seg": True}))["has_seg"] is False
    with pytest.raises(SchemaError):
        hdf5.metadata(Part(attrs={"schema_version": "2"}))
    assert list(m) == hdf5._FIELDS


def volume(i, name, x, affine, dtype="int16"):
    return (i, name, list(x.shape), dtype, [float(v) for v in affine.ravel()], [float(v) for v in x.ravel()])


VOLUME = "sample_id string, modality string, shape array<bigint>, dtype string, affine array<double>, data array<double>"


def test_resampling_between_grids(spark):
    rng = np.random.default_rng(1)
    x = rng.integers(0, 50, (4, 5, 6)).astype(float)
    half = np.diag([0.5, 0.5, 0.5, 1.0])
    turn = np.array([[0.0, 1, 0, 2], [1, 0, 0, 1], [0, 0, 1, 0], [0, 0, 0, 1]])
    df = spark.createDataFrame([volume("a", "CT", x, np.eye(4)), volume("b", "CT", x, np.eye(4)), volume("c", "CT", x, np.eye(4))], VOLUME)
    to = spark.createDataFrame([("a", [7, 9, 11], [float(v) for v in half.ravel()]), ("b", [3, 3, 3], [float(v) for v in turn.ravel()])], "sample_id string, shape array<bigint>, affine array<double>")
    got = {r["sample_id"]: r for r in grids.resample_to(df, to, fill=-1.0).collect()}
    y = np.array(got["a"]["data"]).reshape(7, 9, 11)
    assert np.allclose(y[::2, ::2, ::2], x) and np.allclose(y[1::2, ::2, ::2], (x[:-1] + x[1:]) / 2) and got["a"]["dtype"] == "float32"
    assert got["c"]["dtype"] == "int16" and got["c"]["data"] == x.ravel().tolist()
    near = {r["sample_id"]: r for r in grids.resample_to(df, to, "nearest", -1.0).collect()}
    z = np.array(near["b"]["data"]).reshape(3, 3, 3)
    for i, j, k in np.ndindex(3, 3, 3):
        p, q = j + 2, i + 1
        assert z[i, j, k] == (x[p, q, k] if p < 4 and q < 5 else -1)
    assert near["b"]["dtype"] == "int16" and (np.array(grids.onto(np.full((3, 3), 7.0), np.eye(3), (5, 5), np.diag([0.5, 0.5, 1.0]), "linear")) == 7).all()
    with pytest.raises(ValidationError):
        grids.resample_to(df, to, "cubic")


def test_masks_and_images_from_files(spark, tmp_path):
    x = np.arange(24, dtype=np.int16).reshape(2, 3, 4)
    for name, data, affine in (("ct", x, np.eye(4)), ("mr", x, np.diag([2.0, 2, 2, 1])), ("m", (x > 5).astype(np.uint8), np.eye(4)), ("off", (x > 5).astype(np.uint8), np.diag([2.0, 2, 2, 1]))):
        (tmp_path / f"{name}.nii.gz").write_bytes(nifti.build(data, affine))
    files = nifti.read(spark, str(tmp_path))
    of = {r["path"].rpartition("/")[2].removesuffix(".nii.gz"): r["path"] for r in files.select("path").collect()}
    images = spark.createDataFrame([("s", "CT", of["ct"]), ("s", "MR", of["mr"])], "sample_id string, modality string, path string")
    assert {r["modality"]: r["problem"] for r in nifti.import_samples(images, files).collect()} == {"CT": None, "MR": "affine differs"}
    on = {r["modality"]: r for r in nifti.import_samples(images, files, onto="CT").collect()}
    assert on["MR"]["problem"] is None and on["MR"]["dtype"] == "float32" and on["MR"]["data"][0] == 0 and on["CT"]["data"] == x.ravel().tolist()
    grid = nifti.import_samples(images, files).where("modality = 'CT'").select("sample_id", "shape", "affine")
    which = lambda n: spark.createDataFrame([("s", "t", of[n])], "sample_id string, mask string, path string")
    got = nifti.import_masks(which("m"), files, grid).first()
    assert got["data"] == (x > 5).ravel().tolist()
    with pytest.raises(SourceError, match="another grid"):
        nifti.import_masks(which("off"), files, grid)
    assert len(nifti.import_masks(which("off"), files, grid, resample=True).first()["data"]) == 24
    names = nifti.export_volumes(nifti.import_samples(images, files), nifti.import_masks(which("m"), files, grid), ["CT"], ["t"])
    nifti.export(names, str(tmp_path / "out"))
    assert nifti.parse((tmp_path / "out" / "s" / "image_CT.nii.gz").read_bytes())["data"].tolist() == x.ravel().tolist() and nifti.parse((tmp_path / "out" / "s" / "seg_t.nii.gz").read_bytes())["dtype"] == "uint8"
    with pytest.raises(SourceError, match="has no modality PET"):
        nifti.export_volumes(nifti.import_samples(images, files), None, ["PET"])


def dataset(folder, cases=3, labels=None):
    rng = np.random.default_rng(0)
    kept = {}
    for part in ("imagesTr", "labelsTr", "imagesTs"):
        (folder / part).mkdir(parents=True)
    for k in range(cases):
        y = rng.integers(0, 3, (2, 3, 4)).astype(np.uint8)
        kept[f"c_{k}"] = y
        (folder / "labelsTr" / f"c_{k}.nii.gz").write_bytes(nifti.build(y, np.eye(4)))
        for c in range(2):
            (folder / "imagesTr" / f"c_{k}_000{c}.nii.gz").write_bytes(nifti.build((y * 10 + c).astype(np.int16), np.eye(4)))
            (folder / "imagesTs" / f"t_{k}_000{c}.nii.gz").write_bytes(nifti.build((y * 10 + c).astype(np.int16), np.eye(4)))
    told = {"channel_names": {"0": "CT", "1": "MR"}, "labels": labels or {"background": 0, "liver": 1, "tumor": 2}, "numTraining": cases, "file_ending": ".nii.gz"}
    (folder / "dataset.json").write_text(json.dumps(told))
    return kept


def test_dataset_folders_come_in_and_go_out(spark, tmp_path):
    kept = dataset(tmp_path / "d")
    got = nnunet.import_dataset(spark, str(tmp_path / "d"))
    assert {(r["sample_id"], r["part"]): r["modalities"] for r in got["samples"].collect()} == {(f"{n}_{k}", p): ["CT", "MR"] for n, p in (("c", "train"), ("t", "test")) for k in range(3)}
    assert json.loads(got["samples"].first()["extra"])["nnunetv2"]["schema_version"] == 1
    for r in got["masks"].collect():
        assert r["data"] == (kept[r["sample_id"]].ravel() == {"liver": 1, "tumor": 2}[r["mask"]]).tolist()
    whole = {r["sample_id"]: r["data"] for r in nnunet.label_volumes(got["masks"], {"background": 0, "liver": 1, "tumor": 2}).collect()}
    assert whole == {k: v.ravel().astype(float).tolist() for k, v in kept.items()}
    volumes = got["images"].select(F.col("sample_id").alias("case_id"), F.lit("image").alias("kind"), "modality", "shape", "dtype", "affine", "data", "part")
    lab = nnunet.label_volumes(got["masks"], {"background": 0, "liver": 1, "tumor": 2}).select(F.col("sample_id").alias("case_id"), F.lit("label").alias("kind"), F.lit(None).cast("string").alias("modality"), "shape", F.lit("uint8").alias("dtype"), "affine", "data", F.lit("train").alias("part"))
    assert nnunet.export(volumes.unionByName(lab), str(tmp_path / "o"), {"0": "CT", "1": "MR"}, {"background": 0, "liver": 1, "tumor": 2}) == {"numTraining": 3, "numTest": 3}
    again = nnunet.import_dataset(spark, str(tmp_path / "o"))
    assert sorted(map(tuple, again["masks"].select("sample_id", "mask", "data").collect())) == sorted(map(tuple, got["masks"].select("sample_id", "mask", "data").collect()))
    with pytest.raises(ValidationError, match="case c_0: channels CT instead"):
        nnunet.export(volumes.unionByName(lab).where("modality is null or modality = 'CT'"), str(tmp_path / "p"), {"0": "CT", "1": "MR"}, {"background": 0, "liver": 1, "tumor": 2})
    with pytest.raises(ValidationError, match="no label volume"):
        nnunet.export(volumes, str(tmp_path / "p"), {"0": "CT", "1": "MR"}, {"background": 0})
    assert not (tmp_path / "p").exists()


@pytest.mark.parametrize("harm, says", [("channel", "channels missing 1"), ("label", "no label volume"), ("orphan", "a label volume but no images"), ("grid", "lies on another grid"), ("values", "undeclared"), ("broken", "too short")])
def test_faults_of_dataset_folders(spark, tmp_path, harm, says):
    root = tmp_path / "d"
    dataset(root, 2, {"background": 0, "liver": 1} if harm == "values" else None)
    one = root / "imagesTr" / "c_1_0001.nii.gz"
    if harm == "channel":
        one.unlink()
    elif harm == "label":
        (root / "labelsTr" / "c_1.nii.gz").unlink()
    elif harm == "orphan":
        (root / "labelsTr" / "c_9.nii.gz").write_bytes((root / "labelsTr" / "c_1.nii.gz").read_bytes())
    elif harm == "grid":
        one.write_bytes(nifti.build(np.zeros((2, 3, 4), np.int16), np.diag([2.0, 1, 1, 1])))
    elif harm == "broken":
        one.write_bytes(b"x")
    with pytest.raises(ValidationError, match=says):
        nnunet.import_dataset(spark, str(root))


def test_sample_files_are_collected_by_layout(spark):
    paths = lambda *p: spark.createDataFrame([(x,) for x in p], "path string")
    got = nnunet.collect_samples(paths("/d/imagesTr/b.h5", "/d/imagesTs/a.h5", "/d/c.h5", "/d/imagesTr/deep/e.h5"), "/d/").collect()
    assert [tuple(r) for r in got] == [("/d/imagesTr/b.h5", "train", "b"), ("/d/imagesTs/a.h5", "test", "a")]
    assert [tuple(r) for r in nnunet.collect_samples(paths("/d/b.h5", "/d/x/c.h5"), "/d").collect()] == [("/d/b.h5", "train", "b")]


def slices(n=4, **odd):
    rows = []
    for k in range(n):
        r = {"path": f"p{k}", "uid": "u", "position": [0.0, 0.0, 2.5 * (n - k)], "row_dir": [1.0, 0.0, 0.0], "col_dir": [0.0, 1.0, 0.0], "pixel_spacing": [0.5, 0.25], "thickness": 3.0, "slope": 2.0, "intercept": -1.0, "shape": [1, 2], "data": [float(k), float(k + 1)], "tags": "{}", "problem": None}
        rows.append(r | {c: v[k] for c, v in odd.items() if k in v})
    return [tuple(r.values()) for r in rows]


def test_volumes_of_series(spark):
    df = spark.createDataFrame(slices() + [tuple(r[:1]) + ("v",) + r[2:] for r in slices(2)], dicom.SLICES)
    r = series.assemble(df).first()
    assert (r["uid"], r["n"], r["shape"], r["spacing"]) == ("u", 4, [4, 1, 2], [2.5, 0.5, 0.25])
    assert r["data"] == [5.0, 7.0, 3.0, 5.0, 1.0, 3.0, -1.0, 1.0] and r["origin"] == [0.0, 0.0, 2.5] and r["direction"] == [[0.0, 0.0, 1.0], [0.0, 1.0, 0.0], [1.0, 0.0, 0.0]]
    assert series.assemble(df, "v", lut=False).first()["data"] == [1.0, 2.0, 0.0, 1.0]
    assert series.assemble(spark.createDataFrame(slices(1), dicom.SLICES)).first()["spacing"][0] == 3.0
    with pytest.raises(ValidationError, match="there is no series w"):
        series.assemble(df, "w")
    with pytest.raises(ValidationError, match="no slices"):
        series.assemble(df.limit(0))
    for odd, says in (({"position": {1: None}}, "no position"), ({"row_dir": {2: None}}, "no orientation"), ({"row_dir": {0: [0.0, 1.0, 0.0]}}, "parallel"), ({"shape": {3: [2, 1]}}, "another shape"), ({"position": {1: [0.0, 0.0, 10.0]}}, "same position"), ({"position": {0: [0.0, 0.0, 11.0]}}, "uneven")):
        with pytest.raises(ValidationError, match=says):
            series.assemble(spark.createDataFrame(slices(**odd), dicom.SLICES))


def test_patches_of_images_masks_and_boxes(spark):
    shape, size = (6, 5), (4, 8)
    samples = spark.createDataFrame([("a",), ("b",)], "sample_id string")
    voxels = spark.createDataFrame([(s, m, i, j, float(i * 10 + j)) for s in "ab" for m in ("CT", "MR") for i in range(6) for j in range(5)], "sample_id string, modality string, c0 int, c1 int, value double")
    masks = spark.createDataFrame([("a", "t", 5, 2)], "sample_id string, mask string, c0 int, c1 int")
    boxes = spark.createDataFrame([("a", [5, 0], [5, 4]), ("a", [0, 0], [0, 0])], "sample_id string, lo array<int>, hi array<int>")
    out = patches.sample_patches(samples, voxels, shape, size, 1, "foreground", masks, "t", boxes=boxes, pad_value=-1.0)
    at = {r["sample_id"]: (r["s0"], r["s1"]) for r in out["starts"].collect()}
    assert at["a"] == (2, 0) and 0 <= at["b"][0] <= 2 and at["b"][1] == 0
    rows = out["images"].collect()
    assert len(rows) == 2 * 2 * 32 and all(r["value"] == ((r["c0"] + at[r["sample_id"]][0]) * 10 + r["c1"] if r["c1"] < 5 else -1) for r in rows)
    assert [(r["sample_id"], r["c0"], r["c1"]) for r in out["masks"].collect()] == [("a", 3, 2)]
    assert [(r["lo"], r["hi"]) for r in out["boxes"].collect()] == [([3, 0], [3, 4])]
    with pytest.raises(ValueError):
        patches.sample_patches(samples, voxels, shape, size, 1, "balanced")


def test_random_flips_keep_images_and_masks_together(spark):
    samples = spark.range(200).select(F.col("id").cast("string").alias("sample_id"))
    flips = transforms.random_flips(samples, [0, 1], 0.5, 3)
    n = [len(r["flips"]) for r in flips.collect()]
    assert 140 < sum(n) < 260 and transforms.random_flips(samples, [0, 1], 0).where("size(flips) > 0").isEmpty()
    rows = samples.select("sample_id", F.lit(1).alias("c0"), F.lit(0).alias("c1"))
    got = {r["sample_id"]: (r["c0"], r["c1"]) for r in transforms.random_flip(rows, flips, (4, 3)).collect()}
    assert all(got[r["sample_id"]] == (2 if 0 in r["flips"] else 1, 2 if 1 in r["flips"] else 0) for r in flips.collect())


def test_metadata_that_does_not_fit(spark):
    schema = "path string, shape array<bigint>, spacing array<double>, direction array<array<double>>, axis_labels array<string>, patch_size array<bigint>, extra string"
    df = spark.createDataFrame([("ok", [4, 4], [1.0, 2.0], [[1.0, 0.0], [0.0, 1.0]], ["y", "x"], [2, 2], "{}"), ("none", [4, 4], None, None, None, None, None), ("bad", [4, 4], [1.0, float("nan"), 2.0], [[1.0, 0.0]], ["y", None], [0, 1], "{")], schema)
    found = {}
    for r in validation.metadata_issues(df).collect():
        found.setdefault(r["path"], set()).add(r["problem"])
    assert set(found) == {"bad"} and len(found["bad"]) == 6
    samples = spark.createDataFrame([("a", ["CT"], "1", ["CT"], "x", "x"), ("b", ["CT"], "1", ["CT"], None, None)], "path string, images array<string>, schema_version string, image_names array<string>, checksum string, computed string")
    assert validation.is_valid(samples) and not validation.is_valid(samples, strict=True)
    assert {r["path"]: r["valid"] for r in validation.validity(samples, validation.issues(samples), strict=True).collect()} == {"a": True, "b": False}


def test_an_update_checks_everything_first(spark):
    samples = spark.createDataFrame([("a", "x", "c1", "c1"), ("b", "y", "c2", "other")], "sample_id string, label string, checksum string, computed string")
    masks = spark.createDataFrame([("a", "t", 1)], "sample_id string, mask string, pos int")
    boxes = spark.createDataFrame([("a", 0, [0], [1], 0.5, "l"), ("a", 1, [0], [2], 0.25, "m")], "sample_id string, box long, lo array<int>, hi array<int>, score double, label string")
    tables, seen = {"samples": samples, "masks": masks, "boxes": boxes}, []
    new = spark.createDataFrame([("a", "z")], "sample_id string, v string")
    out = edit.update(tables, (new, {"label": "v"}), {"remove": masks, "add": spark.createDataFrame([("a", "u", 2)], masks.schema)}, clear_boxes=boxes, digests=lambda t: t["samples"].select("sample_id", F.sha2("label", 256).alias("digest")), done=seen.append)
    a = out["samples"].where("sample_id = 'a'").first()
    assert (a["label"], a["has_seg"], a["seg_names"], a["has_bbox"]) == ("z", True, ["u"], False) and len(a["checksum"]) == 64 and len(seen) == 1
    assert out["boxes"].isEmpty() and out["samples"].where("sample_id = 'b'").first()["checksum"] == "c2"
    other = spark.createDataFrame([("b", "z")], "sample_id string, v string")
    with pytest.raises(ValidationError, match="checksum"):
        edit.update(tables, (other, {"label": "v"}))
    assert edit.update(tables, (other, {"label": "v"}), force=True)["samples"].where("sample_id = 'b'").first()["label"] == "z"
    with pytest.raises(ValidationError, match="isn't there"):
        edit.update(tables, (spark.createDataFrame([("q", "z")], "sample_id string, v string"), {"label": "v"}))
    with pytest.raises(ValidationError, match="unknown mask operations"):
        edit.update(tables, seg={"drop": masks})
    score = spark.createDataFrame([("a", 0, 0.9), ("a", 1, 0.8)], "sample_id string, box long, score double")
    got = edit.bbox_update(boxes, score, ["score"]).orderBy("box").collect()
    assert [(r["hi"], r["score"], r["label"]) for r in got] == [([1], 0.9, "l"), ([2], 0.8, "m")]
    with pytest.raises(ValidationError, match="number of boxes"):
        edit.bbox_update(boxes, score.limit(1), ["score"])
    with pytest.raises(ValidationError, match="without boxes"):
        edit.bbox_update(boxes, spark.createDataFrame([("b", 0, 0.9)], score.schema), ["score"])
    events = spark.createDataFrame([], "sample_id string, seq long, status string, annotator string, ts string, notes string")
    with pytest.raises(ValidationError, match="no such sample"):
        review.set_status(events, "q", "flagged", samples=samples)
    assert review.set_status(events, "a", "flagged", samples=samples).count() == 1


def test_geometry_of_missing_parts(spark):
    row = spark.range(1).select(F.array(F.lit(1.0), F.lit(2.0)).alias("s"), F.array(F.lit(5.0), F.lit(6.0)).alias("o"), F.lit(None).cast("array<array<double>>").alias("d"), F.array(F.array(F.lit(0.0), F.lit(1.0)), F.array(F.lit(1.0), F.lit(0.0))).alias("t"))
    o, d = flip_geometry(F.col("s"), F.col("o"), F.col("d"), [4, 4], [0], 2)
    assert tuple(row.select(o, d).first()) == ([5.0, 6.0], None)
    assert row.select(as_affine(F.slice("s", 1, 1), F.col("o"), F.col("t"), 2).alias("m")).first()["m"] == [[0.0, 1.0, 5.0], [1.0, 0.0, 6.0], [0.0, 0.0, 1.0]]
    flat = spark.createDataFrame([([1.0, 0.0, 0.0], [2.0, 0.0, 0.0])], "r array<double>, c array<double>")
    with pytest.raises(Exception, match="parallel"):
        flat.select(slice_normal(F.col("r"), F.col("c"))).collect()
    assert issubclass(ValidationError, EngineError)
