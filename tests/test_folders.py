"""Folders of files to tables and back, by functions and commands; assembled samples."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelgrove import cli
from voxelgrove.errors import SourceError, ValidationError
from voxelgrove.sources import nifti, nnunet, samples

UNIT = np.eye(4)
COARSE = np.diag([2.0, 2, 2, 1]) + np.array([[0, 0, 0, 0.5]] * 3 + [[0] * 4])


def put(path, data, affine=UNIT):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(nifti.build(data, affine))


def folder(top):
    rng = np.random.default_rng(4)
    kept = {}
    for s in ("a", "b"):
        ct, pet = rng.integers(-50, 50, (4, 4, 2)).astype("i2"), rng.integers(0, 9, (2, 2, 1)).astype("f4")
        put(top / s / "ct.nii.gz", ct)
        put(top / s / "pet.nii.gz", pet, COARSE)
        kept[s] = ct, pet
    put(top / "a" / "lesion.nii.gz", (kept["a"][0] > 10).astype("u1"))
    return kept


def test_named_files_of_sample_folders_become_tables(spark, tmp_path):
    kept = folder(tmp_path / "in")
    args = dict(images={"PET": "pet.nii.gz", "CT": "ct.nii.gz"}, masks={"tumor": "lesion.nii.gz"})
    got = nifti.import_folder(spark, str(tmp_path / "in"), **args, resample_to="CT", order="nearest", label="3")
    heads = {r["sample_id"]: r for r in got["samples"].collect()}
    assert heads.keys() == {"a", "b"} and heads["a"]["seg_names"] == ["tumor"] and heads["b"]["seg_names"] is None and not heads["b"]["has_seg"]
    assert heads["a"]["image_names"] == ["CT", "PET"] and heads["a"]["shape"] == [4, 4, 2] and heads["a"]["spacing"] == [1, 1, 1] and heads["a"]["origin"] == [0, 0, 0] and heads["b"]["label"] == "3"
    for r in got["images"].collect():
        ct, pet = kept[r["sample_id"]]
        want = ct if r["modality"] == "CT" else pet.repeat(2, 0).repeat(2, 1).repeat(2, 2)
        assert r["shape"] == [4, 4, 2] and r["data"] == want.astype(float).ravel().tolist()
    assert [r["data"] for r in got["masks"].collect()] == [(kept["a"][0] > 10).ravel().tolist()]
    with pytest.raises(SourceError, match="a, PET: shape differs"):
        nifti.import_folder(spark, str(tmp_path / "in"), **args)
    free = nifti.import_folder(spark, str(tmp_path / "in"), **args, same_grid=False)
    assert {(r["sample_id"], r["modality"], tuple(r["shape"])) for r in free["images"].collect()} == {(s, m, x) for s in "ab" for m, x in (("CT", (4, 4, 2)), ("PET", (2, 2, 1)))}


def test_samples_with_faults_are_named_or_left_out(spark, tmp_path):
    folder(tmp_path / "in")
    (tmp_path / "in" / "b" / "ct.nii.gz").write_bytes(b"no volume")
    put(tmp_path / "in" / "c" / "pet.nii.gz", np.zeros((2, 2, 1), "f4"), COARSE)
    args = dict(images={"PET": "pet.nii.gz", "CT": "ct.nii.gz"}, masks={"tumor": "lesion.nii.gz"}, resample_to="CT", order="nearest")
    with pytest.raises(SourceError, match="b, CT: unreadable or missing"):
        nifti.import_folder(spark, str(tmp_path / "in"), **args)
    got = nifti.import_folder(spark, str(tmp_path / "in"), **args, skip_invalid=True)
    assert [r[0] for r in got["samples"].select("sample_id").collect()] == ["a"] and {r[0] for r in got["images"].select("sample_id").collect()} == {"a"}
    assert got["masks"].count() == 1
    (tmp_path / "none").mkdir()
    assert nifti.import_folder(spark, str(tmp_path / "none"))["samples"].collect() == []


def test_commands_from_files_to_a_dataset_folder_and_back(spark, tmp_path, capsys):
    kept = folder(tmp_path / "in")
    root, out = str(tmp_path / "ds"), str(tmp_path / "nn")
    named = ["--image", "CT=ct.nii.gz", "--image", "PET=pet.nii.gz", "--seg", "tumor=lesion.nii.gz"]
    assert cli.main(["import", "nifti", str(tmp_path / "in"), root + "x", *named]) == 1 and "shape differs" in capsys.readouterr().err
    assert cli.main(["import", "nifti", str(tmp_path / "in"), root, "--image", "CT"]) == 1
    assert cli.main(["import", "nifti", str(tmp_path / "in"), root, *named, "--resample-to", "CT", "--interpolator", "nearest", "--label", "x"]) == 0
    assert cli.main(["validate", root, "a"]) == 0 and cli.main(["index", root, root + ".index"]) == 0
    assert cli.main(["info", root, "--path", "a"]) == 0 and '"seg_names":["tumor"]' in capsys.readouterr().out
    assert cli.main(["export", "nnunetv2", root, out, "--dataset-name", "D1"]) == 0 and '"numTraining": 2' in capsys.readouterr().out
    told = json.loads((tmp_path / "nn" / "dataset.json").read_text())
    assert told["channel_names"] == {"0": "CT", "1": "PET"} and told["labels"] == {"background": 0, "tumor": 1} and told["name"] == "D1"
    assert cli.main(["import", "nnunetv2", out, root + "2"]) == 0
    capsys.readouterr()
    assert cli.main(["validate-all", root + "2"]) == 0 and '"checked":2,"invalid":0' in capsys.readouterr().out
    again = samples.SampleSet(spark, root + "2")
    data = {(r["sample_id"], r["modality"]): r["data"] for r in again.images.collect()}
    assert all(data[s, "CT"] == kept[s][0].astype(float).ravel().tolist() for s in "ab") and len(data) == 4
    assert {r["sample_id"]: sum(r["data"]) for r in again.masks.collect()} == {"a": int((kept["a"][0] > 10).sum()), "b": 0}
    # What the import kept of dataset.json says which channel is which when it goes out again, whatever the names' order.
    text = again.samples.withColumn("extra", F.regexp_replace("extra", '"0": "CT", "1": "PET"', '"1": "CT", "0": "PET"'))
    nnunet.export_dataset({"samples": text, "images": again.images, "masks": again.masks}, str(tmp_path / "n3"))
    assert json.loads((tmp_path / "n3" / "dataset.json").read_text())["channel_names"] == {"0": "PET", "1": "CT"}
    assert nifti.parse((tmp_path / "n3" / "imagesTr" / "a_0001.nii.gz").read_bytes())["data"].tolist() == data["a", "CT"]
    assert cli.main(["export", "nifti", root, str(tmp_path / "ni"), "--modalities", "CT"]) == 0
    assert sorted(p.name for p in (tmp_path / "ni" / "a").iterdir() if not p.name.startswith(".")) == ["image_CT.nii.gz", "seg_tumor.nii.gz"]
    two = text.unionByName(again.samples.withColumn("sample_id", F.concat("sample_id", F.lit("2"))))
    with pytest.raises(ValidationError, match="other channels"):
        nnunet.kept_dataset(two)
    assert cli.main(["export", "nnunetv2", root + "/images", str(tmp_path / "n4")]) == 1


def test_validate_reads_the_tables_themselves(spark, tmp_path, capsys):
    folder(tmp_path / "in")
    good, bad = str(tmp_path / "good"), tmp_path / "bad"
    assert cli.main(["import", "nifti", str(tmp_path / "in"), good, "--image", "CT=ct.nii.gz", "--seg", "tumor=lesion.nii.gz"]) == 0
    own = samples.SampleSet(spark, good)
    samples.write(own.samples.withColumn("checksum", F.lit("x")), str(bad / "samples"))
    samples.write(own.images, str(bad / "images"))
    samples.write(own.masks.withColumn("sample_id", F.lit("b")), str(bad / "masks"))
    capsys.readouterr()
    assert cli.main(["validate-all", str(bad)]) == 1
    codes = {(r["path"], r["code"]) for r in map(json.loads, capsys.readouterr().out.splitlines()) if "code" in r}
    assert codes == {("a", "seg_presence_mismatch"), ("b", "seg_presence_mismatch"), ("b", "seg_names_mismatch"), ("a", "checksum_mismatch"), ("b", "checksum_mismatch")}


def test_assembled_samples(spark, tmp_path):
    heads = spark.createDataFrame([("a", "old"), ("b", None), (None, "n")], "sample_id string, images string")
    images = spark.createDataFrame([("a", "PET", [1, 2], "i"), ("a", "CT", [3], None), ("z", "CT", [9], "i"), ("b", None, [1], "i")], "sample_id string, modality string, shape array<int>, dtype string")
    masks = spark.createDataFrame([("a", "m", None)], "sample_id string, mask string, data array<boolean>")
    boxes = spark.createDataFrame([("a", 1, 5), ("a", 0, 7), ("a", 0, 7)], "sample_id string, box int, lo int")
    got = {r["sample_id"]: r for r in samples.assemble(heads, images, masks, boxes).collect()}
    assert got.keys() == {"a", "b", None}
    assert {k: tuple(v) for k, v in got["a"]["images"].items()} == {"CT": ([3], None), "PET": ([1, 2], "i")} and got["a"]["masks"] == {"m": None}
    assert [tuple(b) for b in got["a"]["boxes"]] == [(0, 7), (0, 7), (1, 5)]
    assert got["b"][1:] == (None, None, None) and got[None][1:] == (None, None, None)
    for name, df in (("samples", heads), ("images", images), ("masks", masks)):
        samples.write(df, f"{tmp_path}/{name}")
    with samples.SampleSet(spark, str(tmp_path)) as s:
        assert s.boxes is None and s.where("sample_id = 'a'", "masks").keys() == {"samples", "masks"} and s.where("sample_id = 'b'")["images"].count() == 1
        assert s.assembled("sample_id = 'a'").first()["masks"] == {"m": None} and s.assembled().count() == 3
        with pytest.raises(AttributeError):
            s.nothing
