"""The data source nifti: files to rows, rows to files. And other files that are read by ranges."""

import contextlib
import gzip
import os
import sys
import types

import numpy as np
import pyarrow as pa
import pytest

from voxelgrove.sources import hdf5, nifti, nifti_format, tiles

AFFINE = [float(v) for v in (2, 0, 0, 5, 0, 3, 0, 6, 0, 0, 4, 7, 0, 0, 0, 1)]
ROWS = "name string, shape array<bigint>, dtype string, affine array<double>, data array<double>, more int"


def made(folder):
    rng = np.random.default_rng(2)
    kept = {}
    for i, kind in enumerate(("u1", "<i2", "<f4", "<f8")):
        x = rng.integers(0, 200, (2, 3, 4 + i)).astype(kind)
        name = f"d{i % 2}/v{i}.nii" + (".gz" if i % 2 else "")
        os.makedirs(folder / f"d{i % 2}", exist_ok=True)
        (folder / name).write_bytes(nifti.build(x, np.array(AFFINE).reshape(4, 4), compress=bool(i % 2)))
        kept[name] = x
    return kept


def read(spark, folder, **options):
    nifti_format.register(spark)
    rows = spark.read.format("nifti").options(**options).load(str(folder)).collect()
    return {r["path"].removeprefix(f"{folder}/"): r for r in rows}


def test_files_come_as_rows_with_their_own_bytes(spark, tmp_path):
    kept = made(tmp_path)
    for size in (1, 1 << 27):
        got = read(spark, tmp_path, partitionBytes=size)
        assert set(got) == set(kept)
        for name, x in kept.items():
            r = got[name]
            assert (r["shape"], r["dtype"], r["affine"], r["error"]) == (list(x.shape), x.dtype.name, AFFINE, None)
            assert bytes(r["data"]) == x.tobytes() and r["bytes"] == os.path.getsize(tmp_path / name)
    assert set(read(spark, tmp_path, pattern="v1*")) == {"d1/v1.nii.gz"} and set(read(spark, tmp_path / "d0" / "v0.nii")) == {str(tmp_path / "d0" / "v0.nii")}


def test_headers_alone_read_the_start_of_a_file(spark, tmp_path):
    kept = made(tmp_path)
    whole = (tmp_path / "d0" / "v0.nii").read_bytes()
    (tmp_path / "cut.nii").write_bytes(whole[:360])
    rng = np.random.default_rng(1).integers(0, 255, (40, 40, 40)).astype("u1")
    packed = nifti.build(rng, np.eye(4))
    (tmp_path / "cut.nii.gz").write_bytes(packed[:3000])
    got = read(spark, tmp_path, headers="true")
    assert set(got) == {*kept, "cut.nii", "cut.nii.gz"} and "data" not in got["cut.nii"].asDict()
    assert got["cut.nii"]["error"] is None and got["cut.nii.gz"]["shape"] == [40, 40, 40]
    full = read(spark, tmp_path)
    assert full["cut.nii"]["error"] == "the file ends before its data" and full["cut.nii.gz"]["error"] and full["cut.nii.gz"]["data"] is None


def test_bad_files_are_rows_and_scaled_values_are_doubles(spark, tmp_path):
    (tmp_path / "empty.nii").write_bytes(b"")
    (tmp_path / "text.nii").write_bytes(b"x" * 500)
    (tmp_path / "bad.nii.gz").write_bytes(b"\x1f\x8b" + b"no gzip")
    (tmp_path / ".hidden.nii").write_bytes(b"x")
    x = np.arange(24, dtype="<i2").reshape(2, 3, 4)
    file = bytearray(nifti.build(x, np.eye(4), compress=False))
    file[112:120] = np.array([2.0, -1.0], "<f4").tobytes()
    (tmp_path / "scaled.nii.gz").write_bytes(gzip.compress(bytes(file)))
    file[42:48] = np.array([32000, 32000, 32000], "<i2").tobytes()
    (tmp_path / "long.nii").write_bytes(bytes(file))
    got = read(spark, tmp_path)
    assert set(got) == {"empty.nii", "text.nii", "bad.nii.gz", "scaled.nii.gz", "long.nii"}
    assert all(got[n]["error"] and got[n]["data"] is None and got[n]["shape"] is None for n in ("empty.nii", "text.nii", "bad.nii.gz", "long.nii")) and "2 GB" in got["long.nii"]["error"]
    assert got["scaled.nii.gz"]["dtype"] == "float64" and np.array_equal(np.frombuffer(got["scaled.nii.gz"]["data"]), x.ravel() * 2.0 - 1)
    os.makedirs(tmp_path / "none")
    assert read(spark, tmp_path / "none") == {}
    with pytest.raises(Exception, match="no such folder"):
        read(spark, tmp_path / "nowhere")


def test_what_is_written_comes_back_and_can_be_cut(spark, tmp_path):
    nifti_format.register(spark)
    x = np.arange(24.0)
    rows = [(f"s{i}/image_CT.nii" + (".gz" if i % 2 else ""), [2, 3, 4], ("int16", "float32")[i % 2], AFFINE if i else None, (x + i).tolist(), i) for i in range(6)]
    df = spark.createDataFrame(rows, ROWS).repartition(3)
    out = tmp_path / "out"
    df.write.format("nifti").mode("append").save(str(out))
    assert sorted(os.listdir(out)) == ["_SUCCESS", *(f"s{i}" for i in range(6))]
    got = read(spark, out)
    for name, shape, dtype, affine, data, _ in rows:
        r = got[name]
        assert (r["shape"], r["dtype"]) == (shape, dtype) and np.frombuffer(r["data"], dtype).tolist() == data and r["affine"] == (affine or np.eye(4).ravel().tolist())
    volumes = spark.read.format("nifti").load(str(out)).selectExpr("path as sample_id", "'CT' as modality", "shape", "dtype", "data")
    again = {r["sample_id"].removeprefix(f"{out}/"): r for r in tiles.numbers(tiles.whole(tiles.cut(volumes, 2, (2, 2, 2)), 3)).collect()}
    assert {n: r["data"] for n, r in again.items()} == {r[0]: r[4] for r in rows}


def test_a_write_that_fails_leaves_nothing(spark, tmp_path):
    nifti_format.register(spark)
    row = lambda n, data=(1.0, 2.0): (n, [1, 1, 2], "int16", AFFINE, None if data is None else list(data), 0)
    save = lambda rows, mode="append": spark.createDataFrame(rows, ROWS).repartition(2, "name").write.format("nifti").mode(mode).save(str(tmp_path))
    for rows, why in (([row("a.nii"), row("b.nii", (1.0,))], "1 values for"), ([row("a.nii"), row("b.nii", None)], "no data"), ([row("a.nii"), row("../b.nii")], "no name"), ([row("a.nii"), row("b.nii"), row("a.nii")], "comes twice")):
        with pytest.raises(Exception, match=why):
            save(rows)
        assert os.listdir(tmp_path) == []
    with pytest.raises(Exception, match="no column"):
        spark.createDataFrame([("a",)], "name string").write.format("nifti").mode("append").save(str(tmp_path))
    save([row("a.nii")])
    before = (tmp_path / "a.nii").read_bytes()
    with pytest.raises(Exception, match="is there already"):
        save([row("a.nii", (8.0, 9.0)), row("c.nii")])
    assert (tmp_path / "a.nii").read_bytes() == before and sorted(os.listdir(tmp_path)) == ["_SUCCESS", "a.nii"]
    save([row("a.nii", (8.0, 9.0)), row("c.nii")], "overwrite")
    assert np.frombuffer(read(spark, tmp_path)["a.nii"]["data"], "<i2").tolist() == [8, 9] and sorted(os.listdir(tmp_path)) == ["_SUCCESS", "a.nii", "c.nii"]
    spark.createDataFrame([], ROWS).write.format("nifti").mode("append").save(str(tmp_path / "none"))
    assert os.listdir(tmp_path / "none") == ["_SUCCESS"]


def test_a_task_that_runs_on_after_an_abort_leaves_nothing(tmp_path):
    batch = pa.RecordBatch.from_pylist([{"name": "a.nii", "shape": [1, 1, 2], "dtype": "int16", "affine": AFFINE, "data": [1.0, 2.0]}])
    late = nifti_format._Writer(str(tmp_path), False)
    assert len(late.write(iter([batch])).files) == 1
    late.abort([])
    with pytest.raises(OSError):
        late.write(iter([batch]))
    assert os.listdir(tmp_path) == []

    def aborted():
        yield batch
        other.abort([])
        yield batch

    other = nifti_format._Writer(str(tmp_path), False)
    with pytest.raises(OSError):
        other.write(aborted())
    assert os.listdir(tmp_path) == []


def test_hdf5_files_are_opened_where_they_lie(spark, tmp_path, monkeypatch):
    """The library isn't installed: one that reads a file's ends stands in for it. Spark's scan has no column of contents."""
    path = tmp_path / "long.h5"
    with open(path, "wb") as f:
        f.write(b"head")
        f.truncate(3 << 30)
    got = {}

    @contextlib.contextmanager
    def file(raw, mode):
        got["head"] = raw.read(4)
        got["end"], before = raw.seek(0, os.SEEK_END), bytearray(2)
        raw.seek(-2, os.SEEK_CUR)
        got["n"] = raw.readinto(before)
        yield {"mode": mode}

    monkeypatch.setitem(sys.modules, "h5py", types.SimpleNamespace(File=file))
    for name in (f"file:{path}", f"file://{path}", str(path)):
        with hdf5._opened(name) as f:
            assert f == {"mode": "r"} and got == {"head": b"head", "end": 3 << 30, "n": 2}
    monkeypatch.setattr(hdf5, "need", lambda module: None)
    plan = hdf5.read_meta(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<path:string>" in plan
