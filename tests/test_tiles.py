"""Stored tiles against slices of whole arrays."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelgrove.sources import tiles


def plain_patch(volume, start, size, pad):
    out = np.full(size, False if volume.dtype.kind == "b" else pad, volume.dtype)
    lo = [max(0, -s) for s in start]
    hi = [min(p, n - s) for s, p, n in zip(start, size, volume.shape)]
    if all(a < b for a, b in zip(lo, hi)):
        out[tuple(map(slice, lo, hi))] = volume[tuple(slice(s + a, s + b) for s, a, b in zip(start, lo, hi))]
    return out


def volumes_of(spark, arrays):
    rows = [(i, n, list(a.shape), a.dtype.str, a.tobytes()) for (i, n), a in arrays.items()]
    return spark.createDataFrame(rows, "sample_id int, modality string, shape array<long>, dtype string, data binary")


@pytest.mark.parametrize("ndim", [2, 3])
def test_patches_equal_slices(spark, tmp_path, ndim):
    rng, draw = np.random.default_rng(ndim), random.Random(ndim)
    arrays = {}
    for i in range(4):
        shape = [draw.randrange(1, 14) for _ in range(ndim)]
        arrays[i, "CT"] = rng.normal(size=shape).astype("<f4")
        arrays[i, "PET"] = rng.integers(0, 999, shape).astype("<u2")
        arrays[i, "lesion"] = rng.random(shape) < 0.4
    cut = tiles.cut(volumes_of(spark, arrays), 4, tile=[4, 3, 5][:ndim])
    tiles.write(cut, str(tmp_path / "t"))
    stored = spark.read.parquet(str(tmp_path / "t"))
    starts = [(i, p, [draw.randrange(-4, 14) for _ in range(ndim)], [draw.randrange(1, 9) for _ in range(ndim)]) for i in range(5) for p in range(6)] + [(0, 99, [40] * ndim, [2] * ndim)]
    got = tiles.patches(stored, spark.createDataFrame(starts, "sample_id int, patch int, start array<int>, size array<int>"), ndim, 7.0).collect()
    want = {(i, p, n): plain_patch(a, s, size, 7) for i, p, s, size in starts for (j, n), a in arrays.items() if i == j}
    assert {(r["sample_id"], r["patch"], r["name"]) for r in got} == set(want) and len(got) == len(want)
    for r in got:
        a = want[r["sample_id"], r["patch"], r["name"]]
        assert r["dtype"] == a.dtype.str and r["size"] == list(a.shape) and r["data"] == a.tobytes()
    back = {(r["sample_id"], r["name"]): np.frombuffer(r["data"], r["dtype"]).reshape(r["shape"]) for r in tiles.whole(stored, ndim).collect()}
    assert back.keys() == arrays.keys() and all(np.array_equal(back[k], a) for k, a in arrays.items())


def plan_of(df):
    """The formatted plan, whose lists aren't cut short."""
    return df.sparkSession._jvm.org.apache.spark.sql.api.python.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def test_reads_of_a_box_reach_the_scan(spark, tmp_path):
    a = np.arange(16 * 16 * 16, dtype="<i4").reshape(16, 16, 16)
    tiles.write(tiles.cut(volumes_of(spark, {(1, "x"): a}), 4, tile=[4, 4, 4]), str(tmp_path / "t"))
    box = tiles.read_box(spark.read.parquet(str(tmp_path / "t")), (0, 3, 8), (4, 5, 9))
    plan = plan_of(box)
    assert "LessThan(lo0,4)" in plan and "GreaterThan(hi1,3)" in plan and "LessThan(lo2,9)" in plan
    assert sorted((r["lo0"], r["lo1"], r["lo2"]) for r in box.collect()) == [(0, 0, 8), (0, 4, 8)]
    at = spark.createDataFrame([(1, 0, [0, 3, 8], [4, 2, 1])], "sample_id int, patch int, start array<int>, size array<int>")
    plan = plan_of(tiles.needed(at, tiles.grids(spark.read.parquet(str(tmp_path / "t"))), 3))
    assert "EqualTo(tile,0)" in plan and "data:binary" not in plan


def test_tiles_of_lists_keep_their_type_and_size_follows_the_patch(spark):
    df = spark.createDataFrame([(1, "a", [3, 2], [float(x) for x in range(6)]), (2, "a", None, [1.0]), (3, "a", [0, 4], []), (None, "a", [1, 1], [1.0])], "sample_id int, modality string, shape array<int>, data array<float>")
    (row,) = tiles.cut(df, 2).collect()
    assert row["sample_id"] == 1 and row["dtype"] == "<f4" and row["tile_shape"] == [3, 2] and np.frombuffer(row["data"], "<f4").tolist() == list(range(6))
    assert tiles.cut(df.limit(0), 2).collect() == []
    with pytest.raises(Exception, match="reshape"):
        tiles.cut(spark.createDataFrame([(1, "a", [3, 3], [1.0])], df.schema), 2).collect()


def test_z_order_codes_agree(spark):
    at = [[random.Random(k).randrange(1 << 20) for _ in range(3)] for k in range(50)] + [[0, 0, 1], [1, 0, 0]]
    got = spark.createDataFrame([(a,) for a in at], "at array<int>").select(tiles.z_code_of(F.col("at"), 3, 20).alias("z")).collect()
    assert [r["z"] for r in got] == [tiles.z_code(a) for a in at] and [tiles.z_code(a) for a in at[-2:]] == [1, 4]
