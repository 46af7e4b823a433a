"""Queries and commands on more than what their SQL, or a short listing, covers."""

import hashlib
import re

import duckdb
import numpy as np
from pyspark.sql import functions as F

from voxelgrove.operators import split
from voxelgrove.plans import catalogue
from voxelgrove.sources import nifti


def test_review_status_of_all_users(spark):
    d = "/root/testdata/sf0.1"
    status = "case event_type when 'error' then 'flagged' when 'purchase' then 'reviewed' when 'view' then 'reviewed' when 'signup' then 'pending' else 'rejected' end"
    last = f"select user_id, arg_max({status}, (ts, event_id)) as s from '{d}/events.parquet' group by 1"
    want = dict(duckdb.connect().execute(f"select u, coalesce(s, 'pending') from (select distinct user_id as u from '{d}/events.parquet' union select * from range(200)) left join ({last}) on u = user_id").fetchall())
    got = catalogue.review_status_of(spark, d).collect()
    assert len(got) == len(want) > 200 and {r["sample_id"]: r["review_status"] for r in got} == want


def test_command_line_shows_every_row(spark, tmp_path, capsys):
    from voxelgrove import cli

    root = str(tmp_path / "ds")
    samples = spark.range(0, 2500, 1, 3).select(
        F.col("id").cast("string").alias("path"), F.array(F.lit("CT")).alias("images"), F.lit("9").alias("schema_version"), F.array(F.lit("CT")).alias("image_names"), F.lit("x").alias("checksum"), F.lit("y").alias("computed")
    )
    samples.write.parquet(root + "/samples")
    spark.createDataFrame([("1", 0, "flagged", None, "t", None)], "sample_id string, seq long, status string, annotator string, ts string, notes string").write.parquet(root + "/review_events")
    for args, code, text, n in ((["info", root], 0, '"file"', 2500), (["validate-all", root], 1, "metadata_read_failed", 2500), (["audit", root], 1, '"mismatch"', 2500), (["review", "list", root, "--status", "pending"], 0, '"pending"', 2499)):
        assert cli.main(args) == code
        assert sum(text in line for line in capsys.readouterr().out.splitlines()) == n, args


def test_resampling_of_whole_volumes(spark, monkeypatch):
    d, shapes, of = "/root/testdata/sf0.001", [], catalogue.labels.resample
    monkeypatch.setattr(catalogue.labels, "resample", lambda df, shape, *a, **k: shapes.append(tuple(shape)) or of(df, shape, *a, **k))
    volumes = {r["vec_id"]: np.array(r["embedding"]).reshape(4, 4, 4) for r in spark.read.parquet(f"{d}/embeddings.parquet").collect()}
    got = {}
    for r in catalogue.resample_linear_volume(spark, d).collect():
        got.setdefault(r["vec_id"], {})[r["idx"]] = r["v"]
    assert got.keys() == volumes.keys()
    for i, x in volumes.items():
        for axis in range(3):
            x = np.moveaxis(x, axis, 0)
            y = np.repeat(x, 2, axis=0)[:-1].copy()
            y[1::2] = (x[:-1] + x[1:]) / 2
            x = np.moveaxis(y, 0, axis)
        assert sorted(got[i]) == list(range(343)) and np.abs([got[i][p] for p in range(343)] - x.ravel()).max() < 1e-6
    assert catalogue.resample_linear(spark, d).count() == 112 * len(volumes) and set(shapes) == {(4, 4, 4)}


def test_recompress_gives_every_component(spark):
    d = "/root/testdata/sf0.001"
    want = {(r["vec_id"], i): v for r in spark.read.parquet(f"{d}/embeddings.parquet").collect() for i, v in enumerate(r["embedding"])}
    assert {(r["vec_id"], r["idx"]): r["v"] for r in catalogue.recompress_components(spark, d).collect()} == want


def test_nifti_files_are_written_in_tasks(spark, tmp_path, monkeypatch):
    rows = [(f"imagesTr/v{i}.nii.gz", [2, 2], "int16", np.eye(4).ravel().tolist(), [float(i), 1.0, 2.0, 3.0]) for i in range(20)]
    vol = spark.createDataFrame(rows, "name string, shape array<bigint>, dtype string, affine array<double>, data array<double>").repartition(3)

    def to_driver(*a, **k):
        raise AssertionError("volumes pass through the driver")

    monkeypatch.setattr(type(vol), "toLocalIterator", to_driver)
    for _ in range(2):
        nifti.export(vol, str(tmp_path / "out"))
    assert sorted(p.name for p in (tmp_path / "out" / "imagesTr").iterdir()) == sorted(r[0][9:] for r in rows)
    assert all(nifti.parse((tmp_path / "out" / r[0]).read_bytes())["data"].tolist() == r[4] for r in rows)


def test_groups_are_ranked_in_buckets(spark):
    rows = [(i, f"g{i}" if i % 50 else None, None if i % 7 == 0 else "ab"[i % 2]) for i in range(3000)]
    df = spark.createDataFrame(rows, "ordinal long, g string, s string")
    key = lambda g: (hashlib.sha256(f"4:{g or ''}".encode()).hexdigest(), g or "")
    for stratum in (None, "s"):
        ranks = split.group_ranks(df, "g", stratum, "ordinal", 4)
        of = {}
        for _, g, s in rows:
            of.setdefault(g, s if stratum else "")
        want = {}
        for s in set(of.values()):
            mine = sorted((g for g in of if of[g] == s), key=key)
            want |= {g: (s, k, len(mine)) for k, g in enumerate(mine)}
        assert {r["group"]: (r["stratum"], r["rank"], r["n"]) for r in ranks.collect()} == want and ranks.count() == len(want)
        plan = ranks._jdf.queryExecution().analyzed().toString()
        assert re.findall(r"row_number\(\) windowspecdefinition\((.*?) ASC", plan) and all("__b#" in x for x in re.findall(r"row_number\(\) windowspecdefinition\((.*?) ASC", plan))
