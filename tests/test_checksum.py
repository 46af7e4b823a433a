"""Digests of stored samples: what they see, and what they don't."""

import hashlib

import numpy as np
from pyspark.sql import functions as F

from voxelgrove import cli
from voxelgrove.operators import checksum, edit
from voxelgrove.sources import samples, tiles


def tables_of(spark, order=1):
    rows = [(i, f"p{i}", None if i == 2 else "x", 1.5) for i in range(5)][::order]
    volumes = [(i, n, [4, 6], "<f4", (np.arange(24, dtype="<f4") * (i + 1)).tobytes()) for i in range(5) for n in ("CT", "PT")][::order]
    boxes = [(i, k, [0.0, 1.0], [2.0, 3.0], "b") for i in range(3) for k in range(2)][::order]
    cut = tiles.cut(spark.createDataFrame(volumes, "sample_id long, modality string, shape array<int>, dtype string, data binary"), 2, tile=[2, 2])
    return {
        "samples": spark.createDataFrame(rows, "sample_id long, path string, label string, spacing double").repartition(3), "tiles": cut.repartition(5),
        "boxes": spark.createDataFrame(boxes, "sample_id long, box int, lo array<double>, hi array<double>, label string"),
    }


def digests(tables):
    return {r["sample_id"]: r["digest"] for r in checksum.stored_digests(tables).collect()}


def test_digest_is_that_of_the_texts_in_order(spark):
    got = digests(tables_of(spark))
    assert got == digests(tables_of(spark, -1)) and len(set(got.values())) == 5
    boxes = "".join(f'boxes/#{k}#hi=j9:[2.0,3.0];label=s1:b;lo=j9:[0.0,1.0];\n' for k in range(2))
    meta = "samples/#0#label=n;path=s2:p2;spacing=f3:1.5;\n"
    whole = np.arange(24, dtype="<f4").reshape(4, 6) * 3
    parts = []
    for name in ("CT", "PT"):
        found = []
        for a in range(2):
            for b in range(3):
                data = hashlib.sha256(np.ascontiguousarray(whole[2 * a : 2 * a + 2, 2 * b : 2 * b + 2]).tobytes()).hexdigest()
                ends = {"lo0": 2 * a, "hi0": 2 * a + 2, "lo1": 2 * b, "hi1": 2 * b + 2, "lo2": 0, "hi2": 1, "lo3": 0, "hi3": 1}
                said = {"data": f"x64:{data}", "dtype": "s3:<f4", "shape": "j5:[4,6]", "tile_shape": "j5:[2,2]", **{k: f"i1:{v}" for k, v in ends.items()}}
                code = tiles.z_code((a, b))
                found.append((code, f"tiles/{name}#{code}#" + "".join(f"{k}={said[k]};" for k in sorted(said)) + "\n"))
        parts += [t for _, t in sorted(found)]
    assert got[2] == hashlib.sha256((boxes + meta + "".join(parts)).encode()).hexdigest()


def test_one_bit_a_null_a_type_and_a_lost_row_are_seen(spark):
    tables = tables_of(spark)
    base = digests(tables)
    flip = F.udf(lambda x: bytes([x[0] ^ 1]) + x[1:], "binary")
    hurt = tables["tiles"].withColumn("data", F.when(F.expr("sample_id = 3 and name = 'PT' and tile = 2"), flip("data")).otherwise(F.col("data")))
    differ = lambda t: {k for k, v in digests(t).items() if v != base[k]}
    assert differ(tables | {"tiles": hurt}) == {3}
    assert differ(tables | {"samples": tables["samples"].withColumn("label", F.coalesce("label", F.lit("")))}) == {2}
    assert differ(tables | {"samples": tables["samples"].withColumn("label", F.when(F.col("sample_id") == 1, "n").otherwise(F.col("label")))}) == {1}
    assert differ(tables | {"boxes": tables["boxes"].where("sample_id <> 1 or box <> 0")}) == {1}
    assert differ(tables | {"samples": tables["samples"].withColumn("spacing", F.col("spacing").cast("string"))}) == set(range(5))
    assert differ(tables | {"samples": tables["samples"].withColumn("checksum", F.lit("z"))}) == set()


def test_a_sample_of_many_batches(spark):
    rows = spark.range(30_000).select(F.lit(7).alias("sample_id"), F.lit("m").alias("modality"), F.col("id").alias("pos"), F.col("id").alias("value"))
    text = "".join(f"voxels/m#{i}#value=i{len(str(i))}:{i};\n" for i in range(30_000))
    assert digests({"voxels": rows.repartition(7)}) == {7: hashlib.sha256(text.encode()).hexdigest()}
    assert digests({"voxels": rows.limit(0)}) == {}


def test_the_command_finds_damage_and_updates_restamp(spark, tmp_path, capsys):
    tables, root = tables_of(spark), tmp_path / "d"
    for name, df in tables.items():
        samples.write(df, str(tmp_path / "bare" / name))
    assert cli.main(["audit", str(tmp_path / "bare")]) == 0  # no digests yet: missing passes
    assert cli.main(["audit", str(tmp_path / "bare"), "--stamp", str(root / "samples")]) == 0
    samples.write(tables["tiles"], str(root / "tiles"))
    samples.write(tables["boxes"], str(root / "boxes"))
    capsys.readouterr()
    assert cli.main(["audit", str(root)]) == 0 and '"checked":5,"failed":0' in capsys.readouterr().out
    samples.write(tables["boxes"].withColumn("label", F.when(F.col("sample_id") == 2, "c").otherwise(F.col("label"))), str(root / "boxes"), mode="overwrite")
    assert cli.main(["audit", str(root)]) == 1 and '"sample_id":2,"status":"mismatch"' in capsys.readouterr().out
    assert cli.main(["audit", str(tmp_path / "nowhere")]) == 1
    stored = {n: spark.read.parquet(str(root / n)) for n in ("samples", "boxes", "tiles")}
    masks = spark.createDataFrame([], "sample_id long, mask string, pos long")
    now = {"samples": checksum.computed(stored), "masks": masks, "boxes": stored["boxes"]}
    change = spark.createDataFrame([(1, "new")], "sample_id long, label string")
    after = edit.update(now, meta=(change, {"label": "label"}), digests=checksum.restamps(tiles=stored["tiles"]))
    held = {"samples": after["samples"].select(*stored["samples"].columns), "boxes": stored["boxes"], "tiles": stored["tiles"]}
    assert {r["sample_id"] for r in after["samples"].where("label = 'new'").collect()} == {1}
    status = {r["sample_id"]: r["status"] for r in checksum.audited({**held, "samples": after["samples"].drop("computed")}).collect()}
    assert status[1] == "ok" and status[2] == "mismatch"


def test_plain_values_and_bytes_of_digests_are_shuffled(spark):
    """Texts of rows are made after the shuffle of rows, texts of digests after that of digests."""
    samples_ = spark.createDataFrame([(1, "a"), (2, None)], "sample_id long, label string")
    voxels = spark.createDataFrame([(1, "m", 0, 5), (2, "m", 0, None)], "sample_id long, modality string, pos long, value long")
    plan = checksum.audited({"samples": samples_, "voxels": voxels})._jdf.queryExecution().optimizedPlan().toString()
    lines = plan.splitlines()
    shuffle = next(i for i, x in enumerate(lines) if "RepartitionByExpression" in x)
    python = next(i for i, x in enumerate(lines) if "MapInArrow" in x)
    assert any("octet_length" in x for x in lines[python:shuffle]) and not any("octet_length" in x for x in lines[shuffle:])
    assert "hex(" in "".join(lines[:2]) and not any("hex(" in x for x in lines[2:])


def test_odd_rows_are_under_a_digest_as_they_were(spark):
    """Nulls in names, numbers and values, rows that come twice, columns by the names that a text's own parts have, and tables of a key alone."""
    samples_ = spark.createDataFrame([(1, "a", 7, b"xy", [1, None]), (1, "a", 7, b"xy", [1, None]), (2, None, None, None, None), (3, "", 0, b"", []), (None, "lost", 1, b"z", [3])], "sample_id int, part string, pos int, raw binary, list array<int>")
    voxels = spark.createDataFrame([(1, None, None, 1.5), (1, "", None, 0.5), (1, "m", 1, None), (1, "m", 0, 2.0), (9, "m", 0, 1.0), (None, "m", 0, 1.0)], "sample_id long, modality string, pos long, value double")
    tables = {"samples": samples_, "voxels": voxels, "boxes": spark.createDataFrame([(2,), (2,), (3,)], "sample_id long"), "reviews": voxels}
    sha = lambda x: hashlib.sha256(x).hexdigest()
    one = f"samples/#0#list=j8:[1,null];part=s1:a;pos=i1:7;raw=x64:{sha(b'xy')};\n"
    want = {
        1: one + one + "voxels/#-1#value=f3:0.5;\nvoxels/#-1#value=f3:1.5;\nvoxels/m#0#value=f3:2.0;\nvoxels/m#1#value=n;\n",
        2: "boxes/#0#\nboxes/#0#\nsamples/#0#list=n;part=n;pos=n;raw=n;\n",
        3: f"boxes/#0#\nsamples/#0#list=j2:[];part=s0:;pos=i1:0;raw=x64:{sha(b'')};\n",
        9: "voxels/m#0#value=f3:1.0;\n",
    }
    want = {k: sha(v.encode()) for k, v in want.items()}
    assert digests(tables) == want
    rows = [(r["sample_id"], r["computed"]) for r in checksum.computed(tables).collect()]
    assert sorted(rows, key=str) == sorted([(1, want[1]), (1, want[1]), (2, want[2]), (3, want[3]), (None, None)], key=str)
    assert {(r["sample_id"], r["status"]) for r in checksum.audited({**tables, "samples": samples_.withColumn("checksum", F.when(F.col("sample_id") == 1, want[1]).when(F.col("sample_id") == 2, "x"))}).collect()} == {(1, "ok"), (2, "mismatch"), (3, "missing"), (None, "missing")}
