"""What grows with the tables: upstream plans that run once, rows that travel once."""

import hashlib
import os

import pyarrow as pa
from pyspark.sql import functions as F

from voxelgrove.functions import geometry as geo
from voxelgrove.operators import boxes, checksum, edit, series, stats
from voxelgrove.plans import catalogue
from voxelgrove.sources import dicom, samples

SF = "/root/testdata/sf0.001"


def counted(spark, rows, tmp_path, name):
    """rows, and the calls that its partitions have had so far: each pass over it leaves a file for each partition."""
    folder = str(tmp_path / name)
    os.makedirs(folder, exist_ok=True)

    def seen(batches):
        import uuid

        open(f"{folder}/{uuid.uuid4().hex}", "w").close()
        yield from batches

    return rows.coalesce(1).mapInArrow(seen, rows.schema), lambda: len(os.listdir(folder))


def test_statistics_run_what_lies_below_voxels_once(spark, tmp_path):
    rows = spark.range(3000).select(F.lit("m").alias("modality"), F.sin("id").alias("value"))
    rows, passes = counted(spark, rows, tmp_path, "a")
    r = stats.modality_stats(rows).first()
    assert r["n_voxels"] == 3000 and r["p01"] < r["p99"] and passes() == 1


def test_masked_voxels_are_made_once_for_statistics(spark, tmp_path):
    rows = spark.createDataFrame([(s, "m", p, float(10 * s + p)) for s in range(50) for p in range(4)], "sample_id long, modality string, pos long, value double")
    rows, passes = counted(spark, rows, tmp_path, "b")
    shapes = spark.createDataFrame([(s, "m", None, [4]) for s in range(50)] + [(1, None, "t", [4]), (2, None, "t", [4]), (2, None, "u", [4]), (3, None, "t", [5])], "sample_id long, modality string, mask string, shape array<int>")
    inside = spark.createDataFrame([(1, "t", 3), (2, "u", 0)], "sample_id long, mask string, pos long")
    r = stats.modality_stats(stats.masked(rows, inside, "t", shapes)).first()
    assert (r["n_voxels"], r["vmin"], r["vmax"]) == (4 * 48 + 1, 0.0, 493.0) and passes() == 1


def test_draws_with_replacement_take_one_shuffle(spark, tmp_path):
    rows = spark.createDataFrame([(s, "m", p, float(p)) for s in (1, 2, None) for p in range(40)] + [(9, "m", 0, 1.0)], "sample_id long, modality string, pos long, value double")
    out = stats.sample_with_replacement(rows, 8)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
    sums = {r["sample_id"]: r["w"] for r in out.groupBy("sample_id").agg(F.sum("weight").alias("w")).collect()}
    assert sums == {1: 8, 2: 8, None: 8, 9: 1}  # a null sample is a group, capped as any other



def test_few_draws_are_counted_without_sorting_voxels_again(spark):
    """Draws are carried beside the rows of their group, so nothing but the order of voxels is sorted for; many draws still are."""
    rows = spark.createDataFrame([(s, "m", p, float(p)) for s in (1, 2) for p in range(40)], "sample_id long, modality string, pos long, value double")
    planned = lambda cap: stats.sample_with_replacement(rows, cap)._jdf.queryExecution().executedPlan().toString()
    sorts = lambda plan: sum("Sort [" in x for x in plan.splitlines())
    assert sorts(planned(3)) == 1 and "explode" not in planned(3) and sorts(planned(stats.FEW_DRAWS + 1)) == 2



def test_sample_replacement_sorts_lines_and_voxels_once_each(spark):
    plan = catalogue.QUERIES["sample_replacement"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert sum("Sort [" in x for x in plan.splitlines()) == 2 and plan.count("Exchange hashpartitioning") == 1


def test_draws_carried_and_draws_sorted_are_the_same(spark, monkeypatch):
    """Groups below, at and over the cap, null keys, names, places and values, a group that comes twice under other places, and no rows at all."""
    sizes = {1: 1, 2: 3, 3: 4, 4: 5, 5: 17, 6: 60, None: 9}
    rows = [(s, m, p if p != 2 or s != 5 else None, None if p % 5 == 4 else p / 8) for s, n in sizes.items() for m in ("a", None) for p in range(n)] + [(4, "a", p + 100, 0.5) for p in range(5)]
    voxels = spark.createDataFrame(rows, "sample_id long, modality string, pos long, value double")
    for cap in (0, 1, 3, 4, 16):
        found = {}
        for few in (0, 16):
            monkeypatch.setattr(stats, "FEW_DRAWS", few)
            found[few] = sorted(map(tuple, stats.sample_with_replacement(voxels.repartition(3), cap, seed=5).collect()), key=str)
        large = [(s, m) for s, m in {(r[0], r[1]) for r in rows} if sum((r[0], r[1]) == (s, m) for r in rows) > cap]
        sums = {k: sum(r[4] for r in found[0] if (r[0], r[1]) == k) for k in large}
        assert found[0] == found[16] and set(sums.values()) == {cap} and sum(r[4] for r in found[0]) == cap * len(large) + sum((r[0], r[1]) not in large for r in rows)
        assert stats.sample_with_replacement(voxels.limit(0), cap).collect() == []


def test_capped_statistics_make_voxels_once(spark, tmp_path):
    rows = spark.range(400).select((F.col("id") % 2).alias("sample_id"), F.lit("m").alias("modality"), F.col("id").alias("pos"), F.sin("id").alias("value"))
    rows, passes = counted(spark, rows, tmp_path, "c")
    samples = spark.createDataFrame([("x", [4])], "label string, shape array<int>")
    r = stats.compute_stats(samples, rows, cap=10)["modalities"].first()
    assert r["n_voxels"] == 400 and r["p01"] < r["p99"] and passes() == 1


def test_partials_are_merged_from_one_pass(spark, tmp_path):
    rows = spark.range(300).select((F.col("id") % 7).alias("sample_id"), F.lit("m").alias("modality"), F.col("id").cast("double").alias("value"))
    rows, passes = counted(spark, rows, tmp_path, "d")
    r = stats.merge(stats.partials(rows)).first()
    assert r["n_voxels"] == 300 and r["mean"] == 149.5 and passes() == 1


def test_a_samples_lines_meet_before_there_is_a_row_for_each_measure(spark):
    plan = catalogue.QUERIES["per_sample_partials"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.index("Generate") < plan.index("Exchange hashpartitioning")


def test_a_patch_is_in_one_cell_of_a_level(spark):
    """Boxes of one level against many patches: each pair meets once, and no side has more than 2 cells an axis."""
    b = spark.range(200).select(F.col("id"), F.lit("a").alias("s"), F.array(F.col("id") * 7 % 90 - 20, F.col("id") * 3 % 80).alias("lo")).withColumn("hi", F.transform("lo", lambda x: x + 5))
    p = spark.range(300).select(F.lit("a").alias("s"), F.col("id").alias("patch"), F.array(F.col("id") * 11 % 90 - 12, F.col("id") * 5 % 80).alias("start"))
    met = boxes._candidates(b, p, (8, 6), "s")
    assert met.count() == met.distinct().count() > 0
    plan = met._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("explode(sequence") == 2  # boxes alone, an axis each


def test_boxes_of_fractions_and_below_zero(spark):
    rows = [(i, "a", [v], [v + w]) for i, (v, w) in enumerate((a / 4, w / 4) for a in range(-60, 60, 3) for w in (0, 1, 9, 70))]
    b = spark.createDataFrame(rows, "id int, s string, lo array<double>, hi array<double>")
    p = spark.createDataFrame([("a", s, [s]) for s in range(-40, 40)], "s string, patch int, start array<int>")
    got = sorted((r["id"], r["patch"]) for r in boxes.touching(b, p, (8,), "s").collect())
    assert got == sorted((i, s) for i, _, lo, hi in rows for s in range(-40, 40) if hi[0] - s >= 0 and lo[0] - s < 8)


def test_a_slice_normal_is_evaluated_once(spark):
    """No function over arrays is left to be evaluated for each use of an element."""
    df = spark.createDataFrame([([3.0, 0.0, 0.0], [0.0, 2.0, 0.0]), (None, [0.0, 1.0, 0.0])], "r array<double>, c array<double>")
    out = df.select(geo.slice_normal(F.col("r"), F.col("c")).alias("n"))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert [r["n"] for r in out.collect()] == [[0.0, 0.0, 1.0], [None] * 3] and not any(x in plan for x in ("transform(", "aggregate(", "zip_with("))


def test_digests_hash_a_samples_rows_of_a_batch_in_one_call(spark):
    """Python is given keys and records alone; samples that reach over batches, texts of several bytes and empty ones hash as row by row."""
    rows = [(f"s{i % 5}" if i % 7 else None, "m", i, "é" * (i % 4) if i % 3 else None) for i in range(90)] + [(f"t{i}", "m", 0, "") for i in range(9)]
    voxels = spark.createDataFrame(rows, "sample_id string, modality string, pos long, value string")
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "4")
    try:
        out = checksum.stored_digests({"voxels": voxels})
        got = {r["sample_id"]: r["digest"] for r in out.collect()}
        pairs = checksum.stored_digests({"voxels": voxels.withColumn("sample_id", F.struct(F.col("sample_id").alias("a")))}).collect()
    finally:
        spark.conf.set(name, before)
    said = lambda v: "value=n;" if v is None else f"value=s{len(v.encode())}:{v};"
    want = {k: hashlib.sha256("".join(f"voxels/m#{p}#{said(v)}\n" for s, _, p, v in rows if s == k).encode()).hexdigest() for k in {r[0] for r in rows} - {None}}
    assert got == want and {r["sample_id"]["a"]: r["digest"] for r in pairs if r["sample_id"]["a"]} == want
    python = next(x for x in out._jdf.queryExecution().optimizedPlan().toString().splitlines() if "MapInArrow" in x)
    assert python.split("(")[1].split(")")[0].count("#") == 2


def test_what_an_edit_gives_back_is_made_once(spark, tmp_path):
    masks, passes = counted(spark, spark.range(30).select((F.col("id") % 10).alias("sample_id"), F.concat(F.lit("m"), F.floor(F.col("id") / 10)).alias("mask"), F.lit(1).alias("voxels")), tmp_path, "e")
    boxes_, box_passes = counted(spark, spark.range(20).select((F.col("id") % 10).alias("sample_id"), F.col("id").alias("box")), tmp_path, "f")
    samples = spark.range(10).select(F.col("id").alias("sample_id"), F.lit("x").alias("label"))
    gone = spark.createDataFrame([(3, "m1")], "sample_id long, mask string")
    out = edit.update({"samples": samples, "masks": masks, "boxes": boxes_}, seg={"remove": gone}, clear_boxes=spark.createDataFrame([(4,)], "sample_id long"))
    at = passes(), box_passes()
    assert at == (2, 1)  # the check, and the edit
    assert out["masks"].count() == 29 and out["boxes"].count() == 18 and out["samples"].where("has_seg").count() == 10 and out["samples"].where("has_bbox").count() == 9
    assert (passes(), box_passes()) == at


def test_files_of_series_are_parsed_once_and_given_back_together(spark, tmp_path):
    rows = [{"path": f"{u}/{k}", "uid": f"1.{u}", "position": [0.0, 0.0, float(k + (u == 3 and k == 2) * 0.5)], "row_dir": [1.0, 0.0, 0.0], "col_dir": [0.0, 1.0, 0.0], "shape": [1, 2 + (u == 4 and k == 1)], "data": [u, k, 7][: 2 + (u == 4 and k == 1)]} for u in range(6) for k in range(3)]
    files = spark.createDataFrame([(r["path"], dicom.encode(r)) for r in rows], "path string, content binary")
    files, passes = counted(spark, files, tmp_path, "g")
    got = {r["uid"]: r for r in series.volumes(dicom.slices(dicom.parsed(files))).collect()}
    assert passes() == 1 and got["1.2"]["data"] == [2.0, 0.0, 2.0, 1.0, 2.0, 2.0] and got["1.2"]["spacing"][0] == 1.0
    assert {u: r["problem"] for u, r in got.items() if r["problem"]} == {"1.3": "slices with uneven spacing", "1.4": "4/1: another shape"}
    sizes = dicom.parsed(files).mapInArrow(lambda batches: (pa.record_batch({"n": [b.num_rows]}) for b in batches), "n long")
    assert [r["n"] for r in sizes.collect()] == [18]


def test_boxes_and_patches_meet_without_a_broadcast(spark):
    """Cells are many more rows than the table that they are made of, by whose size Spark would broadcast them."""
    out = catalogue.QUERIES["boxes_touching_patches"](spark, SF)
    planned = lambda: out._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in planned() and len(out.collect()) > 0 and "Broadcast" not in planned()


def test_assembled_samples_are_not_broadcast(spark, tmp_path, monkeypatch):
    """Samples, images, masks and boxes meet by sorted joins, however small their files are; keys are broadcast only if they were counted to be few."""
    planned = lambda df: df._jdf.queryExecution().executedPlan().toString()
    ids = spark.range(40).withColumnRenamed("id", "sample_id")
    tables = {"samples": ids.where("sample_id < 30"), "images": ids.select("sample_id", F.lit("CT").alias("modality"), F.col("sample_id").alias("data")), "masks": ids.select("sample_id", F.lit("m").alias("mask"), F.lit(1).alias("data")), "boxes": ids.select("sample_id", F.lit(0).alias("box"))}
    tables["images"] = tables["images"].union(tables["images"].where("sample_id >= 30"))  # twice, but of samples that aren't there
    for name, df in tables.items():
        samples.write(df, f"{tmp_path}/{name}")
    own = samples.SampleSet(spark, str(tmp_path))
    plan = planned(own.assembled())
    assert "Broadcast" not in plan and plan.count("Scan parquet") == 4
    want = {i: ({"CT": i}, {"m": 1}, 1) for i in range(30)}
    assert {r["sample_id"]: (r["images"], r["masks"], len(r["boxes"])) for r in own.assembled().collect()} == want
    assert {r["sample_id"]: (r["images"], r["masks"], len(r["boxes"])) for r in samples.assemble(own.samples, own.images, own.masks, own.boxes).collect()} == want
    assert planned(own.where("sample_id < 3", "images")["images"]).count("BroadcastHashJoin") == 1
    monkeypatch.setattr(samples, "FEW", 2)
    out = own.where("sample_id < 3", "images")["images"]
    assert "Broadcast" not in planned(out) and sorted(r["data"] for r in out.collect()) == [0, 1, 2]
