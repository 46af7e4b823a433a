"""Exact quantiles by counting, and pools drawn with replacement."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelgrove.operators import quantiles, stats

INF = float("inf")


def groups():
    rng = random.Random(3)
    return {
        "wide": [rng.choice([-1, 1]) * 10.0 ** rng.uniform(-320, 308) for _ in range(700)], "ties": [1.0] * 500 + [2.0] * 3, "one": [5.5], "two": [-1.0, 3.0], "grid": [float(rng.randrange(50)) for _ in range(900)],
        "near": [1.0 + k * 2.0**-52 for k in range(300)], "ends": [-INF, -1.7e308, 0.0, 1.0, 1.75e308, INF] * 20, "skew": [math.exp(rng.gauss(0, 9)) for _ in range(800)], "zero": [0.0, -0.0, 5e-324, -5e-324] * 9, None: [1.0, 2.0, 4.0],
    }


def plain(values, q):
    s = sorted(values)
    p = q * (len(s) - 1)
    a, b = s[math.floor(p)], s[math.ceil(p)]
    return a if a == b else a + (b - a) * (p - math.floor(p))


@pytest.mark.parametrize("bins", [4, quantiles.BINS])
def test_quantiles_equal_sorting(spark, bins):
    data = groups()
    rows = spark.createDataFrame([(k, x) for k, v in data.items() for x in v] + [("ties", None), ("ties", float("nan")), ("lost", None)], "modality string, value double").repartition(5)
    ends = rows.where("value is not null and not isnan(value)").groupBy("modality").agg(F.count("value").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"))
    if bins == 4:  # halving takes a round for each bit, so only what few rounds settle
        keep = ["one", "two", "ties", None]
        ends, data = ends.where("modality is null or modality in ('one', 'two', 'ties')"), {k: data[k] for k in keep}
    qs = {"a": 0.01, "b": 0.5, "c": 0.99, "d": 0.0, "e": 1.0}
    got = {r["modality"]: r for r in quantiles.exact_quantiles(rows, ends, qs, ["modality"], bins=bins).collect()}
    assert set(got) == set(data)
    for k, v in data.items():
        for c, q in qs.items():
            want = plain(v, q)
            assert got[k][c] == want or math.isnan(want) and math.isnan(got[k][c]), (k, c)


def test_weights_stand_for_rows(spark):
    rows = spark.createDataFrame([("m", float(x), w) for x, w in [(1, 5), (2, 1), (7, 90), (9, 4)]], "modality string, value double, w long")
    ends = rows.groupBy("modality").agg(F.sum("w").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"))
    r = quantiles.exact_quantiles(rows, ends, {"a": 0.01, "b": 0.055, "c": 0.98}, ["modality"], weight="w").first()
    every = [1.0] * 5 + [2.0] + [7.0] * 90 + [9.0] * 4
    assert [r["a"], r["b"], r["c"]] == pytest.approx([np.percentile(every, q) for q in (1, 5.5, 98)])


def test_statistics_keep_nan_and_no_task_holds_a_group(spark):
    rows = spark.createDataFrame([("a", x) for x in (1.0, 2.0, 4.0)] + [("b", float("nan")), ("b", 1.0), ("c", None)], "modality string, value double")
    out = stats.modality_stats(rows)
    got = {r["modality"]: r for r in out.collect()}
    assert set(got) == {"a", "b"} and got["a"]["p01"] == pytest.approx(np.percentile([1, 2, 4], 1)) and got["b"]["n_voxels"] == 2
    assert all(math.isnan(got["b"][c]) for c in ("mean", "vmin", "vmax", "p01", "p99"))
    assert "percentile" not in out._jdf.queryExecution().toString().lower() and stats.modality_stats(rows.limit(0)).collect() == []


def test_a_large_sample_counts_for_no_more_than_its_cap(spark):
    """One sample of 300 voxels that are all 1e6 against five of 60 voxels: in the pool it has 100 of 400 places, not half."""
    rows = spark.range(300).select(F.lit("big").alias("sample_id"), F.lit("m").alias("modality"), F.col("id").alias("pos"), F.lit(1e6).alias("value"))
    few = spark.range(300).select(F.concat(F.lit("s"), F.floor(F.col("id") / 60).cast("string")).alias("sample_id"), F.lit("m").alias("modality"), (F.col("id") % 60).alias("pos"), (F.col("id") % 60).cast("double").alias("value"))
    pool = stats.sample_with_replacement(rows.union(few), 100)
    by = {r["sample_id"]: (r["w"], r["n"]) for r in pool.groupBy("sample_id").agg(F.sum("weight").alias("w"), F.count("*").alias("n")).collect()}
    assert by["big"][0] == 100 and by["big"][1] < 100 and all(by[f"s{i}"] == (60, 60) for i in range(5))
    samples = spark.createDataFrame([("x", [1])], "label string, shape array<int>")
    whole = stats.compute_stats(samples, rows.union(few))["modalities"].first()
    capped = stats.compute_stats(samples, rows.union(few), cap=100)["modalities"].first()
    assert whole["p01"] > capped["p01"] and whole["mean"] == capped["mean"] and capped["p99"] == 1e6
    assert pool.exceptAll(stats.sample_with_replacement(rows.union(few).repartition(7), 100)).isEmpty()


def test_statistics_inside_a_mask_by_its_voxels(spark):
    rows = spark.createDataFrame([(s, "m", p, float(10 * s + p)) for s in (1, 2, 3) for p in range(4)], "sample_id long, modality string, pos long, value double")
    inside = spark.createDataFrame([(1, "liver", 3), (2, "liver", 0), (1, "other", 0)], "sample_id long, mask string, pos long")
    shapes = spark.createDataFrame([(s, "m", None, [4]) for s in (1, 2, 3)] + [(1, None, "liver", [4]), (2, None, "liver", [5])], "sample_id long, modality string, mask string, shape array<int>")
    samples = spark.createDataFrame([("x", [4])], "label string, shape array<int>")
    r = stats.compute_stats(samples, rows, mask="liver", inside=inside, shapes=shapes)["modalities"].first()
    assert (r["n_voxels"], r["vmin"], r["vmax"]) == (9, 13.0, 33.0)  # the mask of 2 has another shape, 3 has none
