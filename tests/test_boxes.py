"""Many boxes against many patches of a sample, held against all pairs."""

import random

import pytest

from voxelgrove.errors import ValidationError
from voxelgrove.operators import boxes

PATCH = (8, 6, 4)
BOX, AT = "id int, s string, lo array<int>, hi array<int>, level int, `__c0` int", "s string, patch int, start array<int>, k string"


def made(seed=4, n=300):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        lo = [r.randint(-20, 90) for _ in PATCH]
        size = r.choice((0, 1, 3, 8, 30, 200))
        rows.append((i, "hot" if i % 3 else f"s{i % 5}", lo, [x + r.randint(-2, size) for x in lo], 7, i))
    rows += [(n, None, [0, 0, 0], [9, 9, 9], 1, 1), (n + 1, "hot", None, [1, 1, 1], 1, 1), (n + 2, "hot", [0, None, 0], [1, 1, 1], 1, 1), (n + 3, "hot", [0, 0, 0], None, 1, 1), rows[1]]
    at = [(s, i, [r.randint(-12, 90) for _ in PATCH], "x") for s in ("hot", "s0", "s3", "none") for i in range(40)]
    return rows, at + [(None, 1, [0, 0, 0], "x"), ("hot", 99, None, "x"), at[0]]


def pairs(rows, at):
    """Every pair by the test itself."""
    for i, s, lo, hi, *_ in rows:
        for t, k, start, _ in at:
            if s is not None and s == t and None not in (lo, hi, start) and None not in lo and all(h - x >= 0 and a - x < p for a, h, x, p in zip(lo, hi, start, PATCH)):
                yield (i, k, tuple(a - x for a, x in zip(lo, start)), tuple(h - x for h, x in zip(hi, start)))


def test_pairs_equal_brute_force(spark):
    rows, at = made()
    out = boxes.touching(spark.createDataFrame(rows, BOX), spark.createDataFrame(at, AT), PATCH, "s")
    assert out.columns == ["id", "s", "lo", "hi", "level", "__c0", "patch", "start", "k"]
    got = out.collect()
    assert sorted((r["id"], r["patch"], tuple(r["lo"]), tuple(r["hi"])) for r in got) == sorted(pairs(rows, at)) and len(got) > 300
    assert all(r["k"] == "x" and r["level"] in (1, 7) for r in got)


def test_both_ways_agree(spark):
    rows, at = made(8, 60)
    b, p = spark.createDataFrame(rows, BOX), spark.createDataFrame(at, AT)
    one = boxes.in_patches(b, p.select("s", "start"), PATCH, "s").select("id", "lo", "hi").collect()
    assert sorted(map(str, one)) == sorted(map(str, boxes.touching(b, p, PATCH, "s").select("id", "lo", "hi").collect()))


def test_large_boxes_are_in_few_cells(spark):
    b = spark.createDataFrame([(i, "a", [0, 0, 0], [10**i, 10**i, 10**i]) for i in range(9)], "id int, s string, lo array<long>, hi array<long>")
    p = spark.createDataFrame([("a", i, [i * 1000, i * 1000, i * 1000]) for i in range(50)], "s string, patch int, start array<long>")
    got = sorted((r["id"], r["patch"]) for r in boxes.touching(b, p, PATCH, "s").collect())
    assert got == sorted((i, k) for i in range(9) for k in range(50) if 10**i >= k * 1000)
    plan = boxes.touching(b, p, PATCH, "s")._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_candidates_are_few_beside_all_pairs(spark):
    """Small boxes and patches spread in one sample: what meets in a cell is at most a few times what touches."""
    r = random.Random(2)
    at = lambda: [r.randint(0, 400) for _ in PATCH]
    lows = [at() for _ in range(2000)]
    b = spark.createDataFrame([(i, "a", x, [v + r.randint(0, 3) for v in x]) for i, x in enumerate(lows)], "id int, s string, lo array<int>, hi array<int>")
    p = spark.createDataFrame([("a", i, at()) for i in range(500)], "s string, patch int, start array<int>")
    met, kept = boxes._candidates(b, p, PATCH, "s").count(), boxes.touching(b, p, PATCH, "s").count()
    assert 0 < kept <= met <= 2000 * 500 // 500 and met < 40 * kept + 200


def test_empty_tables_and_clashing_names(spark):
    rows, at = made(1, 5)
    b, p = spark.createDataFrame(rows, BOX), spark.createDataFrame(at, AT)
    assert boxes.touching(b.limit(0), p, PATCH, "s").isEmpty() and boxes.touching(b, p.limit(0), PATCH, "s").isEmpty()
    with pytest.raises(ValidationError, match="level"):
        boxes.touching(b, p.withColumnRenamed("k", "level"), PATCH, "s")
