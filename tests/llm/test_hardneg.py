"""Hard negatives against brute force: ties, shared ids, nulls, several blocks."""

import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from voxelgrove.llm import hardneg

SCHEMA = "vec_id long, embedding array<float>, label int, cell long, dim int, key string, own int, positive_rank string"


def brute(rows, anchors, positives=5, negatives=5, low=80):
    def fit(rs):
        out = {}
        for i, v, label, *_ in rs:
            if i is None or label is None or not v or any(x is None or not math.isfinite(x) for x in v):
                continue
            w = tuple(math.floor(256 * x) for x in v)
            if sum(x * x for x in w) <= 2**55:
                out[i, label, tuple(v)] = w
        return out

    base, out = fit(rows), []
    for (i, label, v), a in fit(anchors).items():
        s = sorted(((-sum(x * y for x, y in zip(a, c)), j, k) for (j, k, _), c in base.items() if len(c) == len(a)), key=lambda t: t[:2])
        for p, (ps, pid, _) in enumerate([t for t in s if t[2] == label and t[1] != i][:positives], 1):
            hard = [t for t in s if t[2] != label and low * -ps <= 100 * -t[0] <= 100 * -ps][:negatives]
            out += [(i, pid, r, nid, -ps, -ns, p) for r, (ns, nid, _) in enumerate(hard, 1)]
    return sorted(out)


def rows_of(seed, n=260):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        v = [rng.choice([-1.5, -0.01, 0.0, 0.25, 0.5, 1.0, 0.3]) for _ in range(3 if i % 40 == 7 else 6)]
        rows.append([i // 2 if i % 9 == 0 else i, v, rng.choice([0, 0, 0, 1, 2, None]), 5, 6, "k", 7, "p"])
    rows[3][1], rows[4][1], rows[5][1], rows[6][1] = None, [], [1.0, None, 1.0, 1.0, 1.0, 1.0], [float("nan")] * 6
    rows[8][0], rows[9][1] = None, [1e30] * 6
    return [tuple(r) for r in rows] + [tuple(rows[20])] * 3


@pytest.mark.parametrize(("seed", "blocks"), [(1, (10_000, 10_000)), (2, (60, 20))])
def test_hard_negatives_equal_brute_force(spark, seed, blocks):
    rows = rows_of(seed)
    anchors = [r for r in rows if r[0] is not None and r[0] % 5 == 0]
    make = lambda rs: spark.createDataFrame(rs, SCHEMA)
    got = hardneg.hard_negatives(make(rows), make(anchors), candidate_rows=blocks[0], anchor_rows=blocks[1])
    assert sorted(tuple(r)[:7] for r in got.collect()) == brute(rows, anchors)
    few = hardneg.hard_negatives(make(rows), make(anchors), 2, 3, 50, candidate_rows=blocks[0], anchor_rows=blocks[1])
    assert sorted(tuple(r)[:7] for r in few.collect()) == brute(rows, anchors, 2, 3, 50)


def test_no_rows_no_anchors(spark):
    rows = spark.createDataFrame(rows_of(3, 30), SCHEMA)
    for r, a in ((rows.limit(0), rows), (rows, rows.limit(0)), (rows.limit(0), rows.limit(0))):
        assert hardneg.hard_negatives(r, a).collect() == []


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(-9, 9), st.integers(0, 2)), max_size=30), st.integers(-9, 9), st.integers(1, 100))
def test_limits_by_search_equal_plain_ones(entries, positive, low):
    score, labels = np.array([e[0] for e in entries], np.int64), np.array([e[1] for e in entries], np.int64)
    ids = np.arange(len(entries))[::-1].copy()
    order = hardneg.sorted_entries(ids, score)
    want = [i for i in sorted(range(len(entries)), key=lambda i: (-score[i], ids[i])) if labels[i] != 1 and low * positive <= 100 * score[i] <= 100 * positive]
    assert hardneg.negatives_of(order, score, labels, 1, positive, 4, low).tolist() == want[:4]


def test_large_scores_are_exact():
    a, c = np.array([[2**27, 1]], np.int64), np.array([[2**27, 1], [2**27, 2]], np.int64)
    assert hardneg.scores(a, c).tolist() == [[2**54 + 1, 2**54 + 2]]
