"""Ranked search against a plain scoring of every text."""

import math
import random
import re
from collections import Counter

import numpy as np
import pandas as pd
import pytest

from voxelgrove.llm import lexical
from voxelgrove.llm.common import words_of

DOCS = "doc_id long, text string, lang string, term long, n_docs long, key string"
ITEMS = "item_id long, text string, term long, q long, cell long"
TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms_of(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in TERM.findall(text or "")]


def brute(docs, items, k=10):
    rows = [(i, Counter(t)) for i, text, *_ in docs if i is not None and (t := terms_of(text))]
    n, total = len(rows), sum(c.total() for _, c in rows)
    df, out = Counter(t for _, c in rows for t in c), []
    for item, text in {(r[0], r[1]) for r in items if r[0] is not None}:
        found = []
        for i, c in rows:
            m, score = 25 + 75 * c.total() * n // total, 0
            for t in terms_of(text):
                if t in c:
                    w = math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1)))
                    score += w * (10**9 * c[t] // (1000 * c[t] + 8 * m))
            if score > 0:
                found.append((-score, i))
        out += [(item, r, i, -s) for r, (s, i) in enumerate(sorted(found)[:k], 1)]
    return sorted(out)


def corpus(seed, n=300):
    rng = random.Random(seed)
    words = ["the", "The", "of", "été", "Été", "日本", "x1", "a'b", "UP", "up", *(f"w{i}" for i in range(120))]
    weights = [200, 50, 100, *([5] * 7), *(1 + 60 // (i + 1) for i in range(120))]
    docs = [(i, " ".join(rng.choices(words, weights, k=rng.choice([1, 3, 8, 20, 60]))), "en", 1, 2, "k") for i in range(n)]
    docs += [(1000 + i, docs[i % 7][1], "en", 1, 2, "k") for i in range(40)]  # copies: ties
    docs += [docs[5], docs[5], (5, "w3 w4 the", "en", 1, 2, "k"), (2000, None, "en", 1, 2, "k"), (2001, "", "x", 1, 2, "k"), (2002, "-- !!", "x", 1, 2, "k"), (None, "w1 w2 w3", "x", 1, 2, "k")]
    docs.append((3000, "The w7. " * 90_000, "en", 1, 2, "k"))
    items = [(i, " ".join(rng.choices(words, k=rng.choice([1, 4, 12]))), 1, 2, 3) for i in range(25)]
    items += [items[3], (4, "another text w9 w9", 1, 2, 3), (30, None, 1, 2, 3), (31, "", 1, 2, 3), (32, "nowhere", 1, 2, 3), (None, "w1", 1, 2, 3), (33, "the", 1, 2, 3), (34, "w5 " * 300, 1, 2, 3)]
    return docs, items


@pytest.mark.parametrize(("seed", "segment", "cell", "block", "k"), [(1, 1 << 19, 1 << 20, 200_000, 10), (2, 150, 3000, 40, 3)])
def test_search_equals_brute_force(spark, seed, segment, cell, block, k):
    docs, items = corpus(seed)
    segments = lexical.settle(lexical.index(spark.createDataFrame(docs, DOCS), terms=segment))
    got = lexical.search(segments, spark.createDataFrame(items, ITEMS), k, cell_terms=cell, block_terms=block)
    assert sorted(tuple(r) for r in got.collect()) == brute(docs, items, k)


def test_nothing_to_search(spark):
    docs, items = corpus(3, 20)
    d, i = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)
    for a, b in ((d.limit(0), i), (d, i.limit(0)), (d.where("doc_id in (2000, 2001, 2002)"), i)):
        assert lexical.rank_documents(a, b).collect() == []


@pytest.mark.parametrize("wide", [False, True])
def test_pruning_is_safe_and_prunes(monkeypatch, wide):
    """Frequent terms of little weight are never used to find texts once the floor is over what they add."""
    monkeypatch.setattr(lexical, "STEP", 500)
    rng, n = random.Random(4), 400
    texts = [" ".join(["the"] * rng.randrange(1, 4) + (["rare"] if i % 20 == 0 else []) + rng.choices(["b", "c", "d"], k=3)) for i in range(n)]
    words = words_of([t.encode() for t in texts], lexical.TERM)
    total = sum(map(len, words))
    names = [c.split(" ")[0] for c in lexical._SEGMENT.split(", ")]
    segs = [lexical.Read(dict(zip(names, lexical.segment(list(range(a, a + 100)), words[a : a + 100]))), n, total) for a in range(0, n, 100)]
    terms = words_of([b"rare the b"], lexical.TERM)[0].view(np.int64)
    weight = np.array([3000, 10, 20], np.int64) * (10**9 if wide else 1)
    post = [np.concatenate([s.impacts(slice(s.starts[p], s.starts[p + 1])) for s in segs if (p := np.searchsorted(s.terms, t)) < len(s.terms) and s.terms[p] == t]) for t in terms]
    bound = np.array([w * p.max() for w, p in zip(weight, post)])
    floor = max(w * np.sort(p)[-10] for w, p in zip(weight, post))
    order = np.argsort(-bound)
    rest = np.cumsum(bound[order][::-1])[::-1]
    plan = pd.DataFrame({"item": 1, "key": 2, "term": terms[order], "weight": weight[order], "bound": bound[order], "rest": rest, "floor": floor})
    block = lexical.Items(plan, 10)
    assert block.wide == wide and len(block.split()[0][1]) == 1 and len(block.split()[1][1]) == 2
    for s in segs:
        block.search(s)
    score = Counter()
    for s in segs:
        for t, w in zip(terms, weight):
            p = np.searchsorted(s.terms, t)
            at = slice(s.starts[p], s.starts[p + 1])
            for d, x in zip(s.docs[at], s.impacts(at)):
                score[int(s.ids[d])] += int(w) * int(x)
    want = sorted((-v, i) for i, v in score.items())[:10]
    assert list(zip(block.found[2].tolist(), block.found[0].tolist())) == [(-v, i) for v, i in want]
    assert block.floor[0] == -want[-1][0] >= floor


def test_lengths_beyond_64_bits():
    names = [c.split(" ")[0] for c in lexical._SEGMENT.split(", ")]
    row = dict(zip(names, lexical.segment([1], [np.array([1, 2, 2], np.uint64)])))
    s = lexical.Read(row | {"lengths": np.array([10**9], np.uint32).tobytes()}, 10**12, 10**14)
    assert s.m.tolist() == [25 + 75 * 10**9 * 10**12 // 10**14]
