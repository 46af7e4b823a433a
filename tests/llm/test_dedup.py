"""Near, exact and line dedup against brute force."""

import hashlib
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from voxelgrove.llm import cuckoo, linededup, minhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rank int, bucket string"


def rows(texts, sources=None):
    sources = sources or [f"src{i % 4}" for i in range(len(texts))]
    return [(i, t, "en", s, len(t or ""), 7, "x") for i, (t, s) in enumerate(zip(texts, sources))]


def shingles(text, size):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words)} if 0 < len(words) < size else {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} if words else set()


def brute(texts, size, percent):
    sets, parent = [shingles(t, size) for t in texts], list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return [(i, len(s), find(i), find(i) == i) for i, s in enumerate(sets)]


def corpus(seed, n=60):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    texts = [None, "", "  \t\n", "One", "one", "one two", "ONE  two\n", "É é", "é É"]
    for _ in range(n):
        base = [rng.choice(words) for _ in range(rng.choice((3, 6, 12, 40, 200)))]
        for _ in range(rng.randint(1, 5)):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 12))):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(rng.choice((" ", "\n")).join(copy))
    texts.append(" ".join(rng.choice(words) for _ in range(150_000)))
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates_equal_brute_force(spark, size):
    texts = corpus(size)
    got = minhash.near_duplicates(spark.createDataFrame(rows(texts), SCHEMA), words=size).collect()
    assert sorted(map(tuple, got)) == brute(texts, size, 80)


def test_near_duplicates_of_a_hot_group_and_false_buckets(spark):
    rng = random.Random(9)
    base = [f"b{i}" for i in range(100)]
    texts = []
    for _ in range(120):  # a chain of copies, each far from some of the others
        base = list(base)
        base[rng.randrange(100)] = f"x{rng.random()}"
        texts.append(" ".join(base))
    half = [f"h{i}" for i in range(60)]
    texts += [" ".join(half + [f"t{k}_{i}" for i in range(30)]) for k in range(60)]  # many share much, none enough
    got = minhash.near_duplicates(spark.createDataFrame(rows(texts), SCHEMA), words=2).collect()
    assert sorted(map(tuple, got)) == brute(texts, 2, 80)


@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates_of_documents_equal_brute_force(spark, size):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id")
    texts = [r["text"] for r in docs.collect()]
    ids = [r["doc_id"] for r in docs.select("doc_id").collect()]
    want = [(ids[i], n, ids[c], k) for i, n, c, k in brute(texts, size, 80)]
    assert sorted(map(tuple, minhash.near_duplicates(docs, words=size).collect())) == want


def test_near_duplicates_of_rows_that_share_an_id(spark):
    """A link of one text of an id is a link of all; rows that are equal come back as often as they are there."""
    one, two = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    found = [(3, one), (7, one + " x"), (7, two), (5, two + " y"), (7, two), (9, "else"), (None, one), (9, None)]
    got = minhash.near_duplicates(spark.createDataFrame([(i, t, "en", "s", 0, 0, "") for i, t in found], SCHEMA), words=2).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in got) == [
        (3, 29, 3, True), (5, 30, 3, False), (7, 29, 3, False), (7, 29, 3, False), (7, 30, 3, False), (9, 0, 9, True), (9, 1, 9, True)
    ]


def test_near_duplicates_of_nothing(spark):
    assert minhash.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


def test_exact_duplicates(spark):
    texts = [None, "", " ", "a b", "a  b", "a\tb", "a b ", "A b", "\x0b", "é"] + ["hot\ncopy"] * 50 + ["hot copy"]
    want = {}
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for t in texts]
    got = {r["doc_id"]: r for r in cuckoo.exact_duplicates(spark.createDataFrame(rows(texts), SCHEMA)).collect()}
    for i, t in enumerate(norm):
        want.setdefault(t, []).append(i)
    for i, t in enumerate(norm):
        r = got[i]
        assert (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) == (want[t][0], len(want[t]), i == want[t][0], hashlib.sha256(t.encode()).hexdigest())


def test_exact_duplicates_with_null_ids_and_of_nothing(spark):
    got = cuckoo.exact_duplicates(spark.createDataFrame([(None, "a"), (3, "a"), (3, "a")], "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or -1, r["keep_id"] or -1, r["group_size"], r["kept"]) for r in got) == [(-1, -1, 2, False), (3, 3, 2, True), (3, 3, 2, True)]
    assert cuckoo.exact_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


def test_index_deletes_live_digests(spark):
    docs = cuckoo.digests(spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "doc_id long, text string"))
    index = cuckoo.build_index(docs)
    left = cuckoo.delete_from_index(index, docs.where("doc_id = 3").union(docs.where("doc_id = 3")))
    assert [(r["keep_id"], r["group_size"]) for r in left.collect()] == [(2, 1)]


@settings(max_examples=30, deadline=None)
@given(st.lists(st.tuples(st.booleans(), st.integers(0, 300)), max_size=900))
def test_cuckoo_filter_is_exact(steps):
    f, live = cuckoo.CuckooFilter(4), set()
    for add, n in steps:
        key = hashlib.sha256(str(n).encode()).digest()
        if add:
            assert f.insert(key) == (key not in live)
            live.add(key)
        else:
            assert f.delete(key) == (key in live)
            live.discard(key)
    assert f.size == len(live) and all(k in f for k in live)


def test_cuckoo_filter_grows_on_overflow():
    f = cuckoo.CuckooFilter(4)
    keys = [hashlib.sha256(str(i).encode()).digest() for i in range(5000)]
    assert all(f.insert(k) for k in keys) and f.resizes > 0 and all(k in f for k in keys)
    same = [b"\x01\x00" + bytes([0] * 8) + i.to_bytes(4, "little") for i in range(8)]  # one home, one print
    g = cuckoo.CuckooFilter(4)
    assert all(g.insert(k) for k in same) and all(k in g for k in same)


def test_cuckoo_filter_places_stay_and_are_used_again():
    keys = [hashlib.sha256(str(i).encode()).digest() for i in range(900)]
    f = cuckoo.CuckooFilter(4)
    for k in keys:
        f.insert(k)
    at = {k: f.find(k) for k in keys}
    assert sorted(at.values()) == list(range(900))
    assert all(f.delete(k) for k in keys[::3]) and all(f.find(k) == at[k] for k in keys if k in f)
    for k in keys[::3]:
        assert k not in f and f.insert(k)
    assert sorted(map(f.find, keys)) == list(range(900)) and f.size == 900


def test_exact_duplicates_of_long_texts_and_repeated_rows(spark):
    long = "word  " * 400_000
    found = [(4, long), (9, long.replace("  ", "\n")), (9, "a"), (9, "a"), (None, "a"), (2, long + "x")]
    got = cuckoo.exact_duplicates(spark.createDataFrame([(i, t, 1) for i, t in found], "doc_id long, text string, keep_id int")).collect()
    assert sorted((r["doc_id"] or -1, r["keep_id"] or -1, r["group_size"], r["kept"]) for r in got) == [(-1, -1, 2, False), (2, 2, 1, True), (4, 4, 2, True), (9, 4, 2, False), (9, 9, 2, True), (9, 9, 2, True)]


def test_line_dedup_tells_rows_of_one_id_apart(spark):
    """A row loses its own lines, not those of another row with its id; of equal rows each keeps the first occurrence."""
    many = "\n".join(["kept"] + [f"l{i}" for i in range(30_000)] + ["shared x"] * 30_000)
    found = [(i, f"shared x\nown {i}", f"s{i}") for i in range(1, 15)] + [(100, many, "z"), (100, "mine\nshared x", "z"), (1, "shared x\nown 1", "s1"), (None, "shared x", "q"), (7, None, "q")]
    got = linededup.remove_boilerplate(spark.createDataFrame(found, "doc_id long, text string, source string")).collect()
    texts = sorted((r["doc_id"] or -1, r["text"] or "", r["n_lines"], r["n_removed"]) for r in got)
    assert texts == sorted(
        [(1, "shared x\nown 1", 2, 0)] * 2 + [(i, f"own {i}", 2, 1) for i in range(2, 15)] + [(7, "", 0, 0), (-1, "shared x", 1, 0), (100, "mine", 2, 1)]
        + [(100, "\n".join(["kept"] + [f"l{i}" for i in range(30_000)]), 60_001, 30_000)]
    )


def line_brute(docs, sites):
    where, first = {}, {}
    key = lambda x: x.strip(" \t\r\x0b\x0c") if re.search(r"[^\W_]", x) else None
    for i, t, s in docs:
        for p, x in enumerate((t.split("\n") if t is not None else [])):
            if key(x) is not None:
                where.setdefault(key(x), set()).update([s] if s is not None else [])
                first.setdefault(key(x), (i, p))
    out = []
    for i, t, s in docs:
        lines = t.split("\n") if t is not None else []
        gone = {p for p, x in enumerate(lines) if key(x) is not None and len(where[key(x)]) >= sites and first[key(x)] != (i, p)}
        clean = "\n".join(x for p, x in enumerate(lines) if p not in gone) if t is not None else None
        out.append((i, clean, len(lines), len(gone)))
    return out


@pytest.mark.parametrize("sites", [2, 10, 40])
def test_line_dedup_equals_brute_force(spark, sites):
    rng = random.Random(sites)
    docs = []
    for i in range(300):
        lines = [f"own {i} {rng.random()}"] + [f"shared {rng.randrange(1, 60)}" for _ in range(rng.randrange(4))] + rng.choice(([], [""], ["---"], [" Footer \r"], ["Footer", "Footer"]))
        docs.append((i, "\n".join(lines), rng.choice([None] + [f"s{k}" for k in range(rng.choice((3, 60)))])))
    docs += [(300, None, "s1"), (301, "", "s1"), (302, "\n\n", "s2"), (303, "\n".join(["Footer"] * 3000), "s3")]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    got = linededup.remove_boilerplate(df, sites=sites).select("doc_id", "text", "n_lines", "n_removed").collect()
    assert sorted(map(tuple, got)) == line_brute(docs, sites)


def test_line_sketches_merge(spark):
    df = spark.createDataFrame([(i, "x\ny", f"s{i}") for i in range(30)], "doc_id long, text string, source string")
    seen = linededup.occurrences(df)
    merged = linededup.merge_sketches(linededup.line_sketches(seen.where("doc_id < 15")), linededup.line_sketches(seen.where("doc_id >= 15")))
    assert linededup.spread_lines(seen, merged, 30).count() == 2 and linededup.spread_lines(seen, merged, 31).count() == 0


def test_line_dedup_of_nothing_and_null_ids(spark):
    schema = "doc_id long, text string, source string, line string, pos int, n_lines int"
    assert linededup.remove_boilerplate(spark.createDataFrame([], schema)).collect() == []
    got = linededup.remove_boilerplate(spark.createDataFrame([(None, "a", f"s{i}", "l", 1, 2) for i in range(20)], schema), sites=2).collect()
    assert all((r["text"], r["n_lines"], r["n_removed"]) == ("a", 1, 0) for r in got)
