"""Near-duplicate detection: one-permutation MinHash, banded buckets, star-shaped candidate edges.

1. Every text becomes its set of word shingles (64-bit hashes). Texts with equal sets are one class; the
   member with the smallest id stands for it, so copies are never paired.
2. One-permutation hashing with optimal densification gives 128 bins; 4 bins make a band, 32 bands. A pair of
   similarity 0.8 misses every band with probability (1 - 0.8**4)**32 = 4e-8.
3. A bucket links its members to its smallest member: a star. Buckets whose members still lie in different
   components after verification are dealt again. First, texts leave that can't be linked by counting: those
   with too many shingles that no other candidate has. Then those outside a bucket's largest component meet it
   whole, in blocks, and the counting is done again without it. The rest get stars around the 32 members with
   fewest such shingles, then around the next 992 and so on, until each bucket is one component or every member
   was a centre; a pair is made only in the first bucket that both are in. So no link within a bucket is lost,
   while buckets of true copies, however large, need one star.
4. Candidates pass two filters: set sizes, which is exact, and for sets of 256 shingles or more 256 sketch bits. Those
   of a pair at the threshold differ in so many that the limit is 5.5 standard deviations above the mean, if bins were
   independent: 2e-8 of such links would be lost. Then candidates are confirmed on their full sets with integer arithmetic.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, GroupedData, Window
from pyspark.sql import functions as F

from .common import mix, settle, shingle_set, text_batches, words_of
from .graph import add_links, components

BINS, ROWS = 128, 4
BANDS = BINS // ROWS
#: A bucket that one star leaves in several components gets this many centres, then so many times more.
GROWTH = 32
#: Texts outside a component of GROUP or more texts of a bucket meet it whole, in blocks of about BLOCK texts.
GROUP, BLOCK = 16, 512
_EDGES = np.arange(1, BINS, dtype=np.uint64) << np.uint64(57)


def signature(values: np.ndarray) -> np.ndarray:
    """The least hash of each bin of a sorted, non-empty set; an empty bin copies the bin that its own probe
    sequence of pairwise independent hashes meets first (optimal densification)."""
    at = np.concatenate([[0], np.searchsorted(values, _EDGES), [len(values)]])
    full = at[:-1] < at[1:]
    out = values[np.minimum(at[:-1], len(values) - 1)]
    empty = np.flatnonzero(~full)
    attempt = 0
    while len(empty):
        attempt += 1
        donor = (mix(empty.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(attempt)) >> np.uint64(57)).astype(np.int64)
        hit = full[donor]
        out[empty[hit]] = out[donor[hit]]
        empty = empty[~hit]
    return out


_SALT = mix(np.arange(1, BANDS + 1, dtype=np.uint64))


def bands(sig: np.ndarray) -> np.ndarray:
    h = _SALT.copy()
    for col in sig.reshape(BANDS, ROWS).T:
        h = mix(h ^ col)
    return h


def sketch(sig: np.ndarray) -> np.ndarray:
    """Two bits of each bin, in four longs."""
    bits = mix(sig + np.uint64(77))
    return np.packbits(np.concatenate([bits & np.uint64(1), (bits >> np.uint64(1)) & np.uint64(1)]).astype(np.uint8)).view(np.int64)


_SIGNED = "doc_id long, n_shingles long, fp binary, s0 long, s1 long, s2 long, s3 long, bands array<long>"


def _sign(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                texts = [t or b"" for t in part.column(1).cast(pa.binary()).to_pylist()]
                sets = [shingle_set(w, size) for w in words_of(texts)]
                fps, sk, bd = [], [], []
                for s in sets:
                    fps.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                    sig = signature(s) if len(s) else None
                    sk.append(sketch(sig) if sig is not None else np.zeros(4, np.int64))
                    bd.append(bands(sig).view(np.int64) if sig is not None else np.empty(0, np.int64))
                grid = np.array(sk, dtype=np.int64).reshape(-1, 4)
                offsets = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in bd])]).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(fps, pa.binary()), *(pa.array(grid[:, k].copy()) for k in range(4)), pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(bd)))],
                    names=["doc_id", "n_shingles", "fp", "s0", "s1", "s2", "s3", "bands"],
                )

    return run


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                texts = [t or b"" for t in part.column(1).cast(pa.binary()).to_pylist()]
                blobs = [shingle_set(w, size).tobytes() for w in words_of(texts)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(blobs, pa.binary())], names=["doc_id", "shingles"])

    return run


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = np.zeros(b.num_rows, dtype=bool)
            for i, (x, y) in enumerate(zip(b.column("sa"), b.column("sb"))):
                x, y = (np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in (x, y))
                if len(x) > len(y):
                    x, y = y, x
                at = np.searchsorted(y, x)
                at[at == len(y)] = 0
                both = int(np.count_nonzero(y[at] == x)) if len(y) else 0
                keep[i] = 100 * both >= percent * (len(x) + len(y) - both) and both > 0
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep)) for c in (b.column("a"), b.column("b"))], names=["a", "b"])

    return run


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of docs.

    Texts are linked when 100 * shared shingles >= percent * shingles of either; component_id is the smallest
    id reachable over links. A null or wordless text has no shingles, links with nothing and is kept; fewer
    words than a shingle make one shingle of them all. A row with a null id is dropped; an empty table gives an empty
    one. Rows that share an id are one document of several texts: each row comes back with its own n_shingles, and a
    link of one is a link of all. Other columns are ignored. A text of any length is one set."""
    text_batches(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null")
    signed = settle(texts.mapInArrow(_sign(words), _SIGNED))
    some = signed.where("fp is not null")
    groups = settle(some.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    reps = settle(some.join(groups.select(F.col("rep").alias("doc_id"), "fp"), ["doc_id", "fp"], "left_semi"))
    several = some.groupBy("doc_id").agg(F.min("fp").alias("x"), F.max("fp").alias("y")).where("x <> y").select("doc_id")
    known = some.join(several, "doc_id", "left_semi").select("doc_id", "fp").join(groups, "fp").where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    comps = link_components(texts, reps, words, percent, known).withColumnRenamed("node", "rep")
    # Written, so that the join below has an exchange on either side and a hot class of copies can be split.
    classes = settle(groups.join(comps, "rep", "left").select("fp", F.coalesce("component", "rep").alias("component")))
    out = signed.select("doc_id", "n_shingles", "fp").join(classes, "fp", "left")
    out = out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id") == F.col("component_id"))


def link_components(texts: DataFrame, reps: DataFrame, words: int, percent: int, known: DataFrame) -> DataFrame:
    """(node, component) of the representatives that have a confirmed link, or one of known (a, b)."""
    low = reps.select("doc_id", "n_shingles", "s0", "s1", "s2", "s3")
    member = reps.select(F.explode("bands").alias("bucket"), "doc_id")
    shared = member.groupBy("bucket").agg(F.min("doc_id").alias("center"), F.max("doc_id").alias("last")).where("center <> last")
    member = settle(member.join(shared.select("bucket", "center"), "bucket"))
    inside = member.select("doc_id").distinct()
    sets = settle(texts.join(inside, "doc_id", "left_semi").mapInArrow(_sets(words), "doc_id long, shingles binary"))
    stars = member.where("doc_id <> center").select(F.col("center").alias("a"), F.col("doc_id").alias("b")).distinct()
    comps = components(_verify(stars, low, sets, percent).union(known))
    todo = _unresolved(member.select("bucket", "doc_id"), comps)
    todo = _linkable(todo, low, sets, percent)
    new, todo = _against_groups(todo, sets, percent)
    if not new.isEmpty():
        comps = add_links(comps, new)
    todo = _linkable(_unresolved(todo, comps).select("bucket", "doc_id", "component"), low, sets, percent)
    todo = settle(todo.join(todo.groupBy("doc_id").agg(F.array_sort(F.collect_set("bucket")).alias("buckets")), "doc_id"))
    first, done = 0, GROWTH
    while True:
        todo = _unresolved(todo, comps)
        last = todo.agg(F.max("rank")).first()[0]
        if last is None:
            return comps
        side = {x: todo.select("bucket", *(F.col(c).alias(c + x) for c in todo.columns if c != "bucket")) for x in "ab"}
        centers = side["a"].where((F.col("ranka") > first) & (F.col("ranka") <= done))
        ordered = (F.col("rankb") > F.col("ranka")) & (F.col("componenta") != F.col("componentb"))
        both = F.least(F.col("n_shinglesa") - F.col("uniquea"), F.col("n_shinglesb") - F.col("uniqueb"))
        could = 100 * both >= percent * (F.col("n_shinglesa") + F.col("n_shinglesb") - both)
        once = F.array_min(F.array_intersect("bucketsa", "bucketsb")) == F.col("bucket")
        pairs = side["b"].join(centers, "bucket").where(ordered & could & _alike(percent) & once)
        pairs = settle(pairs.select(F.col("doc_ida").alias("a"), F.col("doc_idb").alias("b")))
        new = settle(_confirmed(pairs, sets, percent))
        if not new.isEmpty():
            comps = add_links(comps, new)
        if last <= done:
            return comps
        first, done = done, GROWTH * done


def _unresolved(todo: DataFrame, comps: DataFrame) -> DataFrame:
    """The rows of buckets that still hold different components."""
    rows = todo.drop("component").join(comps.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    rows = rows.withColumn("component", F.coalesce("component", "doc_id"))
    split = rows.groupBy("bucket").agg(F.min("component").alias("c0"), F.max("component").alias("c1")).where("c0 <> c1")
    return settle(rows.join(split.select("bucket"), "bucket", "left_semi"))


def _linkable(todo: DataFrame, low: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """todo with sizes and sketches, unique (the shingles that no other text of todo has) and rank in the bucket.

    Shared shingles aren't unique ones, so a text can't be linked if too many of its own are unique: it leaves.
    The rest are ranked with the fewest unique first, as those are the likeliest centres."""
    ids = todo.select("doc_id").distinct()

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for doc, blob in zip(b.column(0).to_pylist(), b.column(1)):
                x = np.frombuffer(blob.as_buffer(), dtype=np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(np.full(len(x), doc, np.int64))], names=["shingle", "doc_id"])

    each = sets.join(ids, "doc_id", "left_semi").select("doc_id", "shingles").mapInArrow(explode, "shingle long, doc_id long")
    lone = each.groupBy("shingle").agg(F.min("doc_id").alias("doc_id"), F.max("doc_id").alias("other")).where("doc_id = other")
    lone = lone.groupBy("doc_id").agg(F.count("*").alias("unique"))
    facts = low.join(ids, "doc_id", "left_semi").join(lone, "doc_id", "left").fillna(0, ["unique"])
    facts = facts.where(100 * (F.col("n_shingles") - F.col("unique")) >= percent * F.col("n_shingles"))
    order = Window.partitionBy("bucket").orderBy(F.col("unique") / F.col("n_shingles"), "doc_id")
    return settle(todo.join(facts, "doc_id").withColumn("rank", F.row_number().over(order)))


def _against_groups(todo: DataFrame, sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Links between a bucket's largest component, if it has GROUP texts or more, and the texts outside it; and
    todo without those components' rows, as all their pairs are done.

    The texts outside meet the whole component in blocks, each a task's work: pairs exist only within numpy."""
    inside = todo.groupBy("bucket", "component").agg(F.count("*").alias("k")).where(F.col("k") >= GROUP)
    base = settle(inside.groupBy("bucket").agg(F.max_by("component", F.struct("k", "component")).alias("base")))
    rows = todo.join(base, "bucket")
    probes = settle(rows.where("component <> base").select("base", "doc_id").distinct())
    members = todo.select(F.col("component").alias("base"), "doc_id").distinct().join(probes.select("base").distinct(), "base", "left_semi")
    sizes = [x.groupBy("base").agg((F.floor(F.count("*") / BLOCK) + 1).alias(n)) for x, n in ((probes, "ni"), (members, "nj"))]
    sizes = settle(sizes[0].join(sizes[1], "base"))

    def cells(x: DataFrame, mine: str, its: str, n_mine: str, n_its: str) -> GroupedData:
        x = x.join(sizes, "base").withColumn(mine, F.pmod(F.xxhash64("doc_id"), F.col(n_mine)))
        x = x.join(sets, "doc_id").withColumn(its, F.explode(F.sequence(F.lit(0).cast("long"), F.col(n_its) - 1)))
        return x.select(*(F.col(c).alias(c) for c in ("base", "i", "j", "doc_id", "shingles"))).groupBy("base", "i", "j")

    def meet(x: pa.Table, y: pa.Table) -> pa.Table:
        out = []
        if x.num_rows and y.num_rows:
            other, ids = [np.frombuffer(v.as_buffer(), np.uint64) for v in y.column("shingles")], y.column("doc_id").to_numpy()
            size = np.array([len(v) for v in other])
            flat, at = np.concatenate(other), np.concatenate([[0], np.cumsum(size)[:-1]])
            for doc, blob in zip(x.column("doc_id").to_pylist(), x.column("shingles")):
                mine = np.frombuffer(blob.as_buffer(), np.uint64)
                hit = mine[np.minimum(np.searchsorted(mine, flat), len(mine) - 1)] == flat
                both = np.add.reduceat(hit.astype(np.int64), at)
                out += [(doc, k) for k in ids[100 * both >= percent * (size + len(mine) - both)].tolist() if k != doc]
        return pa.table({"a": pa.array([min(p) for p in out], pa.int64()), "b": pa.array([max(p) for p in out], pa.int64())})

    met = cells(probes, "i", "j", "ni", "nj").cogroup(cells(members, "j", "i", "nj", "ni")).applyInArrow(meet, "a long, b long")
    rest = todo.join(base, "bucket", "left").where("base is null or component <> base").drop("base")
    return settle(met), settle(rest)


def _alike(percent: int) -> Column:
    """Whether sizes and sketches of texts a and b let them be a link."""
    far = 1 - percent / 100
    most = 128 * far + 5.5 * (128 * (1.5 * far - far * far)) ** 0.5
    bits = sum(F.bit_count(F.col(f"s{k}a").bitwiseXOR(F.col(f"s{k}b"))) for k in range(4))
    small, large = F.least("n_shinglesa", "n_shinglesb"), F.greatest("n_shinglesa", "n_shinglesb")
    return (100 * small >= percent * large) & ((large < 256) | (bits <= F.lit(most)))


def _verify(pairs: DataFrame, low: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that are links: size and sketch filters, then the full sets."""
    for side in "ab":
        pairs = pairs.join(low.select(*(F.col(c).alias(c + side) for c in low.columns)).withColumnRenamed("doc_id" + side, side), side)
    return _confirmed(settle(pairs.where(_alike(percent)).select("a", "b")), sets, percent)


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    pairs = pairs.join(sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb")), "b")
    pairs = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa")), "a")
    return pairs.select("a", "b", "sa", "sb").mapInArrow(_confirm(percent), "a long, b long")
