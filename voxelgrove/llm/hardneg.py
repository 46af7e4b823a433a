"""Hard negatives for contrastive training, from every anchor's fully sorted integer scores.

All rows are scored against all anchors in cells of one block each. In a cell an anchor's scores are sorted by (score
from the highest, id); its positives are the first entries of its own label, and a positive's negatives start where a
binary search puts its upper limit and go on, over entries of other labels, down to its lower limit. Each cell gives
its k best, and the k best of all cells are the answer, as a row that isn't among its own cell's k best is not among
those of all. The scores of one anchor are never together in one place but in one cell.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .topk import integer_vectors

SCALE = 256
#: Positives of an anchor, negatives of a positive, and the percentage of the positive's score that a negative has at least.
POSITIVES, NEGATIVES, LOW = 5, 5, 80
#: Rows of a block of candidates and of anchors: a task holds one of each.
CANDIDATES, ANCHORS = 16384, 4096
#: A vector's squared integer norm; by Cauchy-Schwarz all scores times 100 then fit 64 bits.
MAX_NORM = 2.0**55

_PACKED = "cell long, dim int, ids binary, keys binary, labels binary, vectors binary"


def _pack(scale: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(cell, id, key, label, v) as byte strings, one row for each cell and length of vectors of a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, keys, labels = (b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("id", "key", "label"))
            groups: dict[tuple[int, int], list[int]] = {}
            vectors = integer_vectors(b.column("v"), scale, MAX_NORM)
            for i, (cell, v) in enumerate(zip(b.column("cell").to_pylist(), vectors)):
                if v is not None:
                    groups.setdefault((cell, len(v)), []).append(i)
            for (cell, dim), at in groups.items():
                data = [x[at].tobytes() for x in (ids, keys, labels)] + [np.stack([vectors[i] for i in at]).tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([cell], pa.int64()), pa.array([dim], pa.int32()), *(pa.array([d], pa.binary()) for d in data)], names=["cell", "dim", "ids", "keys", "labels", "vectors"])

    return run


def _unpack(rows: pd.DataFrame, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """ids, keys, labels and vectors; rows that are the same in all of them (a key is a hash of the vector and label) count once."""
    ids, keys, labels, flat = (np.frombuffer(b"".join(rows[c]), np.int64) for c in ("ids", "keys", "labels", "vectors"))
    vectors = flat.reshape(len(ids), dim)
    _, first = np.unique(np.stack([ids, keys, labels]), axis=1, return_index=True)
    return (ids, keys, labels, vectors) if len(first) == len(ids) else (ids[first], keys[first], labels[first], vectors[first])


def scores(a: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Integer inner products; through doubles where they are exact in them."""
    if float(np.abs(a).max(initial=0)) * float(np.abs(c).max(initial=0)) * a.shape[1] < 2**52:
        return np.rint(a.astype(np.float64) @ c.astype(np.float64).T).astype(np.int64)
    return a @ c.T


def sorted_entries(ids: np.ndarray, score: np.ndarray) -> np.ndarray:
    """The places of all entries, highest score first, ties by the smaller id."""
    return np.lexsort((ids, -score))


def positives_of(order: np.ndarray, ids: np.ndarray, labels: np.ndarray, anchor: int, label: int, n: int) -> np.ndarray:
    """The first n places of `order` with the anchor's label and another id."""
    return order[(labels[order] == label) & (ids[order] != anchor)][:n]


def negatives_of(order: np.ndarray, score: np.ndarray, labels: np.ndarray, label: int, positive: int, n: int, low: int) -> np.ndarray:
    """The first n places of `order` with another label and low * positive <= 100 * score <= 100 * positive."""
    falling = -score[order]
    start = int(np.searchsorted(falling, -positive, "left"))
    stop = int(np.searchsorted(falling, -positive * low // 100, "right"))  # -score <= floor(-positive * low / 100)
    run = order[start:stop]
    return run[labels[run] != label][:n]


def _cells(rows: DataFrame, own: Column, others: int, at: Callable[[Column, Column], Column]) -> DataFrame:
    """Each row once for every block of the other side."""
    return rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(others - 1)))).withColumn("cell", at(F.col("own"), F.col("other"))).drop("own", "other")


def hard_negatives(
    rows: DataFrame, anchors: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, scale: int = SCALE, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", candidate_rows: int = CANDIDATES, anchor_rows: int = ANCHORS,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score, positive_rank, anchor_key).

    rows and anchors have an id, an integer label and a vector; scores are inner products of floor(scale * x). An anchor's
    positives are its `positives` best rows of the same label and another id. For each of them, the `negatives` best rows of
    another label (ids that differ from the anchor's go without saying, unless an id has rows of several labels) with
    low * positive_score <= 100 * negative_score <= 100 * positive_score. Ties go to the smaller id. Whoever has fewer has fewer.

    Rows with a null id, label or vector, with an empty vector, with a null or non-finite component, or with a squared norm over
    2**55 in integers take no part; only vectors of one length meet. Rows that are the same in id, label and vector count once;
    others that share an id are rows of their own, and anchors among them are told apart by anchor_key. Empty tables give empty
    ones, other columns are passed over. Candidates travel once for each block of anchors, in either of two passes: the
    limits of the second are the positives' scores that the first has found."""
    key = F.xxhash64(F.col(vec_col), F.col(label_col))

    def fit(df: DataFrame) -> DataFrame:
        out = df.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), key.alias("key"), F.col(vec_col).alias("v"))
        return out.where("id is not null and label is not null and v is not null")

    base, asked = fit(rows), fit(anchors)
    n_c, n_a = -(-max(1, base.count()) // candidate_rows), -(-max(1, asked.count()) // anchor_rows)
    at_c, at_a = F.pmod(F.xxhash64("id", "key"), F.lit(n_c)), F.pmod(F.xxhash64("id", "key", F.lit(1)), F.lit(n_a))
    left = _cells(asked, at_a, n_c, lambda own, other: other * n_a + own).mapInArrow(_pack(scale), _PACKED)
    right = _cells(base, at_c, n_a, lambda own, other: own * n_a + other).mapInArrow(_pack(scale), _PACKED)

    def near(group: tuple, a: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(a) and len(c):
            (a_ids, a_keys, a_labels, av), (c_ids, _, c_labels, cv) = _unpack(a, int(group[1])), _unpack(c, int(group[1]))
            for label in np.unique(a_labels):
                mine, same = np.flatnonzero(a_labels == label), np.flatnonzero(c_labels == label)
                for part in np.array_split(mine, -(-len(mine) * max(1, len(same)) // (1 << 22))):
                    for i, s in zip(part, scores(av[part], cv[same])):
                        found = positives_of(sorted_entries(c_ids[same], s), c_ids[same], c_labels[same], a_ids[i], label, positives)
                        out += [(a_ids[i], a_keys[i], c_ids[same][p], s[p]) for p in found]
        return pd.DataFrame(out, columns=["anchor_id", "anchor_key", "positive_id", "positive_score"]).astype("int64").assign(dim=group[1])

    found = left.groupBy("cell", "dim").cogroup(right.groupBy("cell", "dim")).applyInPandas(near, "anchor_id long, anchor_key long, positive_id long, positive_score long, dim int")
    best = Window.partitionBy("anchor_id", "anchor_key").orderBy(F.desc("positive_score"), "positive_id")
    found = found.withColumn("positive_rank", F.row_number().over(best)).where(F.col("positive_rank") <= positives)
    limits = F.array_sort(F.collect_list(F.struct("positive_rank", "positive_id", "positive_score")))
    limits = found.groupBy(F.col("anchor_id").alias("id"), F.col("anchor_key").alias("key"), "dim").agg(limits.alias("limits"))
    # The packed anchors again, and beside them the limits of each, which are few numbers.
    limits = _cells(limits, at_a, n_c, lambda own, other: other * n_a + own)
    limits = limits.select("cell", "dim", "id", "key", F.col("limits.positive_rank").alias("ranks"), F.col("limits.positive_id").alias("positives"), F.col("limits.positive_score").alias("scores"))
    # No null among the numbers, as pandas would make doubles of them.
    both = left.unionByName(limits, allowMissingColumns=True).fillna(0, ["id", "key"])

    def hard(group: tuple, a: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        out = []
        packed, limit = a[a["ids"].notna()], a[a["ids"].isna()]
        if len(packed) and len(limit) and len(c):
            (a_ids, a_keys, a_labels, av), (c_ids, _, c_labels, cv) = _unpack(packed, int(group[1])), _unpack(c, int(group[1]))
            wanted = {(int(i), int(k)): list(zip(*x)) for i, k, *x in zip(limit["id"], limit["key"], limit["ranks"], limit["positives"], limit["scores"])}
            for part in np.array_split(np.arange(len(a_ids)), -(-len(a_ids) * len(c_ids) // (1 << 22))):
                for i, s in zip(part, scores(av[part], cv)):
                    if pairs := wanted.get((int(a_ids[i]), int(a_keys[i]))):
                        order = sorted_entries(c_ids, s)
                        for rank, positive, score in pairs:
                            for n in negatives_of(order, s, c_labels, a_labels[i], int(score), negatives, low):
                                out.append((a_ids[i], a_keys[i], rank, positive, score, c_ids[n], s[n]))
        return pd.DataFrame(out, columns=["anchor_id", "anchor_key", "positive_rank", "positive_id", "positive_score", "negative_id", "negative_score"]).astype("int64")

    out = both.groupBy("cell", "dim").cogroup(right.groupBy("cell", "dim")).applyInPandas(hard, "anchor_id long, anchor_key long, positive_rank int, positive_id long, positive_score long, negative_id long, negative_score long")
    best = Window.partitionBy("anchor_id", "anchor_key", "positive_rank").orderBy(F.desc("negative_score"), "negative_id")
    out = out.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= negatives)
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score", "positive_rank", "anchor_key")
