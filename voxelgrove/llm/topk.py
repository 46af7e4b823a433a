"""Exact top-k by inner product, with bounds from segment means and deviations, coarse to fine.

Write a vector's segment as its mean m and a rest of norm s. For two segments of n components the inner product
is at most n * m1 * m2 + s1 * s2 (Cauchy-Schwarz), which is the lower bound of their distance read the other
way. Summed over few long segments the bound is cheap; over more and shorter ones it is tighter. Pairs whose
bound is below the query's k-th best score so far are dropped; survivors get exact integer scores.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SCALE = 1024
K = 10
#: A vector's squared integer norm; by Cauchy-Schwarz all scores then fit 64 bits.
MAX_NORM = 2.0**62
#: Segments of each resolution.
LEVELS = (4, 16)
#: Rows of a block of candidates and of queries: a task holds one of each.
CANDIDATES, QUERIES = 16384, 8192


def segment_features(x: np.ndarray, parts: int) -> np.ndarray:
    """Rows whose plain inner products are upper bounds: sqrt(n) * mean and the norm of the rest, per segment."""
    cols = []
    for seg in np.array_split(np.arange(x.shape[1]), min(parts, x.shape[1])):
        s = x[:, seg].astype(np.float64)
        mean = s.mean(axis=1)
        cols += [np.sqrt(len(seg)) * mean, np.sqrt(((s - mean[:, None]) ** 2).sum(axis=1))]
    return np.stack(cols, axis=1)


def block_top_k(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int, levels: Sequence[int] = LEVELS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, candidate, score) with each query's best k of a block; ties go to the smaller candidate id.

    Candidate rows that share an id are one candidate of several vectors, whose score is its best one."""
    # Sums below 2**53 are exact in doubles; larger ones need whole numbers.
    wide = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * q.shape[1] >= 2**52
    qx, cx = (q, c) if wide else (q.astype(np.float64), c.astype(np.float64))
    feats = [(segment_features(q, p), segment_features(c, p)) for p in levels]
    out_q, out_c, out_s = [], [], []
    # k candidates are among the best k rows of each id times the most rows of an id.
    enough = k * int(np.unique(c_ids, return_counts=True)[1].max(initial=1))
    step = max(1, (1 << 22) // max(1, len(c)))
    for at in range(0, len(q), step):
        rows = slice(at, at + step)
        bound = feats[0][0][rows] @ feats[0][1].T
        slack = 1e-9 * np.abs(bound).max(initial=1) + 1e-6
        for i in range(bound.shape[0]):
            row = bound[i] + slack
            row[c_ids == q_ids[at + i]] = -np.inf
            first = np.argpartition(row, -enough)[-enough:] if len(row) > enough else np.arange(len(row))
            first = first[np.isfinite(row[first])]
            seed = cx[first] @ qx[at + i]
            seed = seed[_first_of_each(c_ids[first], np.argsort(-seed, kind="stable"))]
            floor = seed[k - 1] if len(seed) >= k else -np.inf
            left = np.flatnonzero((row >= floor) & np.isfinite(row))
            for fq, fc in feats[1:]:
                left = left[fc[left] @ fq[at + i] + slack >= floor]
            score = np.rint(cx[left] @ qx[at + i]).astype(np.int64) if not wide else cx[left] @ qx[at + i]
            best = _first_of_each(c_ids[left], np.lexsort((c_ids[left], -score)))[:k]
            out_q.append(np.full(len(best), q_ids[at + i]))
            out_c.append(c_ids[left][best])
            out_s.append(score[best])
    join = lambda parts: np.concatenate(parts).astype(np.int64) if parts else np.empty(0, np.int64)
    return join(out_q), join(out_c), join(out_s)


def _first_of_each(ids: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The places of `order` whose id comes there for the first time."""
    return order[np.sort(np.unique(ids[order], return_index=True)[1])]


def integer_vectors(v: pa.Array, scale: int, most: float) -> list[np.ndarray | None]:
    """floor(scale * x) of each vector; None for the null or empty, and for those with a null or non-finite component or a squared norm over `most`."""
    out: list[np.ndarray | None] = []
    for x in v:
        if not x.is_valid or x.values.null_count or not len(x.values):
            out.append(None)
            continue
        y = np.floor(scale * x.values.to_numpy(zero_copy_only=False).astype(np.float64))
        with np.errstate(over="ignore", invalid="ignore"):
            fits = np.isfinite(y).all() and float(y @ y) <= most
        out.append(y.astype(np.int64) if fits else None)
    return out


_PACKED = "cell long, dim int, ids binary, vectors binary"


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole vectors of one block as two byte strings, batch by batch; unfit vectors, and a batch's repeated rows, are left out."""
    for b in batches:
        ids, vectors = b.column("id").to_numpy(zero_copy_only=False), b.column("v")
        groups: dict[tuple[int, int], dict[tuple[int, bytes], None]] = {}
        for i, (cell, x) in enumerate(zip(b.column("cell").to_pylist(), integer_vectors(vectors, SCALE, MAX_NORM))):
            if x is not None:
                groups.setdefault((cell, len(x)), {})[int(ids[i]), x.tobytes()] = None
        for (cell, dim), rows in groups.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([cell], pa.int64()), pa.array([dim], pa.int32()), pa.array([np.array([i for i, _ in rows], np.int64).tobytes()]), pa.array([b"".join(v for _, v in rows)])],
                names=["cell", "dim", "ids", "vectors"],
            )


def _unpack(rows: pd.DataFrame, dim: int) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(b"".join(rows["ids"]), np.int64)
    return ids, np.frombuffer(b"".join(rows["vectors"]), np.int64).reshape(len(ids), dim)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, levels: Sequence[int] = LEVELS, id_col: str = "vec_id", vec_col: str = "embedding", candidates: int = CANDIDATES, query_rows: int = QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best other vectors by the inner product of floor(1024 * x).

    Ties go to the smaller id; fewer than k candidates give them all. Null or empty vectors, and those with null
    or non-finite components, or with a squared norm over 2**62 in integers, take no part; only vectors of one length are compared. Rows without an id are dropped.
    Rows that share one are one item of several vectors: a pair of items has one score, the best of its vectors', and an
    item is no candidate of its own; repeated rows change nothing. Vectors are dealt to blocks by id and components, and
    each pair of a candidate block and a query block is one task's work: candidates travel once per query block, queries
    once per candidate block."""
    base = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v")).where("id is not null and v is not null")
    asked = queries.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v")).where("id is not null and v is not null")
    n_c, n_q = -(-max(1, base.count()) // candidates), -(-max(1, asked.count()) // query_rows)
    at_c, at_q = F.pmod(F.xxhash64("id", "v"), F.lit(n_c)), F.pmod(F.xxhash64("id", "v", F.lit(1)), F.lit(n_q))
    base = base.select("id", "v", F.explode(F.sequence(F.lit(0), F.lit(n_q - 1))).alias("g"), at_c.alias("h")).withColumn("cell", F.col("h") * n_q + F.col("g")).select("cell", "id", "v")
    asked = asked.select("id", "v", F.explode(F.sequence(F.lit(0), F.lit(n_c - 1))).alias("h"), at_q.alias("g")).withColumn("cell", F.col("h") * n_q + F.col("g")).select("cell", "id", "v")

    def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")
        found = block_top_k(*_unpack(left, int(key[1])), *_unpack(right, int(key[1])), k, levels)
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), found)))

    packed_q, packed_c = asked.mapInArrow(_pack, _PACKED), base.mapInArrow(_pack, _PACKED)
    cells = packed_q.groupBy("cell", "dim").cogroup(packed_c.groupBy("cell", "dim"))
    found = cells.applyInPandas(run, "query_id long, vec_id long, score long")
    # Dealt by query once, which serves the window as well.
    found = found.repartition("query_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
