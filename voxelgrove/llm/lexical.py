"""Ranked lexical search by a join that starts from stored impacts.

Texts become segments, each a small inverted index of its own. For each term the search takes from them the number of texts
that hold it, its highest impact and its k-th highest. The k texts of a term's k highest impacts score that much at
least for any item that holds the term, so the largest such k-th impact is a floor of the item's k-th score. With an
item's terms from the highest impact down, the sums of impacts from each term to the end bound what a text can score
that holds none before it: the terms from where that sum is below the floor on are pruned. Texts that hold one of
the others and whose bound reaches the floor are candidates, and are scored in full; scores that are found raise the floor.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, settle, text_batches, words_of

K = 10
#: Terms (with repeats) of a segment's texts; a longer text is a segment of its own. A row then is under half a megabyte, which the JVM moves
#: without allocations of unusual size. Item terms of a block. Pairs of a text and an item term at a time.
SEGMENT, BLOCK, STEP = 1 << 15, 200_000, 1 << 19
#: Segments' worth of texts that meet a block of items in one task.
PER_CELL = 32
#: A text's length counts for PERCENT of a hundred; impacts are in millionths.
PERCENT, ONE = 75, 1_000_000_000

#: Bytes of terms, A-Z lower-cased; all others are white. Terms are ASCII letters, digits and everything beyond ASCII.
TERM = LOWER.copy()
TERM[[*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = 0x20

_SEGMENT = "n_docs long, n_terms long, ids binary, lengths binary, terms binary, starts binary, docs binary, tfs binary"


def _starts(counts: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers of several ranges, one after the other."""
    return np.repeat(starts - _starts(counts)[:-1], counts) + np.arange(int(counts.sum()))


def _narrow(x: np.ndarray) -> np.ndarray:
    """In two bytes each where they fit."""
    return x.astype(np.uint16 if x.max(initial=0) < 1 << 16 else np.uint32)


def segment(ids: list[int], words: list[np.ndarray]) -> tuple:
    """A row of _SEGMENT for texts that each have a term: the sorted distinct terms, and for each its texts and how often it is there."""
    lengths = np.array([len(w) for w in words], np.int64)
    terms, at = np.unique(np.concatenate(words).view(np.int64), return_inverse=True)
    pairs, tfs = np.unique(at.astype(np.int64) * len(ids) + np.repeat(np.arange(len(ids)), lengths), return_counts=True)
    starts = np.searchsorted(pairs, np.arange(len(terms) + 1) * len(ids))
    parts = (np.array(ids, np.int64), lengths.astype(np.uint32), terms, starts.astype(np.uint32), _narrow(pairs % len(ids)), _narrow(tfs))
    return len(ids), int(lengths.sum()), *(p.tobytes() for p in parts)


def _segments(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int] = []
        words: list[np.ndarray] = []
        names = [c.split(" ")[0] for c in _SEGMENT.split(", ")]

        def flush() -> pa.RecordBatch:
            row = segment(ids, words)
            ids.clear()
            words.clear()
            return pa.RecordBatch.from_pylist([dict(zip(names, row))])

        held = 0
        for b in batches:
            texts = b.column("text").cast(pa.binary())
            for at in range(0, b.num_rows, 256):
                part = [t.as_py() or b"" for t in texts[at : at + 256]]
                for i, w in zip(b.column("id")[at : at + 256].to_pylist(), words_of(part, TERM)):
                    if held and held + len(w) > most:
                        yield flush()
                        held = 0
                    if len(w):
                        ids.append(i)
                        words.append(w)
                        held += len(w)
        if held:
            yield flush()

    return run


def index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", terms: int = SEGMENT) -> DataFrame:
    """The segments of a table of texts. Rows without an id are left out; texts without a term are in none. No shuffle."""
    text_batches(docs.sparkSession)
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_segments(terms), _SEGMENT)


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for item, key, text in zip(b.column("item").to_pylist(), b.column("key").to_pylist(), b.column("text")):
            terms, n = np.unique(words_of([(text.as_py() or "").encode()], TERM)[0].view(np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(terms), item)), pa.array(np.full(len(terms), key)), pa.array(terms), pa.array(n.astype(np.int64))], names=["item", "key", "term", "q"])


class Read:
    """A segment's arrays, and the saturated frequency of each posting: ONE * tf div (1000 * tf + 8 * m)."""

    def __init__(self, row: dict, n: int, total: int) -> None:
        get = lambda c, t: np.frombuffer(row[c], t)
        self.ids, self.terms = get("ids", np.int64), get("terms", np.int64)
        self.lengths, self.starts = get("lengths", np.uint32).astype(np.int64), get("starts", np.uint32).astype(np.int64)
        wide = [np.uint16 if len(row[c]) == 2 * self.starts[-1] else np.uint32 for c in ("docs", "tfs")]
        self.docs, self.tfs = get("docs", wide[0]).astype(np.int32), get("tfs", wide[1])
        # Whole numbers of any size where 64 bits don't hold the product.
        long = self.lengths if PERCENT * n * int(self.lengths.max()) < 2**63 else self.lengths.astype(object)
        self.m = (100 - PERCENT + (PERCENT * n * long) // total).astype(np.int64)

    def impacts(self, at: np.ndarray | slice) -> np.ndarray:
        tf = self.tfs[at].astype(np.int64)
        return ONE * tf // (1000 * tf + 8 * self.m[self.docs[at]])


def best_of_each(group: np.ndarray, value: np.ndarray, k: int, tie: np.ndarray | None = None) -> np.ndarray:
    """The places of each group's k highest values, in order; ties by the smaller `tie`."""
    order = np.lexsort((*(() if tie is None else (tie,)), -value, group))
    g = group[order]
    first = np.flatnonzero(np.diff(g, prepend=g[:1] - 1 if len(g) else g))
    return order[np.arange(len(g)) - np.repeat(first, np.diff(np.append(first, len(g)))) < k]


def _term_rows(n: int, total: int, k: int, most: int = 1 << 18):
    """Segments to (term, df, impacts): how many texts hold a term, and its k highest saturated frequencies, summed up in the task up to `most` numbers."""

    def rows(terms: np.ndarray, df: np.ndarray, owner: np.ndarray, top: np.ndarray) -> pa.RecordBatch:
        counts = np.bincount(owner, minlength=len(terms))
        lists = pa.ListArray.from_arrays(pa.array(_starts(counts).astype(np.int32)), pa.array(top))
        return pa.RecordBatch.from_arrays([pa.array(terms), pa.array(df), lists], names=["term", "df", "impacts"])

    def merged(parts: list[tuple]) -> tuple:
        terms, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        df = np.bincount(at, np.concatenate([p[1] for p in parts]), len(terms)).astype(np.int64)
        base = _starts([len(p[0]) for p in parts])
        owner, top = at[np.concatenate([p[2] + o for p, o in zip(parts, base)])], np.concatenate([p[3] for p in parts])
        keep = best_of_each(owner, top, k)
        return terms, df, owner[keep], top[keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple] = []
        held = 0
        for b in batches:
            for i in range(b.num_rows):
                s = Read(b.slice(i, 1).to_pylist()[0], n, total)
                df = np.diff(s.starts)
                owner, top = np.repeat(np.arange(len(df)), df), s.impacts(slice(None))
                keep = best_of_each(owner, top, k)
                parts.append((s.terms, df, owner[keep], top[keep]))
                held += len(keep)
                if held > most:
                    parts = [merged(parts)]
                    if len(parts[0][3]) > most // 2:
                        yield rows(*parts.pop())
                    held = sum(len(p[3]) for p in parts)
        if parts:
            yield rows(*merged(parts))

    return run


class Items:
    """A block of items: their terms from the highest impact down, weights, bounds and floors."""

    def __init__(self, rows: pd.DataFrame, k: int) -> None:
        rows = rows.sort_values(["item", "key", "bound", "term"], ascending=[True, True, False, True])
        names, self.of = np.unique(rows[["item", "key"]].to_numpy(np.int64), axis=0, return_inverse=True)
        self.names, self.of, self.k = names, self.of.ravel(), k
        self.weight, self.rest = rows["weight"].to_numpy(np.int64), rows["rest"].to_numpy(np.int64)
        self.terms, self.at = np.unique(rows["term"].to_numpy(np.int64), return_inverse=True)
        self.floor = np.ones(len(names), np.int64)
        np.maximum.at(self.floor, self.of, rows["floor"].to_numpy(np.int64))
        self.wide = int(self.rest.max()) >= 2**53
        self.found = [np.empty(0, np.int64)] * 3

    def split(self) -> tuple[tuple, tuple, np.ndarray]:
        """Which item terms are kept and which are pruned, by term, as (starts, items, weights); and what the pruned ones of an item can add."""
        kept = self.rest >= self.floor[self.of]
        left = np.zeros(len(self.names), np.int64)
        np.maximum.at(left, self.of[~kept], self.rest[~kept])
        return self._by_term(kept), self._by_term(~kept), left

    def _by_term(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.flatnonzero(which)
        at = at[np.argsort(self.at[at], kind="stable")]
        return _starts(np.bincount(self.at[at], minlength=len(self.terms))), self.of[at], self.weight[at]

    def tally(self, lists: tuple, term: np.ndarray, doc: np.ndarray, impact: np.ndarray, n_docs: int) -> np.ndarray:
        """The sums of weight * impact by (text, item), for the item terms of `lists`."""
        starts, items, weights = lists
        counts = starts[term + 1] - starts[term]
        at, p = _ranges(starts[term], counts), np.repeat(np.arange(len(term)), counts)
        cell, part, size = doc[p] * len(self.names) + items[at], weights[at] * impact[p], n_docs * len(self.names)
        if not self.wide:
            return np.bincount(cell, part.astype(np.float64), size).astype(np.int64)  # whole numbers below 2**53: exact
        out = np.zeros(size, np.int64)
        np.add.at(out, cell, part)
        return out

    def search(self, s: Read) -> None:
        """Meets a segment: candidates, full scores, and the k best of each item so far."""
        place = np.searchsorted(s.terms, self.terms)
        here = np.flatnonzero(s.terms[np.minimum(place, len(s.terms) - 1)] == self.terms)
        first, counts = s.starts[place[here]], s.starts[place[here] + 1] - s.starts[place[here]]
        post, term = _ranges(first, counts), np.repeat(here, counts)
        order = np.argsort(s.docs[post], kind="stable")
        post, term = post[order], term[order]
        # Texts in runs whose pairs with item terms, and with items, are STEP at most.
        pairs = np.bincount(s.docs[post], np.bincount(self.at, minlength=len(self.terms))[term], len(s.ids)) + len(self.names)
        run = (np.cumsum(pairs) // STEP).astype(np.int64)
        edges = np.append(np.unique(run, return_index=True)[1], len(s.ids))
        for lo, hi in zip(edges, edges[1:]):
            a, b = np.searchsorted(s.docs[post], [lo, hi])
            self._score(s, post[a:b], term[a:b], int(lo), int(hi))

    def _score(self, s: Read, post: np.ndarray, term: np.ndarray, lo: int, hi: int) -> None:
        kept, pruned, left = self.split()
        doc, impact = s.docs[post].astype(np.int64) - lo, s.impacts(post)
        part = self.tally(kept, term, doc, impact, hi - lo).reshape(hi - lo, len(self.names))
        d, i = np.nonzero((part > 0) & (part + left >= self.floor))
        if not len(d):
            return
        near = np.zeros(hi - lo, bool)
        near[d] = True
        rest = near[doc]
        score = part[d, i] + self.tally(pruned, term[rest], doc[rest], impact[rest], hi - lo).reshape(part.shape)[d, i]
        good = score >= self.floor[i]
        ids, items, scores = (np.concatenate([x, y]) for x, y in zip(self.found, (s.ids[lo + d[good]], i[good], score[good])))
        best = best_of_each(items, scores, self.k, ids)
        self.found = [ids[best], items[best], scores[best]]
        n = np.bincount(items[best], minlength=len(self.names))
        last = _starts(n)[1:] - 1
        full = n == self.k
        self.floor[full] = np.maximum(self.floor[full], scores[best][last[full]])


def search(segments: DataFrame, items: DataFrame, k: int = K, item_id: str = "item_id", item_text: str = "text", cell_terms: int = PER_CELL * SEGMENT, block_terms: int = BLOCK) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's k best texts of an index, score above 0, ties to the smaller id.

    Terms are runs of ASCII letters, digits and characters beyond ASCII, only A-Z lower-cased, and are told apart by 64-bit
    hashes. With N texts that hold a term, L their terms, n a text's, df the texts that hold a term and tf its number in one: a
    term weighs w = floor(1000 * ln((2 N + 2) / (2 df + 1))), m = 25 + 75 n N div L, and a text scores the sum of
    w * (10**9 tf div (1000 tf + 8 m)) over the item's terms, repeats included.

    segments: a written index(). Rows without an item id are left out, null and empty items find nothing; rows that share an item
    id and differ are items of their own, ranked each, and repeated rows count once. Rows of texts that share an id are texts of
    their own. Items meet the segments in blocks: a task holds the segments of about cell_terms terms and one block, segments
    travel once for each block of items, and each task gives back k rows an item at most."""
    spark = segments.sparkSession
    n, total, cells = segments.agg(F.sum("n_docs"), F.sum("n_terms"), F.ceil(F.sum("n_terms") / cell_terms)).first()
    n, total, cells = n or 0, total or 1, int(cells or 1)
    asked = items.where(F.col(item_id).isNotNull()).select(F.col(item_id).cast("long").alias("item"), F.xxhash64(item_text).alias("key"), F.col(item_text).cast("string").alias("text"))
    asked = settle(asked.mapInArrow(_item_terms, "item long, key long, term long, q long").distinct())
    terms = asked.select("term").distinct()
    held = settle(segments.mapInArrow(_term_rows(n, total, k), "term long, df long, impacts array<long>").join(terms, "term"))
    df = held.groupBy("term").agg(F.sum("df").alias("df"))
    top = held.select("term", F.explode("impacts").alias("impact"))
    top = top.withColumn("place", F.row_number().over(Window.partitionBy("term").orderBy(F.desc("impact")))).where(F.col("place") <= k)
    top = top.groupBy("term").agg(F.max("impact").alias("most"), F.coalesce(F.max(F.when(F.col("place") == k, F.col("impact"))), F.lit(0)).alias("kth"))
    w = F.floor(1000 * F.log((2 * F.lit(n).cast("double") + 2) / (2 * F.col("df").cast("double") + 1))).cast("long")
    plan = asked.join(df.join(top, "term").withColumn("w", w), "term").withColumn("weight", F.col("q") * F.col("w"))
    plan = plan.withColumns({"bound": F.col("weight") * F.col("most"), "seed": F.col("weight") * F.col("kth")})
    own = Window.partitionBy("item", "key")
    on = own.orderBy(F.desc("bound"), "term").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    plan = plan.withColumns({"floor": F.max("seed").over(own), "rest": F.sum("bound").over(on)}).where("weight > 0")
    plan = settle(plan.select("item", "key", "term", "weight", "bound", "rest", "floor"))
    blocks = -(-max(1, plan.count()) // block_terms)
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    left = plan.withColumns({"block": F.pmod(F.xxhash64("item", "key"), F.lit(blocks).cast("long")), "cell": each(cells)})
    right = segments.select(F.pmod(F.xxhash64("ids", "terms"), F.lit(cells).cast("long")).alias("cell"), each(blocks).alias("block"), *segments.columns)

    def meet(asked: pd.DataFrame, segs: pd.DataFrame) -> pd.DataFrame:
        if not len(asked) or not len(segs):
            return pd.DataFrame(columns=["item", "key", "doc_id", "score"], dtype="int64")
        block = Items(asked, k)
        for row in segs.to_dict("records"):
            block.search(Read(row, n, total))
        ids, at, score = block.found
        return pd.DataFrame({"item": block.names[at, 0], "key": block.names[at, 1], "doc_id": ids, "score": score})

    found = left.groupBy("cell", "block").cogroup(right.groupBy("cell", "block")).applyInPandas(meet, "item long, key long, doc_id long, score long")
    best = Window.partitionBy("item", "key").orderBy(F.desc("score"), "doc_id")
    found = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return found.select(F.col("item").alias("item_id"), "rank", "doc_id", "score")


def rank_documents(docs: DataFrame, items: DataFrame, k: int = K) -> DataFrame:
    """search() of items (item_id, text) in the written index of docs (doc_id, text)."""
    return search(settle(index(docs)), items, k)
