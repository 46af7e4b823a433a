"""Language-model scoring by context-tree weighting over bytes.

A byte is eight binary choices; each choice has its own context tree over the DEPTH bytes before it. A node
estimates its bit by Krichevsky-Trofimov counts, and its weight against its children is the posterior that
context-tree weighting gives it. A prediction mixes the estimates of all depths along the path; a context
that was never seen adds nothing to the mix below it, so every bit's two probabilities sum to one.

All counts are exact and cover all training rows. Texts are dealt to blocks. A block's first pass gives its distinct
words and grams with their training counts (0 for those of held-out texts); their sums and predictions come back to
the block by equi-joins. So no model is broadcast or held whole: what a task holds is one block of texts and its
dictionary, or a slice of sorted grams that it streams over, at any size of the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, part_of, settle, text_batches, words_of

DEPTH = 5
#: Bytes of text to a block, about; a longer text is a block's share all the same.
BLOCK_BYTES = 32 << 20
END = 10
#: The end of a text, counted as a token.
END_TOKEN = np.uint64(0x0E0D0F7E8D)
WORD, GRAM = 0, 1
_HASH = np.uint64(0x9E3779B97F4A7C15)
_CHUNK = 1 << 18
#: Subtrees hang below contexts of so many bytes; a task streams over sorted grams, about SLICE at once, whole subtrees of them.
TOP, SLICE = 3, 1 << 16
#: Shares into which the grams of a two-byte context are dealt.
SHARES = 16


class Tally:
    """Distinct uint64 keys and their sums, gathered as sorted runs that are merged when they have doubled."""

    def __init__(self) -> None:
        self.runs: list[tuple[np.ndarray, np.ndarray]] = []
        self.held, self.merged = 0, 1 << 20

    def add(self, keys: np.ndarray, counted: bool) -> None:
        if not len(keys):
            return
        keys = np.sort(keys)
        start = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        n = np.diff(start, append=len(keys)) if counted else np.zeros(len(start), np.int64)
        self.runs.append((keys[start], n))
        self.held += len(start)
        if self.held > 2 * self.merged:
            self.merged = max(1 << 20, len(self.items()[0]))

    def items(self) -> tuple[np.ndarray, np.ndarray]:
        """(sorted keys, sums)."""
        if len(self.runs) != 1:
            keys, n = (np.concatenate([r[k] for r in self.runs] or [np.empty(0, t)]) for k, t in ((0, np.uint64), (1, np.int64)))
            order = np.argsort(keys, kind="stable")
            keys, n = keys[order], n[order]
            start = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
            self.runs = [(keys[start], np.add.reduceat(n, start) if len(start) else n)]
            self.held = len(start)
        return self.runs[0]


class Lookup:
    """Values of distinct uint64 keys (not 0), in an open-addressing table that numpy probes array-wise."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(10, int(len(keys)).bit_length() + 1)
        self.keys, self.values = np.zeros(1 << self.bits, dtype=np.uint64), np.zeros(1 << self.bits)
        at = self._home(keys)
        rest = np.arange(len(keys))
        while len(rest):
            free = self.keys[at] == 0
            self.keys[at[free]] = keys[rest[free]]
            won = self.keys[at] == keys[rest]
            self.values[at[won]] = values[rest[won]]
            rest, at = rest[~won], (at[~won] + 1) & ((1 << self.bits) - 1)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _HASH) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The value of each key; 0 for those that aren't held."""
        at = self._home(keys)
        here = self.keys[at]
        out = self.values[at]
        rest = np.flatnonzero((here != keys) & (here != 0))
        out[here == 0] = 0
        while len(rest):
            at_rest = at[rest] = (at[rest] + 1) & ((1 << self.bits) - 1)
            here = self.keys[at_rest]
            out[rest] = np.where(here == 0, 0, self.values[at_rest])
            rest = rest[(here != keys[rest]) & (here != 0)]
        return out


def streams(texts: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, marks): the texts lower-cased, with single spaces and one end byte (marked 2), each behind `depth` end bytes (marked 1)."""
    pad = bytes([0] * depth)
    raw = np.frombuffer(b"".join(x for t in texts for x in (pad, t, b"\0")), dtype=np.uint8)
    size = np.array([len(t) for t in texts], dtype=np.int64) + depth + 1
    stop = np.cumsum(size)
    low = LOWER[raw]
    mark = np.zeros(len(raw), dtype=np.int8)
    for k in range(depth):
        mark[stop - size + k] = 1
    mark[stop - 1] = 2
    low[mark > 0] = END
    white = low == 0x20
    before = np.concatenate([[True], (white | (mark > 0))[:-1]])
    keep = ~(white & before)
    low, mark = low[keep], mark[keep]
    after = np.concatenate([mark[1:] == 2, [False]])
    keep = ~((low == 0x20) & after)
    return low[keep], mark[keep]


def grams(low: np.ndarray, depth: int) -> np.ndarray:
    """For each byte from position `depth` on: its context, nearest byte first, then itself; never 0."""
    n = len(low) - depth
    if n <= 0:
        return np.empty(0, np.uint64)
    wide = np.concatenate([np.zeros(8 - depth, np.uint8), low])
    # Eight bytes up to the one before each symbol, read as a little-endian number: the nearest byte is its highest.
    key = np.array(np.ndarray(n, "<u8", wide, 0, (1,)), dtype=np.uint64)
    key >>= np.uint64(8 * (8 - depth))
    key <<= np.uint64(8)
    key |= low[depth:]
    key |= np.uint64(1) << np.uint64(8 * depth + 8)
    return key


def _packs(texts: list[bytes | None], limit: int = 1 << 19) -> Iterator[list[int]]:
    pack, held = [], 0
    for i, t in enumerate(texts):
        pack.append(i)
        held += len(t or b"") + 8
        if held > limit:
            yield pack
            pack, held = [], 0
    if pack:
        yield pack


def _gram_slices(low: np.ndarray, mark: np.ndarray, depth: int) -> Iterator[tuple[slice, np.ndarray]]:
    """(positions, grams) over a pack's stream, a slice at a time; what stands before a text is no symbol and has gram 0."""
    for s in range(depth, len(low), _CHUNK):
        e = min(len(low), s + _CHUNK)
        keys = grams(low[s - depth : e], depth)
        keys[mark[s:e] == 1] = 0
        yield slice(s, e), keys


def _tally(texts: list[bytes], words: Tally, tree: Tally, depth: int, counted: bool) -> None:
    for pack in _packs(texts):
        some = [texts[i] for i in pack]
        words.add(np.concatenate([*words_of(some), np.full(len(some), END_TOKEN)]), counted)
        for _, keys in _gram_slices(*streams(some, depth), depth):
            tree.add(keys[keys != 0], counted)


def block_keys(dealt: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(block, kind, key, n): the distinct words (with the end of each text) and grams of each block's texts, and how often
    its training texts have them. dealt: (block, held_out, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, tree, block = Tally(), Tally(), 0
        for b in batches:
            texts, held = b.column("text").cast(pa.binary()).to_pylist(), b.column("held_out").to_pylist()
            for side in (False, True):
                _tally([t for t, h in zip(texts, held) if h is side], words, tree, depth, not side)
            block = b.column("block")[0].as_py() if b.num_rows else block
        for kind, x in ((WORD, words), (GRAM, tree)):
            keys, n = x.items()
            for s in range(0, len(keys), 1 << 16):
                part = slice(s, s + (1 << 16))
                size = len(keys[part])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(size, block, np.int32)), pa.array(np.full(size, kind, np.int32)), pa.array(keys[part].view(np.int64)), pa.array(n[part])], names=["block", "kind", "key", "n"]
                )

    return dealt.select("block", "held_out", "text").groupBy("block").applyInArrow(run, "block int, kind int, key long, n long")


def lgamma(x: np.ndarray) -> np.ndarray:
    y = x + 8
    series = (y - 0.5) * np.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5)
    rising = x
    for k in range(1, 8):
        rising = rising * (x + k)
    return series - np.log(rising)


def kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """The natural log of the Krichevsky-Trofimov probability of n0 zeros and n1 ones."""
    return lgamma(n0 + 0.5) + lgamma(n1 + 0.5) - lgamma(n0 + n1 + 1.0) - np.log(np.pi)


def _weigh(pe: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(log of the weighted probability, weight of the node's own estimate)."""
    pw = np.log(0.5) + np.logaddexp(pe, below)
    return pw, np.exp(np.log(0.5) + pe - pw)


class Level:
    """One depth of some subtrees: sorted rows (context, byte) with counts, and for each bit of the byte its nodes.

    Rows of one node stand together, as a node is a context and the bits before its own."""

    def __init__(self, rows: np.ndarray, n: np.ndarray):
        self.rows, self.n = rows, n.astype(np.float64)
        self.start, self.node, self.n0, self.n1 = [], [], [], []
        for j in range(8):
            group = rows >> np.uint64(8 - j)
            first = np.concatenate([[True], group[1:] != group[:-1]])
            start = np.flatnonzero(first)
            one = np.add.reduceat(self.n * ((rows >> np.uint64(7 - j)) & np.uint64(1)), start)
            self.start.append(start)
            self.node.append(np.cumsum(first) - 1)
            self.n0.append(np.add.reduceat(self.n, start) - one)
            self.n1.append(one)

    def names(self, j: int) -> np.ndarray:
        """The nodes of bit j, as context and bit prefix."""
        row = self.rows[self.start[j]]
        return (row >> np.uint64(8)) << np.uint64(8) | (np.uint64(1) << np.uint64(j)) | ((row & np.uint64(255)) >> np.uint64(8 - j))

    def up(self) -> tuple[Level, np.ndarray]:
        """The depth above, and the row there of each row here."""
        short = (self.rows >> np.uint64(16)) << np.uint64(8) | (self.rows & np.uint64(255))
        rows, at = np.unique(short, return_inverse=True)
        return Level(rows, np.bincount(at, self.n, len(rows))), at


class Subtrees:
    """The trees below some contexts of `top` bytes, from all their grams (sorted); grams with a count of 0 aren't in
    the trees but can be asked for."""

    def __init__(self, keys: np.ndarray, n: np.ndarray, depth: int, top: int):
        self.depth, self.top = depth, top
        self.levels, self.ups, self.weights = {depth: Level(keys, n)}, {}, {}
        below: list[np.ndarray] = []
        for d in range(depth, top - 1, -1):
            here, weights, pws = self.levels[d], [], []
            for j in range(8):
                pe = kt(here.n0[j], here.n1[j])
                if d == depth:
                    pw, w = pe, np.ones(len(pe))
                else:
                    parent = here.node[j][self.ups[d][self.levels[d + 1].start[j]]]
                    pw, w = _weigh(pe, np.bincount(parent, below[j], len(pe)))
                weights.append(w)
                pws.append(pw)
            self.weights[d], below = weights, pws
            if d > 0:
                self.levels[d - 1], self.ups[d - 1] = here.up()
        self.below = below

    def above(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(nodes, n0, n1, log of the weighted probability of the subtrees below them) of the depth above the top."""
        here, out = self.levels[self.top - 1], []
        for j in range(8):
            parent = here.node[j][self.ups[self.top - 1][self.levels[self.top].start[j]]]
            out.append((here.names(j), here.n0[j], here.n1[j], np.bincount(parent, self.below[j], len(here.start[j]))))
        nodes, n0, n1, below = (np.concatenate(x) for x in zip(*out))
        return nodes, n0, n1, below

    def log10(self, head: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]) -> np.ndarray:
        """log10 of the mixed probability of each gram's byte; head: the depths above, (sorted nodes, n0, n1, weight)."""
        at = {self.depth: np.arange(len(self.levels[self.depth].rows))}
        for d in range(self.depth - 1, -1, -1):
            if d < self.top - 1:
                self.levels[d], self.ups[d] = self.levels[d + 1].up()
            at[d] = self.ups[d][at[d + 1]]
        sym, out = self.levels[self.depth].rows & np.uint64(255), np.zeros(len(at[self.depth]))
        for j in range(8):
            p1, acc, rest, seen = np.full(len(out), 0.5), np.zeros(len(out)), np.ones(len(out)), np.ones(len(out), dtype=bool)
            for d in range(self.depth + 1):
                here = self.levels[d]
                if d in head:
                    names, n0, n1, w = head[d]
                    want = here.names(j)
                    k = np.minimum(np.searchsorted(names, want), max(0, len(names) - 1))
                    known = names[k] == want if len(names) else np.zeros(len(want), dtype=bool)
                    n0, n1, w = (x[k] if len(names) else np.zeros(len(want)) for x in (n0, n1, w))
                else:
                    n0, n1, w = here.n0[j], here.n1[j], self.weights[d][j]
                    known = n0 + n1 > 0
                node = here.node[j][at[d]]
                seen &= known[node]
                est, w = ((n1 + 0.5) / (n0 + n1 + 1))[node], w[node]
                acc += rest * w * est
                rest *= 1 - w
                p1 = np.where(seen, acc + rest * est, p1)
            out += np.log10(np.where((sym >> np.uint64(7 - j)) & np.uint64(1) == 1, p1, 1 - p1))
        return out


def _share(key: Column, depth: int) -> Column:
    """Which share of its two-byte context a gram falls to: one of SHARES, by its third byte, as some contexts have many grams."""
    return F.pmod(F.xxhash64(F.shiftright(key, 8 * (depth - TOP) + 8)), F.lit(SHARES)).cast("int")


def _by_context(rows: DataFrame, depth: int) -> DataFrame:
    """Rows (key, n, share, ...) by the two-byte context of the gram in key, and its share; sorted, a context's nodes (n < 0) before its grams."""
    rows = rows.withColumn("ctx", F.shiftright("key", 8 * (depth - 2) + 8)).repartition("ctx", "share")
    return rows.sortWithinPartitions("ctx", F.col("n") >= 0, "key").drop("ctx", "share")


def _slices(batches: Iterator[pa.RecordBatch], depth: int, size: int = SLICE) -> Iterator[list[np.ndarray]]:
    """The columns (key, n, ...) of a partition that _by_context() sorted, about `size` rows at a time, cut between contexts of TOP bytes.

    So a task holds a slice and a batch, or the grams of one such context if they are more, whatever the partition has."""
    parts, held, limit = [], 0, size
    for b in batches:
        if not b.num_rows:
            continue
        parts.append([c.to_numpy(zero_copy_only=False) for c in b.columns])
        held += b.num_rows
        if held < limit:
            continue
        cols = [np.concatenate(x) for x in zip(*parts)]
        ctx = cols[0] >> (8 * (depth - TOP) + 8)
        ctx = np.where(cols[1] < 0, ctx & ~np.int64(255), ctx)
        cut = int(np.searchsorted(ctx, ctx[-1]))
        if cut:
            yield [x[:cut] for x in cols]
        parts, held = [[x[cut:].copy() for x in cols]], held - cut
        limit = max(size, 2 * held)
    if held:
        yield [np.concatenate(x) for x in zip(*parts)]


def middle_level(counts: DataFrame, depth: int, size: int = SLICE) -> DataFrame:
    """(key, n0, n1, pw, w): the nodes of depth TOP - 1, with the weights that the trees below give them.

    counts: (key, n), the grams of training. key is a node, as context and bit prefix, at the place of a gram's context."""

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, n in _slices(batches, depth, size):
            nodes, n0, n1, below = Subtrees(keys.view(np.uint64), n, depth, TOP).above()
            yield pa.RecordBatch.from_arrays([pa.array(nodes.view(np.int64)), pa.array(n0), pa.array(n1), pa.array(below)], names=["node", "n0", "n1", "below"])

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            node, n0, n1, below = (c.to_numpy() for c in b.columns)
            pw, w = _weigh(kt(n0, n1), below)
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(n0), pa.array(n1), pa.array(pw), pa.array(w)], names=["node", "n0", "n1", "pw", "w"])

    rows = _by_context(counts.select("key", "n", _share(F.col("key"), depth).alias("share")), depth).mapInArrow(grow, "node long, n0 double, n1 double, below double")
    sums = rows.groupBy("node").agg(*(F.sum(c).alias(c) for c in ("n0", "n1", "below")))
    return sums.mapInArrow(weigh, "node long, n0 double, n1 double, pw double, w double")


def head_levels(middle: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Depths 0 and 1. What is collected has at most 256 * 255 rows, whatever the corpus holds."""
    up = F.shiftleft(F.shiftright("node", 16), 8).bitwiseOR(F.col("node").bitwiseAND(255))
    rows = middle.groupBy(up.alias("node")).agg(*(F.sum(c).alias(c) for c in ("n0", "n1", "pw"))).orderBy("node").toPandas()
    node, n0, n1 = rows["node"].to_numpy(np.int64).view(np.uint64), rows["n0"].to_numpy(float), rows["n1"].to_numpy(float)
    pw, w = _weigh(kt(n0, n1), rows["pw"].to_numpy(float))
    root, at = np.unique((node >> np.uint64(16)) << np.uint64(8) | (node & np.uint64(255)), return_inverse=True)
    r0, r1 = np.bincount(at, n0, len(root)), np.bincount(at, n1, len(root))
    _, rw = _weigh(kt(r0, r1), np.bincount(at, pw, len(root)))
    return {0: (root, r0, r1, rw), 1: (node, n0, n1, w)}


def predictions(counts: DataFrame, depth: int = DEPTH, size: int = SLICE) -> DataFrame:
    """(key, value): log10 of the probability of each gram of counts (key, n); those with n = 0 weren't seen in training. size: grams to a slice."""
    middle = settle(middle_level(counts.where("n > 0"), depth, size))
    head = head_levels(middle)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [np.empty(0, np.int64), *(np.empty(0) for _ in range(3))]
        for keys, n, n0, n1, w in _slices(batches, depth, size):
            is_node = n < 0
            # The nodes of a context whose grams the last slice began with are needed again.
            kept = [np.concatenate([a, b[is_node]]) for a, b in zip(kept, (keys, n0, n1, w))]
            if not is_node.all():
                # A node came at the place of its context's grams: its marker bit goes back to where the nodes have it.
                own = head | {TOP - 1: (kept[0].view(np.uint64) >> np.uint64(8 * (depth - TOP + 1)), *kept[1:])}
                grams = keys[~is_node]
                value = Subtrees(grams.view(np.uint64), n[~is_node], depth, TOP).log10(own)
                yield pa.RecordBatch.from_arrays([pa.array(grams), pa.array(value)], names=["key", "value"])
            last = kept[0] >> (8 * (depth - 2) + 8) == keys[-1] >> (8 * (depth - 2) + 8)
            kept = [x[last] for x in kept]

    nothing = F.lit(0.0)
    nodes = middle.select(F.shiftleft("node", 8 * (depth - TOP + 1)).alias("key"), F.lit(-1).cast("long").alias("n"), "n0", "n1", "w", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))).alias("share"))
    rows = counts.select("key", "n", nothing.alias("n0"), nothing.alias("n1"), nothing.alias("w"), _share(F.col("key"), depth).alias("share")).union(nodes)
    return _by_context(rows, depth).mapInArrow(run, "key long, value double")


def score_documents(docs: DataFrame, held_out: Column | None = None, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte) for each row.

    held_out: rows not learned from; by default crc32(doc_id as text) mod 10 = 0, and rows without an id. A null
    text is empty: one end token. base_score is the smoothed unigram log10 probability of the words, score the
    context-tree model's of the same lower-cased words. Rows that share an id are rows of their own. depth: TOP to 6."""
    if not TOP <= depth <= 6:
        raise ValueError(f"depth is {depth}; {TOP} to 6 are possible")
    text_batches(docs.sparkSession)
    held = part_of(id_col, 10) == 0 if held_out is None else held_out
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(held, F.lit(True)).alias("held_out"), F.coalesce(text_col, F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 + size // block_bytes)).cast("int")).select("block", "doc_id", "held_out", "text")
    keys = settle(block_keys(dealt, depth))
    counts = settle(keys.groupBy("kind", "key").agg(F.sum("n").alias("n")))
    total = counts.where((F.col("kind") == WORD) & (F.col("n") > 0)).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    logs = predictions(counts.where(F.col("kind") == GRAM), depth)
    values = counts.where(F.col("kind") == WORD).select("kind", "key", F.col("n").cast("double").alias("value")).union(logs.select(F.lit(GRAM).alias("kind"), "key", "value"))
    told = keys.select("block", "kind", "key").join(values, ["kind", "key"]).select("block", "kind", "key", "value")
    n, v = int(total["n"]), int(total["v"])

    def score(texts: pa.Table, told: pa.Table) -> pa.Table:
        kind, key, value = (told.column(c).to_numpy() for c in ("kind", "key", "value"))
        words, tree = (Lookup(key[kind == k].view(np.uint64), value[kind == k]) for k in (WORD, GRAM))
        cols: dict[str, list[np.ndarray]] = {c: [] for c in ("n_tokens", "n_known", "base_score", "score", "bits_per_byte")}
        for b in texts.to_batches(1024):
            all_texts = b.column("text").cast(pa.binary()).to_pylist()
            for pack in _packs(all_texts):
                some = [all_texts[i] for i in pack]
                hashes = words_of(some)
                size = np.array([len(h) + 1 for h in hashes])
                c = words.get(np.concatenate([x for h in hashes for x in (h, [END_TOKEN])]).astype(np.uint64))
                at = np.cumsum(size) - size
                cols["n_tokens"].append(size)
                cols["n_known"].append(np.add.reduceat((c > 0).astype(np.int64), at))
                cols["base_score"].append(np.add.reduceat(np.log10((c + 0.1) / (n + 0.1 * (v + 1))), at))
                low, mark = streams(some, depth)
                logp = np.zeros(len(low))
                for place, keys in _gram_slices(low, mark, depth):
                    logp[place] = tree.get(keys)
                logp[mark == 1] = 0
                end = np.flatnonzero(mark == 2) + 1
                begin = np.concatenate([[0], end[:-1]])
                got = np.add.reduceat(logp, begin)
                cols["score"].append(got)
                cols["bits_per_byte"].append(-got * np.log2(10) / (end - begin - depth))
        out = {c: np.concatenate(x) if x else np.empty(0) for c, x in cols.items()}
        ints = {c: pa.array(out[c], pa.int64()) for c in ("n_tokens", "n_known")}
        return pa.table({"doc_id": texts.column("doc_id"), "held_out": texts.column("held_out"), **ints, "train_tokens": pa.array(np.full(texts.num_rows, n), pa.int64()), **{c: pa.array(out[c], pa.float64()) for c in ("base_score", "score", "bits_per_byte")}})

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"
    return dealt.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(score, schema)
