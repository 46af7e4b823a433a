"""Byte-level BPE by monoid tree reduction.

A token list is valid when every two neighbours, joined and encoded on their own, give the same two tokens
back; the BPE of a string is its only valid token list. So encodings form a monoid: two encoded neighbours are joined by
re-encoding a window around the boundary and growing it until both pairs at the window's ends are valid.
"""

from __future__ import annotations

import base64
import hashlib
import sys
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_batches

LEAF = 24
#: Token pairs that a worker process remembers, about 250 bytes each.
CACHE = 1 << 16
#: Pieces up to so many characters are remembered, in two generations of so many bytes: at most 32 MB of pieces, whatever their lengths.
PIECE, HELD = 64, 16 << 20
#: Tokens of a leaf of the tree that decoding goes up.
DECODE_LEAF = 256
#: Characters of the texts whose pieces are looked up together; a longer text goes by itself.
GROUP = 1 << 17
#: Leaves that are merged side by side, and the rank of a pair that isn't in the vocabulary.
SIDE, NONE = 1 << 14, np.iinfo(np.int32).max


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class TreeBPE:
    """Encoder and decoder of one vocabulary. pattern parts the text; each match is encoded by itself."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.split = ranks, regex.compile(pattern)
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.table = np.full(max(self.bytes_of, default=-1) + 1, None, object)
        for i, b in self.bytes_of.items():
            self.table[i] = b
        #: The ids of single bytes, and every pair of tokens that is a token, as sorted keys with its rank; made when they are first asked for.
        self.pairs: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None
        self.valid: dict[tuple[int, int], bool] = {}
        #: Ids of pieces; a full memory becomes the older one, from which pieces in use come back.
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.held = 0

    def leaf(self, piece: bytes) -> list[int]:
        """The plain merge loop, for short strings: always the lowest rank, leftmost first."""
        if (whole := self.ranks.get(piece)) is not None:
            return [whole]
        get, none = self.ranks.get, 1 << 62
        cut = list(range(len(piece) + 1))
        rank = [get(piece[i : i + 2], none) for i in range(len(piece) - 1)]
        while rank and (best := min(rank)) < none:
            i = rank.index(best)
            del cut[i + 1], rank[i]
            if i < len(rank):
                rank[i] = get(piece[cut[i] : cut[i + 2]], none)
            if i:
                rank[i - 1] = get(piece[cut[i - 1] : cut[i + 1]], none)
        return [self.ranks[piece[a:b]] for a, b in zip(cut, cut[1:])]

    def _pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if self.pairs is None:
            get, keys, to = self.ranks.get, [], []
            for b, i in self.ranks.items():
                for j in range(1, len(b)):
                    if (left := get(b[:j])) is not None and (right := get(b[j:])) is not None:
                        keys.append(left << 32 | right)
                        to.append(i)
            order = np.argsort(found := np.array(keys, np.int64))
            single = np.array([self.ranks[bytes([i])] for i in range(256)], np.int64)
            # A last key above all others, so that a search never ends outside.
            self.pairs = single, np.append(found[order], np.iinfo(np.int64).max), np.append(np.array(to, np.int32)[order], NONE).astype(np.int32)
        return self.pairs

    def leaves(self, pieces: list[bytes]) -> list[bytes]:
        """leaf() of many short strings that aren't tokens, as little-endian uint32: the same merges in the same order, a merge of every string at each step."""
        single, keys, to = self._pairs()

        def rank(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            at = np.searchsorted(keys, key := a << 32 | b)
            return np.where(keys[at] == key, to[at], NONE)

        out = []
        for at in range(0, len(pieces), SIDE):
            part = pieces[at : at + SIDE]
            size = np.array([len(p) for p in part])
            n, width = len(part), int(size.max()) + 1
            # Rows of tokens, each linked to its neighbours; width - 1 is the place behind the last one.
            place = np.arange(width)
            inside = place < size[:, None]
            tokens = np.zeros((n, width), np.int64)
            tokens[inside] = single[np.frombuffer(b"".join(part), np.uint8)]
            ranks = np.full((n, width), NONE, np.int32)
            pair = place < size[:, None] - 1
            rows, cols = np.nonzero(pair)
            ranks[pair] = rank(tokens[rows, cols], tokens[rows, cols + 1])
            after = np.where(pair, place + 1, width - 1)
            before = np.broadcast_to(place - 1, (n, width)).copy()
            r = np.arange(n)
            while r.size:
                best = ranks[r].argmin(axis=1)
                low = ranks[r, best]
                go = low < NONE
                r, best, low = r[go], best[go], low[go]
                gone = after[r, best]
                then = after[r, gone]
                tokens[r, best], after[r, best], before[r, then] = low, then, best
                inside[r, gone], ranks[r, gone] = False, NONE
                ranks[r, best] = np.where(then < width - 1, rank(tokens[r, best], tokens[r, then]), NONE)
                has = best > 0
                q, b = r[has], best[has]
                first = before[q, b]
                ranks[q, first] = rank(tokens[q, first], tokens[q, b])
            ids, ends = tokens[inside].astype("<u4").tobytes(), (4 * np.cumsum(inside.sum(axis=1))).tolist()
            out += [ids[a:b] for a, b in zip([0, *ends], ends)]
        return out

    def fits(self, a: int, b: int) -> bool:
        """Whether tokens a and b can stand side by side."""
        if (a, b) not in self.valid:
            if len(self.valid) >= CACHE:
                self.valid.clear()
            self.valid[a, b] = self.leaf(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
        return self.valid[a, b]

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of the concatenation of two encoded strings."""
        if not left or not right:
            return left or right
        if self.fits(left[-1], right[0]):
            return left + right
        k = 1
        while True:
            i, j = max(0, len(left) - k), min(len(right), k)
            window = b"".join(self.bytes_of[t] for t in left[i:] + right[:j])
            mid = self.leaf(window) if len(window) <= 8 * LEAF else self._bisect(window)
            ok_left = i == 0 or self.fits(left[i - 1], mid[0])
            ok_right = j == len(right) or self.fits(mid[-1], right[j])
            if ok_left and ok_right:
                return left[:i] + mid + right[j:]
            k *= 2

    def _bisect(self, piece: bytes) -> list[int]:
        half = len(piece) // 2
        return self.join(self.encode_piece(piece[:half]), self.encode_piece(piece[half:]))

    def encode_piece(self, piece: bytes) -> list[int]:
        """Tree reduction: leaves in order, then neighbours joined pair by pair, level by level."""
        if len(piece) <= LEAF:
            return self.leaf(piece)
        level = [self.leaf(piece[i : i + LEAF]) for i in range(0, len(piece), LEAF)]
        while len(level) > 1:
            level = [self.join(level[i], level[i + 1]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
        return level[0]

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        return self._together([text])[0]

    def encode_all(self, texts: Iterable[str]) -> Iterator[bytes]:
        """encode() of each text, in order; the new pieces of several texts are encoded together."""
        group, size = [], 0
        for text in texts:
            if group and size + len(text) > GROUP:
                yield from self._together(group)
                group, size = [], 0
            group.append(text)
            size += len(text)
        yield from self._together(group)

    def _together(self, texts: list[str]) -> list[bytes]:
        parted, known = [self.split.findall(t) for t in texts], self.known
        long: dict[str, bytes] = {}
        got: dict[str, bytes] = {}
        short: dict[str, bytes] = {}
        for piece in set().union(*parted).difference(known):
            if (ids := self.older.get(piece)) is not None:
                got[piece] = ids
            elif len(raw := piece.encode()) > LEAF:
                (long if len(piece) > PIECE else got)[piece] = np.array(self.encode_piece(raw), dtype="<u4").tobytes()
            elif (whole := self.ranks.get(raw)) is not None:
                got[piece] = whole.to_bytes(4, "little")
            else:
                short[piece] = raw
        got.update(zip(short, self.leaves(list(short.values()))))
        known.update(got)
        self.held += sum(map(sys.getsizeof, got)) + sum(map(sys.getsizeof, got.values())) + 100 * len(got)  # 100: its place in the dictionary
        of = (lambda p: long[p] if p in long else known[p]) if long else known.__getitem__
        out = [b"".join(map(of, pieces)) for pieces in parted]
        if self.held > HELD:
            self.known, self.older, self.held = {}, known, 0
        return out

    def decode(self, ids: bytes) -> bytes:
        """The bytes of each leaf's tokens, then neighbours concatenated pair by pair, level by level."""
        tokens = self.table[np.frombuffer(ids, dtype="<u4")].tolist()
        level = [b"".join(tokens[i : i + DECODE_LEAF]) for i in range(0, len(tokens), DECODE_LEAF)] or [b""]
        while len(level) > 1:
            level = [level[i] + level[i + 1] if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
        return level[0]


_CODERS: dict[tuple[str, str], TreeBPE] = {}


def coder(path: str, pattern: str) -> TreeBPE:
    """One coder for each worker process."""
    if (path, pattern) not in _CODERS:
        _CODERS[path, pattern] = TreeBPE(load_ranks(path), pattern)
    return _CODERS[path, pattern]


def encode_documents(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids binary): the token ids of each whole text, little-endian uint32. Null text is empty: no ids.

    One pass without a shuffle; path must be readable on every executor. Ids may repeat or be null: each row gives one
    row. Other columns are ignored; an empty table gives an empty table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(path, pattern)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                ids = list(bpe.encode_all(t or "" for t in part.column(1).to_pylist()))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    text_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, ids binary")


def decode_documents(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids, decoded binary) of encode_documents' rows. Null ids give null bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(path, pattern)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                texts = [None if x is None else bpe.decode(x) for x in part.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("ids"), pa.array(texts, pa.binary())], names=["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids binary, decoded binary")


def token_digests(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens long, ids_sha256, decoded_sha256) for each row: a text is encoded, its ids are decoded, both are digested.

    The three happen in one pass, so that ids and bytes never leave the task. Nulls, repeats and empty tables are as
    in encode_documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(path, pattern)
        for b in batches:
            n, ids_digest, digest = [], [], []
            for ids in bpe.encode_all(text.as_py() or "" for text in b.column(1)):
                n.append(len(ids) // 4)
                ids_digest.append(hashlib.sha256(ids).hexdigest())
                digest.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids_digest, pa.string()), pa.array(digest, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    text_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
