"""Exact dedup over a sharded cuckoo-filter index of live digests."""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WHITE, settle

SLOTS, KICKS = 4, 200
#: Digests of a shard, about 110 bytes each in a task.
SHARD = 1 << 19


class CuckooFilter:
    """16-bit fingerprints in buckets of 4, each with two homes; a slot also says where its key is stored.

    A fingerprint hit is verified against the slot's stored key, so answers are exact, and find() gives the key's place
    without any other index. When an insertion finds no room after KICKS moves, the table doubles and is refilled
    from the stored keys. Deleted keys leave their slot, and their place is used again."""

    def __init__(self, capacity: int = 64):
        self.resizes, self.size = 0, 0
        self.keys: list[bytes | None] = []
        self.free: list[int] = []
        self._make(max(4, 1 << (max(1, capacity) * 5 // (SLOTS * 4)).bit_length()))

    def _make(self, buckets: int) -> None:
        self.mask = buckets - 1
        self.prints = array("H", bytes(2 * SLOTS * buckets))  # 0: empty
        self.places = array("i", bytes(4 * SLOTS * buckets))

    def _homes(self, key: bytes) -> tuple[int, int, int]:
        mark = int.from_bytes(key[:2], "little") or 1
        first = int.from_bytes(key[2:10], "little") & self.mask
        return mark, first, self._other(first, mark)

    def _other(self, home: int, mark: int) -> int:
        return (home ^ (mark * 0x5BD1E995)) & self.mask

    def _slot(self, key: bytes) -> int:
        """The slot of a live key, else -1."""
        mark, *homes = self._homes(key)
        for h in homes:
            for s in range(SLOTS * h, SLOTS * h + SLOTS):
                if self.prints[s] == mark and self.keys[self.places[s]] == key:
                    return s
        return -1

    def find(self, key: bytes) -> int:
        """Where a live key is stored, else -1: a number that stays the same while it is live."""
        s = self._slot(key)
        return -1 if s < 0 else self.places[s]

    def __contains__(self, key: bytes) -> bool:
        return self._slot(key) >= 0

    def insert(self, key: bytes) -> bool:
        """False if the key is live already."""
        if self._slot(key) >= 0:
            return False
        if self.free:
            place = self.free.pop()
            self.keys[place] = key
        else:
            place = len(self.keys)
            self.keys.append(key)
        self.size += 1
        if not self._put(place):
            self._grow()
        return True

    def _put(self, place: int) -> bool:
        mark, home, other = self._homes(self.keys[place])
        for kick in range(KICKS):
            for h in (home, other) if not kick else (home,):
                for s in range(SLOTS * h, SLOTS * h + SLOTS):
                    if not self.prints[s]:
                        self.prints[s], self.places[s] = mark, place
                        return True
            s = SLOTS * home + (kick + mark) % SLOTS
            self.prints[s], mark = mark, self.prints[s]
            self.places[s], place = place, self.places[s]
            home = self._other(home, mark)
        return False

    def _grow(self) -> None:
        while True:
            self.resizes += 1
            self._make(2 * (self.mask + 1))
            if all(self._put(i) for i, k in enumerate(self.keys) if k is not None):
                return

    def delete(self, key: bytes) -> bool:
        """False if the key isn't live."""
        s = self._slot(key)
        if s < 0:
            return False
        self.prints[s] = 0
        self.keys[self.places[s]] = None
        self.free.append(self.places[s])
        self.size -= 1
        return True


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_sha256): the SHA-256 of each text with its white space runs made one space; null is empty."""
    text = F.regexp_replace(F.coalesce(text_col, F.lit("")), WHITE, " ")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.sha2(text, 256).alias("text_sha256"))


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Before the shuffle, each task folds its own copies, batch by batch, so a hot digest sends few rows."""
    for b in batches:
        rows = b.to_pandas()
        rows = rows.groupby("key", sort=False).agg(keep_id=("doc_id", "min"), group_size=("doc_id", "size")).reset_index()
        yield pa.RecordBatch.from_pandas(rows[["key", "keep_id", "group_size"]], preserve_index=False)


_ENTRY = "key binary, keep_id long, group_size long"


def _entries(live: CuckooFilter, keep: array, count: array) -> Iterator[pa.RecordBatch]:
    at = [i for i, k in enumerate(live.keys) if k is not None]
    for s in range(0, len(at), 16384):
        some = at[s : s + 16384]
        yield pa.RecordBatch.from_arrays([pa.array([live.keys[i] for i in some], pa.binary()), *(pa.array([x[i] for i in some], pa.int64()) for x in (keep, count))], names=["key", "keep_id", "group_size"])


def _load(live: CuckooFilter, keep: array, count: array, key: bytes, first: int, n: int) -> None:
    """An entry goes into the filter: a new digest is inserted, a live one is found there and takes the smaller id and both counts."""
    if live.insert(key):
        i = live.find(key)
        if i == len(keep):
            keep.append(first)
            count.append(n)
        else:
            keep[i], count[i] = first, n
    else:
        i = live.find(key)
        keep[i], count[i] = min(keep[i], first), count[i] + n


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One shard: each arriving digest is looked up in the filter, verified and inserted if it is new."""
    live, keep, count = CuckooFilter(1024), array("q"), array("q")
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns)):
            _load(live, keep, count, *row)
    yield from _entries(live, keep, count)


def _shards(df: DataFrame) -> int:
    """So many that each holds SHARD digests or fewer, about; as many as Spark's own at least."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // SHARD))


def build_index(rows: DataFrame) -> DataFrame:
    """(key binary, keep_id, group_size): the live digests of rows (doc_id, text_sha256), one entry each.

    Shards are hash partitions of the digest; rows are counted, so that none holds more than about SHARD digests."""
    keyed = rows.where("doc_id is not null and text_sha256 is not null").select("doc_id", F.unhex("text_sha256").alias("key"))
    return keyed.mapInArrow(_fold, _ENTRY).repartition(_shards(rows), "key").mapInArrow(_index, _ENTRY)


def delete_from_index(index: DataFrame, gone: DataFrame) -> DataFrame:
    """The index without the digests of gone (text_sha256); digests that aren't live, nulls and repeats are passed over.

    A shard inserts its stored keys into its filter, deletes, and gives what is left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        live, keep, count, drop = CuckooFilter(1024), array("q"), array("q"), []
        for b in batches:
            for key, first, n in zip(*(c.to_pylist() for c in b.columns)):
                if n is None:
                    drop.append(key)
                else:
                    _load(live, keep, count, key, first, n)
        for key in drop:
            live.delete(key)
        yield from _entries(live, keep, count)

    marks = gone.where("text_sha256 is not null").select(F.unhex("text_sha256").alias("key")).distinct()
    marks = marks.select("key", F.lit(None).cast("long").alias("keep_id"), F.lit(None).cast("long").alias("group_size"))
    return index.select("key", "keep_id", "group_size").union(marks).repartition(_shards(index), "key").mapInArrow(run, _ENTRY)


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for each row; of equal texts the smallest id stays.

    Null text is empty text, and empty texts are equal to each other. A row with a null id is given back with
    a null keep_id and is not kept. Rows with one id twice count twice. A text of any length is one digest, and an
    empty table gives an empty one; other columns are ignored. Only groups of two or more travel back
    to the rows; a hot group's rows are split by the skew join."""
    rows = settle(digests(docs, id_col, text_col))
    groups = build_index(rows).where("group_size > 1").select(F.lower(F.hex("key")).alias("text_sha256"), "keep_id", "group_size")
    out = rows.join(groups, "text_sha256", "left")
    keep = F.when(F.col("doc_id").isNotNull(), F.coalesce("keep_id", "doc_id"))
    return out.select("doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), F.coalesce(F.col("doc_id") == keep, F.lit(False)).alias("kept"), "text_sha256")
