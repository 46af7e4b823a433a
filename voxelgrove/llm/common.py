"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import settle, shared_folder

__all__ = ["clear", "settle", "shared_folder"]

#: White space and word bytes of every tokeniser here: [\x20\x09-\x0D]+ parts words.
WHITE = "[\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input folder; Spark reads it, wherever the folder is."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def clear(spark: SparkSession) -> None:
    """Removes the settled tables of this application, once none of its DataFrames needs them; others' stay."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(shared_folder(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def set_aside(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """df with the columns that start with two underscores, as the operators' own do, under other names; and the way back."""
    names, back = {c.lower() for c in df.columns}, {}
    for c in df.columns:
        if c.startswith("__"):
            k = len(back)
            while f"aside_{k}" in names:
                k += 1
            names.add(f"aside_{k}")
            back[f"aside_{k}"] = c
    return df.withColumnsRenamed({c: a for a, c in back.items()}), back


def named_aside(back: dict[str, str], *names: str) -> list[str]:
    """What columns are called after set_aside()."""
    now = {c.lower(): a for a, c in back.items()}
    return [now.get(n.lower(), n) for n in names]


def text_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Has Spark hand rows with whole texts to Python `rows` at a time, where the session has Spark's own 10,000."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, str(rows))


def part_of(doc_id: str | Column, parts: int) -> Column:
    """crc32 of the id as text, modulo parts: the fold of a row."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(c.cast("string").cast("binary")) % parts


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_WHITE = np.zeros(256, dtype=bool)
IS_WHITE[[0x20, 9, 10, 11, 12, 13]] = True
LOWER[IS_WHITE] = 0x20

_rng = np.random.Generator(np.random.PCG64(20240607))
_VALUE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ODD = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD6E8FEB86659FD93)
_SEGMENT = 1 << 19
_POW = np.empty(0, dtype=np.uint64)
_INV = np.empty(0, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POW, _INV
    if len(_POW) < n:
        n = 1 << (n - 1).bit_length()
        inverse = np.uint64(pow(int(_STEP), -1, 2**64))
        _POW = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, _STEP)]), dtype=np.uint64)
        _INV = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, inverse)]), dtype=np.uint64)
    return _POW, _INV


def word_hashes(low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of lower-cased bytes, and where each word starts."""
    if not len(low):
        return np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64)
    inner = low != 0x20
    edge = np.flatnonzero(np.diff(inner.view(np.int8), prepend=0, append=0))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return np.empty(0, dtype=np.uint64), starts
    power, inverse = _powers(len(low) + 1)
    total = np.empty(len(low) + 1, dtype=np.uint64)
    total[0] = 0
    np.cumsum(_VALUE[low] * power[: len(low)], out=total[1:])
    return mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * _ODD), starts


def words_of(texts: list[bytes], lower: np.ndarray = LOWER) -> list[np.ndarray]:
    """The word hashes of each text, in order; texts are packed into short buffers that fit the cache.

    lower gives what each byte counts as, 0x20 being white. A text longer than a buffer is cut at white space, so memory holds one buffer and the hashes."""
    out: list[np.ndarray] = [np.empty(0, dtype=np.uint64)] * len(texts)
    pack: list[int] = []
    held = 0

    def flush() -> None:
        nonlocal held
        if pack:
            low = lower[np.frombuffer(b"\n".join(texts[i] for i in pack), dtype=np.uint8)]
            hashes, starts = word_hashes(low)
            bounds = np.cumsum([len(texts[i]) + 1 for i in pack])
            for i, h in zip(pack, np.split(hashes, np.searchsorted(starts, bounds[:-1]))):
                out[i] = h
        pack.clear()
        held = 0

    for i, t in enumerate(texts):
        if len(t) > _SEGMENT:
            out[i] = _long_words(t, lower)
            continue
        if held + len(t) > _SEGMENT:
            flush()
        pack.append(i)
        held += len(t) + 1
    flush()
    return out


def _long_words(text: bytes, lower: np.ndarray) -> np.ndarray:
    is_white = lower == 0x20
    low, at, parts = np.frombuffer(text, dtype=np.uint8), 0, []
    while at < len(low):
        end = min(len(low), at + _SEGMENT)
        while end < len(low) and not is_white[low[end]]:
            cut = low[at:end]
            white = np.flatnonzero(is_white[cut[-4096:]])
            if len(white):
                end = end - len(cut[-4096:]) + int(white[-1])
            else:
                ahead = np.flatnonzero(is_white[low[end : end + _SEGMENT]])
                end = end + int(ahead[0]) if len(ahead) else min(len(low), end + _SEGMENT)
        parts.append(word_hashes(lower[low[at:end]])[0])
        at = end
    return np.concatenate(parts)


def shingle_set(words: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of `size` words; fewer words make one run; none, none."""
    n = len(words)
    if not n:
        return words
    run = min(n, size)
    total = np.full(n - run + 1, run * int(_ODD) % 2**64, dtype=np.uint64)
    for k in range(run):
        total = mix(total + words[k : n - run + 1 + k] * np.uint64((2 * k + 1) * int(_STEP) % 2**64))
    return np.unique(total)


def small(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """df, marked for broadcast if it was counted to hold at most `rows` narrow rows; else as it is, for a shuffled join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
