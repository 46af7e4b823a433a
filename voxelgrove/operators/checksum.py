"""Digests of samples and their audit."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import in_order

#: The tables that hold a sample's content beside the table of samples: the column that names a part of it, and the one that numbers its rows.
PARTS = {"tiles": ("name", "tile"), "images": ("modality", None), "voxels": ("modality", "pos"), "masks": ("mask", "pos"), "boxes": (None, "box")}
#: Columns of samples that are about the digest, not under it.
OUTSIDE = ("checksum", "computed")


def sample_digest(chunks: DataFrame, key: str, order: Sequence[str], text: Column) -> DataFrame:
    """(key, digest): SHA-256 over a sample's chunk texts, each with a bar after it, in order. A sample is one group."""
    rows = chunks.select(key, F.struct(*order, F.concat(text, F.lit("|")).alias("__text")).alias("c"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list("c")), lambda c: c["__text"]), "")
    return rows.groupBy(key).agg(F.sha2(joined.cast("binary"), 256).alias("digest"))


def verify(stored: Column, computed: Column) -> Column:
    return F.when(stored.isNull(), "missing").when(stored == computed, "ok").otherwise("mismatch")


def audit(status: DataFrame) -> DataFrame:
    """(checked, failed) of rows with status; missing passes."""
    return status.agg(F.count("*").alias("checked"), F.count_if(F.col("status") == "mismatch").alias("failed"))


def _plain(rows: DataFrame, column: str) -> Column:
    """A column as its text is made of it: bytes as their SHA-256, lists, maps and structs as JSON, others as they are."""
    kind, v = rows.schema[column].dataType.typeName(), F.col(f"`{column}`")
    return F.sha2(v, 256) if kind == "binary" else F.to_json(v) if kind in ("array", "map", "struct") else v


def canonical(rows: DataFrame, columns: Mapping[str, Column]) -> Column:
    """The text of a row of a table: each column's name, the mark of its type and its value, the last with its length in bytes before it. columns: where
    each column's plain value (_plain) is.

    Marks: i whole numbers, f other numbers, b booleans, s texts, dates and times, x bytes (as their SHA-256), j lists, maps and structs (as JSON); a
    null is n. So 1, 1.0, "1" and null differ, and so do a null and an empty text."""
    kinds = {f.name: f.dataType.typeName() for f in rows.schema}
    out = []
    for c, v in columns.items():
        kind, text = kinds[c], v.cast("string")
        if kind in ("byte", "short", "integer", "long"):
            mark = "i"
        elif kind in ("float", "double") or kind.startswith("decimal"):
            mark = "f"
        elif kind == "boolean":
            mark = "b"
        elif kind == "binary":
            mark = "x"
        elif kind in ("array", "map", "struct"):
            mark = "j"
        else:
            mark = "s"
        said = F.concat(F.lit(f"{mark}"), F.octet_length(text).cast("string"), F.lit(":"), text)
        out.append(F.concat(F.lit(f"{c}="), F.coalesce(said, F.lit("n")), F.lit(";")))
    return F.concat(F.lit(""), *out)


def _under(table: str, rows: DataFrame, key: str) -> list[str]:
    """The columns of a table that texts name, in their order."""
    return sorted(c for c in rows.columns if c not in (key, *PARTS.get(table, ()), *(OUTSIDE if table == "samples" else ())))


def _beside(tables: Mapping[str, DataFrame], key: str) -> DataFrame:
    """(key, a struct __table for each table): the rows of all tables, each with the struct of its own: part, pos and plain values, which
    are narrower than a text."""
    out = None
    for table, rows in tables.items():
        name, number = (c if c in rows.columns else None for c in PARTS.get(table, (None, None)))
        part = F.coalesce(F.col(name).cast("string"), F.lit("")) if name else F.lit("")
        pos = F.coalesce(F.col(number).cast("long"), F.lit(-1)) if number else F.lit(0)
        values = [_plain(rows, c).alias(f"_{c}") for c in _under(table, rows, key)]
        its = rows.where(F.col(key).isNotNull()).select(key, F.struct(part.alias("part"), pos.cast("long").alias("pos"), *values).alias(f"__{table}"))
        out = its if out is None else out.unionByName(its, allowMissingColumns=True)
    return out


def texts(beside: DataFrame, tables: Mapping[str, DataFrame], key: str = "sample_id") -> DataFrame:
    """(key, part, pos, text) of the rows of _beside(): what a digest runs over, in the order of the last three."""
    own = {t: F.col(f"__{t}") for t in tables}
    part = F.coalesce(*(F.concat(F.lit(f"{t}/"), its.getField("part")) for t, its in own.items()))
    pos = F.coalesce(*(its.getField("pos") for its in own.values()))
    said = [F.when(own[t].isNotNull(), canonical(rows, {c: own[t].getField(f"_{c}") for c in _under(t, rows, key)})) for t, rows in tables.items()]
    return beside.select(key, part.alias("part"), pos.alias("pos"), F.coalesce(*said).alias("text"))


def _views(column: pa.Array) -> tuple[np.ndarray, memoryview]:
    """(n + 1 offsets, bytes) of a column of texts or bytes without nulls."""
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    return np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1], memoryview(data)


def _starts(keys: pa.Array) -> list[int]:
    """The rows at which a key begins that isn't that of the row before."""
    if pa.types.is_nested(keys.type):
        values = keys.to_pylist()
        return [0, *(i for i in range(1, len(values)) if values[i] != values[i - 1])]
    return [0, *(np.flatnonzero(pc.not_equal(keys.slice(1), keys.slice(0, len(keys) - 1)).to_numpy(zero_copy_only=False)) + 1).tolist()]


def stored_digests(tables: Mapping[str, DataFrame], key: str = "sample_id", as_bytes: bool = False) -> DataFrame:
    """(key, digest): SHA-256 over everything that the tables hold of a sample, in one order whatever order the rows are stored in.

    tables: samples and those of PARTS that there are, each with the key. Bytes of tiles are digested where they are read, and what
    is shuffled are plain values, of which texts are made where they arrive; each sample's texts run through one hash in order of part, number and text, a batch
    at a time, and a sample of any size needs no more memory than a batch. A sample's rows of a batch lie side by side and are hashed
    in one call. Rows without a key are under no digest. as_bytes: digests as their 32 bytes, half of their text, for a shuffle that follows."""
    held = {name: df for name, df in sorted(tables.items()) if name == "samples" or name in PARTS}
    rows = _beside(held, key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, h, kind = None, None, None
        for b in batches:
            if not b.num_rows:
                continue
            keys, kind = b.column(0), b.column(0).type
            (at, data), starts, done = _views(b.column(1)), _starts(keys), []
            firsts = keys.take(pa.array(starts)).to_pylist()
            for k, i, j in zip(firsts, starts, [*starts[1:], b.num_rows]):
                if h is None or k != now:
                    if h is not None:
                        done.append((now, h.digest()))
                    now, h = k, hashlib.sha256()
                h.update(data[at[i] : at[j]])
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], kind), pa.array([d[1] for d in done])], names=[key, "digest"])
        if h is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], kind), pa.array([h.digest()])], names=[key, "digest"])

    record = F.concat("part", F.lit("#"), F.col("pos").cast("string"), F.lit("#"), "text", F.lit("\n")).alias("record")
    out = in_order(rows, [key], ["part", "pos", "text"], run, f"`{key}` {rows.schema[key].dataType.simpleString()}, digest binary", [key, record], lambda dealt: texts(dealt, held, key))
    return out if as_bytes else out.withColumn("digest", _hex("digest"))


def _hex(digest: str) -> Column:
    return F.lower(F.hex(digest))


def _joined(samples: DataFrame, tables: Mapping[str, DataFrame], key: str, column: str) -> DataFrame:
    """samples with the digests of the tables as a column. Digests become texts after the join, so their bytes alone are shuffled."""
    found = stored_digests(tables, key, as_bytes=True).withColumnRenamed("digest", column)
    return samples.join(found, key, "left").withColumn(column, _hex(column))


def stamped(tables: Mapping[str, DataFrame], key: str = "sample_id") -> DataFrame:
    """samples with the digest of what the tables hold as their checksum."""
    return _joined(tables["samples"].drop(*OUTSIDE), tables, key, "checksum")


def computed(tables: Mapping[str, DataFrame], key: str = "sample_id") -> DataFrame:
    """samples with the column computed, the digest as the tables are now; what edits and audits hold against checksum."""
    return _joined(tables["samples"].drop("computed"), tables, key, "computed")


def audited(tables: Mapping[str, DataFrame], key: str = "sample_id") -> DataFrame:
    """(key, status, digest): ok, mismatch, or missing where samples have no checksum."""
    rows = computed(tables, key)
    stored = F.col("checksum") if "checksum" in rows.columns else F.lit(None).cast("string")
    return rows.select(key, verify(stored, F.col("computed")).alias("status"), F.col("computed").alias("digest"))


def restamps(key: str = "sample_id", **others: DataFrame) -> Callable[[Mapping[str, DataFrame]], DataFrame]:
    """The `digests` of edit.update(): those of the edited tables, and of the others that hold content (tiles, images, voxels)."""
    return lambda tables: stored_digests({**others, **tables}, key)
