"""NIfTI-1 as a data source of Spark: register(spark), then spark.read.format("nifti") and df.write.format("nifti").

Reading gives a row for each file: path, bytes, shape, dtype, affine, data (the values' own bytes, in C order, as tiles.cut takes
them) and error. Files are dealt to tasks by their sizes. With the option headers the values aren't read and there is no column
data: a task then reads a few hundred bytes of each file, however long it is. Options: pattern (of file names, `*.nii*`), headers,
partitionBytes (128 MB). A file that can't be parsed is a row with its error, and so is one whose values exceed a row of Spark, 2 GB.

Writing takes rows (name, shape, dtype, affine, data as bytes or a list of numbers). Tasks write to a hidden folder beside the
results; only a commit moves files to their names, so tasks that fail, or run twice, leave nothing. Mode append refuses names that
are there already, overwrite replaces those and leaves other files alone; a name that comes twice is an error and nothing is written.
An empty table writes nothing but the mark _SUCCESS. Paths are those of pyarrow.fs: local or mounted folders, hdfs, s3, gs."""

from __future__ import annotations

import fnmatch
import os
import struct
import time
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from ..errors import SourceError
from . import nifti

HEADERS = "path string, bytes bigint, shape array<bigint>, dtype string, affine array<double>, error string"
VOLUMES = "path string, bytes bigint, shape array<bigint>, dtype string, affine array<double>, data binary, error string"
_TYPES = {"path": pa.string(), "bytes": pa.int64(), "shape": pa.list_(pa.int64()), "dtype": pa.string(), "affine": pa.list_(pa.float64()), "data": pa.binary(), "error": pa.string()}
#: What a row's bytes, and those of a batch of rows, may come to.
ROW, BATCH = (1 << 31) - (1 << 20), 64 << 20
#: Enough of a file, packed or not, for its header.
START = 4096


def register(spark: SparkSession) -> None:
    spark.dataSource.register(NiftiSource)


def place(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path and the path in it."""
    if path.startswith("file:/"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return pafs.FileSystem.from_uri(os.path.abspath(path) if ":/" not in path else path)


@dataclass
class Files(InputPartition):
    """Files of one task: paths and sizes."""

    files: list[tuple[str, int]]


class NiftiSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "nifti"

    def schema(self) -> str:
        return HEADERS if self.options.get("headers", "false").lower() == "true" else VOLUMES

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options, schema.names)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        if lost := [c for c in ("name", "shape", "dtype", "affine", "data") if c not in schema.names]:
            raise SourceError(f"no column {', '.join(lost)}")
        return _Writer(self.options["path"], overwrite)


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str], names: list[str]) -> None:
        self.path, self.pattern = options["path"], options.get("pattern", "*.nii*")
        self.most, self.names = int(options.get("partitionBytes", 128 << 20)), names

    def partitions(self) -> list[Files]:
        """Files in the order of their paths, as many to a task as fit partitionBytes; with headers alone a file weighs its start."""
        fs, root = place(self.path)
        info = fs.get_file_info(root)
        if info.type == pafs.FileType.NotFound:
            raise SourceError(f"{self.path}: no such folder")
        found = [info] if info.is_file else fs.get_file_info(pafs.FileSelector(root, recursive=True))
        hidden = lambda p: any(part[:1] in (".", "_") for part in p[len(root) :].split("/"))
        files = sorted((f.path, f.size) for f in found if f.is_file and (info.is_file or not hidden(f.path)) and fnmatch.fnmatch(f.base_name, self.pattern))
        parts, held, size = [], [], 0
        for path, n in files:
            weight = (n if "data" in self.names else START) + (1 << 16)
            if held and size + weight > self.most:
                parts.append(Files(held))
                held, size = [], 0
            held.append((path, n))
            size += weight
        return [*parts, Files(held)] if held or not parts else parts

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(c, _TYPES[c]) for c in self.names])
        fs, _ = place(self.path)
        rows, size = [], 0
        for path, n in partition.files:
            row = self._row(fs, path, n)
            rows.append(row)
            size += len(row.get("data") or b"")
            if size >= BATCH or len(rows) >= 1000:
                yield pa.RecordBatch.from_pylist(rows, schema)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)

    def _row(self, fs: pafs.FileSystem, path: str, n: int) -> dict:
        row = {"path": path, "bytes": n}
        try:
            head = nifti.header(_start(fs, path))
            if "data" in self.names:
                width = 8 if nifti.scaled(head) else head["kind"].itemsize
                if int(np.prod(head["shape"], dtype=object)) * width > ROW:
                    raise SourceError("values over 2 GB don't fit a row")
                with fs.open_input_stream(path, compression=None) as f:
                    _, values = nifti.stored(f.read())
                if nifti.scaled(head):
                    values, head["dtype"] = values * head["slope"] + head["inter"], "float64"
                row["data"] = np.ascontiguousarray(values, values.dtype.newbyteorder("<")).tobytes()
            row |= {c: head[c] for c in ("shape", "dtype", "affine")}
        except (SourceError, struct.error, OSError, EOFError, ValueError, zlib.error) as e:
            row = {"path": path, "bytes": n, "error": str(e)}
        return row


def _start(fs: pafs.FileSystem, path: str) -> bytes:
    """The first bytes of a file, unpacked if it is packed; more of it is read only where a packed start is too short."""
    with fs.open_input_stream(path, compression=None) as f:
        start = f.read(START)
        if start[:2] != b"\x1f\x8b":
            return start
        unpack, out = zlib.decompressobj(31), b""
        while start and len(out) < nifti.HEADER:
            out += unpack.decompress(start, nifti.OFFSET - len(out))
            start = unpack.unconsumed_tail or f.read(START)
    return out


@dataclass
class Written(WriterCommitMessage):
    """Files that a task wrote: hidden paths, and the names they are to have."""

    files: list[tuple[str, str]]


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool) -> None:
        self.path, self.overwrite = path.rstrip("/"), overwrite
        self.hidden = f".writing-{uuid.uuid4().hex}"
        fs, root = place(self.path)  # here, on the driver: tasks that run on after an abort find it gone, and don't make it again
        fs.create_dir(f"{root}/{self.hidden}", recursive=True)

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        fs, root = place(self.path)
        own, done = f"{root}/{self.hidden}/{uuid.uuid4().hex}", []
        fs.create_dir(own, recursive=False)
        for b in batches:
            for i in range(b.num_rows):
                r = {c: b.column(c)[i] for c in ("name", "shape", "dtype", "affine", "data")}
                name = r["name"].as_py()
                if not name or name.startswith("/") or ".." in name.split("/"):
                    raise SourceError(f"{name!r} is no name of a file in a folder")
                if lost := [c for c in ("shape", "dtype", "data") if not r[c].is_valid]:
                    raise SourceError(f"{name}: no {', '.join(lost)}")
                kind, x = np.dtype(r["dtype"].as_py()), r["data"]
                values = np.frombuffer(x.as_buffer(), kind) if isinstance(x, (pa.BinaryScalar, pa.LargeBinaryScalar)) else x.values.to_numpy(zero_copy_only=False).astype(kind)
                shape = r["shape"].as_py()
                if values.size != np.prod(shape):
                    raise SourceError(f"{name}: {values.size} values for the shape {shape}")
                affine = np.array(r["affine"].as_py(), dtype=float).reshape(4, 4) if r["affine"].is_valid else np.eye(4)
                part = f"{own}/{len(done)}"
                with fs.open_output_stream(part, compression=None) as f:
                    f.write(nifti.build(values.reshape(shape), affine, compress=name.endswith(".gz")))
                done.append((part, name))
        return Written(done)

    def commit(self, messages: list[Written | None]) -> None:
        """Moves files to their names, then marks the folder; nothing is moved if a name is taken or comes twice."""
        fs, root = place(self.path)
        files = [f for m in messages if m for f in m.files]
        names = [n for _, n in files]
        try:
            if len(set(names)) < len(names):
                seen: set[str] = set()
                twice = next(n for n in names if n in seen or seen.add(n))
                raise SourceError(f"{twice} comes twice")
            if not self.overwrite:
                for at in range(0, len(names), 1000):
                    for info in fs.get_file_info([f"{root}/{n}" for n in names[at : at + 1000]]):
                        if info.type != pafs.FileType.NotFound:
                            raise SourceError(f"{info.path} is there already")
            for folder in {n.rpartition("/")[0] for n in names}:
                fs.create_dir(f"{root}/{folder}".rstrip("/"), recursive=True)
            for part, name in files:
                self._replace(fs, part, f"{root}/{name}")
        finally:
            self._clear(fs, root)
        with fs.open_output_stream(f"{root}/_SUCCESS") as f:
            f.write(b"")

    def _replace(self, fs: pafs.FileSystem, part: str, path: str) -> None:
        """A move that replaces; elsewhere than in local folders a move doesn't. A checksum that Hadoop keeps of an older file goes."""
        folder, name = os.path.split(path)
        stale = [f"{folder}/.{name}.crc"] if fs.type_name == "local" else [path]
        for info in fs.get_file_info(stale) if self.overwrite else ():
            if info.type != pafs.FileType.NotFound:
                fs.delete_file(info.path)
        fs.move(part, path)

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(*place(self.path))

    def _clear(self, fs: pafs.FileSystem, root: str) -> None:
        """Again, if tasks that still run put something into the folder meanwhile."""
        for left in range(9, -1, -1):
            try:
                return fs.delete_dir(f"{root}/{self.hidden}")
            except FileNotFoundError:
                return None
            except OSError:
                if not left:
                    raise
                time.sleep(0.1)
