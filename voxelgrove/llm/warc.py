"""WARC records and their Merkle fixity audit.

Records lie in files, in order, with byte offsets. The leaf of a record is the SHA-256 of its bytes with its place
and range of offsets; a node hashes the ranges and digests of its children in order, over FANOUT consecutive
positions. So a node differs if bytes changed, or if records moved. Files are the leaves of an upper tree. Two
replicas are compared from the root, and only the children of nodes that differ are compared next.

write_files() stores records as .warc files, stored_records() reads stored files into the table that audit() takes.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import settle

FANOUT = 16
#: Records of a file: bounds its window and the height of its tree.
PER_FILE = 1024


def warc_record(record_id: Column, url: Column, body: Column) -> Column:
    """The bytes of a WARC/1.0 response record; nulls count as empty."""
    body = F.coalesce(body, F.lit("")).cast("binary")
    head = F.concat(F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:record:"), record_id.cast("string"), F.lit(">\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")), F.lit("\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"))
    return F.concat(head.cast("binary"), body, F.lit("\r\n\r\n").cast("binary"))


def records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", per_file: int = PER_FILE) -> DataFrame:
    """(file, pos, record_id, offset, length, digest): ids in order, per_file consecutive ids to a file.

    pos is the id's place in its file, so a missing record doesn't move the others. Only digests and lengths
    are shuffled. Rows without an id are left out; further rows of one id, in the order of their digests, have
    places behind those of all ids."""
    rec = warc_record(F.col(id_col), F.col(url_col), F.col(body_col))
    rows = pages.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("record_id"), F.octet_length(rec).cast("long").alias("length"), F.sha2(rec, 256).alias("digest"))
    rows = rows.withColumn("file", F.floor(F.col("record_id") / per_file).cast("long"))
    order = Window.partitionBy("file").orderBy("record_id", "digest")
    end = F.sum("length").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    again = F.row_number().over(Window.partitionBy("file", "record_id").orderBy("digest")) - 1
    return rows.select("file", (F.pmod("record_id", F.lit(per_file)) + again * per_file).cast("long").alias("pos"), "record_id", (end - F.col("length")).alias("offset"), "length", "digest")


def write_files(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", per_file: int = PER_FILE) -> DataFrame:
    """(file, name, n, length): the files that the tasks have written to folder (a path or URI that all executors reach).

    Records and their order are those of records(). A file is one group's work, at most per_file ids; it is written under a
    name of its own and then moved to <file>.warc, so a task that runs again does no harm. Rows without an id are left out."""
    rec = warc_record(F.col(id_col), F.col(url_col), F.col(body_col))
    rows = pages.where(F.col(id_col).isNotNull()).select(F.floor(F.col(id_col) / per_file).cast("long").alias("file"), F.col(id_col).cast("long").alias("record_id"), rec.alias("record"))

    def run(group: pa.Table) -> pa.Table:
        at = group.column("file")[0].as_py()
        store, path = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)
        store.create_dir(path, recursive=True)
        name, temporary = f"{path.rstrip('/')}/{at:012d}.warc", f"{path.rstrip('/')}/.{uuid.uuid4().hex}"
        rows = sorted(zip(group.column("record_id").to_pylist(), group.column("record").to_pylist()), key=lambda r: (r[0], hashlib.sha256(r[1]).hexdigest()))
        with store.open_output_stream(temporary) as out:
            for _, record in rows:
                out.write(record)
        store.move(temporary, name)
        return pa.table({"file": [at], "name": [name], "n": [len(rows)], "length": [sum(len(r) for _, r in rows)]})

    return rows.groupBy("file").applyInArrow(run, "file long, name string, n long, length long")


_LENGTH = re.compile(rb"\r\nContent-Length: *(\d+)", re.I)
_ID = re.compile(rb"\r\nWARC-Record-ID: *<urn:record:(-?\d+)>", re.I)


def split_file(data: bytes) -> Iterator[tuple[int | None, int, bytes]]:
    """(record id, offset, bytes) of a stored file's records. Where a head can't be read, all up to the next head that can
    (or the end) is one record without an id, so damage to a head costs no other record."""
    at = 0
    while at < len(data):
        end, found = data.find(b"\r\n\r\n", at), None
        if data.startswith(b"WARC/", at) and end >= 0 and (size := _LENGTH.search(data, at, end + 2)):
            stop = end + 4 + int(size[1])
            if data[stop : stop + 4] == b"\r\n\r\n":
                found, name = stop + 4, _ID.search(data, at, end + 2)
        if found is None:
            after = data.find(b"\r\n\r\nWARC/", at)
            found, name = len(data) if after < 0 else after + 4, None
        yield int(name[1]) if name else None, at, data[at:found]
        at = found


def stored_records(spark: SparkSession, folder: str, per_file: int = PER_FILE) -> DataFrame:
    """(file, pos, record_id, offset, length, digest) of the .warc files in folder, as records() has them.

    A file is read whole by one task: files stay far below the 2 GB of a binary column. A record without a readable id gets the
    place after the record before it, if no other record is there, else one behind all ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, data in zip(b.column("path").to_pylist(), b.column("content")):
                at = int(path.rpartition("/")[2].removesuffix(".warc"))
                rows, again = [], {}
                for record, offset, body in split_file(data.as_buffer().to_pybytes()):
                    rows.append([record, offset, len(body), hashlib.sha256(body).hexdigest()])
                named = {r[0] % per_file for r in rows if r[0] is not None}
                last, spare, places = -1, per_file * (len(rows) + 1), []
                for r in rows:
                    if r[0] is not None:
                        place = last = r[0] % per_file
                        again[place] = again.get(place, -1) + 1
                        places.append(place + again[place] * per_file)
                    elif last + 1 < per_file and last + 1 not in named:
                        last += 1
                        named.add(last)
                        places.append(last)
                        r[0] = at * per_file + last
                    else:
                        places.append(spare)
                        spare += 1
                columns = list(zip(*rows)) if rows else [(), (), (), ()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([at] * len(rows), pa.int64()), pa.array(places, pa.int64()), *(pa.array(list(c), t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string())))],
                    names=["file", "pos", "record_id", "offset", "length", "digest"],
                )

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc").load(folder).select("path", "content")
    return files.mapInArrow(run, "file long, pos long, record_id long, offset long, length long, digest string")


def _parents(nodes: DataFrame, fanout: int) -> DataFrame:
    """One level up: nodes (tree, pos, offset, length, digest). A parent's digest is of its children's places, ranges and digests."""
    kids = F.array_sort(F.collect_list(F.struct("pos", "offset", "length", "digest")))
    text = F.array_join(F.transform(kids, lambda k: F.concat_ws(":", *(k[c].cast("string") for c in ("pos", "offset", "length", "digest")))), "\n")
    return nodes.groupBy("tree", F.floor(F.col("pos") / fanout).cast("long").alias("pos")).agg(
        F.min("offset").alias("offset"), F.sum("length").cast("long").alias("length"), F.sha2(text, 256).alias("digest")
    )


def merkle_levels(leaves: DataFrame, fanout: int = FANOUT) -> list[DataFrame]:
    """The levels of the trees of leaves (tree, pos, offset, length, digest), leaves first, until each is one node."""
    levels = [settle(leaves)]
    while (levels[-1].agg(F.max("pos")).first()[0] or 0) > 0:
        levels.append(settle(_parents(levels[-1], fanout)))
    return levels


def _differ(a: DataFrame, b: DataFrame) -> DataFrame:
    """(tree, pos, expected, found, moved) of nodes whose digest or range differs, or that one side lacks."""
    sides = [x.select("tree", "pos", F.col("digest").alias(n), F.struct("offset", "length").alias(n + "_range")) for x, n in ((a, "expected"), (b, "found"))]
    both = sides[0].join(sides[1], ["tree", "pos"], "full")
    same = F.col("expected").eqNullSafe(F.col("found"))
    moved = same & ~F.col("expected_range").eqNullSafe(F.col("found_range"))
    return both.where(~same | moved).select("tree", "pos", "expected", "found", moved.alias("moved"))


def _descend(a: list[DataFrame], b: list[DataFrame], fanout: int, start: DataFrame | None = None) -> DataFrame:
    """Differing leaves of two forests of one height, reached only through differing nodes; start: trees to look at."""
    height = max(len(a), len(b))
    for side in (a, b):
        while len(side) < height:
            side.append(_parents(side[-1], fanout))

    def within(level: DataFrame, marks: DataFrame | None, keys: list[str]) -> DataFrame:
        if marks is None:
            return level
        level = level.withColumn("up", F.floor(F.col("pos") / fanout).cast("long"))
        return level.join(marks.select(*(F.col(c).alias("up" if c == "pos" else c) for c in keys)).distinct(), ["up" if c == "pos" else c for c in keys], "left_semi")

    marks, keys = start, ["tree"]
    for x, y in zip(reversed(a), reversed(b)):
        marks, keys = settle(_differ(within(x, marks, keys), within(y, marks, keys))), ["tree", "pos"]
    return marks


def audit(expected: DataFrame, found: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """(file, pos, record_id, offset, length, expected, found, moved) of the records that differ between two replicas.

    expected and found are tables of records() or stored_records(). moved: the bytes are the same at another offset. First an upper tree over the file roots narrows the audit to
    files, then each bad file's tree is descended. A record that one replica lacks has a null digest on that
    side, and the offset and length of the other. Equal or empty replicas give no rows."""
    expected, found = settle(expected), settle(found)  # each record is read and hashed once
    trees, roots = [], []
    for side in (expected, found):
        leaves = side.select(F.col("file").alias("tree"), "pos", "offset", "length", "digest")
        trees.append(merkle_levels(leaves, fanout))
    height = max(map(len, trees))
    for levels in trees:
        while len(levels) < height:
            levels.append(settle(_parents(levels[-1], fanout)))
        roots.append(merkle_levels(levels[-1].select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("pos"), "offset", "length", "digest"), fanout))
    files = _descend(roots[0], roots[1], fanout).select(F.col("pos").alias("tree"))
    bad = _descend(trees[0], trees[1], fanout, files).withColumnRenamed("tree", "file")
    for name, side in (("e", expected), ("f", found)):
        side = side.select("file", "pos", *(F.col(c).alias(c + name) for c in ("record_id", "offset", "length")))
        bad = bad.join(side, ["file", "pos"], "left")
    return bad.select("file", "pos", *(F.coalesce(c + "e", c + "f").alias(c) for c in ("record_id", "offset", "length")), "expected", "found", "moved")


def fixity(expected: DataFrame, found: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """The records of the expected replica, each with status: ok, corrupt (the digest differs), moved (only its offset does) or missing."""
    expected = settle(expected)
    status = F.when(F.col("found").isNull(), "missing").when(F.col("moved"), "moved").otherwise("corrupt")
    bad = audit(expected, found, fanout).where("expected is not null").select("file", "pos", status.alias("status"), "found")
    return expected.join(bad, ["file", "pos"], "left").withColumn("status", F.coalesce("status", F.lit("ok")))
