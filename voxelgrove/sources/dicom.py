"""DICOM slices: a parser and a writer of Part 10 files, little endian, with plain pixels.

The layout is that of the standard's Parts 5 and 10: a preamble, a group of file meta elements in explicit VR, then a data set in the
transfer syntax that they name. Sequences are passed over, whatever their lengths say. Files that can't be read are rows with a problem."""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

IMPLICIT, EXPLICIT, DEFLATED = "1.2.840.10008.1.2", "1.2.840.10008.1.2.1", "1.2.840.10008.1.2.1.99"
#: Fixed by the standard: value representations whose length takes four bytes, those that are numbers, and those that are text.
LONG = {"OB", "OD", "OF", "OL", "OV", "OW", "SQ", "SV", "UC", "UN", "UR", "UT", "UV"}
NUMBERS = {"US": "<u2", "SS": "<i2", "UL": "<u4", "SL": "<i4", "FL": "<f4", "FD": "<f8", "SV": "<i8", "UV": "<u8"}
TEXTS = {"AE", "AS", "CS", "DA", "DS", "DT", "IS", "LO", "LT", "PN", "SH", "ST", "TM", "UC", "UI", "UR", "UT"}
#: The elements that a slice is made of, with their representations, as implicit files don't say them: fixed by the standard.
SERIES, POSITION, ORIENTATION, SPACING, THICKNESS = 0x0020000E, 0x00200032, 0x00200037, 0x00280030, 0x00180050
SLOPE, INTERCEPT, ROWS, COLUMNS, BITS, SIGNED, SAMPLES, FRAMES = 0x00281053, 0x00281052, 0x00280010, 0x00280011, 0x00280100, 0x00280103, 0x00280002, 0x00280008
CHARSET, PIXELS, SYNTAX = 0x00080005, 0x7FE00010, 0x00020010
VRS = {
    SERIES: "UI", POSITION: "DS", ORIENTATION: "DS", SPACING: "DS", THICKNESS: "DS", SLOPE: "DS", INTERCEPT: "DS", FRAMES: "IS", CHARSET: "CS", PIXELS: "OW", SYNTAX: "UI",
    ROWS: "US", COLUMNS: "US", BITS: "US", SIGNED: "US", SAMPLES: "US", 0x00100020: "LO", 0x0020000D: "UI", 0x00080018: "UI", 0x00200052: "UI", 0x00200013: "IS", 0x00080060: "CS",
}
#: What tells images, series and grids apart, kept beside the pixels: patient, study, series, image, frame of reference, number, kind.
KEEP = (0x00100020, 0x0020000D, SERIES, 0x00080018, 0x00200052, 0x00200013, 0x00080060)
ITEM, ITEM_END, SEQUENCE_END, UNDEFINED = 0xFFFEE000, 0xFFFEE00D, 0xFFFEE0DD, 0xFFFFFFFF
#: Pixels and slices that a task holds before it gives them back.
PIXELS_HELD, ROWS_HELD = 1 << 20, 1000
CODECS = {"ISO_IR 100": "latin-1", "ISO_IR 192": "utf-8"}

SLICES = (
    "path string, uid string, position array<double>, row_dir array<double>, col_dir array<double>, pixel_spacing array<double>, thickness double, slope double, intercept double, shape array<bigint>, data array<double>, tags string, problem string"
)
_NAMES = [c.split(" ")[0] for c in SLICES.split(", ")]


class Problem(ValueError):
    """Why a file gives no slice."""


class Reader:
    """The elements of a data set, one after the other."""

    def __init__(self, data: memoryview, at: int, explicit: bool):
        self.data, self.at, self.explicit = data, at, explicit

    def _take(self, form: str) -> tuple:
        size = struct.calcsize(form)
        if self.at + size > len(self.data):
            raise Problem("the file is cut short")
        out = struct.unpack_from(form, self.data, self.at)
        self.at += size
        return out

    def head(self) -> tuple[int, str, int]:
        """(tag, vr, length) of the next element; delimiters have no representation."""
        group, element = self._take("<HH")
        tag = group << 16 | element
        if group == 0xFFFE or not self.explicit:
            return tag, VRS.get(tag, "UN"), self._take("<I")[0]
        vr = bytes(self._take("2s")[0]).decode("latin-1")
        if not (vr.isalpha() and vr.isupper()):
            raise Problem(f"{vr!r} is no value representation")
        return (tag, vr, self._take("<2xI")[0]) if vr in LONG else (tag, vr, self._take("<H")[0])

    def skip(self, vr: str, length: int) -> None:
        """Past a value; one of undefined length ends where its items do."""
        if length != UNDEFINED:
            if self.at + length > len(self.data):
                raise Problem("the file is cut short")
            self.at += length
            return
        # An unknown value of undefined length is a sequence in implicit form.
        inner = Reader(self.data, self.at, self.explicit and vr != "UN")
        open_items = [SEQUENCE_END]
        while open_items:
            tag, vr, length = inner.head()
            if tag == open_items[-1]:
                open_items.pop()
            elif tag == ITEM and open_items[-1] == SEQUENCE_END:
                if length == UNDEFINED:
                    open_items.append(ITEM_END)
                else:
                    inner.skip("", length)
            elif length == UNDEFINED:
                open_items.append(SEQUENCE_END)
            else:
                inner.skip(vr, length)
        self.at = inner.at


def elements(content: bytes) -> tuple[dict[int, tuple[str, memoryview]], str]:
    """({tag: (vr, bytes)}, transfer syntax) of a file's own elements, pixels included, sequences not."""
    if content[128:132] != b"DICM":
        raise Problem("not a DICOM file")
    data = memoryview(content)
    meta, syntax = Reader(data, 132, True), IMPLICIT
    while meta.at + 2 <= len(data) and data[meta.at : meta.at + 2] == b"\x02\x00":
        tag, vr, length = meta.head()
        at = meta.at
        meta.skip(vr, length)
        if tag == SYNTAX:
            syntax = bytes(data[at : meta.at]).rstrip(b"\0 ").decode("latin-1")
    if syntax not in (IMPLICIT, EXPLICIT, DEFLATED):
        raise Problem(f"pixels or elements in the transfer syntax {syntax} aren't read")
    if syntax == DEFLATED:
        body = zlib.decompressobj(-15)
        data, meta.at = memoryview(body.decompress(data[meta.at :])), 0
    body, found = Reader(data, meta.at, syntax != IMPLICIT), {}
    while body.at < len(data):
        tag, vr, length = body.head()
        at = body.at
        if tag == PIXELS and length == UNDEFINED:
            raise Problem("the pixels are compressed")
        body.skip(vr, length)
        if vr != "SQ" and length != UNDEFINED:
            found[tag] = vr, data[at : body.at]
    return found, syntax


def value(vr: str, raw: memoryview, codec: str = "latin-1") -> list:
    """An element's values as numbers or texts; of other representations none."""
    if vr in NUMBERS:
        return np.frombuffer(raw, NUMBERS[vr]).tolist()
    if vr not in TEXTS:
        return []
    text = bytes(raw).decode(codec, "replace").rstrip("\0 ")
    parts = [text] if vr in ("LT", "ST", "UT", "UR") else text.split("\\")
    if vr in ("DS", "IS"):
        return [float(p) if vr == "DS" else int(p) for p in parts if p.strip()]
    return [p.strip(" ") for p in parts] if text else []


def as_json(found: dict[int, tuple[str, memoryview]], keep: Sequence[int], codec: str) -> str:
    """Elements in the standard's JSON model: {"GGGGEEEE": {"vr": ..., "Value": [...]}}, those that are there."""
    return json.dumps({f"{t:08X}": {"vr": found[t][0], "Value": value(*found[t], codec)} for t in keep if t in found})


def parse(path: str | None, content: bytes, keep: Sequence[int] = KEEP) -> dict:
    """A row of SLICES; one that gives no slice has its path and its problem."""
    row = dict.fromkeys(_NAMES) | {"path": path}
    try:
        found, _ = elements(content)
        if PIXELS not in found:
            raise Problem("no pixels")

        def numbers(tag: int, n: int | None = None) -> list | None:
            got = value(VRS[tag], found[tag][1]) if tag in found else []
            if got and n is not None and len(got) != n:
                raise Problem(f"element {tag:08X} has {len(got)} values, not {n}")
            return got or None

        one = lambda tag, other=None: (numbers(tag, 1) or [other])[0]
        if one(SAMPLES, 1) != 1 or one(FRAMES, 1) != 1:
            raise Problem("colours or several frames in one file")
        bits, shape = one(BITS), [one(ROWS), one(COLUMNS)]
        if bits not in (8, 16, 32) or None in shape:
            raise Problem("no size of the image, or pixels of other than 8, 16 or 32 bits")
        raw, size = found[PIXELS][1], shape[0] * shape[1] * bits // 8
        if len(raw) < size:
            raise Problem("fewer pixels than the image has")
        charset = value(*found[CHARSET]) if CHARSET in found else []
        turn = [float(x) for x in numbers(ORIENTATION, 6) or []]
        uid = value("UI", found[SERIES][1]) if SERIES in found else []
        row |= {
            "uid": uid[0] if uid else None, "position": numbers(POSITION, 3), "row_dir": turn[:3] or None, "col_dir": turn[3:] or None, "pixel_spacing": numbers(SPACING, 2),
            "thickness": one(THICKNESS), "slope": one(SLOPE), "intercept": one(INTERCEPT), "shape": shape, "tags": as_json(found, keep, CODECS.get((charset or [""])[0], "latin-1")),
            "data": np.frombuffer(raw[:size], f"<{'i' if one(SIGNED, 0) else 'u'}{bits // 8}").astype(np.float64),
        }
    except (ValueError, struct.error, zlib.error) as e:
        row = dict.fromkeys(_NAMES) | {"path": path, "problem": str(e)}
    return row


def _types() -> pa.Schema:
    kinds = {"string": pa.string(), "double": pa.float64(), "array<double>": pa.list_(pa.float64()), "array<bigint>": pa.list_(pa.int64())}
    return pa.schema([(c, kinds[t]) for c, t in (x.split(" ") for x in SLICES.split(", "))])


def parsed(files: DataFrame, keep: Sequence[int] = KEEP) -> DataFrame:
    """SLICES of files (path, content), one row for each. keep: tags that go along as JSON."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types, rows, pixels = _types(), [], 0
        for b in batches:
            for path, content in zip(b.column(0), b.column(1)):
                rows.append(parse(path.as_py(), content.as_py() or b"", keep))
                pixels += 0 if rows[-1]["data"] is None else len(rows[-1]["data"])
                if pixels >= PIXELS_HELD or len(rows) >= ROWS_HELD:
                    yield pa.RecordBatch.from_pylist(rows, types)
                    rows, pixels = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, types)

    return files.select("path", "content").mapInArrow(run, SLICES)


def read_dicom(spark: SparkSession, root: str, keep: Sequence[int] = KEEP) -> DataFrame:
    """SLICES of every file below a folder, of any series."""
    return parsed(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root), keep)


def encode(row: dict, syntax: str = EXPLICIT) -> bytes:
    """A file of one slice: uid, position, row_dir, col_dir, pixel_spacing, thickness, slope, intercept, shape and whole numbers of 16 bits as data; nulls are left out."""
    text = lambda values: "\\".join(f"{v:.12g}" for v in values)
    have = {ROWS: struct.pack("<H", row["shape"][0]), COLUMNS: struct.pack("<H", row["shape"][1]), BITS: struct.pack("<H", 16), SIGNED: struct.pack("<H", 1), SAMPLES: struct.pack("<H", 1), PIXELS: np.asarray(row["data"], "<i2").tobytes()}
    turn = [*row["row_dir"], *row["col_dir"]] if row.get("row_dir") and row.get("col_dir") else None
    said = {SERIES: [row["uid"]] if row.get("uid") is not None else None, POSITION: row.get("position"), ORIENTATION: turn, SPACING: row.get("pixel_spacing")}
    said |= {t: None if row.get(c) is None else [row[c]] for t, c in ((THICKNESS, "thickness"), (SLOPE, "slope"), (INTERCEPT, "intercept"))}
    have |= {t: (v[0] if t == SERIES else text(v)).encode() for t, v in said.items() if v is not None}

    def element(tag: int, raw: bytes, explicit: bool) -> bytes:
        vr = VRS[tag]
        raw += (b"\0" if vr in ("UI", "OW") else b" ") * (len(raw) % 2)
        place = struct.pack("<HH", tag >> 16, tag & 0xFFFF)
        if not explicit:
            return place + struct.pack("<I", len(raw)) + raw
        return place + vr.encode() + (struct.pack("<2xI", len(raw)) if vr in LONG else struct.pack("<H", len(raw))) + raw

    body = b"".join(element(t, have[t], syntax != IMPLICIT) for t in sorted(have))
    if syntax == DEFLATED:
        z = zlib.compressobj(wbits=-15)
        body = z.compress(body) + z.flush()
    return b"\0" * 128 + b"DICM" + element(SYNTAX, syntax.encode(), True) + body


def encoded(slices: DataFrame, syntax: str = "syntax") -> DataFrame:
    """(path, content) of slices with the columns that encode() names, a path, and the transfer syntax in a column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = b.to_pylist()
            yield pa.RecordBatch.from_arrays([b.column("path"), pa.array([encode(r, r[syntax]) for r in rows], pa.binary())], names=["path", "content"])

    return slices.mapInArrow(run, "path string, content binary")


def slices(rows: DataFrame) -> DataFrame:
    """Those of SLICES that are slices."""
    return rows.where(F.col("problem").isNull())
