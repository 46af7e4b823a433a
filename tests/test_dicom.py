"""The DICOM parser on files that are built here, element by element."""

import json
import random
import struct

import numpy as np
import pytest

from voxelgrove import cli
from voxelgrove.operators import series
from voxelgrove.sources import dicom


def slice_row(k, uid="1.2.3", n=4, **odd):
    return {
        "path": f"p{k}", "uid": uid, "position": [1.5, -2.25, 2.5 * k], "row_dir": [1.0, 0.0, 0.0], "col_dir": [0.0, 1.0, 0.0], "pixel_spacing": [0.5, 0.25], "thickness": 3.0, "slope": 2.0, "intercept": -1024.0,
        "shape": [3, n], "data": [(17 * k + 5 * i) % 4000 - 2000 for i in range(3 * n)],
    } | odd


def element(tag, vr, raw, explicit=True):
    place = struct.pack("<HH", tag >> 16, tag & 0xFFFF)
    if not explicit:
        return place + struct.pack("<I", len(raw)) + raw
    return place + vr + (struct.pack("<2xI", len(raw)) if vr.decode() in dicom.LONG else struct.pack("<H", len(raw))) + raw


def with_sequences(explicit):
    """A private text, and sequences nested in all three ways, before the elements that count; one of them holds a tag that counts."""
    item = lambda raw: struct.pack("<HHI", 0xFFFE, 0xE000, len(raw)) + raw
    open_item = lambda raw: struct.pack("<HHI", 0xFFFE, 0xE000, 0xFFFFFFFF) + raw + struct.pack("<HHI", 0xFFFE, 0xE00D, 0)
    open_sq = lambda tag, raw: (struct.pack("<HH", tag >> 16, tag & 0xFFFF) + (b"SQ\0\0" if explicit else b"") + struct.pack("<I", 0xFFFFFFFF) + raw + struct.pack("<HHI", 0xFFFE, 0xE0DD, 0))
    inner = element(dicom.ROWS, b"US", struct.pack("<H", 77), explicit)
    out = element(0x00090010, b"LO", b"PRIVATE ", explicit)
    out += element(0x00081140, b"SQ", item(inner) + item(b""), explicit)
    out += open_sq(0x00081150, open_item(inner + open_sq(0x00081160, open_item(inner) + item(inner))) + item(inner))
    if explicit:  # an unknown value of undefined length holds implicit elements
        out += struct.pack("<HH", 0x0009, 0x1001) + b"UN\0\0" + struct.pack("<I", 0xFFFFFFFF) + open_item(element(dicom.ROWS, b"US", struct.pack("<H", 78), False)) + struct.pack("<HHI", 0xFFFE, 0xE0DD, 0)
    return out


@pytest.mark.parametrize("syntax", [dicom.IMPLICIT, dicom.EXPLICIT, dicom.DEFLATED])
def test_written_slices_come_back(syntax):
    row = slice_row(3)
    got = dicom.parse("p3", dicom.encode(row, syntax))
    assert got["problem"] is None and got["data"].tolist() == row["data"] and got["uid"] == "1.2.3" and got["shape"] == [3, 4]
    assert {c: got[c] for c in ("position", "row_dir", "col_dir", "pixel_spacing", "thickness", "slope", "intercept")} == {c: row[c] for c in ("position", "row_dir", "col_dir", "pixel_spacing", "thickness", "slope", "intercept")}
    bare = dicom.parse("x", dicom.encode({"shape": [1, 2], "data": [7, -7]}, syntax))
    assert bare["problem"] is None and bare["data"].tolist() == [7, -7] and all(bare[c] is None for c in ("uid", "position", "row_dir", "thickness", "slope"))


@pytest.mark.parametrize("syntax", [dicom.IMPLICIT, dicom.EXPLICIT])
def test_sequences_are_passed_over(syntax):
    whole = dicom.encode(slice_row(1), syntax)
    at = 132 + len(element(dicom.SYNTAX, b"UI", syntax.encode() + b"\0" * (len(syntax) % 2)))
    got = dicom.parse("p", whole[:at] + with_sequences(syntax == dicom.EXPLICIT) + whole[at:])
    assert got["problem"] is None and got["shape"] == [3, 4] and got["data"].tolist() == slice_row(1)["data"]


def test_values_by_representation_and_tags_as_json():
    assert dicom.value("DS", b"1.5\\ -2e3 ") == [1.5, -2000.0] and dicom.value("IS", b"") == [] and dicom.value("US", struct.pack("<2H", 1, 65535)) == [1, 65535]
    assert dicom.value("LO", b"a \\b\0") == ["a", "b"] and dicom.value("UT", b"a\\b") == ["a\\b"] and dicom.value("PN", "Müller".encode(), "utf-8") == ["Müller"] and dicom.value("OB", b"x") == []
    whole = dicom.encode(slice_row(1))
    at = 132 + len(element(dicom.SYNTAX, b"UI", dicom.EXPLICIT.encode() + b"\0"))
    more = element(dicom.CHARSET, b"CS", b"ISO_IR 192") + element(0x00100020, b"LO", "Mü1".encode())
    tags = json.loads(dicom.parse("p", whole[:at] + more + whole[at:])["tags"])
    assert tags == {"00100020": {"vr": "LO", "Value": ["Mü1"]}, "0020000E": {"vr": "UI", "Value": ["1.2.3"]}}


def test_bad_files_are_problems():
    good = dicom.encode(slice_row(1))
    said = lambda content: dicom.parse("p", content)["problem"]
    assert said(b"") == said(b"x" * 500) == "not a DICOM file"
    assert "cut short" in said(good[:-5]) and "1.2.840.10008.1.2.4.50" in said(good.replace(dicom.EXPLICIT.encode() + b"\0", b"1.2.840.10008.1.2.4.50")[:200].replace(b"UI\x14\0", b"UI\x16\0") + b"")
    at = good.index(struct.pack("<HH", 0x7FE0, 0x0010))
    assert said(good[:at]) == "no pixels" and said(good[:at] + good[at:].replace(b"OW\0\0\x18\0\0\0", b"OW\0\0\x04\0\0\0")[:16]) == "fewer pixels than the image has"
    assert said(good[:at] + b"\xe0\x7f\x10\0OB\0\0\xff\xff\xff\xff") == "the pixels are compressed"
    assert "3 values, not 2" in said(dicom.encode(slice_row(1, pixel_spacing=[1.0, 2.0, 3.0]))) and "value representation" in said(good[:at] + b"\x08\0\x08\0??\0\0")
    rng = random.Random(1)
    for _ in range(300):  # damage anywhere is a row, never an exception
        hurt = bytearray(good)
        for _ in range(rng.randrange(1, 9)):
            hurt[rng.randrange(132, len(hurt))] = rng.randrange(256)
        assert set(dicom.parse("p", bytes(hurt[: rng.randrange(132, len(hurt))]))) == set(dicom.parse("p", good))


def test_all_series_of_a_folder(spark, tmp_path, capsys):
    rng = random.Random(2)
    for s in range(3):
        order = list(range(5))
        rng.shuffle(order)
        for name, k in enumerate(order):
            place = tmp_path / "in" / f"s{s}"
            place.mkdir(parents=True, exist_ok=True)
            odd = {"position": [0.0, 0.0, 40.0]} if s == 2 and k == 4 else {}
            (place / f"{name}.dcm").write_bytes(dicom.encode(slice_row(k, f"1.{s}", **odd), [dicom.EXPLICIT, dicom.IMPLICIT, dicom.DEFLATED][k % 3]))
    (tmp_path / "in" / "notes.txt").write_text("hello")
    rows = dicom.read_dicom(spark, str(tmp_path / "in"))
    assert [(r["path"][-9:], r["problem"]) for r in rows.where("problem is not null").collect()] == [("notes.txt", "not a DICOM file")]
    got = {r["uid"]: r for r in series.volumes(dicom.slices(rows)).collect()}
    want = [2.0 * x - 1024 for k in range(5) for x in slice_row(k)["data"]]
    assert got["1.0"]["data"] == got["1.1"]["data"] == want and got["1.0"]["shape"] == [5, 3, 4] and got["1.0"]["spacing"] == [2.5, 0.5, 0.25] and got["1.0"]["origin"] == [1.5, -2.25, 0.0]
    assert got["1.2"]["data"] is None and "uneven" in got["1.2"]["problem"]
    assert cli.main(["import", "dicom", str(tmp_path / "in"), str(tmp_path / "all"), "--all-series", "--modality", "CT"]) == 0 and '"uid":"1.2"' in capsys.readouterr().out
    assert {(r["uid"], r["modality"]) for r in spark.read.parquet(str(tmp_path / "all")).collect()} == {("1.0", "CT"), ("1.1", "CT")}
    assert cli.main(["import", "dicom", str(tmp_path / "in"), str(tmp_path / "one"), "--series-uid", "1.1", "--stored-values"]) == 0
    assert spark.read.parquet(str(tmp_path / "one")).first()["data"] == [float(x) for k in range(5) for x in slice_row(k)["data"]]
    assert cli.main(["import", "dicom", str(tmp_path / "in"), str(tmp_path / "none"), "--series-uid", "1.2"]) == 1
