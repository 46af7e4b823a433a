"""Volumes stored as tiles: cut once, read back patch by patch.

A tile is one row: where it starts, its shape, and its values as bytes of their own type in C order. Its number is the
Z-order code of its place in the grid of tiles, so tiles that are near each other in space are near each other in a
table that is sorted by sample and tile. A patch names the tiles it needs by arithmetic, and finds them by an equi-join."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tiles import mask_tile, tile_shape
from ..operators.ordered import in_order

#: Bounds are scalars, so that Parquet's statistics can rule row groups out; axes that a volume lacks go from 0 to 1.
AXES = 4
_BOUNDS = [f"{e}{a}" for a in range(AXES) for e in ("lo", "hi")]
TILES = "sample_id {key}, name string, tile long, dtype string, shape array<int>, tile_shape array<int>, " + ", ".join(f"{b} int" for b in _BOUNDS) + ", data binary"
#: Rows, and bytes of their data, that are handed on at a time.
ROWS, BYTES = 1000, 4 << 20


def z_code(at: Sequence[int]) -> int:
    """The bits of all coordinates, interleaved; the last axis has the lowest bit."""
    code, n = 0, len(at)
    for a, x in enumerate(at):
        for b in range(60 // n):
            code |= (int(x) >> b & 1) << (b * n + n - 1 - a)
    return code


def z_code_of(at: Column, n: int, bits: int) -> Column:
    """z_code() of an array column of n coordinates below 2 ** bits."""
    code = F.lit(0).cast("long")
    for a in range(n):
        x = F.get(at, F.lit(a)).cast("long")
        for b in range(bits):
            code = code.bitwiseOR(F.shiftleft(F.shiftright(x, b).bitwiseAND(F.lit(1).cast("long")), b * n + n - 1 - a))
    return code


def _values(x: pa.Scalar, dtype: str | None) -> np.ndarray:
    """The numbers of a list as an array of their own type, without making objects of them; or bytes of the named type."""
    if isinstance(x, (pa.BinaryScalar, pa.LargeBinaryScalar)):
        return np.frombuffer(x.as_py(), np.dtype(dtype))
    return np.asarray(x.values.to_numpy(zero_copy_only=False))


def _batched(rows: Iterator[tuple[pa.Schema, dict]]) -> Iterator[pa.RecordBatch]:
    held, size, schema = [], 0, None
    for schema, row in rows:
        held.append(row)
        size += len(row["data"])
        if len(held) >= ROWS or size >= BYTES:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def cut(volumes: DataFrame, patch: int | Sequence[int], tile: Sequence[int] | None = None, item_bytes: int | None = None, key: str = "sample_id", name: str = "modality") -> DataFrame:
    """The tiles of volumes (key, name, shape, data, and dtype where data are bytes): columns of TILES, in no order.

    Tiles have the shape that suits reads of `patch` (functions.tiles.tile_shape), or that of `tile`; those at the far edges are shorter.
    Masks of a sample get its images' tiles where item_bytes is that of the images. Data are a list of numbers or bytes, in C order;
    numbers keep their type, booleans take a byte. A volume without voxels, or with a null in key, shape or data, has no tiles; data of
    another length than the shape's are an error. One pass without a shuffle: a task holds one batch of volumes."""
    fields = {f.name: f.dataType for f in volumes.schema}
    schema = TILES.format(key=fields[key].simpleString())
    rows = volumes.where(F.col(key).isNotNull() & F.col("shape").isNotNull() & F.col("data").isNotNull())
    dtype = F.col("dtype") if fields["data"].typeName() == "binary" else F.lit(None).cast("string")
    rows = rows.select(F.col(key).alias("sample_id"), F.col(name).cast("string").alias("name"), F.col("shape").cast("array<int>").alias("shape"), dtype.alias("dtype"), "data")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Schema, dict]]:
        for b in batches:
            kind = b.schema.field("sample_id").type
            own = pa.schema([("sample_id", kind), ("name", pa.string()), ("tile", pa.int64()), ("dtype", pa.string()), ("shape", pa.list_(pa.int32())), ("tile_shape", pa.list_(pa.int32())), *((c, pa.int32()) for c in _BOUNDS), ("data", pa.binary())])
            for i in range(b.num_rows):
                shape = b.column("shape")[i].as_py()
                if not shape or min(shape) <= 0:
                    continue
                values = _values(b.column("data")[i], b.column("dtype")[i].as_py()).reshape(shape)
                size = list(tile) if tile is not None else tile_shape(shape, patch, item_bytes or values.dtype.itemsize)
                size = mask_tile(size, shape)
                for at in np.ndindex(*(-(-s // t) for s, t in zip(shape, size))):
                    lo = [x * t for x, t in zip(at, size)]
                    hi = [min(s, x + t) for x, t, s in zip(lo, size, shape)]
                    part = np.ascontiguousarray(values[tuple(map(slice, lo, hi))])
                    ends = {f"{e}{a}": int(v[a]) if a < len(shape) else d for e, v, d in (("lo", lo, 0), ("hi", hi, 1)) for a in range(AXES)}
                    yield own, {"sample_id": b.column("sample_id")[i].as_py(), "name": b.column("name")[i].as_py(), "tile": z_code(at), "dtype": part.dtype.str, "shape": shape, "tile_shape": size, **ends, "data": part.tobytes()}

    return rows.mapInArrow(lambda batches: _batched(pieces(batches)), schema)


def write(tiles: DataFrame, path: str, preset: str = "balanced", mode: str = "errorifexists") -> None:
    """Tiles as Parquet, in order of sample, name and tile over the whole table, so that a read of few tiles touches few row groups."""
    from .samples import options

    tiles.repartitionByRange("sample_id", "name", "tile").sortWithinPartitions("sample_id", "name", "tile").write.mode(mode).options(**options(preset)).parquet(path)


def read_box(tiles: DataFrame, lo: Sequence[int], hi: Sequence[int]) -> DataFrame:
    """Tiles that meet [lo, hi): bare comparisons of their bounds, which reach the scan."""
    for a, (x, y) in enumerate(zip(lo, hi)):
        tiles = tiles.where((F.col(f"lo{a}") < y) & (F.col(f"hi{a}") > x))
    return tiles


def grids(tiles: DataFrame) -> DataFrame:
    """(sample_id, name, shape, tile_shape, dtype) of each volume; values aren't read."""
    return tiles.where("tile = 0").select("sample_id", "name", "shape", "tile_shape", "dtype")


def needed(starts: DataFrame, volumes: DataFrame, ndim: int) -> DataFrame:
    """starts (sample_id, patch, start, size) with each volume's grid and the number of every tile that a patch meets.

    A patch outside a volume has one row with a null tile."""
    rows = starts.join(volumes, "sample_id")
    for a in range(ndim):
        s, p, n, t = (F.get(c, F.lit(a)) for c in ("start", "size", "shape", "tile_shape"))
        first, last = F.greatest(s, F.lit(0)), F.least(s + p, n) - 1
        rows = rows.withColumn(f"t{a}", F.explode_outer(F.when(last >= first, F.sequence(F.floor(first / t).cast("int"), F.floor(last / t).cast("int")))))
    at = F.array(*(f"t{a}" for a in range(ndim)))
    whole = F.forall(at, lambda x: x.isNotNull())
    return rows.withColumn("tile", F.when(whole, z_code_of(at, ndim, 60 // ndim))).drop(*(f"t{a}" for a in range(ndim)))


def patches(tiles: DataFrame, starts: DataFrame, ndim: int, pad: float = 0.0) -> DataFrame:
    """(sample_id, patch, name, dtype, size, data): the values of each patch in every volume of its sample, as bytes in C order.

    starts: (sample_id, patch, start array<int>, size array<int>); a patch may reach beyond its volume, where it is padded (booleans
    with false); a padding that a type cannot hold is an error. Patches of samples without tiles give nothing. Only tiles that a patch needs are joined, by sample, name and
    number; each is cropped to the patch before it is shuffled to the patch's other pieces. There is no row for a voxel, and a task
    holds one patch and one batch."""
    plan = needed(starts.select("sample_id", "patch", F.col("start").cast("array<int>").alias("start"), F.col("size").cast("array<int>").alias("size")), grids(tiles), ndim)
    have = tiles.select("sample_id", "name", "tile", F.array(*(f"lo{a}" for a in range(ndim))).alias("lo"), F.array(*(f"hi{a}" for a in range(ndim))).alias("hi"), "data")
    rows = plan.join(have, ["sample_id", "name", "tile"], "left").select("sample_id", "patch", "name", "tile", "dtype", "start", "size", "lo", "hi", "data")

    def crop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            los, his, data = [], [], []
            for r in b.drop_columns(["sample_id", "patch", "name"]).to_pylist():
                if r["data"] is None:
                    los.append(None), his.append(None), data.append(None)
                    continue
                lo, hi, start = (np.array(r[c]) for c in ("lo", "hi", "start"))
                a, z = np.maximum(lo, start), np.minimum(hi, start + np.array(r["size"]))
                part = np.frombuffer(r["data"], np.dtype(r["dtype"])).reshape(hi - lo)[tuple(map(slice, a - lo, z - lo))]
                los.append((a - start).tolist()), his.append((z - start).tolist()), data.append(np.ascontiguousarray(part).tobytes())
            ints = pa.list_(pa.int32())
            new = {"lo": pa.array(los, ints), "hi": pa.array(his, ints), "data": pa.array(data, pa.binary())}
            yield pa.RecordBatch.from_arrays([new.get(n, b.column(n)) for n in b.schema.names], names=b.schema.names)

    def assembled(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Schema, dict]]:
        key, block, kind = None, None, None

        def done() -> tuple[pa.Schema, dict]:
            out = pa.schema([("sample_id", kind[0]), ("patch", kind[1]), ("name", pa.string()), ("dtype", pa.string()), ("size", pa.list_(pa.int32())), ("data", pa.binary())])
            return out, {"sample_id": key[0], "patch": key[1], "name": key[2], "dtype": block.dtype.str, "size": list(block.shape), "data": block.tobytes()}

        for b in batches:
            kind = b.schema.field("sample_id").type, b.schema.field("patch").type
            for r in b.to_pylist():
                if (r["sample_id"], r["patch"], r["name"]) != key:
                    if key is not None:
                        yield done()
                    key, dtype = (r["sample_id"], r["patch"], r["name"]), np.dtype(r["dtype"])
                    block = np.full(r["size"], False if dtype.kind == "b" else pad, dtype)
                if r["data"] is not None:
                    lo, hi = np.array(r["lo"]), np.array(r["hi"])
                    block[tuple(map(slice, lo, hi))] = np.frombuffer(r["data"], block.dtype).reshape(hi - lo)
        if key is not None:
            yield done()

    types = {f.name: f.dataType.simpleString() for f in rows.schema}
    cropped = rows.mapInArrow(crop, ", ".join(f"{c} {types[c]}" for c in rows.columns))
    return in_order(cropped, ["sample_id", "patch", "name"], ["tile"], lambda batches: _batched(assembled(batches)), f"sample_id {types['sample_id']}, patch {types['patch']}, name string, dtype string, size array<int>, data binary")


def whole(tiles: DataFrame, ndim: int) -> DataFrame:
    """(sample_id, name, dtype, shape, data): volumes put together again, one row each."""
    all_of = grids(tiles).select("sample_id", F.col("name").alias("patch"), F.array(*(F.lit(0) for _ in range(ndim))).alias("start"), F.col("shape").alias("size"))
    out = patches(tiles, all_of, ndim).where("name = patch")
    return out.select("sample_id", "name", "dtype", F.col("size").alias("shape"), "data")


def numbers(rows: DataFrame, data: str = "data") -> DataFrame:
    """rows with their bytes as array<double>; for looking at patches, as lists are many times the bytes."""
    schema = ", ".join(f"`{f.name}` {'array<double>' if f.name == data else f.dataType.simpleString()}" for f in rows.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = [None if x is None else np.frombuffer(x, np.dtype(t)).astype(np.float64) for x, t in zip(b.column(data).to_pylist(), b.column("dtype").to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(lists, pa.list_(pa.float64())) if n == data else b.column(n) for n in b.schema.names], names=b.schema.names)

    return rows.mapInArrow(run, schema)
