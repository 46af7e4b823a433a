"""Bounding boxes as rows with arrays lo and hi, one number per axis."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import ValidationError


def clamp(boxes: DataFrame, shape: Sequence[int]) -> DataFrame:
    """boxes with lo and hi clamped to the shape and put in order, and issues (sorted names, joined by ;).

    In this order: a lower end below 0 becomes 0, an upper end above the bound becomes the bound, and ends the
    wrong way round are swapped, whatever that gives."""
    bound = F.array(*(F.lit(int(s)).cast("long") for s in shape))
    lo = F.transform("lo", lambda x: F.greatest(x.cast("long"), F.lit(0).cast("long")))
    hi = F.zip_with("hi", bound, lambda x, b: F.least(x.cast("long"), b))
    out = boxes.withColumns({"__lo": lo, "__hi": hi})
    issues = F.array_compact(F.array(
        F.when(F.exists("lo", lambda x: x < 0), "min_below_zero"),
        F.when(F.exists(F.zip_with("hi", bound, lambda x, b: x > b), lambda t: t), "max_above_shape"),
        F.when(F.exists(F.zip_with("__lo", "__hi", lambda a, b: a > b), lambda t: t), "min_above_max"),
    ))
    small, large = F.zip_with("__lo", "__hi", lambda a, b: F.least(a, b)), F.zip_with("__lo", "__hi", lambda a, b: F.greatest(a, b))
    return out.withColumn("issues", F.array_join(issues, ";")).withColumns({"lo": small, "hi": large}).drop("__lo", "__hi")


def flip(lo: Column, hi: Column, size: Sequence[int], axes: Sequence[int]) -> tuple[Column, Column]:
    """Box ends mirrored along axes: [lo, hi] becomes [(s-1)-hi, (s-1)-lo]."""
    new_lo = F.array(*((F.lit(s - 1) - F.get(hi, F.lit(a))) if a in axes else F.get(lo, F.lit(a)) for a, s in enumerate(size)))
    new_hi = F.array(*((F.lit(s - 1) - F.get(lo, F.lit(a))) if a in axes else F.get(hi, F.lit(a)) for a, s in enumerate(size)))
    return new_lo, new_hi


def in_patches(boxes: DataFrame, patches: DataFrame, patch: Sequence[int], key: str = "sample_id") -> DataFrame:
    """Boxes that touch a patch (sample, start array), moved to its coordinates.

    An equi-join on the sample with the range test as its residue: a box is kept if on every axis
    hi - start >= 0 and lo - start < patch."""
    rows = boxes.join(patches.select(key, "start"), key)
    lo, hi = F.zip_with("lo", "start", lambda a, s: a - s), F.zip_with("hi", "start", lambda a, s: a - s)
    rows = rows.withColumns({"__lo": lo, "__hi": hi})
    size = F.array(*(F.lit(p) for p in patch))
    keep = F.forall("__hi", lambda x: x >= 0) & F.forall(F.zip_with("__lo", size, lambda x, p: x < p), lambda t: t)
    return rows.where(keep).withColumns({"lo": F.col("__lo"), "hi": F.col("__hi")}).drop("__lo", "__hi")


def _size(n: int) -> Column:
    """The length of a cell at a row's level."""
    return F.call_function("shiftleft", F.lit(int(n)).cast("long"), F.col("level"))


def _at(c: str, axis: int) -> Column:
    return F.get(c, F.lit(axis))


def _candidates(boxes: DataFrame, patches: DataFrame, patch: Sequence[int], key: str) -> DataFrame:
    """Rows k, b and p (the key, and structs of a box and a patch) that meet in a cell, once for each pair."""
    axes = range(len(patch))
    b = boxes.select(boxes[key].alias("k"), F.struct(*(boxes[c] for c in boxes.columns if c != key)).alias("b"))
    p = patches.select(patches[key].alias("k"), F.struct(*(patches[c] for c in patches.columns if c != key)).alias("p"))
    for a in axes:
        b, p = b.where(_at("b.lo", a).isNotNull() & _at("b.hi", a).isNotNull()), p.where(_at("p.start", a).isNotNull())
    lows, highs = [F.floor(_at("b.lo", a)) - (int(patch[a]) - 1) for a in axes], [F.floor(_at("b.hi", a)) for a in axes]
    for x, h in zip(lows, highs):
        b = b.where(h >= x)
    level = F.greatest(F.lit(0), F.lit(0), *(F.ceil(F.log2((h - x + 1) / int(n))).cast("int") for x, h, n in zip(lows, highs, patch)))
    b = b.withColumn("level", level)
    levels = b.groupBy("k").agg(F.collect_set("level").alias("levels"))
    p = p.join(levels.hint("shuffle_hash"), "k").withColumn("level", F.explode("levels")).drop("levels")  # patches pass by the levels unsorted
    for a, (x, h) in enumerate(zip(lows, highs)):
        b = b.withColumn(f"c{a}", F.explode(F.sequence(F.floor(x / _size(patch[a])), F.floor(h / _size(patch[a])))))
    p = p.withColumns({f"c{a}": F.floor(_at("p.start", a) / _size(patch[a])) for a in axes})
    return b.join(p.hint("merge"), ["k", "level", *(f"c{a}" for a in axes)])  # sorted, as what is exploded is larger than Spark thinks, and would be broadcast


def touching(boxes: DataFrame, patches: DataFrame, patch: Sequence[int], key: str = "sample_id") -> DataFrame:
    """in_patches() for many patches a sample: one row for each box and patch that it touches, with the columns of both.

    Space is dealt into cells of the patch's size, and of twice, four times, ... that size. A box is touched by the patches that start between
    its lower end less the patch and its upper end; it lies at the first level whose cells are no smaller than that. So a box is in at most 2 cells
    an axis, a patch in the one that it starts in of each level that its sample has, and an equi-join on sample, level and cell
    brings each pair together once; then the exact test. A sample with many boxes is spread over its cells.

    Ends the wrong way round are tested as they are. A box or patch with a null in key, ends or start touches nothing. Repeated rows
    give repeated pairs. Both sides having a column of one name, other than key, is an error."""
    if both := sorted(set(boxes.columns) & set(patches.columns) - {key}):
        raise ValidationError(f"boxes and patches both have {', '.join(both)}")
    rows = _candidates(boxes, patches, patch, key)
    for a, n in enumerate(patch):
        rows = rows.where((_at("b.hi", a) - _at("p.start", a) >= 0) & (_at("b.lo", a) - _at("p.start", a) < int(n)))
    moved = {e: F.zip_with(f"b.{e}", "p.start", lambda x, s: x - s).alias(e) for e in ("lo", "hi")}
    return rows.select(*(F.col("k").alias(key) if c == key else moved.get(c, F.col("b")[c].alias(c)) for c in boxes.columns), *(F.col("p")[c].alias(c) for c in patches.columns if c != key))
