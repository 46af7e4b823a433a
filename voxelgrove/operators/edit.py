"""Edits of samples, masks and boxes. Each checks first, and gives back the table as it is after the edit."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import ValidationError
from ..session import settle


def update_meta(samples: DataFrame, changes: DataFrame, columns: Mapping[str, str], key: str = "sample_id") -> DataFrame:
    """samples with columns (name -> column of changes) replaced where changes has the key; a null there is written."""
    new = changes.select(F.col(key).alias("__k"), F.lit(True).alias("__hit"), *(F.col(c).alias(f"__{n}") for n, c in columns.items()))
    out = samples.join(new, F.col(key) == F.col("__k"), "left")
    return out.withColumns({n: F.when(F.col("__hit"), F.col(f"__{n}")).otherwise(F.col(n)) for n in columns}).select(*samples.columns)


def seg_add(masks: DataFrame, new: DataFrame, check: bool = True) -> DataFrame:
    """masks with those of new; a (sample, mask) that is there already is an error."""
    keys = ["sample_id", "mask"]
    if check and not new.select(*keys).join(masks.select(*keys), keys, "left_semi").isEmpty():
        raise ValidationError("a mask of that name exists")
    return masks.unionByName(new)


def _gone(masks: DataFrame, which: DataFrame, check: bool) -> DataFrame:
    keys = ["sample_id", "mask"]
    if check and not which.select(*keys).join(masks.select(*keys), keys, "left_anti").isEmpty():
        raise ValidationError("there is no mask of that name")
    return masks.join(which.select(*keys), keys, "left_anti").select(*masks.columns)


def seg_remove(masks: DataFrame, which: DataFrame, check: bool = True) -> DataFrame:
    return _gone(masks, which, check)


def seg_replace(masks: DataFrame, new: DataFrame, check: bool = True) -> DataFrame:
    return _gone(masks, new, check).unionByName(new)


def bbox_set(boxes: DataFrame, new: DataFrame, key: str = "sample_id") -> DataFrame:
    """The boxes of new's samples replaced by new's."""
    return boxes.join(new.select(key).distinct(), key, "left_anti").select(*boxes.columns).unionByName(new)


def bbox_clear(boxes: DataFrame, which: DataFrame, key: str = "sample_id") -> DataFrame:
    return boxes.join(which.select(key), key, "left_anti").select(*boxes.columns)


def bbox_update(boxes: DataFrame, new: DataFrame, columns: Sequence[str], key: str = "sample_id", order: str = "box") -> DataFrame:
    """boxes (key, order, lo, hi, score, label) with only `columns` of new's samples replaced, box by box.

    Ends (lo and hi) may come in another number only with the columns that depend on them: scores or labels that stay must be
    as many as the boxes, else it is an error. A sample without boxes can't be given scores or labels alone."""
    own, its = boxes.groupBy(key).agg(F.count("*").alias("n")), new.groupBy(key).agg(F.count("*").alias("m"))
    both = its.join(own, key, "left")
    ends = "lo" in columns or "hi" in columns
    if not ends and not both.where("n is null").isEmpty():
        raise ValidationError("scores or labels without boxes")
    rest = {"lo", "hi", "score", "label"} - set(columns)
    kept = boxes.join(new.select(key).distinct(), key, "left_semi").where(" or ".join(f"{c} is not null" for c in sorted(rest)) if rest else "false")
    if not both.join(kept.select(key).distinct(), key, "left_semi").where("n <> m").isEmpty():
        raise ValidationError("the number of boxes differs from that of the scores or labels that stay")
    old = boxes.select(F.col(key), F.col(order), *(F.col(c).alias(f"__{c}") for c in sorted(rest)))
    done = new.select(key, order, *columns).join(old, [key, order], "left").withColumnsRenamed({f"__{c}": c for c in rest})
    return boxes.join(new.select(key).distinct(), key, "left_anti").select(*boxes.columns).unionByName(done.select(*boxes.columns))


def resync(samples: DataFrame, masks: DataFrame, boxes: DataFrame, key: str = "sample_id") -> DataFrame:
    """samples with has_seg, seg_names and has_bbox as the tables have them."""
    names = masks.groupBy(key).agg(F.array_sort(F.collect_set("mask")).alias("seg_names"))
    with_box = boxes.select(key).distinct().withColumn("has_bbox", F.lit(True))
    out = samples.drop("has_seg", "seg_names", "has_bbox").join(names, key, "left").join(with_box, key, "left")
    return out.withColumns({"has_seg": F.col("seg_names").isNotNull(), "has_bbox": F.coalesce("has_bbox", F.lit(False))})


def guard(stored: Column, computed: Column, force: bool = False) -> Column:
    """Rows that may be edited: those whose digest isn't known to be wrong, or all if forced."""
    return F.lit(True) if force else F.coalesce(stored == computed, F.lit(True))


def restamp(samples: DataFrame, digests: DataFrame, key: str = "sample_id", column: str = "checksum") -> DataFrame:
    """samples with the digests (key, digest) stored; those that aren't among them keep what they have."""
    new = digests.select(F.col(key).alias("__k"), F.col("digest").alias("__d"))
    return samples.join(new, F.col(key) == F.col("__k"), "left").withColumn(column, F.coalesce("__d", column)).select(*samples.columns)


def update(
    tables: Mapping[str, DataFrame],
    meta: tuple[DataFrame, Mapping[str, str]] | None = None,
    seg: Mapping[str, DataFrame] | None = None,
    boxes: DataFrame | None = None,
    clear_boxes: DataFrame | None = None,
    digests: Callable[[Mapping[str, DataFrame]], DataFrame] | None = None,
    force: bool = False,
    done: Callable[[Mapping[str, DataFrame]], None] | None = None,
    key: str = "sample_id",
) -> dict[str, DataFrame]:
    """samples, masks and boxes after one edit: metadata, masks (seg: add, replace, remove) and boxes together.

    Every operation is checked before the first is done. A sample that is touched and whose stored checksum isn't the computed
    one (columns checksum and computed of samples) is an error, unless forced. Afterwards has_seg, seg_names and has_bbox
    follow the tables; digests gives (key, digest) of the edited tables, and those of the touched samples are stored. done is
    called with the result. The touched keys and the edited masks and boxes are settled once, as checks, digests and has_seg read them again; the tables
    themselves aren't written: save them beside the old ones and swap them."""
    samples, masks, old = tables["samples"], tables["masks"], tables["boxes"]
    if seg and (unknown := set(seg) - {"add", "replace", "remove"}):
        raise ValidationError(f"unknown mask operations: {', '.join(sorted(unknown))}")
    parts = [x.select(key) for x in (meta[0] if meta else None, boxes, clear_boxes, *(seg or {}).values()) if x is not None]
    if not parts:
        return dict(tables)
    touched = parts[0]
    for p in parts[1:]:
        touched = touched.union(p)
    touched = settle(touched.distinct())
    if not touched.join(samples.select(key), key, "left_anti").isEmpty():
        raise ValidationError("an edit of a sample that isn't there")
    if {"checksum", "computed"} <= set(samples.columns):
        if not samples.join(touched, key, "left_semi").where(~guard(F.col("checksum"), F.col("computed"), force)).isEmpty():
            raise ValidationError("the stored checksum of a sample doesn't match; use force to edit it all the same")
    out = dict(tables)
    for name, step in (("remove", seg_remove), ("replace", seg_replace), ("add", seg_add)):
        if seg and name in seg:
            masks = step(masks, seg[name])
    out["masks"] = settle(masks) if seg else masks
    if clear_boxes is not None:
        old = bbox_clear(old, clear_boxes, key)
    old = bbox_set(old, boxes, key) if boxes is not None else old
    out["boxes"] = old if old is tables["boxes"] else settle(old)
    samples = update_meta(samples, *meta, key) if meta else samples
    columns = samples.columns
    samples = resync(samples, out["masks"], out["boxes"], key)
    out["samples"] = samples.select(*columns, *(c for c in samples.columns if c not in columns))
    if digests is not None:
        out["samples"] = restamp(out["samples"], digests(out).join(touched, key, "left_semi"), key)
    if done is not None:
        done(out)
    return out
