"""The review trail: an append-only table (sample_id, seq, status, annotator, ts, notes)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import ValidationError

STATUSES = ("pending", "reviewed", "flagged", "rejected")


def set_status(events: DataFrame, sample_id: object, status: str, annotator: str | None = None, notes: str | None = None, timestamp: str | None = None, samples: DataFrame | None = None, key: str = "sample_id") -> DataFrame:
    """events with one more; seq goes on from the sample's last. With samples, one that isn't among them is an error."""
    if status not in STATUSES:
        raise ValidationError(f"unknown review status: {status}")
    if samples is not None and samples.where(F.col(key) == F.lit(sample_id)).isEmpty():
        raise ValidationError(f"no such sample: {sample_id}")
    now = F.lit(timestamp) if timestamp else F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
    last = events.where(F.col("sample_id") == F.lit(sample_id)).agg(F.coalesce(F.max("seq") + 1, F.lit(0)).alias("seq"))
    kind = events.schema["sample_id"].dataType
    row = last.select(F.lit(sample_id).cast(kind).alias("sample_id"), F.col("seq").cast("long").alias("seq"), F.lit(status).alias("status"), F.lit(annotator).cast("string").alias("annotator"), now.alias("ts"), F.lit(notes).cast("string").alias("notes"))
    return events.unionByName(row)


def current(events: DataFrame, order: list[str] | None = None) -> DataFrame:
    """(sample_id, status) of the latest event: an aggregate, without a sort."""
    key = F.struct(*(order or ["seq"]))
    return events.groupBy("sample_id").agg(F.max_by("status", key).alias("status"))


def history(events: DataFrame, order: list[str] | None = None) -> DataFrame:
    """events with prev: the status before each, pending before the first."""
    w = Window.partitionBy("sample_id").orderBy(*(order or ["seq"]))
    return events.withColumn("prev", F.lag("status", 1, "pending").over(w))


def status_of(samples: DataFrame, events: DataFrame, key: str = "sample_id") -> DataFrame:
    """samples with review_status, pending where there are no events."""
    return samples.join(current(events).withColumnsRenamed({"sample_id": key, "status": "review_status"}), key, "left").fillna("pending", ["review_status"])


def with_status(samples: DataFrame, events: DataFrame, status: str, key: str = "sample_id") -> DataFrame:
    return status_of(samples, events, key).where(F.col("review_status") == status)
