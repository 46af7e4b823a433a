"""Cases found in file names, their channels, and image series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def case_files(files: DataFrame, ending: str = ".nii.gz", name: str = "name") -> DataFrame:
    """files with case_id and channel from <case>_<4 digits><ending>; other names are left out."""
    end = ending.replace(".", "\\.")
    pattern = f"^(.+)_([0-9]{{4}}){end}$"
    rows = files.withColumns({"case_id": F.regexp_extract(name, pattern, 1), "channel": F.regexp_extract(name, pattern, 2)})
    return rows.where("channel <> ''").withColumn("channel", F.col("channel").cast("int"))


def channel_name(case: Column, channel: Column, ending: str = ".nii.gz") -> Column:
    """<case>_<channel><ending>; a channel has four digits, and more where it needs them. A null in either gives null."""
    return F.concat(case.cast("string"), F.lit("_"), F.when(channel.isNotNull(), F.format_string("%04d", channel.cast("long"))), F.lit(ending))


def discover(found: DataFrame, keys: str = "case_id", channels: int | None = None) -> DataFrame:
    """(case, n, duplicates, missing, extra): channels of each case against 0 .. channels-1.

    Without channels each case is held against 0 .. its own highest. missing and extra are sorted texts;
    a case is whole if they are empty and duplicates is 0. Channels of a case are few, so a set of them is."""
    rows = found.groupBy(keys).agg(F.count("*").alias("files"), F.array_sort(F.collect_set("channel")).alias("have"))
    top = F.lit(channels - 1) if channels is not None else F.coalesce(F.array_max("have"), F.lit(0))
    want = F.sequence(F.lit(0), top.cast("int"))
    text = lambda a: F.array_join(F.transform(F.array_sort(a), lambda x: x.cast("string")), ",")
    return rows.select(
        keys, F.size("have").cast("long").alias("n"), (F.col("files") - F.size("have")).alias("duplicates"), text(F.array_except(want, F.col("have").cast("array<int>"))).alias("missing"), text(F.array_except(F.col("have").cast("array<int>"), want)).alias("extra")
    )


def with_label(found: DataFrame, label_files: DataFrame, keys: str = "case_id") -> DataFrame:
    """found with label_path and complete: whether each case has its label file."""
    one = label_files.select(keys, F.col("path").alias("label_path"))
    return found.join(one, keys, "left").withColumn("complete", F.col("label_path").isNotNull())


def name_difference(have: Column, want: Column) -> tuple[Column, Column]:
    """(missing, extra) of two lists of names."""
    return F.array_sort(F.array_except(want, have)), F.array_sort(F.array_except(have, want))


def largest_series(slices: DataFrame, uid: str = "uid", wanted: str | None = None) -> DataFrame:
    """(uid, n) of the series with most slices, ties to the smaller uid; or of the wanted one. Null uids are one series."""
    key = F.coalesce(F.col(uid).cast("string"), F.lit("<missing-series-uid>"))
    n = slices.groupBy(key.alias("uid")).agg(F.count("*").alias("n"))
    return n.where(F.col("uid") == wanted) if wanted is not None else n.orderBy(F.desc("n"), "uid").limit(1)


def gap_measures(position: str) -> list[Column]:
    """Aggregates of the column gap, the distance to the slice before: the first gap, the least and the greatest."""
    return [F.min_by("gap", F.when(F.col("gap").isNotNull(), F.col(position))).alias("first_gap"), F.min("gap").alias("g0"), F.max("gap").alias("g1")]


def gap_status(atol: float = 1e-4, rtol: float = 1e-4) -> Column:
    """ok, duplicate, uneven or single, from n and gap_measures()."""
    first, tol = F.col("first_gap"), atol + rtol * F.abs("first_gap")
    even = (F.abs(F.col("g0") - first) <= tol) & (F.abs(F.col("g1") - first) <= tol)
    return F.when(F.col("n") == 1, "single").when(F.col("g0") <= 1e-5, "duplicate").when(even, "ok").otherwise("uneven")


def slice_spacing(slices: DataFrame, key: str, position: str, atol: float = 1e-4, rtol: float = 1e-4, thickness: str | None = None) -> DataFrame:
    """(key, n, first_gap, status) of ordered slices: ok, duplicate (a gap of 1e-5 or less), uneven, or single. With thickness, that column of a
    single slice takes the place of its gap."""
    thick = F.first(thickness, True) if thickness else F.lit(None).cast("double")
    gap = F.col(position) - F.lag(position).over(Window.partitionBy(key).orderBy(position))
    rows = slices.select(key, position, gap.alias("gap"), *([thickness] if thickness else []))
    agg = rows.groupBy(key).agg(F.count("*").alias("n"), *gap_measures(position), thick.alias("thick"))
    first_gap = F.when(F.col("n") == 1, F.coalesce("first_gap", "thick")).otherwise(F.col("first_gap"))
    return agg.select(key, "n", first_gap.alias("first_gap"), gap_status(atol, rtol).alias("status"))


def stack_slices(slices: DataFrame, key: str, position: str, data: str) -> DataFrame:
    """(key, data): the slices of a series in order of position, as one array of arrays; a series is one volume."""
    return slices.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(position, data))), lambda x: x[data]).alias(data))
