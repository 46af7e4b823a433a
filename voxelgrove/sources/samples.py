"""Sample tables as Parquet: presets, partitioned writes, pruned reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import SchemaError, ValidationError

#: Samples that are chosen for a read, up to this many, have their keys broadcast.
FEW = 100_000
#: Presets of storage: fast to write, balanced, or small.
PRESETS = {"fast": ("lz4raw", None), "balanced": ("zstd", 3), "max": ("zstd", 9)}
SCHEMA_VERSION = 1


def options(preset: str) -> dict[str, str]:
    if preset not in PRESETS:
        raise ValidationError(f"unknown preset: {preset}")
    codec, level = PRESETS[preset]
    return {"compression": codec} | ({"parquet.compression.codec.zstd.level": str(level)} if level else {})


def write(df: DataFrame, path: str, partition_by: list[str] | None = None, preset: str = "balanced", mode: str = "errorifexists") -> None:
    """A table in one commit; sources.tiles.write() is for tiles."""
    writer = df.write.mode(mode).options(**options(preset))
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def read(spark: SparkSession, path: str, modalities: list[str] | None = None) -> DataFrame:
    """A lazy table; modalities prune partitions."""
    df = spark.read.parquet(path)
    return df.where(df["modality"].isin(modalities)) if modalities is not None else df


def assemble(samples: DataFrame, images: DataFrame | None = None, masks: DataFrame | None = None, boxes: DataFrame | None = None, key: str = "sample_id") -> DataFrame:
    """samples, each row with all that the sample holds: images and masks, maps from their names, and boxes, an array in the order of box.

    images and masks: rows (key, modality or mask, ...), whose other columns are the map's values, as a struct where they are several; a
    name that comes twice for a sample is an error when it is read. A sample without images, masks or boxes has a null there. Columns of samples
    by those three names are replaced. The volumes of a sample meet in one row, so choose samples and columns before: read one box of large volumes by
    sources.tiles instead. Rows meet by sorted joins: files say little of how large maps are, so none is broadcast."""
    out = samples.drop("images", "masks", "boxes")
    for name, rows, column in (("images", images, "modality"), ("masks", masks, "mask")):
        if rows is None:
            continue
        rest = [c for c in rows.columns if c not in (key, column)]
        value = F.col(f"`{rest[0]}`") if len(rest) == 1 else F.struct(*(F.col(f"`{c}`") for c in rest))
        of = rows.where(F.col(column).isNotNull()).groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(column).alias("k"), F.struct(value.alias("v")).alias("v"))), lambda a, b: F.when(a["k"] < b["k"], -1).when(a["k"] > b["k"], 1).otherwise(0)).alias(name))
        named = F.transform_values(F.map_from_entries(name), lambda k, v: v["v"])  # after the join, as names of samples that aren't asked for may come twice
        out = out.join(of.hint("merge"), key, "left").withColumn(name, named)
    if boxes is not None:
        rest = [c for c in boxes.columns if c != key]
        of = boxes.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("box", *(c for c in rest if c != "box")))).alias("boxes"))
        out = out.join(of.hint("merge"), key, "left")
    return out


class SampleSet:
    """The tables of a dataset folder by name: `SampleSet(spark, root).images`. A table is read when it is asked for, and lazily then.

    It holds no file open, so there is nothing to close; `with` works and does nothing. A table that the folder lacks is None, but samples must be there."""

    TABLES = ("samples", "images", "voxels", "tiles", "masks", "boxes", "review_events")

    def __init__(self, spark: SparkSession, root: str, key: str = "sample_id"):
        self.spark, self.root, self.key = spark, root.rstrip("/"), key

    def __enter__(self) -> SampleSet:
        return self

    def __exit__(self, *_: object) -> None:
        return None

    def __getattr__(self, name: str) -> DataFrame | None:
        if name not in self.TABLES:
            raise AttributeError(name)
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        if name != "samples" and not path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            return None
        return self.spark.read.parquet(f"{self.root}/{name}")

    def _found(self, *names: str) -> dict[str, DataFrame]:
        return {n: t for n in names or self.TABLES if n != "samples" and (t := getattr(self, n)) is not None}

    def where(self, condition: Column | str, *names: str) -> dict[str, DataFrame]:
        """The named tables (all, if none is named) of the samples that fit a condition on the table of samples.

        Samples that fit are counted first, up to FEW + 1: the keys of a few are broadcast, more meet the tables by sorted joins."""
        ids, found = self.samples.where(condition), self._found(*names)
        keys = ids.select(self.key)
        keys = F.broadcast(keys) if keys.limit(FEW + 1).count() <= FEW else keys.hint("merge")
        return {"samples": ids} | {n: t.join(keys, self.key, "left_semi") for n, t in found.items()}

    def assembled(self, condition: Column | str | None = None) -> DataFrame:
        """assemble() of the folder's samples, or of those that fit a condition."""
        names = ("images", "masks", "boxes")
        tables = {"samples": self.samples} | self._found(*names) if condition is None else self.where(condition, *names)
        return assemble(tables["samples"], tables.get("images"), tables.get("masks"), tables.get("boxes"), self.key)


def recompress(spark: SparkSession, src: str, dst: str, preset: str) -> None:
    """The table again, in another preset and another place; rows aren't shuffled."""
    spark.read.parquet(src).write.options(**options(preset)).parquet(dst)


def check_version(version: object) -> int:
    """The version as a number; newer ones and other texts are errors, older ones pass."""
    try:
        n = int(str(version))
    except ValueError as e:
        raise SchemaError(f"schema version is not a number: {version}") from e
    if n > SCHEMA_VERSION:
        raise SchemaError(f"schema version {n} is newer than {SCHEMA_VERSION}")
    return n
