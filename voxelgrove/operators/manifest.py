"""Manifests: scans, filters, dotted look-ups, staleness, save and load."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SUFFIX = ".h5"
MANIFEST_VERSION = 1


def list_files(spark: SparkSession, root: str, suffix: str = SUFFIX, recursive: bool = True) -> DataFrame:
    """(path, file_size, mtime) of the files under root with the suffix, in the order of their paths; contents aren't read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").option("recursiveFileLookup", str(recursive).lower()).load(root)
    return files.select("path", F.col("length").alias("file_size"), F.unix_micros("modificationTime").cast("double").alias("us")).select("path", "file_size", (F.col("us") / 1e6).alias("mtime")).orderBy("path")


def filter_records(records: DataFrame, predicate: Column | Callable) -> DataFrame:
    """A Column keeps the work in the JVM; a Python function of a row dict is the slow way."""
    if isinstance(predicate, Column):
        return records.where(predicate)
    return records.where(F.udf(lambda r: bool(predicate(r.asDict(True))), "boolean")(F.struct("*")))


def lookup(json_col: str | Column, dotted: str) -> Column:
    """The value at a dotted path of a JSON text, as string; null wherever the path ends early."""
    return F.get_json_object(json_col, "$." + dotted)


def review_status(json_col: str | Column) -> Column:
    """review.status of a JSON text if it is a non-empty string, else pending."""
    c = F.col(json_col) if isinstance(json_col, str) else json_col
    kind = F.schema_of_variant(F.try_variant_get(F.try_parse_json(c), "$.review.status", "variant"))
    status = F.try_variant_get(F.try_parse_json(c), "$.review.status", "string")
    return F.when((kind == "STRING") & (status != ""), status).otherwise("pending")


def stale(manifest: DataFrame, current: DataFrame, key: str = "path", stamps: Sequence[str] = ("file_size", "mtime")) -> DataFrame:
    """(key, why): records whose file is missing or has another size or time now."""
    now = current.select(key, F.lit(True).alias("__there"), *(F.col(s).alias(f"__{s}") for s in stamps))
    rows = manifest.select(key, *stamps).join(now, key, "left")
    why = F.when(F.col("__there").isNull(), "missing")
    for s in stamps:
        why = why.when(~F.col(s).eqNullSafe(F.col(f"__{s}")), s)
    return rows.select(key, why.alias("why")).where("why is not null")


def save(records: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Records with the manifest's version, one JSON object per line, in parts."""
    records.withColumn("manifest_version", F.lit(MANIFEST_VERSION)).write.mode(mode).json(path)


def load(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Saved records; with a schema no pass over the files is needed to infer one."""
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.json(path).drop("manifest_version")
