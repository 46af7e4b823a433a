"""Session settings for a cluster of any size."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "voxelgrove", **conf: str) -> SparkSession:
    """A session with adaptive execution and UTC; conf overrides."""
    builder = SparkSession.builder.appName(app)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for k, v in (settings | conf).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


_OWN: str | None = None


def shared_folder(spark: SparkSession) -> str:
    """This application's folder below spark.checkpoint.dir, for tables between two steps. A session on one machine that names none gets a temporary one; on a cluster that is an error."""
    global _OWN
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named is None:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and the executors share")
        named = _OWN = _OWN or tempfile.mkdtemp(prefix="checkpoints-")
    path = f"{named.rstrip('/')}/voxelgrove-{spark.sparkContext.applicationId}"
    if path not in _AT_EXIT:
        _AT_EXIT.add(path)
        atexit.register(_remove, spark, path)
    return path


#: Folders that go when the driver ends.
_AT_EXIT: set[str] = set()


def _remove(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # a stopped session leaves its folder to the cluster
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def settle(df: DataFrame) -> DataFrame:
    """df, written as Parquet to the shared folder and read again: computed once, cut from its lineage, and safe from lost executors."""
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
