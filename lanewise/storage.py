"""Tables written to the folder that the whole cluster shares."""

from __future__ import annotations

import atexit
import contextlib
import gc
import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

_FOLDERS: dict[str, str] = {}


def base_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset a temporary folder of this machine, which only a local master can share."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is unset: the executors of a cluster need a folder that all of them share")
    return "file://" + tempfile.mkdtemp(prefix="lanewise-")


def folder(spark: SparkSession, kind: str) -> str:
    """A folder of this application for tables of a kind, deleted when the interpreter ends."""
    key = f"{spark.sparkContext.applicationId}/{kind}"
    if key not in _FOLDERS:
        _FOLDERS[key] = path = f"{base_folder(spark)}/lanewise-{kind}-{uuid.uuid4().hex}"
        atexit.register(delete, spark, path)
    return _FOLDERS[key]


def drop(spark: SparkSession, kind: str) -> None:
    """Delete the tables of a kind written so far. Only for callers whose later results don't read them."""
    path = _FOLDERS.pop(f"{spark.sparkContext.applicationId}/{kind}", None)
    if path:
        delete(spark, path)


def delete(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the session may have ended before the interpreter
        own = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        own.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(own, True)


def written(spark: SparkSession, df: DataFrame, name: str, kind: str = "scratch", partition_by: list[str] | None = None) -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage ends there, and lost executors lose nothing."""
    path = f"{folder(spark, kind)}/{name}-{uuid.uuid4().hex[:12]}"
    out = df.write
    if partition_by:
        out = out.partitionBy(*partition_by)
    out.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def written_in_slices(spark: SparkSession, slices: Iterable[DataFrame], name: str, kind: str = "scratch", partition_by: list[str] | None = None) -> DataFrame:
    """Write the union of slices of one schema as a table, one after the other, and let go of the shuffle files of each before the next."""
    path, schema = f"{folder(spark, kind)}/{name}-{uuid.uuid4().hex[:12]}", None
    for df in slices:
        schema = df.schema
        out = df.write.mode("append").option("compression", "zstd")
        by = [c for c in partition_by or [] if c in df.columns]
        (out.partitionBy(*by) if by else out).parquet(path)
        del df, out
        free_shuffles(spark)
    return spark.read.schema(schema).parquet(path)


def free_shuffles(spark: SparkSession) -> None:
    """Spark deletes the shuffle files of a query when its plan is collected; with a heap that is far from full that may be never."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
