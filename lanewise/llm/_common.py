"""Shared helpers: reading tables, scratch tables, and the memory of Python workers."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from lanewise import storage
from lanewise.storage import written

__all__ = ["SPACE", "drop_scratch", "lean", "pipeline_folder", "shuffle_partitions", "sliced", "table", "written"]

#: Whitespace of the word definition `[^\x20\x09-\x0D]+`, as a Java character class body.
SPACE = r"\x20\x09-\x0D"
#: Rows that a task works on at once where each becomes several arrays.
ROWS = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pipeline_folder(spark: SparkSession) -> str:
    """A folder for the tables between stages, which outlive scratch tables."""
    return storage.folder(spark, "pipeline")


def drop_scratch(spark: SparkSession) -> None:
    """Delete the scratch tables written so far. Only for callers whose earlier results are stored elsewhere."""
    storage.drop(spark, "scratch")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def sliced(batches: Iterator[pa.RecordBatch], rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    """Batches of at most `rows` rows, of the same rows in the same order."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function of a task's batches that gives freed memory back when the task ends: workers are used again by later stages."""

    @functools.wraps(run)
    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)

    return own
