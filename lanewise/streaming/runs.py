"""A log of pipeline runs: each change of state is a row appended to a Parquet table; a run's state is its last row."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "run_id string, pipeline string, change int, at timestamp, status string, counts map<string,long>, note string, error string"
#: Characters of an error that are kept.
ERROR_LENGTH = 1_000


class Run:
    """A run in progress: counts are added up, partial() makes its end PARTIAL instead of SUCCESS."""

    def __init__(self, spark: SparkSession, log: str, pipeline: str):
        self.run_id, self._spark, self._log, self._pipeline = uuid.uuid4().hex, spark, log, pipeline
        self._changes, self._note, self._counts = 0, None, {}

    def add(self, **counts: int) -> None:
        for name, n in counts.items():
            self._counts[name] = self._counts.get(name, 0) + n

    def partial(self, note: str) -> None:
        self._note = note

    def _append(self, status: str, error: str | None = None) -> None:
        row = (self.run_id, self._pipeline, self._changes, datetime.now(timezone.utc), status, dict(self._counts), self._note, error and error[:ERROR_LENGTH])
        self._spark.createDataFrame([row], SCHEMA).coalesce(1).write.mode("append").parquet(self._log)
        self._changes += 1

    def checkpoint(self) -> None:
        """Make the counts so far visible to readers of the log."""
        self._append("RUNNING")


@contextlib.contextmanager
def tracked(spark: SparkSession, log: str, pipeline: str) -> Iterator[Run]:
    """RUNNING from here on, then SUCCESS or PARTIAL, or FAILED with the error, which is raised again."""
    run = Run(spark, log, pipeline)
    run._append("RUNNING")
    try:
        yield run
    except BaseException as e:
        run._append("FAILED", f"{type(e).__name__}: {e}")
        raise
    run._append("SUCCESS" if run._note is None else "PARTIAL")


def runs(log: DataFrame) -> DataFrame:
    """One row per run: its last state and the times of its start and its end, null while it runs."""
    last = F.max_by(F.struct("status", "counts", "note", "error", "at"), "change").alias("last")
    each = log.groupBy("run_id", "pipeline").agg(F.min("at").alias("started_at"), last)
    ended = F.when(F.col("last.status") != "RUNNING", F.col("last.at"))
    return each.select("run_id", "pipeline", "started_at", ended.alias("completed_at"), *[f"last.{c}" for c in ("status", "counts", "note", "error")])


def latest(log: DataFrame) -> DataFrame:
    """The run of each pipeline that started last; of equal times the greater id."""
    own = runs(log)
    return own.groupBy("pipeline").agg(F.max_by(F.struct(*own.columns), F.struct("started_at", "run_id")).alias("r")).select("r.*")


def running(log: DataFrame) -> DataFrame:
    return runs(log).filter("status = 'RUNNING'").orderBy("started_at")
