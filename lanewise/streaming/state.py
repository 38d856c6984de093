"""Incremental state without a table format: upserts with history, affected keys, late data, and file streams."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanewise.storage import folder

LATE_DAYS = 7


def _same(keys: list[str], left: str = "n", right: str = "o"):
    return reduce(lambda a, b: a & b, [F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}")) for k in keys])


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(state after replacing the rows of new's keys, old rows that were replaced). Keys match null-safely and are unique in new."""
    on = _same(keys, "o", "n")
    kept = old.alias("o").join(new.alias("n"), on, "left_anti")
    replaced = old.alias("o").join(new.alias("n"), on, "left_semi")
    return kept.unionByName(new), replaced


def insert_missing(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Old rows and those of new whose key is not there yet."""
    return old.unionByName(new.alias("n").join(old.alias("o"), _same(keys), "left_anti"))


def write_back(rows: DataFrame, values: DataFrame, key: str, column: str) -> DataFrame:
    """rows with column filled from values(key, column) where it is null."""
    found = values.select(key, F.col(column).alias("_found"))
    return rows.join(found, key, "left").withColumn(column, F.coalesce(column, "_found")).drop("_found")


def late_window(watermark: str | None, last: str, days: int = LATE_DAYS) -> tuple[str | None, str]:
    """SQL bounds of a build: from some days before the watermark, floored to its month so that no month is part-built."""
    start = None if watermark is None else f"date_trunc('month', date_sub(DATE '{watermark}', {days}))"
    return start, f"DATE '{last}'"


def joint_watermark(*marks: str | None) -> str | None:
    """The oldest known watermark of outputs that are built together; null, a full build, if none is known."""
    return min((m for m in marks if m is not None), default=None)


def recompute(facts: DataFrame, delta: DataFrame, keys: list[str], build: Callable[[DataFrame], DataFrame], state: DataFrame) -> DataFrame:
    """State after building the keys that delta touches anew from their whole history."""
    touched = delta.select(*keys).distinct()
    mine = facts.alias("n").join(touched.alias("o"), _same(keys), "left_semi")
    return upsert(state, build(mine), keys)[0]


def stream_files(spark: SparkSession, folder: str, schema: str, checkpoint: str, apply: Callable[[DataFrame, int], None], kind: str = "parquet") -> None:
    """Hand each new file of a folder to apply(batch, id) once; the checkpoint remembers which were read."""
    rows = spark.readStream.format(kind).schema(schema).option("recursiveFileLookup", "true").load(folder)
    rows.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def advance(spark: SparkSession, log: str, name: str, mark: str, succeeded: bool = True) -> None:
    """Move a watermark forward after a build that succeeded; an older mark, or a failed build, moves nothing."""
    if succeeded:
        spark.createDataFrame([(name, mark)], "name string, mark string").coalesce(1).write.mode("append").parquet(log)


def watermarks(spark: SparkSession, log: str) -> dict[str, str]:
    """The latest mark of each name: a row per output that is built incrementally."""
    return {r["name"]: r["mark"] for r in spark.read.schema("name string, mark string").parquet(log).groupBy("name").agg(F.max("mark").alias("mark")).collect()}


def since(df: DataFrame, column: str, marker: str | None) -> DataFrame:
    """Rows processed after the day of the marker; without one, all."""
    return df if marker is None else df.filter(F.to_date(column) > F.lit(marker).cast("date"))


def stamped(old: DataFrame, new: DataFrame, keys: list[str], at: str) -> DataFrame:
    """upsert() that keeps created_at of rows that were there and sets updated_at of those that come, both `at` for new ones."""
    moment = F.lit(at).cast("timestamp")
    before = old.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("created_at").alias("_created"))
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    coming = new.join(before, on, "left").select(*new.columns, F.coalesce("_created", moment).alias("created_at"), moment.alias("updated_at"))
    return upsert(old, coming, keys)[0]


def without_session(df: DataFrame, session: str, column: str = "session_id") -> DataFrame:
    """Rows of other sessions, and of none."""
    return df.filter(~F.col(column).eqNullSafe(F.lit(session)))


def late(files: DataFrame, stages: list[str]) -> DataFrame:
    """For each stage the files that the stage before finished and that it hasn't, by their times: (stage, path)."""
    pairs = zip(["ingested_at", *[f"{s}_at" for s in stages]], stages)
    each = [files.filter(F.col(before).isNotNull() & (F.col(f"{stage}_at").isNull() | (F.col(f"{stage}_at") < F.col(before)))).select(F.lit(stage).alias("stage"), "path") for before, stage in pairs]
    return reduce(DataFrame.unionByName, each)


def _months(ledger: DataFrame) -> DataFrame:
    return ledger.groupBy("user_id").agg(F.count("*").alias("n"), F.max("ts").alias("last_ts"))


def t05_affected_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-user totals after the later half of the events arrives: equal to a full build."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    state = _months(events.filter("event_id % 2 = 0"))
    return recompute(events, events.filter("event_id % 2 = 1"), ["user_id"], _months, state).select("user_id", "n", "last_ts")


def t07_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_name", "c_acctbal")
    return upsert(c, c.filter("c_custkey % 3 = 0").withColumn("c_acctbal", F.lit(0.0)), ["c_custkey"])[0]


def t10_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_name", "c_acctbal")
    return upsert(c, c.filter("c_custkey % 3 = 0").withColumn("c_acctbal", F.lit(0.0)), ["c_custkey"])[1]


def t08_insert_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_name")
    return insert_missing(c.filter("c_custkey % 2 = 0"), c.withColumn("c_name", F.upper("c_name")), ["c_custkey"])


def t01_late_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that a build looks at again: from seven days before the watermark, floored to its month."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    day = events.agg(F.max(F.to_date("ts")).cast("string")).first()[0]
    start, end = late_window(day, day)
    return events.filter(f"to_date(ts) >= {start} AND to_date(ts) <= {end}").groupBy("event_type").agg(F.count("*").alias("n"))


def t02_joint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The older of two outputs' watermarks, each the last day of an event type."""
    marks = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("event_type").agg(F.max(F.to_date("ts")).cast("string").alias("mark"))
    return marks.agg(F.min("mark").alias("mark"))


def t03_advance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marks after a build that succeeded, one that failed, and one that was late."""
    log = f"{folder(spark, 'state')}/{uuid.uuid4().hex[:12]}"
    for name, mark, done in (("lane", "2024-01-05", True), ("lane", "2024-02-01", False), ("corridor", "2024-01-09", True), ("corridor", "2024-01-02", True)):
        advance(spark, log, name, mark, done)
    return spark.createDataFrame(sorted(watermarks(spark, log).items()), "name string, mark string")


def t04_marker(spark: SparkSession, sf_dir: str) -> DataFrame:
    return since(spark.read.parquet(f"{sf_dir}/orders.parquet"), "o_orderdate", "1997-06-30").groupBy("o_orderstatus").agg(F.count("*").alias("n"))


def t06_anti_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of customers without any in the first year: what a load adds to a target that has the first year."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_custkey", F.year("o_orderdate").alias("year"))
    target = orders.join(orders.agg(F.min("year").alias("year")), "year").select("o_custkey").distinct()
    return insert_missing(target, orders.select("o_custkey").distinct(), ["o_custkey"]).join(target, "o_custkey", "left_anti")


def t09_write_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    open_ = c.select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")).alias("org"))
    return write_back(open_, c.filter("c_custkey % 3 = 0").select("c_custkey", F.upper("c_name").alias("org")), "c_custkey", "org")


def t11_stamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_acctbal")
    day = lambda d: F.lit(d).cast("timestamp")
    old = c.filter("c_custkey % 2 = 0").withColumns({"created_at": day("2024-01-01"), "updated_at": day("2024-01-01")})
    return stamped(old, c.filter("c_custkey % 3 = 0"), ["c_custkey"], "2024-02-02").select("c_custkey", F.to_date("created_at").alias("created"), F.to_date("updated_at").alias("updated"))


def t12_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("session_id", F.when(F.col("user_id") % 5 > 0, F.concat(F.lit("s"), F.col("user_id") % 5)))
    return without_session(events, "s3").groupBy("session_id").agg(F.count("*").alias("n"))


def t14_late_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as files: ingested on their day, standardized if urgent, loaded before that if large."""
    at = F.col("o_orderdate")
    done = F.when(F.col("o_orderpriority").startswith("1") | F.col("o_orderpriority").startswith("2"), F.date_add(at, 1).cast("timestamp"))
    files = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").cast("string").alias("path"), at.cast("timestamp").alias("ingested_at"), done.alias("standardized_at"), F.when(F.col("o_totalprice") > 100000, at.cast("timestamp")).alias("loaded_at"))
    return late(files, ["standardized", "loaded"]).groupBy("stage").agg(F.count("*").alias("n"))


def t13_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States of a run that counts rows, one that fails and one that is partial."""
    from lanewise.streaming.runs import SCHEMA, runs, tracked

    log = f"{folder(spark, 'state')}/{uuid.uuid4().hex[:12]}"
    with tracked(spark, log, "load") as run:
        run.add(rows=spark.read.parquet(f"{sf_dir}/nation.parquet").count())
    with contextlib.suppress(ValueError), tracked(spark, log, "broken"):
        raise ValueError("no file")
    with tracked(spark, log, "half") as run:
        run.partial("one file is missing")
    return runs(spark.read.schema(SCHEMA).parquet(log)).select("pipeline", "status", F.col("counts")["rows"].alias("row_count"), "note", "error")


QUERIES = {f.__name__: f for f in (t01_late_window, t02_joint, t03_advance, t04_marker, t05_affected_keys, t06_anti_load, t07_upsert, t08_insert_missing, t09_write_back, t10_history, t11_stamps, t12_delete, t13_runs, t14_late_files)}
ORACLES = {
    "t05_affected_keys": "SELECT user_id, count(*) AS n, max(ts) AS last_ts FROM events GROUP BY user_id",
    "t07_upsert": "SELECT c_custkey, c_name, CASE WHEN c_custkey % 3 = 0 THEN 0e0 ELSE c_acctbal END AS c_acctbal FROM customer",
    "t10_history": "SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey % 3 = 0",
    "t08_insert_missing": "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE upper(c_name) END AS c_name FROM customer",
    "t01_late_window": "SELECT event_type, count(*) AS n FROM events WHERE CAST(ts AS DATE) >= date_trunc('month', (SELECT max(CAST(ts AS DATE)) FROM events) - INTERVAL 7 DAY) GROUP BY 1",
    "t02_joint": "SELECT CAST(min(d) AS VARCHAR) AS mark FROM (SELECT max(CAST(ts AS DATE)) AS d FROM events GROUP BY event_type)",
    "t03_advance": "SELECT 'corridor' AS name, '2024-01-09' AS mark UNION ALL SELECT 'lane', '2024-01-05'",
    "t04_marker": "SELECT o_orderstatus, count(*) AS n FROM orders WHERE CAST(o_orderdate AS DATE) > DATE '1997-06-30' GROUP BY 1",
    "t06_anti_load": "SELECT o_custkey FROM orders GROUP BY 1 HAVING min(year(o_orderdate)) > (SELECT min(year(o_orderdate)) FROM orders)",
    "t09_write_back": "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_name WHEN c_custkey % 3 = 0 THEN upper(c_name) END AS org FROM customer",
    "t11_stamps": "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN DATE '2024-01-01' ELSE DATE '2024-02-02' END AS created, CASE WHEN c_custkey % 3 = 0 THEN DATE '2024-02-02' ELSE DATE '2024-01-01' END AS updated FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 3 = 0",
    "t12_delete": "SELECT CASE WHEN user_id % 5 > 0 THEN 's' || (user_id % 5) END AS session_id, count(*) AS n FROM events WHERE user_id % 5 <> 3 GROUP BY 1",
    "t13_runs": "SELECT 'load' AS pipeline, 'SUCCESS' AS status, count(*) AS row_count, NULL AS note, NULL AS error FROM nation UNION ALL SELECT 'broken', 'FAILED', NULL, NULL, 'ValueError: no file' UNION ALL SELECT 'half', 'PARTIAL', NULL, 'one file is missing', NULL",
    "t14_late_files": "SELECT 'standardized' AS stage, count(*) AS n FROM orders WHERE o_orderpriority NOT LIKE '1%' AND o_orderpriority NOT LIKE '2%' UNION ALL SELECT 'loaded', count(*) FROM orders WHERE o_orderpriority LIKE '1%' OR o_orderpriority LIKE '2%'",
}
