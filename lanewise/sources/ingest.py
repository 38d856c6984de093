"""Ingestion of files: a registry of files and their states, raw rows with row numbers, sinks, and table access."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lanewise.sources.files import discover, raw_lines
from lanewise.storage import folder, written

#: A row per change; a file is known by its checksum, and its state is its last change.
REGISTRY = "checksum string, change long, path string, reporting_country string, direction string, source_format string, status string, row_count long, error string, at timestamp"
RAW = "path string, checksum string, reporting_country string, direction string, source_format string, row_number long, raw_data map<string,string>"
#: The names under which a raw row may hold its code, parties and date; the first that is there counts.
ALIASES = {
    "hs_code_raw": ["hs_code", "HS_CODE", "hscode"], "buyer_name_raw": ["buyer", "BUYER", "importer"],
    "supplier_name_raw": ["supplier", "SUPPLIER", "exporter"], "shipment_date_raw": ["date", "shipment_date"],
}


def first_alias(raw_data: Column, names: list[str]) -> Column:
    """The first value of a map that isn't empty, or an empty text."""
    return F.coalesce(*[F.nullif(raw_data[F.lit(n)], F.lit("")) for n in names], F.lit(""))


def with_aliases(raw: DataFrame) -> DataFrame:
    return raw.withColumns({field: first_alias(F.col("raw_data"), names) for field, names in ALIASES.items()})


def registry(spark: SparkSession, log: str) -> DataFrame:
    """The state of every file: its last change."""
    try:
        rows = spark.read.schema(REGISTRY).parquet(log)
    except Exception:  # no change has been logged yet
        return spark.createDataFrame([], REGISTRY)
    names = [f for f in rows.columns if f != "checksum"]
    return rows.groupBy("checksum").agg(F.max_by(F.struct(*names), "change").alias("last")).select("checksum", "last.*")


def set_status(spark: SparkSession, log: str, files: DataFrame, status: str, error: str | None = None) -> None:
    """Append a change for each of files(checksum, path, reporting_country, direction, source_format and maybe row_count)."""
    known = registry(spark, log).select("checksum", F.col("change").alias("known"))
    n = F.col("row_count") if "row_count" in files.columns else F.lit(None).cast("long")
    out = files.join(known, "checksum", "left").select("checksum", F.coalesce(F.col("known") + 1, F.lit(0)).cast("long").alias("change"), "path", "reporting_country", "direction", "source_format", F.lit(status).alias("status"), n.alias("row_count"), F.lit(error).cast("string").alias("error"), F.current_timestamp().alias("at"))
    out.coalesce(1).write.mode("append").parquet(log)


def pending(files: DataFrame, done: str = "INGESTED") -> DataFrame:
    """Registered files that a stage hasn't taken yet, oldest first."""
    return files.filter(F.col("status") != done).orderBy("at", "checksum")


def ingest(spark: SparkSession, root: str, log: str, raw: str, header_row: int = 1, glob: str = "*.csv") -> DataFrame:
    """Ingest the files below root into the raw table: (path, status, rows_ingested) of every file.

    DUPLICATE: its content is ingested already, or is that of a file with a smaller path. SKIPPED: a test file by its name.
    INGESTED: its rows are in the raw table, which is partitioned by country and direction. A run that fails marks its files
    FAILED and raises; these are taken again by the next run, whose rows replace theirs since rows are told by checksum.
    """
    found = discover(spark, root, glob)
    known = registry(spark, log).filter("status = 'INGESTED'").select("checksum", F.lit(True).alias("known"))
    first = found.groupBy("checksum").agg(F.min("path").alias("path"), F.lit(True).alias("first"))
    state = F.when(F.col("known") | F.col("first").isNull(), "DUPLICATE").when(F.col("source_format") == "TEST", "SKIPPED").otherwise("PROCESSING")
    judged = found.join(known, "checksum", "left").join(first, ["checksum", "path"], "left").withColumn("status", state).drop("known", "first")
    judged = written(spark, judged, "judged", "ingest")  # decided once, before the registry changes
    todo = judged.filter("status = 'PROCESSING'").drop("status")
    paths = [r["path"] for r in todo.select("path").toLocalIterator()]  # a row per new file of this run
    counts = spark.createDataFrame([], "path string, row_count long")
    if paths:
        set_status(spark, log, todo, "PROCESSING")
        try:
            rows = raw_lines(spark, paths, header_row).join(todo.select("path", "checksum", "reporting_country", "direction", "source_format"), "path")
            append(rows.select(*[c.split()[0] for c in RAW.split(", ")]), raw, ["reporting_country", "direction"])
            counts = spark.read.parquet(raw).join(todo.select("checksum"), "checksum", "left_semi").groupBy("path").agg(F.count("*").alias("row_count"))
            set_status(spark, log, todo.join(counts, "path", "left").fillna(0, ["row_count"]), "INGESTED")
        except Exception as e:
            set_status(spark, log, todo, "FAILED", str(e)[:1000])
            raise
    done = F.when(F.col("status") == "PROCESSING", "INGESTED").otherwise(F.col("status"))
    return judged.join(counts, "path", "left").select("path", done.alias("status"), F.coalesce("row_count", F.lit(0)).alias("rows_ingested"))


def append(df: DataFrame, path: str, partition_by: list[str]) -> None:
    """Append rows to a Parquet table; every value of the partition columns is written by as many tasks as its size asks for."""
    df.hint("rebalance", *partition_by).write.mode("append").partitionBy(*partition_by).parquet(path)


def replace_partitions(spark: SparkSession, df: DataFrame, path: str, partition_by: list[str]) -> None:
    """Replace those partitions of a table that df has rows of, and no others."""
    df.hint("rebalance", *partition_by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by).parquet(path)


def export_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", "true").csv(path)


def without(spark: SparkSession, path: str, predicate: str, new_path: str) -> int:
    """Write a table without the rows that fulfil a predicate to a new path, and return how many they are; rows for which it is unknown stay."""
    rows = spark.read.parquet(path)
    gone = F.coalesce(F.expr(predicate), F.lit(False))
    rows.filter(~gone).write.parquet(new_path)
    return rows.filter(gone).count()


def query(spark: SparkSession, text: str, **tables: DataFrame | str | int | float) -> DataFrame:
    """A statement over tables named in braces; plain values among the arguments are bound as :name parameters."""
    frames = {k: v for k, v in tables.items() if isinstance(v, DataFrame)}
    return spark.sql(text, {k: v for k, v in tables.items() if k not in frames}, **frames)


def exists(spark: SparkSession, path: str) -> bool:
    own = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return own.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(own)


def table_sizes(spark: SparkSession, path: str) -> DataFrame:
    """(files, bytes, row_count) of a Parquet table: files and bytes from its listing, rows from the footers."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path).agg(F.count("*").alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))
    return listed.crossJoin(spark.read.parquet(path).agg(F.count("*").alias("row_count")))


def one_csv(spark: SparkSession, df: DataFrame, path: str) -> None:
    """A small table as one CSV file with a header."""
    df.coalesce(1).write.option("header", "true").csv(f"{path}.parts")
    Path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    parts = Path(f"{path}.parts")
    fs = parts.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    part = next(f.getPath() for f in fs.listStatus(parts) if f.getPath().getName().startswith("part-"))
    fs.rename(part, Path(path))
    fs.delete(parts, True)


#: Sample files in the layout of a raw folder: table, its key, place. The third is a copy of the first, the last a test file.
SAMPLES = [("supplier", "s_suppkey", "kenya/import/2023/01/Kenya Import F.csv"), ("customer", "c_custkey", "kenya/export/2023/02/Kenya Export F.csv"), ("supplier", "s_suppkey", "kenya/import/2023/03/Kenya Import F.csv"), ("nation", "n_nationkey", "kenya/import/2023/04/kenya_import_202304.csv")]


def samples(spark: SparkSession, sf_dir: str) -> str:
    """The folder of SAMPLES, made from the tables of sf_dir."""
    root = f"{folder(spark, 'ingest')}/{uuid.uuid4().hex[:12]}"
    for name, key, place in SAMPLES:
        one_csv(spark, spark.read.parquet(f"{sf_dir}/{name}.parquet").orderBy(key), f"{root}/raw/{place}")
    return root


def s18_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw rows that a run over a folder of files leaves, and a second run over the same folder adds none to."""
    root = samples(spark, sf_dir)
    log, raw = f"{root}/registry", f"{root}/table"
    ingest(spark, f"{root}/raw", log, raw)
    ingest(spark, f"{root}/raw", log, raw)
    return spark.read.parquet(raw).groupBy("reporting_country", "direction", "source_format").agg(F.count("*").alias("n"), F.max("row_number").alias("last_row"), F.count_if(F.map_contains_key("raw_data", F.lit("S_SUPPKEY"))).alias("suppliers"))


def s10_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a first and a second run over one folder say of each file."""
    root = samples(spark, sf_dir)
    log, raw = f"{root}/registry", f"{root}/table"
    runs = [ingest(spark, f"{root}/raw", log, raw).withColumn("run", F.lit(k).cast("long")) for k in (1, 2)]
    return runs[0].unionByName(runs[1]).groupBy("run", "status").agg(F.count("*").alias("files"), F.sum("rows_ingested").alias("row_count"))


def w11_row_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The row number of every line of a file, and the value it had there."""
    lines = raw_lines(spark, [f"{samples(spark, sf_dir)}/raw/{SAMPLES[1][2]}"])
    return lines.select("row_number", F.col("raw_data")["C_CUSTKEY"].cast("long").alias("c_custkey"))


def s08_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First aliases of raw rows in which part names stand under one of three keys."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    key = F.when(F.col("p_partkey") % 3 == 0, "hs_code").when(F.col("p_partkey") % 3 == 1, "hscode").otherwise("other")
    raw = part.select("p_partkey", F.create_map(key, F.col("p_name"), F.lit("HS_CODE"), F.lit("")).alias("raw_data"))
    return with_aliases(raw).select("p_partkey", "hs_code_raw", "buyer_name_raw")


def s25_wipe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders without those of a status: rows that are left and rows that went."""
    root = f"{folder(spark, 'ingest')}/{uuid.uuid4().hex[:12]}"
    gone = without(spark, f"{sf_dir}/orders.parquet", "o_orderstatus = 'F'", root)
    return spark.read.parquet(root).agg(F.count("*").alias("left_over"), F.lit(gone).cast("long").alias("gone"))


def s15_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders appended to a table by year, then one year replaced by its rows of a status."""
    root = f"{folder(spark, 'ingest')}/{uuid.uuid4().hex[:12]}"
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_orderstatus", F.year("o_orderdate").alias("year"))
    append(orders, root, ["year"])
    replace_partitions(spark, orders.filter("year = 1996 AND o_orderstatus = 'O'"), root, ["year"])
    return spark.read.parquet(root).groupBy(F.col("year").cast("long").alias("year")).agg(F.count("*").alias("n"))


def s27_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table written as CSV and read again."""
    root = f"{folder(spark, 'ingest')}/{uuid.uuid4().hex[:12]}"
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_name", "p_retailprice")
    export_csv(part, root)
    return spark.read.schema(part.schema).option("header", "true").csv(root)


def s16_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return query(spark, "SELECT o_orderstatus, count(*) AS n FROM {orders} WHERE o_totalprice >= :least GROUP BY o_orderstatus", orders=spark.read.parquet(f"{sf_dir}/orders.parquet"), least=100000)


def s17_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether tables exist, and their rows."""
    names = ["orders", "nation", "no_such_table"]
    have = [n for n in names if exists(spark, f"{sf_dir}/{n}.parquet")]
    counts = [table_sizes(spark, f"{sf_dir}/{n}.parquet").select(F.lit(n).alias("name"), F.lit(True).alias("found"), "row_count") for n in have]
    none = spark.createDataFrame([(n, False, None) for n in names if n not in have], "name string, found boolean, row_count long")
    for c in counts:
        none = none.unionByName(c)
    return none


QUERIES = {f.__name__: f for f in (s18_ingest, s10_states, w11_row_numbers, s08_aliases, s25_wipe, s15_partitions, s27_export, s16_query, s17_counts)}
ORACLES = {
    "s18_ingest": "SELECT 'KENYA' AS reporting_country, 'IMPORT' AS direction, 'FULL' AS source_format, count(*) AS n, count(*) AS last_row, count(*) AS suppliers FROM supplier UNION ALL SELECT 'KENYA', 'EXPORT', 'FULL', count(*), count(*), 0 FROM customer",
    "s10_states": "SELECT 1 AS run, 'INGESTED' AS status, 2 AS files, (SELECT count(*) FROM supplier) + (SELECT count(*) FROM customer) AS row_count UNION ALL SELECT 1, 'DUPLICATE', 1, 0 UNION ALL SELECT 1, 'SKIPPED', 1, 0 UNION ALL SELECT 2, 'DUPLICATE', 3, 0 UNION ALL SELECT 2, 'SKIPPED', 1, 0",
    "w11_row_numbers": "SELECT row_number() OVER (ORDER BY c_custkey) AS row_number, c_custkey FROM customer",
    "s08_aliases": "SELECT p_partkey, CASE WHEN p_partkey % 3 < 2 THEN p_name ELSE '' END AS hs_code_raw, '' AS buyer_name_raw FROM part",
    "s25_wipe": "SELECT count(*) FILTER (o_orderstatus <> 'F') AS left_over, count(*) FILTER (o_orderstatus = 'F') AS gone FROM orders",
    "s15_partitions": "SELECT year(o_orderdate) AS year, count(*) FILTER (year(o_orderdate) <> 1996 OR o_orderstatus = 'O') AS n FROM orders GROUP BY 1",
    "s27_export": "SELECT p_partkey, p_name, p_retailprice FROM part",
    "s16_query": "SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_totalprice >= 100000 GROUP BY 1",
    "s17_counts": "SELECT 'orders' AS name, TRUE AS found, count(*) AS row_count FROM orders UNION ALL SELECT 'nation', TRUE, count(*) FROM nation UNION ALL SELECT 'no_such_table', FALSE, NULL",
}
