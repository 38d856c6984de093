"""Source files: discovery, metadata, checksums, raw rows, mapping to the shipment schema, and synthetic ledgers."""

from __future__ import annotations

import csv
from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lanewise.functions import scalars as X

#: Standard fields that a mapping may name, and how each is cleaned.
FIELDS = ["buyer_name_raw", "supplier_name_raw", "hs_code_raw", "origin_country_raw", "destination_country_raw", "shipment_date_raw", "qty_raw", "unit_raw", "value_raw", "vessel_name", "container_id"]


def discover(spark: SparkSession, root: str, glob: str = "*.{csv,xlsx,xls}") -> DataFrame:
    """(path, checksum, bytes and path metadata) of every file below root."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    return files.select("path", F.sha2("content", 256).alias("checksum"), F.col("length").alias("bytes"), *[c.alias(n) for n, c in X.path_metadata(F.col("path")).items()])


def not_ingested(files: DataFrame, registry: DataFrame) -> DataFrame:
    """Files whose checksum is not INGESTED; of equal files the first path."""
    first = files.groupBy("checksum").agg(F.min_by(F.struct(*[F.col(c) for c in files.columns]), "path").alias("f")).select("f.*")
    return first.join(registry.filter("status = 'INGESTED'").select("checksum"), "checksum", "left_anti")


def numbered_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, line, fields): every line of text files that isn't blank, its number from 1 and its comma-separated fields.

    A task numbers the lines of a split; the splits of a file are then added up, a row per split. Fields hold no line breaks.
    """

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: dict[tuple[str, int], int] = {}
        for b in batches:
            # The names of files as their listing gives them, not as URLs.
            paths = {p: unquote(p).replace("file:///", "file:/", 1) for p in b.column(0).unique().to_pylist()}
            where, rows = [(paths[p], k) for p, k in zip(b.column(0).to_pylist(), b.column(1).to_pylist())], b.column(2).to_pylist()
            own = []
            for key in where:
                at[key] = at.get(key, 0) + 1
                own.append(at[key])
            fields = [next(csv.reader([r]), []) for r in rows]
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in where], pa.string()), b.column(1), pa.array(own, pa.int64()), pa.array(fields, pa.list_(pa.string()))], names=["path", "block", "own", "fields"])

    lines = spark.read.text(paths).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), "value")
    own = lines.mapInArrow(number, "path string, block long, own long, fields array<string>")
    blocks = own.groupBy("path", "block").agg(F.max("own").alias("n"))
    before = blocks.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    return own.join(before, ["path", "block"]).select("path", (F.col("own") + F.col("before")).alias("line"), "fields").filter("size(fields) > 0")


def raw_lines(spark: SparkSession, paths: list[str], header_row: int = 1) -> DataFrame:
    """(path, row_number, raw_data) of CSV files, each with a header of its own at header_row, counted from 1.

    Names are upper-case with underscores; of equal names the first counts. Empty fields, those beyond the header and NaN are left out.
    """
    lines = numbered_lines(spark, paths)
    names = F.transform("fields", lambda c: F.upper(F.replace(F.trim(c), F.lit(" "), F.lit("_"))))
    heads = lines.filter(F.col("line") == header_row).select("path", names.alias("names"))
    rows = lines.filter(F.col("line") > header_row).join(heads, "path")
    pairs = F.filter(F.arrays_zip(F.col("names").alias("k"), F.slice("fields", F.lit(1), F.size("names")).alias("v")), lambda p: p["v"].isNotNull() & (F.trim(p["v"]) != "") & (F.lower(p["v"]) != "nan"))
    keyed = F.aggregate(pairs, F.create_map().cast("map<string,string>"), lambda m, p: F.when(F.map_contains_key(m, p["k"]), m).otherwise(F.map_concat(m, F.create_map(p["k"], p["v"]))))
    return rows.select("path", (F.col("line") - header_row).alias("row_number"), keyed.alias("raw_data"))


def read_csv(spark: SparkSession, paths: str | list[str], header_row: int = 1) -> DataFrame:
    """Rows as text, with upper-case names; header_row counts from 1 and lines above it are dropped. All files have one header."""
    if header_row == 1:
        df = spark.read.option("header", "true").csv(paths)
        return df.toDF(*[c.strip().upper().replace(" ", "_") for c in df.columns])
    lines = numbered_lines(spark, [paths] if isinstance(paths, str) else paths)
    heads = lines.filter(F.col("line") == header_row).select("fields").distinct().limit(2).collect()
    if len(heads) != 1:
        raise ValueError(f"the files have {'no header' if not heads else 'different headers'} at line {header_row}")
    names = [c.strip().upper().replace(" ", "_") for c in heads[0]["fields"]]
    return lines.filter(F.col("line") > header_row).select(*[F.nullif(F.get("fields", F.lit(i)), F.lit("")).alias(c) for i, c in enumerate(names)])


def raw_rows(df: DataFrame) -> DataFrame:
    """raw_data: a map of the columns that have a value."""
    each = F.create_map(*[x for c in df.columns for x in (F.lit(c), F.col(f"`{c}`").cast("string"))])
    return df.select(F.map_filter(each, lambda _, v: v.isNotNull() & (F.trim(v) != "") & (F.lower(v) != "nan")).alias("raw_data"))


def missing_columns(df: DataFrame, mapping: dict[str, str | None], required: list[str]) -> list[str]:
    have = {c.upper() for c in df.columns}
    return [f for f in required if (mapping.get(f) or "").upper() not in have]


def standardize(raw: DataFrame, config: dict) -> DataFrame:
    """Shipments from raw_data by a mapping: one projection. A null or TODO_ mapping gives null."""
    mapping, defaults = config["column_mapping"], config.get("defaults") or {}

    def field(name: str) -> Column:
        key = mapping.get(name)
        value = F.col("raw_data")[F.lit(key.upper())] if key and not key.startswith("TODO_") else F.lit(None).cast("string")
        return F.coalesce(value, F.lit(defaults.get(name)).cast("string"))

    qty = X.weight_kg(X.number(field("qty_raw")), field("unit_raw"), config.get("unit_conversions"))
    usd = X.value_usd(X.number(field("value_raw")), F.lit((config.get("value_currency") or {}).get("usd", "USD")))
    day = X.any_date(F.coalesce(field("shipment_date_raw"), field("export_date_raw"), field("import_date_raw"), field("monthyear_raw")))
    return raw.select(
        F.lit(config["reporting_country"]).alias("reporting_country"), F.lit(config["direction"]).alias("direction"),
        X.organisation(field("buyer_name_raw")).alias("buyer_name"), X.organisation(field("supplier_name_raw")).alias("supplier_name"), X.hs_code_6(field("hs_code_raw")).alias("hs_code_6"),
        X.country(field("origin_country_raw")).alias("origin_country"), X.country(field("destination_country_raw")).alias("destination_country"), day.alias("shipment_date"),
        F.year(day).alias("year"), F.month(day).alias("month"), qty.alias("qty_kg"), usd.alias("value_usd"), X.price_per_kg(usd, qty).alias("price_per_kg"), X.teu(qty).alias("teu"), field("vessel_name").alias("vessel_name"), field("container_id").alias("container_id"),
    )


def quality(df: DataFrame) -> DataFrame:
    """Shares of usable fields in one pass, and whether dates and product codes reach 90 %."""
    share = lambda c: F.round(100.0 * F.count_if(c) / F.greatest(F.count("*"), F.lit(1)), 4)
    out = df.agg(F.count("*").alias("n"), share(F.col("shipment_date").isNotNull()).alias("date_pct"), share(F.col("hs_code_6").isNotNull()).alias("hs_pct"), share(F.col("qty_kg") > 0).alias("qty_pct"), share(F.col("value_usd") > 0).alias("value_pct"))
    return out.withColumn("passed", (F.col("date_pct") >= 90) & (F.col("hs_pct") >= 90))


def modes(status: Column) -> Column:
    """What an upload may do, by the state of its mapping."""
    return F.when(status == "LIVE", F.array(*map(F.lit, ["INGEST_ONLY", "INGEST_AND_STANDARDIZE", "FULL_PIPELINE"]))).when(status == "VERIFIED", F.array(*map(F.lit, ["INGEST_ONLY", "INGEST_AND_STANDARDIZE"]))).otherwise(F.array(F.lit("INGEST_ONLY")))


def synthetic(spark: SparkSession, rows: int, seed: int = 42) -> DataFrame:
    """A seeded ledger of fake countries, products 2020-2021, 100 to 50,000 kg at 0.5 to 100 USD a kg."""
    pick = lambda n, k: F.pmod(F.xxhash64("id", F.lit(seed), F.lit(k)), F.lit(n))
    share = lambda k: pick(1_000_000, k) / 1_000_000
    base = spark.range(rows).withColumns({"qty_kg": F.round(100 + share(1) * 49_900, 2), "price_per_kg": F.round(0.5 + share(2) * 99.5, 2)})
    value = F.round(F.col("qty_kg") * F.col("price_per_kg"), 2)
    return base.select(
        (F.col("id") + 10_000_000).alias("std_id"), F.concat(F.lit("FAKE_"), pick(10, 3)).alias("reporting_country"), F.lpad((pick(40, 4) + 100_000).cast("string"), 6, "0").alias("hs_code_6"),
        F.date_add(F.lit("2020-01-01").cast("date"), pick(731, 5).cast("int")).alias("shipment_date"), "qty_kg", "price_per_kg", value.alias("value_usd"), F.round(value * 0.9, 2).alias("fob_usd"), F.round(value * 1.1, 2).alias("cif_usd"),
        F.when(share(6) >= 0.3, X.teu(F.col("qty_kg"))).alias("teu"), F.lit("SYNTHETIC").alias("source_format"),
    )


def s24_synthetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synthetic(spark, 10_000).groupBy("reporting_country").agg(F.count("*").alias("n"))


def s07_raw_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = raw_rows(spark.read.parquet(f"{sf_dir}/part.parquet"))
    config = {"reporting_country": "KENYA", "direction": "IMPORT", "column_mapping": {"hs_code_raw": "P_PARTKEY", "supplier_name_raw": "P_NAME", "qty_raw": "P_SIZE", "value_raw": "P_RETAILPRICE", "unit_raw": None}}
    upper = raw.select(F.transform_keys("raw_data", lambda k, _: F.upper(k)).alias("raw_data"))
    return standardize(upper, config).select("hs_code_6", "qty_kg", "value_usd", "reporting_country")


QUERIES = {"s24_synthetic": s24_synthetic, "s07_raw_rows": s07_raw_rows}
ORACLES = {"s07_raw_rows": "SELECT CASE WHEN length(CAST(p_partkey AS VARCHAR)) >= 2 THEN rpad(substr(CAST(p_partkey AS VARCHAR), 1, 6), 6, '0') END AS hs_code_6, CASE WHEN p_size <> 0 THEN CAST(p_size AS DOUBLE) END AS qty_kg, CASE WHEN p_retailprice <> 0 THEN p_retailprice END AS value_usd, 'KENYA' AS reporting_country FROM part"}
