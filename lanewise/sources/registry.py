"""The registry of mappings: keys, states, what an upload may do; uploads, file listings and the sandbox."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lanewise.functions import scalars as X
from lanewise.operators.serving import filtered, page
from lanewise.sources import discovery, files

KEYS = ["reporting_country", "direction", "source_format"]
SANDBOX_ROWS = 1_000
_KEY = r"(?i)^(.+?)_(import|export)_(full|short)$"


def config_key(key: Column) -> dict[str, Column]:
    """Country, direction and format of keys such as ivory_coast_import_full; null for others."""
    part = lambda k: F.when(key.rlike(_KEY), F.upper(F.regexp_extract(key, _KEY, k)))
    return {"reporting_country": F.replace(part(1), F.lit("_"), F.lit(" ")), "direction": part(2), "source_format": part(3)}


def scan(spark: SparkSession, folder: str) -> DataFrame:
    """(config_key, yaml_path and KEYS) of the mapping files of a folder whose names are keys."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.{yml,yaml,json}").load(folder).select(F.col("path").alias("yaml_path"))
    keyed = found.withColumn("config_key", F.regexp_extract("yaml_path", r"([^/]*)\.[^./]*$", 1))
    return keyed.select("config_key", "yaml_path", *[c.alias(n) for n, c in config_key(F.col("config_key")).items()]).filter("reporting_country IS NOT NULL")


def register(old: DataFrame, new: DataFrame) -> DataFrame:
    """The registry after an upsert on KEYS of new(KEYS, config_key, yaml_path, status, notes): a LIVE mapping stays LIVE, and notes stay where none come."""
    o = old.select(*KEYS, *[F.col(c).alias(f"_{c}") for c in ("config_key", "yaml_path", "status", "notes")])
    both = o.join(new, KEYS, "full")
    state = F.when(F.col("_status") == "LIVE", "LIVE").otherwise(F.coalesce("status", "_status"))
    return both.select(*KEYS, F.coalesce("config_key", "_config_key").alias("config_key"), F.coalesce("yaml_path", "_yaml_path").alias("yaml_path"), state.alias("status"), F.coalesce("notes", "_notes").alias("notes"))


def live(registry: DataFrame, country: str | None = None, direction: str | None = None) -> DataFrame:
    return filtered(registry.filter("status = 'LIVE'"), reporting_country=country and country.upper(), direction=direction and direction.upper()).orderBy(*KEYS)


def gated(asked: DataFrame, registry: DataFrame) -> DataFrame:
    """asked(KEYS) with the state of its mapping, NOT_FOUND where there is none, and the modes that it allows."""
    upper = asked.select(*[c for c in asked.columns if c not in KEYS], *[F.upper(F.col(k)).alias(k) for k in KEYS])
    state = F.coalesce("status", F.lit("NOT_FOUND"))
    return upper.join(registry.select(*[F.upper(F.col(k)).alias(k) for k in KEYS], "status"), KEYS, "left").withColumns({"status": state, "allowed_modes": files.modes(state)})


def upload(spark: SparkSession, path: str, mapping: dict, registry: DataFrame, seen: DataFrame, mode: str, header_row: int = 1) -> tuple[str, list[str]]:
    """(REJECTED, DUPLICATE or ACCEPTED, missing columns or the modes that are allowed) of one file to be ingested in a mode."""
    asked = spark.createDataFrame([tuple(mapping[k] for k in KEYS)], ", ".join(f"{k} string" for k in KEYS))
    allowed = gated(asked, registry).first()["allowed_modes"]
    if mode not in allowed:
        return "REJECTED", list(allowed)
    own = files.discover(spark, path, "*")
    if files.not_ingested(own, seen).isEmpty():
        return "DUPLICATE", []
    needed = [f for rule, f in (("require_hs_code", "hs_code_raw"), ("require_importer", "buyer_name_raw"), ("require_value_usd", "value_raw"), ("require_quantity", "qty_raw")) if mapping.get("quality_rules", {}).get(rule)]
    missing = files.missing_columns(files.read_csv(spark, path, header_row), mapping["column_mapping"], needed)
    return ("REJECTED", missing) if missing else ("ACCEPTED", [])


def file_list(registry: DataFrame, limit: int = 50, offset: int = 0, **conditions) -> DataFrame:
    """Registered files under the conditions that aren't None, the latest first."""
    return page(filtered(registry, **conditions), [F.desc("at"), F.asc("checksum")], limit, offset)


def sandbox(df: DataFrame, rows: int = SANDBOX_ROWS) -> DataFrame:
    """Some rows of a source for a trial of its mapping, with upper-case names: a bounded sample by its purpose."""
    return files.raw_rows(df.limit(rows).toDF(*[c.strip().upper().replace(" ", "_") for c in df.columns]))


_COUNTRY = "concat(case when n_nationkey % 2 = 0 then 'Ivory_' else '' end, n_name)"
_STATE = "element_at(array('DRAFT', 'VERIFIED', 'LIVE'), cast(n_nationkey % 3 + 1 as int))"


def _registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mapping per nation, in the three states in turn."""
    n = spark.read.parquet(f"{sf_dir}/nation.parquet").withColumn("key", F.expr(f"lower(concat({_COUNTRY}, case when n_nationkey % 4 < 2 then '_import_full' else '_export_short' end))"))
    return n.select(*[c.alias(k) for k, c in config_key(F.col("key")).items()], F.col("key").alias("config_key"), F.concat(F.lit("config/"), "key", F.lit(".yml")).alias("yaml_path"), F.expr(_STATE).alias("status"), F.when(F.col("n_nationkey") % 5 == 0, "seen").alias("notes"))


def c30_register(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registry after every mapping comes again as VERIFIED, without notes."""
    old = _registry(spark, sf_dir)
    return register(old, old.withColumns({"status": F.lit("VERIFIED"), "notes": F.lit(None).cast("string")}))


def v16_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    return live(_registry(spark, sf_dir), direction="import").select(*KEYS, "config_key")


def c29_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What imports in full of each nation may do."""
    asked = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.expr(f"replace({_COUNTRY}, '_', ' ')").alias("reporting_country"), F.lit("import").alias("direction"), F.lit("full").alias("source_format"))
    return gated(asked, _registry(spark, sf_dir)).select("reporting_country", "status", F.array_join("allowed_modes", ",").alias("modes"))


def q23_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of orders as files that failed."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").cast("string").alias("checksum"), F.col("o_orderdate").alias("at"), F.when(F.col("o_orderstatus") == "F", "FAILED").otherwise("INGESTED").alias("status"))
    return file_list(orders, 20, 10, status="FAILED").select("checksum", F.to_date("at").alias("day"))


def q24_upload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers to an upload in a mode that isn't allowed, without a required column, whole, and a second time."""
    from lanewise.sources import ingest

    path = f"{ingest.samples(spark, sf_dir)}/raw/{ingest.SAMPLES[0][2]}"
    mapping = discovery.draft_mapping("KENYA", "IMPORT", "FULL", ["S_SUPPKEY", "S_NAME"]) | {"quality_rules": {"require_hs_code": True}}
    whole = mapping | {"column_mapping": mapping["column_mapping"] | {"hs_code_raw": "S_SUPPKEY"}}
    known = spark.createDataFrame([("KENYA", "IMPORT", "FULL", "VERIFIED")], "reporting_country string, direction string, source_format string, status string")
    none = spark.createDataFrame([], "checksum string, status string")
    seen = files.discover(spark, path, "*").select("checksum", F.lit("INGESTED").alias("status"))
    answers = [upload(spark, path, mapping, known, none, "FULL_PIPELINE"), upload(spark, path, mapping, known, none, "INGEST_ONLY"), upload(spark, path, whole, known, none, "INGEST_AND_STANDARDIZE"), upload(spark, path, whole, known, seen, "INGEST_ONLY")]
    return spark.createDataFrame([(k, state, ",".join(more)) for k, (state, more) in enumerate(answers)], "step long, answer string, details string")


def c27_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of usable fields of parts seen as shipments, every tenth without a date and every eighth without a weight."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    own = part.select(F.when(F.col("p_partkey") % 10 > 0, F.lit("2024-01-05").cast("date")).alias("shipment_date"), X.hs_code_6(F.col("p_partkey").cast("string")).alias("hs_code_6"), F.when(F.col("p_partkey") % 8 > 0, F.col("p_size").cast("double")).alias("qty_kg"), F.col("p_retailprice").alias("value_usd"))
    return files.quality(own)


def s19_sandbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names and number of the raw rows that a trial reads."""
    return sandbox(spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("order key"), "o_orderstatus")).select(F.explode(F.map_keys("raw_data")).alias("name")).groupBy("name").agg(F.count("*").alias("n"))


def s22_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts of file names made from nations."""
    name = F.expr("concat(replace(n_name, '_', ' '), case when n_nationkey % 2 = 0 then ' Import ' else ' export ' end, element_at(array('F', 's', 'Full', 'odd'), cast(n_nationkey % 4 + 1 as int)), case when n_nationkey % 3 = 0 then ' (2)' else '' end, '.xlsx')")
    return spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", *[c.alias(k) for k, c in discovery.file_name(name).items()])


def s02_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The metadata of paths made from nations."""
    path = F.expr("concat('/data/raw/', lower(n_name), case when n_nationkey % 2 = 0 then '/imports/' else '/export/' end, 2000 + n_nationkey, '/', lpad(cast(n_nationkey % 14 as string), 2, '0'), '/report', case when n_nationkey % 3 = 0 then ' summary' else '' end, '.csv')")
    return spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", *[c.cast("long").alias(k) if k in ("year", "month") else c.alias(k) for k, c in X.path_metadata(path).items()])


QUERIES = {f.__name__: f for f in (c30_register, v16_live, c29_modes, q23_files, q24_upload, c27_quality, s19_sandbox, s22_names, s02_paths)}

_NAME = "(CASE WHEN n_nationkey % 2 = 0 THEN 'IVORY ' ELSE '' END || replace(upper(n_name), '_', ' '))"
_DIRECTION = "CASE WHEN n_nationkey % 4 < 2 THEN 'IMPORT' ELSE 'EXPORT' END"
_FORMAT = "CASE WHEN n_nationkey % 4 < 2 THEN 'FULL' ELSE 'SHORT' END"
_LOWER = f"replace(lower({_NAME}), ' ', '_') || lower('_' || {_DIRECTION} || '_' || {_FORMAT})"
ORACLES = {
    "c30_register": f"SELECT {_NAME} AS reporting_country, {_DIRECTION} AS direction, {_FORMAT} AS source_format, {_LOWER} AS config_key, 'config/' || {_LOWER} || '.yml' AS yaml_path, CASE WHEN n_nationkey % 3 = 2 THEN 'LIVE' ELSE 'VERIFIED' END AS status, CASE WHEN n_nationkey % 5 = 0 THEN 'seen' END AS notes FROM nation",
    "v16_live": f"SELECT {_NAME} AS reporting_country, 'IMPORT' AS direction, 'FULL' AS source_format, {_LOWER} AS config_key FROM nation WHERE n_nationkey % 3 = 2 AND n_nationkey % 4 < 2",
    "c29_modes": f"SELECT {_NAME} AS reporting_country, CASE WHEN n_nationkey % 4 > 1 THEN 'NOT_FOUND' ELSE ['DRAFT', 'VERIFIED', 'LIVE'][n_nationkey % 3 + 1] END AS status, 'INGEST_ONLY' || CASE WHEN n_nationkey % 4 < 2 AND n_nationkey % 3 > 0 THEN ',INGEST_AND_STANDARDIZE' ELSE '' END || CASE WHEN n_nationkey % 4 < 2 AND n_nationkey % 3 = 2 THEN ',FULL_PIPELINE' ELSE '' END AS modes FROM nation",
    "q23_files": "SELECT o_orderkey::VARCHAR AS checksum, o_orderdate::DATE AS day FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderdate DESC, o_orderkey::VARCHAR LIMIT 20 OFFSET 10",
    "q24_upload": "SELECT * FROM (VALUES (0::BIGINT, 'REJECTED', 'INGEST_ONLY,INGEST_AND_STANDARDIZE'), (1, 'REJECTED', 'hs_code_raw'), (2, 'ACCEPTED', ''), (3, 'DUPLICATE', '')) x(step, answer, details)",
    "c27_quality": "SELECT count(*) AS n, round(100e0 * count(*) FILTER (p_partkey % 10 > 0) / count(*), 4) AS date_pct, round(100e0 * count(*) FILTER (p_partkey > 9) / count(*), 4) AS hs_pct, round(100e0 * count(*) FILTER (p_partkey % 8 > 0 AND p_size > 0) / count(*), 4) AS qty_pct, round(100e0 * count(*) FILTER (p_retailprice > 0) / count(*), 4) AS value_pct, count(*) FILTER (p_partkey % 10 > 0) >= 9e-1 * count(*) AND count(*) FILTER (p_partkey > 9) >= 9e-1 * count(*) AS passed FROM part",
    "s19_sandbox": "SELECT name, least(1000, count(*)) AS n FROM orders, (VALUES ('ORDER_KEY'), ('O_ORDERSTATUS')) x(name) GROUP BY 1",
    "s22_names": "SELECT n_nationkey, CASE WHEN n_nationkey % 4 < 3 THEN upper(n_name) END AS country, CASE WHEN n_nationkey % 4 < 3 THEN CASE WHEN n_nationkey % 2 = 0 THEN 'IMPORT' ELSE 'EXPORT' END END AS direction, CASE n_nationkey % 4 WHEN 1 THEN 'SHORT' WHEN 3 THEN NULL ELSE 'FULL' END AS source_format FROM nation",
    "s02_paths": "SELECT n_nationkey, upper(n_name) AS reporting_country, CASE WHEN n_nationkey % 2 = 0 THEN 'IMPORT' ELSE 'EXPORT' END AS direction, 2000 + n_nationkey AS year, CASE WHEN n_nationkey % 14 BETWEEN 1 AND 12 THEN n_nationkey % 14 END AS month, CASE WHEN n_nationkey % 3 = 0 THEN 'SHORT' ELSE 'FULL' END AS source_format FROM nation",
}
