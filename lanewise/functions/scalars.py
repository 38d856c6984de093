"""Cleaning functions for shipment fields, as column expressions."""

from __future__ import annotations

import unicodedata
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Country names, units, exchange rates, legal forms, abbreviations and mail domains that results depend on.
COUNTRIES = {
    "U.S.A.": "USA", "U.S.A": "USA", "UNITED STATES": "USA", "UNITED STATES OF AMERICA": "USA", "U.K.": "UK", "UNITED KINGDOM": "UK",
    "U.A.E.": "UAE", "UNITED ARAB EMIRATES": "UAE", "PEOPLES REPUBLIC OF CHINA": "CHINA", "PEOPLE'S REPUBLIC OF CHINA": "CHINA", "P.R. CHINA": "CHINA",
}
UNIT_KG = {
    "KG": 1.0, "KGM": 1.0, "KGS": 1.0, "KILOGRAMS": 1.0, "MT": 1000.0, "TNE": 1000.0, "METRIC TONS": 1000.0, "METRIC TON": 1000.0, "TON": 1000.0, "TONS": 1000.0,
    "LB": 0.453592, "LBS": 0.453592, "POUNDS": 0.453592, "G": 0.001, "GRM": 0.001, "GRAMS": 0.001, "GRAM": 0.001,
}
USD_RATES = {"INR": 0.012, "KES": 0.0077, "EUR": 1.10, "GBP": 1.27, "CNY": 0.14, "AED": 0.27, "BDT": 0.0091}
LEGAL_FORMS = [
    "PRIVATE LIMITED", "PVT LIMITED", "PVT LTD", "PRIVATE LTD", "PUBLIC LIMITED COMPANY", "LIMITED LIABILITY COMPANY", "LIMITED LIABILITY PARTNERSHIP", "JOINT STOCK COMPANY", "JOINT VENTURE",
    "SOLE PROPRIETOR", "SOLE PROPRIETORSHIP", "GENERAL PARTNERSHIP", "CO LTD", "CO LIMITED", "LIMITED", "LTD", "LLC", "LLP", "PLC", "INC", "INCORPORATED", "CORP", "CORPORATION", "COMPANY", "CO", "PVT",
    "PRIVATE", "PUBLIC", "GMBH", "AG", "SA", "SRL", "SARL", "BV", "NV", "AB", "AS", "OY", "PTY", "SDN", "BHD", "FZE", "FZC", "FZCO", "FZ", "DMCC", "PJSC", "JSC", "OOO", "ZAO", "OAO", "KK", "GK", "PT", "CV", "EPE",
]
ABBREVIATIONS = {
    "INTL": "INTERNATIONAL", "INT": "INTERNATIONAL", "CORP": "CORPORATION", "MFG": "MANUFACTURING", "MFRS": "MANUFACTURERS", "IND": "INDUSTRIES", "INDS": "INDUSTRIES", "TECH": "TECHNOLOGY",
    "CHEM": "CHEMICAL", "PHARM": "PHARMACEUTICAL", "EXP": "EXPORT", "IMP": "IMPORT", "ENGG": "ENGINEERING", "ENGR": "ENGINEERING", "AGRI": "AGRICULTURE", "ELEC": "ELECTRICAL", "ELECTR": "ELECTRICAL",
    "COMM": "COMMERCIAL", "COMMN": "COMMUNICATION", "SERV": "SERVICES", "SVCS": "SERVICES", "DIST": "DISTRIBUTORS", "DISTRS": "DISTRIBUTORS", "TRDG": "TRADING", "TRD": "TRADING", "GEN": "GENERAL",
    "GENL": "GENERAL", "BROS": "BROTHERS", "ASSOC": "ASSOCIATES", "GRPS": "GROUPS", "GRP": "GROUP", "HLDGS": "HOLDINGS", "HLDG": "HOLDING", "INVT": "INVESTMENT", "INVTS": "INVESTMENTS",
    "MGMT": "MANAGEMENT", "DEV": "DEVELOPMENT", "DEVT": "DEVELOPMENT", "ENTS": "ENTERPRISES", "ENT": "ENTERPRISE", "PRODS": "PRODUCTS", "PROD": "PRODUCTS", "SYS": "SYSTEMS", "SUPPL": "SUPPLY",
    "SUPP": "SUPPLY", "MKT": "MARKET", "MKTG": "MARKETING",
}
FREE_MAIL = ["gmail.com", "yahoo.com", "hotmail.com", "outlook.com", "aol.com", "mail.com", "protonmail.com", "icloud.com", "yandex.com", "zoho.com", "gmx.com", "live.com", "msn.com", "rediffmail.com", "mail.ru"]
DATE_FORMATS = ["yyyy-MM-dd", "dd-MM-yyyy", "dd/MM/yyyy", "MM/dd/yyyy", "dd-MMM-yyyy", "MMM yyyy", "yyyyMMdd"]
KG_PER_TEU = 20_000

#: Accented letters whose decomposition is one plain letter and marks, made by rule.
_ACCENTED = {chr(c): d for c in range(0xC0, 0x1F00) if len(d := "".join(x for x in unicodedata.normalize("NFKD", chr(c)) if not unicodedata.combining(x))) == 1 and d != chr(c) and d.isascii()}


def _lookup(table: dict, key: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[key]


def hs_code_6(raw: Column) -> Column:
    """Digits of a product code: the first six, or two to five padded with zeros; else null."""
    digits = F.regexp_replace(raw, r"[^0-9]", "")
    return F.when(F.length(digits) >= 2, F.rpad(F.substring(digits, 1, 6), 6, "0"))


def country(raw: Column) -> Column:
    name = F.nullif(F.upper(F.trim(raw)), F.lit(""))
    return F.coalesce(_lookup(COUNTRIES, name), name)


def any_date(raw: Column, formats: list[str] = DATE_FORMATS) -> Column:
    """A date from a spreadsheet serial number or the first format that fits; null for NULL, NA, N/A and anything else."""
    text = F.nullif(F.trim(raw), F.lit(""))
    serial = F.when(text.rlike(r"^[0-9]{4,5}(\.0+)?$"), F.date_add(F.lit("1899-12-30").cast("date"), F.regexp_replace(text, r"\..*$", "").cast("int")))
    return F.when(F.upper(text).isin("NULL", "NA", "N/A"), None).otherwise(F.coalesce(serial, *[F.try_to_timestamp(text, F.lit(f)).cast("date") for f in formats]))


def number(raw: Column) -> Column:
    """A number without separators and currency signs; null if it is none or not finite."""
    value = F.regexp_replace(raw, r"[,$€£¥\s]", "").try_cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)


def weight_kg(quantity: Column, unit: Column, config: dict[str, dict] | None = None) -> Column:
    """Kilograms; a configured unit goes first, with its multiplier or its estimate per piece. Zero and unknown units are null."""
    name = F.coalesce(F.nullif(F.upper(F.trim(unit)), F.lit("")), F.lit("KG"))
    own = {k.upper(): (v.get("to_kg_multiplier", 1.0) if v.get("is_weight") else v.get("estimate_kg_per_unit")) for k, v in (config or {}).items()}
    factor = _lookup(UNIT_KG, name)
    if own:
        factor = F.when(name.isin(list(own)), _lookup({k: float(v) if v is not None else None for k, v in own.items()} | {"": None}, name)).otherwise(factor)
    return F.when(quantity != 0, quantity * factor)


def value_usd(value: Column, currency: Column, rates: dict[str, float] | None = None) -> Column:
    """US dollars; an unknown currency has rate 1. Zero is null."""
    return F.when(value != 0, value * F.coalesce(_lookup({"USD": 1.0, **(rates or USD_RATES)}, F.upper(F.trim(currency))), F.lit(1.0)))


def teu(kg: Column) -> Column:
    return F.when(kg != 0, F.round(kg / KG_PER_TEU, 2))


def price_per_kg(value: Column, kg: Column) -> Column:
    return F.when((value != 0) & (kg > 0), F.round(F.try_divide(value, kg), 2))


def organisation(raw: Column, expand: bool = False) -> Column:
    """A company name for matching: upper case, no accents, punctuation or legal form; null if nothing is left."""
    name = F.translate(F.upper(F.trim(raw)), "".join(_ACCENTED), "".join(_ACCENTED.values()))
    name = F.regexp_replace(name, "[\\u0300-\\u036f]", "")
    name = F.regexp_replace(name, r"""[.,\-/\\()&'"#@!?:;*+=\[\]{}|<>~`$%^_]""", " ")
    name = F.trim(F.regexp_replace(F.regexp_replace(name, r"^M\s*S\s+", ""), r"\s+", " "))
    forms = sorted(dict.fromkeys(LEGAL_FORMS), key=len, reverse=True)  # of equal lengths the first of the list goes first
    name = reduce(lambda c, form: F.regexp_replace(c, rf"\s+{form}$", ""), forms, name)  # one pass, longest first
    name = F.when(name.isin(forms) | (name == ""), None).otherwise(name)
    return F.array_join(F.transform(F.split(name, " "), lambda w: F.coalesce(_lookup(ABBREVIATIONS, w), w)), " ") if expand else name


def organisation_country(role: Column, direction: Column, origin: Column, destination: Column, reporting: Column) -> Column:
    supplier = F.coalesce(origin, F.when(direction == "EXPORT", reporting))
    buyer = F.coalesce(destination, F.when(direction == "IMPORT", reporting))
    return F.nullif(F.upper(F.trim(F.when(role == "SUPPLIER", supplier).otherwise(buyer))), F.lit(""))


def trigrams(text: Column) -> Column:
    """Distinct trigrams of the words of a text, each padded with two blanks before and one after."""
    words = F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")
    padded = F.transform(words, lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    return F.array_distinct(F.flatten(F.transform(padded, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: w.substr(i, F.lit(3))))))


def similarity(a: Column, b: Column) -> Column:
    """Shared part of two texts' trigrams, from 0 to 1."""
    x, y = trigrams(a), trigrams(b)
    return F.coalesce(F.try_divide(F.size(F.array_intersect(x, y)), F.size(F.array_union(x, y))), F.lit(0.0))


def mail_domain(text: Column) -> Column:
    return F.when(text.contains("@"), F.lower(F.element_at(F.split(text, "@"), -1)))


def is_free_mail(text: Column) -> Column:
    return F.coalesce(mail_domain(text).isin(FREE_MAIL), F.lit(False))


def path_metadata(path: Column) -> dict[str, Column]:
    """Country, direction, year, month and format of a file from its path below `raw` and its name."""
    parts = F.split(F.regexp_extract(path, r"(?:^|/)raw/(.*)$", 1), "/")
    part = lambda i: F.nullif(F.coalesce(F.get(parts, F.lit(i)), F.lit("")), F.lit(""))
    direction, name = F.upper(part(1)), F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")
    listed = F.lower(name).rlike("kenya|indonesia")
    kind = (
        F.when(listed & F.lower(name).rlike(r"^(kenya|indonesia)_(import|export)_[0-9]+"), "TEST").when(listed & F.upper(name).endswith(" F"), "FULL").when(listed & F.upper(name).endswith(" S"), "SHORT").when(listed, "TEST")
        .when(F.lower(name).rlike("summary|agg|short"), "SHORT").otherwise("FULL")
    )
    return {
        "reporting_country": F.upper(part(0)), "direction": F.when(direction.contains("EXPORT"), "EXPORT").when(direction.contains("IMPORT"), "IMPORT"),
        "year": F.when(part(2).rlike("^[0-9]{4}$"), part(2)).cast("int"), "month": F.when(part(3).rlike("^(0?[1-9]|1[0-2])$"), part(3)).cast("int"), "source_format": kind,
    }


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, s = spark.read.parquet(f"{sf_dir}/customer.parquet"), spark.read.parquet(f"{sf_dir}/supplier.parquet")
    return c.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")).unionByName(s.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")))


def x10_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _names(spark, sf_dir).select("id", "name", organisation(F.concat("name", F.lit(" Co., Ltd."))).alias("normal"))


def x24_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part's name beside its brand and type."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    other = F.concat_ws(" ", "p_brand", "p_type", "p_name")
    return part.select("p_partkey", F.round(similarity(F.concat_ws(" ", "p_name", "p_type"), other), 6).alias("similarity"))


def x01_clean_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    kg = weight_kg(F.col("l_quantity"), F.when(F.col("l_linenumber") % 2 == 0, "mt").otherwise("LBS"))
    usd = value_usd(F.col("l_extendedprice"), F.lit("INR"))
    return line.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", hs_code_6(F.col("l_partkey").cast("string")).alias("hs_code_6"), F.round(kg, 4).alias("kg"), F.round(usd, 4).alias("usd"))


def _spelled(column: str, forms: list[str], by: str) -> Column:
    """One of several spellings of a value, by a number: tests of cleaning functions over whole tables."""
    return F.element_at(F.array(*[F.expr(f.replace("?", column)) for f in forms]), (F.col(by) % len(forms) + 1).cast("int"))


def x02_countries(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    raw = _spelled("n_name", ["concat('  ', lower(?))", "'U.s.a.'", "'united arab emirates '", "''"], "n_nationkey")
    return nation.select("n_nationkey", country(raw).alias("country"))


def x03_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order dates in seven spellings, a spreadsheet's serial number among them, read back."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").withColumn("d", F.to_date("o_orderdate"))
    forms = [f"date_format(?, '{f}')" for f in ("yyyy-MM-dd", "dd/MM/yyyy", "dd-MMM-yyyy", "yyyyMMdd", "MMM yyyy")] + ["cast(datediff(?, date'1899-12-30') as string)", "'n/a'"]
    return orders.select("o_orderkey", any_date(_spelled("d", forms, "o_orderkey")).alias("day"))


def x05_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = spark.read.parquet(f"{sf_dir}/orders.parquet").withColumn("n", F.floor("o_totalprice").cast("long"))
    raw = _spelled("n", ["concat('$', format_number(?, 0))", "concat(?, ' ')", "concat('-', ?)", "'NaN'", "'twelve'", "concat('€ ', ?)"], "o_orderkey")
    return line.select("o_orderkey", number(raw).alias("value"))


def x08_teu(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    kg = F.floor("l_quantity") * 1000
    return line.groupBy(teu(kg).alias("teu"), price_per_kg(F.floor("l_quantity") * 50, kg).alias("price")).agg(F.count("*").alias("n"))


def x11_org_country(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    origin = F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name"))
    role = F.explode(F.array(F.lit("BUYER"), F.lit("SUPPLIER")))
    each = nation.select("n_nationkey", "n_name", origin.alias("origin"), role.alias("role")).select("*", F.explode(F.array(F.lit("EXPORT"), F.lit("IMPORT"))).alias("direction"))
    return each.select("n_nationkey", "role", "direction", organisation_country(F.col("role"), F.col("direction"), F.col("origin"), F.lit(None).cast("string"), F.col("n_name")).alias("country"))


def x17_seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.groupBy("user_id").agg((F.unix_timestamp(F.max("ts")) - F.unix_timestamp(F.min("ts"))).alias("seconds"))


def x29_mail_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    text = _spelled("c_custkey", ["concat('a', ?, '@GMAIL.com')", "concat('b', ?, '@Firm.example')", "concat('none ', ?)", "concat('x@y@', ?, '.ru')"], "c_custkey")
    return c.select("c_custkey", mail_domain(text).alias("domain"), is_free_mail(text).alias("free"))


def x10_stacked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names with two legal forms: those of equal length go in the order of the list, each once."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    raw = _spelled("c_custkey", ["concat('Acme ', ?, ' LLC LTD')", "concat('Acme ', ?, ' INC LTD')", "concat('Acme ', ?, ' LTD LLC')", "concat('Acme ', ?, ' Pvt. Ltd.')", "'PRIVATE LIMITED'"], "c_custkey")
    return c.select("c_custkey", organisation(raw).alias("normal"))


QUERIES = {f.__name__: f for f in (x01_clean_fields, x10_names, x10_stacked, x24_similarity, x02_countries, x03_dates, x05_numbers, x08_teu, x11_org_country, x17_seconds, x29_mail_domains)}
ORACLES = {
    "x01_clean_fields": """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN length(CAST(l_partkey AS VARCHAR)) >= 2 THEN rpad(substr(CAST(l_partkey AS VARCHAR), 1, 6), 6, '0') END AS hs_code_6,
        round(CASE WHEN l_quantity <> 0 THEN l_quantity * CASE WHEN l_linenumber % 2 = 0 THEN 1000e0 ELSE 453592e-6 END END, 4) AS kg, round(CASE WHEN l_extendedprice <> 0 THEN l_extendedprice * 12e-3 END, 4) AS usd FROM lineitem""",
    "x10_names": "SELECT c_custkey AS id, c_name AS name, trim(replace(upper(c_name), '#', ' ')) AS normal FROM customer UNION ALL SELECT s_suppkey, s_name, trim(replace(upper(s_name), '#', ' ')) FROM supplier",
    "x24_similarity": r"""WITH t AS (SELECT p_partkey, p_name || ' ' || p_type AS a, p_brand || ' ' || p_type || ' ' || p_name AS b FROM part),
        w AS (SELECT p_partkey, side, unnest(list_filter(regexp_split_to_array(lower(s), '[^a-z0-9]+'), lambda x: x <> '')) AS w FROM (SELECT p_partkey, 'a' AS side, a AS s FROM t UNION ALL SELECT p_partkey, 'b', b FROM t)),
        g AS (SELECT DISTINCT p_partkey, side, substr('  ' || w || ' ', i, 3) AS t FROM (SELECT *, unnest(range(1, length(w) + 2)) AS i FROM w)),
        n AS (SELECT p_partkey, t, count(*) AS sides FROM g GROUP BY 1, 2)
        SELECT p_partkey, round(count(*) FILTER (sides = 2) / CAST(count(*) AS DOUBLE), 6) AS similarity FROM n GROUP BY 1""",
    "x02_countries": "SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN upper(n_name) WHEN 1 THEN 'USA' WHEN 2 THEN 'UAE' END AS country FROM nation",
    "x03_dates": "SELECT o_orderkey, CASE o_orderkey % 7 WHEN 4 THEN CAST(date_trunc('month', o_orderdate) AS DATE) WHEN 6 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS day FROM orders",
    "x05_numbers": "SELECT o_orderkey, CASE WHEN o_orderkey % 6 IN (0, 1, 5) THEN floor(o_totalprice) WHEN o_orderkey % 6 = 2 THEN -floor(o_totalprice) END AS value FROM orders",
    "x08_teu": "SELECT CASE WHEN q <> 0 THEN round(q / 20, 2) END AS teu, CASE WHEN q > 0 THEN 5e-2 END AS price, count(*) AS n FROM (SELECT floor(l_quantity) AS q FROM lineitem) GROUP BY 1, 2",
    "x11_org_country": "SELECT n_nationkey, role, direction, CASE WHEN role = 'BUYER' THEN CASE WHEN direction = 'IMPORT' THEN upper(n_name) END WHEN n_nationkey % 2 = 0 OR direction = 'EXPORT' THEN upper(n_name) END AS country FROM nation, (VALUES ('BUYER'), ('SUPPLIER')) r(role), (VALUES ('EXPORT'), ('IMPORT')) d(direction)",
    "x17_seconds": "SELECT user_id, epoch(date_trunc('second', max(ts)))::BIGINT - epoch(date_trunc('second', min(ts)))::BIGINT AS seconds FROM events GROUP BY 1",
    "x29_mail_domains": "SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'gmail.com' WHEN 1 THEN 'firm.example' WHEN 3 THEN c_custkey || '.ru' END AS domain, c_custkey % 4 = 0 AS free FROM customer",
    "x10_stacked": "SELECT c_custkey, CASE c_custkey % 5 WHEN 2 THEN 'ACME ' || c_custkey || ' LTD' WHEN 4 THEN NULL ELSE 'ACME ' || c_custkey END AS normal FROM customer",
}
