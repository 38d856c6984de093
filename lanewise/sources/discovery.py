"""Layouts of unknown files: where the header is, what each column holds, and a draft of a mapping for review.

Only the first rows and the names of columns come to the driver.
"""

from __future__ import annotations

import json
import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lanewise.sources.excel import xlsx_rows

HEADER_ROWS = 10

# The words of headers, the patterns of column names by role, spellings of countries.
HEADER_WORDS = ["date", "code", "value", "name", "country", "quantity", "unit", "port", "hs", "description"]
ROLES = {
    "date": [r".*DATE.*", r".*_DT$", r".*_DATE$", r"EXPORT.*", r"IMPORT.*", r"SHIP.*", r"INVOICE.*", r"IMP_DATE", r"EXP_DATE", r"BILL.*DATE", r"DECL.*DATE"],
    "hs_code": [r"HS.*CODE.*", r"HS_CODE.*", r"HSCODE.*", r"TARIFF.*", r".*HARMONIZED.*", r"PRODUCT.*CODE", r"COMMODITY.*CODE"],
    "value": [r".*VALUE.*", r".*USD.*", r"FOB.*", r"CIF.*", r".*AMOUNT.*", r"TOTAL.*", r"CUSTOMS.*VALUE", r".*PRICE.*"],
    "quantity": [r".*QTY.*", r".*QUANTITY.*", r".*WEIGHT.*", r".*KG.*", r".*VOLUME.*", r"NET.*", r"GROSS.*"],
    "unit": [r".*UNIT.*", r"UOM", r".*MEASURE.*"],
    "buyer": [r".*IMPORTER.*", r".*BUYER.*", r".*CONSIGNEE.*", r".*RECEIVER.*", r"NOTIFY.*PARTY"],
    "supplier": [r".*EXPORTER.*", r".*SUPPLIER.*", r".*SHIPPER.*", r".*SELLER.*", r".*SENDER.*"],
    "origin": [r".*ORIGIN.*", r".*SOURCE.*COUNTRY", r"COUNTRY.*ORIGIN", r"FROM.*COUNTRY", r"EXPORT.*COUNTRY"],
    "destination": [r".*DESTINATION.*", r".*DEST.*COUNTRY", r"TO.*COUNTRY", r"IMPORT.*COUNTRY", r".*PORT.*DISCHARGE"],
}
SPELLINGS = {"SRI_LANKA": "SRILANKA", "COSTARICA": "COSTA_RICA", "EQUADOR": "ECUADOR"}
DATE_FORMATS = ["%Y-%m-%d", "%d/%m/%Y", "%Y/%m/%d", "%d-%m-%Y"]
REQUIRED = {"require_hs_code": True, "require_importer": True, "require_value_usd": False, "require_origin_country": False, "require_quantity": False}

_NAME = r"(?iU)^([\w\s]+?)\s+(import|export)\s+(f|s|full|short)(?:\s+\(\d+\))?\.xlsx$"


def file_name(name: Column) -> dict[str, Column]:
    """country, direction and source_format of names such as "Sri Lanka Import F (2).xlsx"; null for others."""
    part = lambda k: F.when(name.rlike(_NAME), F.upper(F.trim(F.regexp_extract(name, _NAME, k))))
    country, spelled = F.replace(part(1), F.lit(" "), F.lit("_")), F.create_map(*[F.lit(x) for kv in SPELLINGS.items() for x in kv])
    return {"country": F.coalesce(spelled[country], country), "direction": part(2), "source_format": F.when(F.left(part(3), F.lit(1)) == "F", "FULL").when(part(3).isNotNull(), "SHORT")}


def header_row(rows: list[list[str | None]]) -> int:
    """Which of the first rows, from 1, is most like a header: 2 for each header word in a cell, 1 for capitals; the first if none."""
    scores = [sum(2 * sum(w in c.lower() for w in HEADER_WORDS) + (c.isupper() or c.istitle()) for c in row if c) for row in rows[:HEADER_ROWS]]
    return scores.index(max(scores)) + 1 if scores else 1


def first_rows(spark: SparkSession, path: str, limit: int = HEADER_ROWS) -> list[list[str | None]]:
    """The first rows of one workbook or comma-separated file; rows that a workbook leaves out are empty."""
    if path.lower().endswith(".xlsx"):
        found = {r["row"]: r["cells"] for r in xlsx_rows(spark, path).filter(F.col("row") <= limit).collect()}
        return [found.get(i, []) for i in range(1, max(found, default=0) + 1)]
    return [list(r) for r in spark.read.csv(path).limit(limit).collect()]


def column_roles(columns: list[str]) -> dict[str, list[str]]:
    """The columns of each role, in order, and those of none as "other"; a column may have several roles."""
    out = {role: [c for c in columns if any(re.match(p, c.upper()) for p in patterns)] for role, patterns in ROLES.items()}
    known = {c for own in out.values() for c in own}
    return out | {"other": [c for c in columns if c not in known]}


def draft_mapping(country: str, direction: str, source_format: str, columns: list[str], header: int = 1) -> dict:
    """A mapping as files.standardize reads it: the first column of each role, TODO_ names where there is none."""
    roles, place = column_roles(columns), country.replace("_", " ").upper()
    first = lambda role, todo: next(iter(roles[role]), f"TODO_{todo}")
    mine = "import_date_raw" if direction == "IMPORT" else "export_date_raw"
    other_side = "destination_country_raw" if direction == "IMPORT" else "origin_country_raw"
    return {
        "reporting_country": place, "direction": direction, "source_format": source_format, "record_grain": "LINE_ITEM", "header_row": header, "data_start_row": header + 1,
        "column_mapping": {
            "buyer_name_raw": first("buyer", "BUYER"), "supplier_name_raw": first("supplier", "SUPPLIER"), "hs_code_raw": first("hs_code", "HS_CODE"), mine: first("date", "DATE_COLUMN"),
            "qty_raw": first("quantity", "QUANTITY"), "qty_unit_raw": first("unit", "UNIT"), "value_raw": first("value", "VALUE"), "origin_country_raw": first("origin", "ORIGIN"), "destination_country_raw": first("destination", "DESTINATION"),
        },
        "defaults": {"reporting_country": place, "direction": direction, other_side: place},
        "date_formats": DATE_FORMATS, "quality_rules": REQUIRED, "_metadata": {"auto_generated": True, "detected_columns": columns, "needs_review": True},
    }


def draft_text(mapping: dict) -> str:
    """The mapping as JSON, which YAML readers accept."""
    return json.dumps(mapping, indent=2, ensure_ascii=False)


def load_mapping(folder: str, country: str, direction: str, source_format: str = "FULL") -> dict:
    """The mapping of a layout: the file of its format, else that of its direction; .yml files, or .json without a YAML reader."""
    stem = f"{country}_{direction}".lower()
    for name in (f"{stem}_{source_format.lower()}", stem):
        for path in (Path(folder) / f"{name}.yml", Path(folder) / f"{name}.json"):
            if path.exists():
                return _parsed(path.read_text(encoding="utf-8"))
    raise FileNotFoundError(f"no mapping of {country} {direction} {source_format} in {folder}")


def _parsed(text: str) -> dict:
    try:
        import yaml
    except ImportError:
        return json.loads(text)
    return yaml.safe_load(text)


def _role_flags(df: DataFrame, name: str) -> DataFrame:
    return df.select(name, *[F.exists(F.array(*map(F.lit, patterns)), lambda p: F.rlike(F.upper(name), F.concat(F.lit("^"), p))).alias(role) for role, patterns in ROLES.items()])


def s21_column_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One flag per role for the column names of the sources, taken from a table of names."""
    names = [n for t in ("lineitem", "orders", "part", "supplier", "events") for n in spark.read.parquet(f"{sf_dir}/{t}.parquet").columns]
    return _role_flags(spark.createDataFrame([(n,) for n in names], "name string"), "name")


QUERIES = {"s21_column_roles": s21_column_roles}
