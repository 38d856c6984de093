"""Queries of this subpackage by name, and their SQL where SQL expresses them."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

MODULES = ["topk", "quality", "html", "simhash", "suffix", "packing", "pieces", "toxicity", "secrets", "urls"]


def _modules() -> list:
    return [importlib.import_module(f"lanewise.llm.{name}") for name in MODULES]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for m in _modules() for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _modules() for name, sql in m.ORACLES.items()}
