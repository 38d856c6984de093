"""Every query of the library by name, with its SQL for the oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lanewise.functions import scalars
from lanewise.operators import analytics, identity, oracles, ranking, relational, serving
from lanewise.plans import portable
from lanewise.sources import discovery, files, ingest, registry
from lanewise.streaming import state

FLAGSHIP = "c09_invoice_outliers"

PLANS = relational.PLANS | analytics.PLANS | serving.PLANS


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    name, spark_text, _ = relational.TUPLE_COUNT
    return portable.queries(PLANS, analytics.ANEW) | portable.queries({name: spark_text}) | ranking.QUERIES | serving.QUERIES | ingest.QUERIES | registry.QUERIES | scalars.QUERIES | identity.QUERIES | state.QUERIES | files.QUERIES | discovery.QUERIES


def oracle_sql() -> dict[str, str]:
    name, _, oracle_text = relational.TUPLE_COUNT
    return {k: portable.oracle_sql(v) for k, v in PLANS.items()} | {name: portable.oracle_sql(oracle_text)} | ranking.ORACLES | serving.oracles() | ingest.ORACLES | registry.ORACLES | scalars.ORACLES | state.ORACLES | files.ORACLES | oracles.ORACLES | identity.ORACLES
