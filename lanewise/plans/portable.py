"""Plans written once in SQL that Spark and the oracle both read.

A plan names its tables in braces and may use the plans of `VIEWS` by name. For the oracle the views that a plan uses become
its WITH clause. For Spark the views of `STORED` are tables: each is built once for a session and a source folder, written
as Parquet to the shared folder, and read by every later plan, as the profiles and summaries of a warehouse are. The ledger is
computed from the table of its lines, a quarter of its size; it is a table only where `stored` was asked for it.
`refresh` builds them anew. Macros cover what the dialects spell differently: @days(a; b) is a - b in days, @list(x) a comma
list of sorted values, @directions a row for each direction beside the row before it, @quartiles[x] the three quartiles in one pass and @at(q; i)
one of them.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanewise.storage import written_in_slices

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]
AS_OF = "DATE '2001-07-01'"

_BASE = """
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_returnflag, l_linestatus, o_custkey, p_type, p_brand, s_name, c_name,
       sn.n_name AS origin, cn.n_name AS destination, CAST(l_shipdate AS DATE) AS ship_day, l_quantity, l_extendedprice
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {part} ON l_partkey = p_partkey JOIN {supplier} ON l_suppkey = s_suppkey
JOIN {nation} sn ON s_nationkey = sn.n_nationkey JOIN {customer} ON o_custkey = c_custkey JOIN {nation} cn ON c_nationkey = cn.n_nationkey
"""

_LEDGER = """
SELECT concat(direction, '-', CAST(l_orderkey AS STRING), '-', CAST(l_partkey AS STRING), '-', CAST(l_suppkey AS STRING), '-', CAST(l_linenumber AS STRING)) AS transaction_id,
       direction, CASE WHEN direction = 'EXPORT' THEN origin ELSE destination END AS reporting_country, origin AS origin_country, destination AS destination_country,
       p_type AS hs_code_6, l_suppkey AS supplier_id, CASE WHEN direction = 'EXPORT' AND l_returnflag = 'R' THEN NULL ELSE o_custkey END AS buyer_id, o_custkey AS true_buyer_id,
       direction = 'EXPORT' AND l_returnflag = 'R' AS hidden_buyer, shipment_date,
       CAST(EXTRACT(YEAR FROM shipment_date) AS BIGINT) AS year, CAST(EXTRACT(MONTH FROM shipment_date) AS BIGINT) AS month,
       CAST(l_quantity * (CASE WHEN direction = 'EXPORT' THEN 1e0 ELSE 1e0 + ((l_linenumber % 3) - 1) * 2e-2 END) AS DECIMAL(18,4)) AS qty_kg,
       CAST(l_extendedprice AS DECIMAL(18,2)) AS value_usd, CAST(l_extendedprice AS DOUBLE) / NULLIF(l_quantity, 0) AS price_per_kg,
       CASE WHEN l_linestatus = 'F' THEN concat(CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING)) END AS container_id, p_brand AS vessel_name
FROM (SELECT base.*, direction, CASE WHEN direction = 'EXPORT' THEN ship_day ELSE ship_day + (10 + 5 * l_linenumber) END AS shipment_date FROM base @directions) x
"""

#: name -> plan
VIEWS: dict[str, str] = {"base": _BASE, "ledger": _LEDGER}
_ORDER = ["base", "ledger"]
#: Views that are tables for Spark, and the columns that these are partitioned by.
STORED: dict[str, list[str]] = {"base": [], "ledger": ["direction", "year"]}
#: Views of STORED that plans compute themselves until someone asks for the table.
ON_DEMAND = {"ledger"}
#: Functions that yield a view of STORED in slices, so that a slice's shuffles are gone before the next: one for so many bytes of input, so many at most.
SLICED: dict[str, Callable[[SparkSession, str], Iterator[DataFrame]]] = {}
#: Columns of the ledger that no row of a view of STORED mixes values of: these views are built in slices by them.
APART: dict[str, list[str]] = {}
SLICE, SLICES = 64 << 20, 8
#: Views that a function builds for Spark, where their SQL would put all rows into one task.
BUILT: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_TABLES: dict[tuple[str, str, str], DataFrame] = {}


def view(name: str, sql: str, stored: list[str] | None = None) -> None:
    VIEWS[name] = sql
    _ORDER.append(name)
    if stored is not None:
        STORED[name] = stored


def _used(sql: str, ends: Iterable[str] = ()) -> list[str]:
    """Views that a plan uses, those behind others too, in the order of their definition; no view is looked for behind `ends`."""
    used: set[str] = set()
    todo = [sql]
    while todo:
        text = todo.pop()
        for name in VIEWS:
            if name not in used and re.search(rf"\b{name}\b", text):
                used.add(name)
                if name not in ends:
                    todo.append(VIEWS[name])
    return [n for n in _ORDER if n in used]


def _spark_text(sql: str) -> str:
    text = re.sub(r"@days\((.+?); (.+?)\)", r"datediff(\1, \2)", sql).replace("@directions", "LATERAL VIEW explode(array('EXPORT', 'IMPORT')) d AS direction")
    text = re.sub(r"@quartiles\[(.+?)\]", r"percentile(\1, array(0.25, 0.5, 0.75))", text)
    text = re.sub(r"@at\((\w+); (\d)\)", r"element_at(\1, \2)", text)
    return re.sub(r"@list\((.+?)\)", r"array_join(array_sort(collect_set(\1)), ',')", text)


def oracle_sql(sql: str) -> str:
    parts = ", ".join(f"{n} AS NOT MATERIALIZED ({VIEWS[n]})" for n in _used(sql))
    text = re.sub(r"@days\((.+?); (.+?)\)", r"date_diff('day', \2, \1)", (f"WITH {parts} " if parts else "") + sql)
    text = text.replace("@directions", ", (SELECT 'EXPORT' AS direction UNION ALL SELECT 'IMPORT' AS direction) d")
    text = re.sub(r"@quartiles\[(.+?)\]", r"quantile_cont(\1, [0.25, 0.5, 0.75])", text)
    text = re.sub(r"@at\((\w+); (\d)\)", r"list_extract(\1, \2)", text)
    text = re.sub(r"@list\((.+?)\)", r"coalesce(string_agg(DISTINCT \1, ',' ORDER BY \1), '')", text)
    return re.sub(r"\{(\w+)\}", r"\1", text)


def run(spark: SparkSession, sf_dir: str, sql: str, anew: Iterable[str] = ()) -> DataFrame:
    """The plan over the tables of sf_dir; views named by `anew` are computed in the plan itself, not read as tables."""
    return _wide(_planned(spark, sf_dir, sql, anew))


def _wide(out: DataFrame) -> DataFrame:
    return out.select(*[F.col(f"`{c}`").cast("long").alias(c) if kind == "int" else F.col(f"`{c}`") for c, kind in out.dtypes])


def _planned(spark: SparkSession, sf_dir: str, sql: str, anew: Iterable[str] = (), given: dict[str, DataFrame] | None = None) -> DataFrame:
    given = given or {}
    tables = {n for n in [*STORED, *BUILT] if (n not in anew or n in BUILT) and not (n in ON_DEMAND and _key(spark, sf_dir, n) not in _TABLES)} | (given.keys() & VIEWS.keys())
    used = _used(sql, tables)
    inputs = {f"{n}__": given[n] if n in given else stored(spark, sf_dir, n) if n in STORED and n not in anew else BUILT[n](spark, sf_dir) for n in used if n in tables}
    parts = ", ".join(f"{n} AS (SELECT * FROM {{{n}__}})" if n in tables else f"{n} AS ({VIEWS[n]})" for n in used)
    text = _spark_text((f"WITH {parts} " if parts else "") + sql)
    sources = set(re.findall(r"\{(\w+)\}", text)) - set(inputs)
    return spark.sql(text, **inputs, **{t: given[t] if t in given else _source(spark, sf_dir, t) for t in sources})


def _source(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def slices_for(df: DataFrame) -> int:
    """How many slices the tables that df reads ask for."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return min(SLICES, 1 + sum(int(str(leaves.apply(k).stats().sizeInBytes())) for k in range(leaves.size())) // SLICE)


def _lines(spark: SparkSession, sf_dir: str) -> Iterator[DataFrame]:
    """The lines that the ledger is made of, without the names it has no use for, in slices that share no order."""
    both = {"lineitem": "l_orderkey", "orders": "o_orderkey"}
    slices = slices_for(_source(spark, sf_dir, "lineitem"))
    for k in range(slices):
        of = lambda key: F.pmod(F.xxhash64(key), F.lit(slices)) == k  # noqa: B023, E731
        given = {t: _source(spark, sf_dir, t).filter(of(key)) for t, key in both.items()} if slices > 1 else {}
        yield _planned(spark, sf_dir, "SELECT * FROM base", ["base"], given).drop("s_name", "c_name")


SLICED["base"] = _lines


def _key(spark: SparkSession, sf_dir: str, name: str) -> tuple[str, str, str]:
    return spark.sparkContext.applicationId, sf_dir.rstrip("/"), name


def stored(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view as a table, built where this session has not done so."""
    key = _key(spark, sf_dir, name)
    if key not in _TABLES:
        slices = SLICED[name](spark, sf_dir) if name in SLICED else _apart(spark, sf_dir, name)
        _TABLES[key] = written_in_slices(spark, slices, name, "warehouse", STORED[name])
    return _TABLES[key]


def _apart(spark: SparkSession, sf_dir: str, name: str) -> Iterator[DataFrame]:
    every = ledger(spark, sf_dir) if name in APART else None
    slices = slices_for(every) if name in APART else 1
    for k in range(slices):
        if slices > 1:
            own = every.filter(F.pmod(F.xxhash64(*APART[name]), F.lit(slices)) == k)
            df = _wide(_planned(spark, sf_dir, f"SELECT * FROM {name}", [name], {"ledger": own}))
        else:
            df = BUILT[name](spark, sf_dir) if name in BUILT else run(spark, sf_dir, f"SELECT * FROM {name}", [name])
        by = [c for c in STORED[name] if c in df.columns]
        yield df.hint("rebalance", *by) if by else df  # a partition of the table is written by as many tasks as its size asks for, however skewed


def refresh(spark: SparkSession, sf_dir: str, names: Iterable[str] | None = None) -> list[str]:
    """Forget tables, and those that are built from them, so that the next plan builds them anew beside the old ones: who reads an old one meanwhile isn't disturbed. Returns the names."""
    gone = list(STORED) if names is None else list(names)
    gone = [n for n in STORED if n in gone or any(g in _used(VIEWS[n]) for g in gone)]
    return [n for n in gone if _TABLES.pop(_key(spark, sf_dir, n), None) is not None]


def planned(spark: SparkSession, sf_dir: str, sql: str, given: dict[str, DataFrame]) -> DataFrame:
    """The plan with some of its views given."""
    return _planned(spark, sf_dir, sql, (), given)


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shipments of both directions: the driver's tables seen as a trade ledger."""
    return run(spark, sf_dir, "SELECT * FROM ledger")


def queries(plans: dict[str, str], anew: dict[str, list[str]] | None = None) -> dict:
    return {name: (lambda spark, sf_dir, sql=sql, own=tuple((anew or {}).get(name, ())): run(spark, sf_dir, sql, own)) for name, sql in plans.items()}
