"""Parameterised serving: optional filters, thresholds on ordered levels, scores before pages, and JSON views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lanewise.functions import scalars as X
from lanewise.plans import portable
from lanewise.plans.portable import AS_OF

# What each highest accepted level lets through; buyers without a score stand between MEDIUM and HIGH.
ALLOWED = {
    "LOW": ["LOW"], "MEDIUM": ["LOW", "MEDIUM", "UNKNOWN", "UNSCORED"], "HIGH": ["LOW", "MEDIUM", "UNKNOWN", "UNSCORED", "HIGH"],
    "CRITICAL": ["LOW", "MEDIUM", "UNKNOWN", "UNSCORED", "HIGH", "CRITICAL"], "ALL": ["LOW", "MEDIUM", "UNKNOWN", "UNSCORED", "HIGH", "CRITICAL"],
}
FREE_MAIL_VALUE = 500_000


def filtered(df: DataFrame, **conditions) -> DataFrame:
    """df under the conditions that aren't None: name=value, name=[values], name__from=least, name__like=part of a text."""
    for name, value in conditions.items():
        if value is None:
            continue
        column, _, kind = name.partition("__")
        c = F.col(column)
        df = df.filter(c >= F.lit(value) if kind == "from" else c.ilike(f"%{value}%") if kind == "like" else c.isin(value) if isinstance(value, list) else c == F.lit(value))
    return df


def up_to(level: Column, most: str) -> Column:
    """Whether a risk level is let through; an unknown threshold counts as MEDIUM."""
    return level.isin(ALLOWED.get(most.upper(), ALLOWED["MEDIUM"]))


def page(df: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)


def buyers(spark: SparkSession, sf_dir: str, risk_level: str | None = None, min_value: float | None = None, hs_code: str | None = None, name: str | None = None) -> DataFrame:
    """Buyers that fulfil every given condition, from the buyer view; a product is looked up in the ledger by a semi join."""
    own = filtered(portable.run(spark, sf_dir, "SELECT * FROM buyer_360"), risk_level=risk_level and risk_level.upper(), value_usd__from=min_value, buyer_name__like=name)
    if hs_code is not None:
        own = own.join(portable.ledger(spark, sf_dir).filter(F.col("hs_code_6") == hs_code).select("buyer_id"), "buyer_id", "left_semi")
    return own


def targets(spark: SparkSession, sf_dir: str, max_risk: str = "MEDIUM", countries: list[str] | None = None) -> DataFrame:
    """Scored target buyers up to a risk level, best first by the rounded score, then by value."""
    own = filtered(portable.run(spark, sf_dir, "SELECT * FROM hunt_score"), destination_country=countries)
    return own.filter(up_to(F.col("risk_level"), max_risk))


def _best_first() -> list[Column]:
    return [F.desc("score"), F.desc("value_usd"), F.asc("buyer_id")]


def f07_dynamic_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return buyers(spark, sf_dir, min_value=200_000, hs_code="PROMO", name="customer").select("buyer_id", "buyer_name", "value_usd", "risk_level")


def f08_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = portable.run(spark, sf_dir, "SELECT risk_level FROM hunted")
    return own.agg(*[F.count_if(up_to(F.col("risk_level"), most)).alias(f"up_to_{most.lower()}") for most in ("low", "medium", "high", "all")])


def o05_page_after_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page(targets(spark, sf_dir, "HIGH"), _best_first(), 10, 5).select("buyer_id", "value_usd", "score")


def o06_rounded_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = targets(spark, sf_dir, "ALL").select("buyer_id", F.round("score").alias("score"), "value_usd")
    return page(own, _best_first(), 25).select("buyer_id", "score", "value_usd")


def o09_sample(spark: SparkSession, sf_dir: str, rows: int = 20, seed: int = 42) -> DataFrame:
    """A seeded random sample: the rows with the least hashes of seed and id."""
    hidden = portable.ledger(spark, sf_dir).filter("hidden_buyer").select("transaction_id", "hs_code_6")
    return hidden.withColumn("place", F.md5(F.concat(F.lit(f"{seed}|"), F.col("transaction_id")).cast("binary"))).orderBy("place").limit(rows)


def c12_free_email(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Buyers of the ghost rule whose names hold an address of a free mail service; every third buyer here has one of them."""
    ghosts = portable.run(spark, sf_dir, "SELECT g.buyer_id, g.value_usd, c.c_name FROM ghost_risk g JOIN {customer} c ON c.c_custkey = g.buyer_id")
    mail = F.when(F.col("buyer_id") % 3 == 0, F.concat(F.lit("b"), F.col("buyer_id"), F.lit("@GMail.com"))).when(F.col("buyer_id") % 3 == 1, F.concat(F.lit("b"), F.col("buyer_id"), F.lit("@firm.example")))
    return free_email(ghosts.withColumn("variants", F.array("c_name", mail))).select("buyer_id", "email_domain", "score", "risk_level", "confidence", "scope")


def free_email(df: DataFrame) -> DataFrame:
    """Rows of df(variants array<string>, value_usd) whose first variant with an @ is of a free mail service, with the score of the rule."""
    first = F.get(F.filter("variants", lambda v: v.contains("@")), F.lit(0))
    found = df.withColumn("email_domain", X.mail_domain(first)).filter(F.col("email_domain").isin(X.FREE_MAIL))
    score = F.when(F.col("value_usd") >= FREE_MAIL_VALUE, 40).otherwise(30).cast("long")
    return found.withColumns({"score": score, "risk_level": F.when(score >= 40, "MEDIUM").otherwise("LOW"), "confidence": F.lit(0.9), "scope": F.lit("EMAIL_DOMAIN")})


def x20_json_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


def x21_json_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("user_id").agg(F.to_json(F.array_sort(F.collect_set("event_type"))).alias("types"))
    return lists.select("user_id", F.json_array_length("types").cast("long").alias("n"), F.when(F.json_array_length("types").isNotNull(), "array").otherwise("other").alias("kind"))


def x22_json_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(F.explode(F.json_object_keys("props")).alias("key")).groupBy("key").agg(F.count("*").alias("n"))


def x23_json_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.to_json(F.struct(F.col("event_type").alias("type"), F.col("user_id").alias("user"))).alias("doc"))


def f11_json_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = F.json_object_keys("props")
    return spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("event_type").agg(F.count_if(F.array_contains(keys, "k")).alias("with_k"), F.count_if(F.array_contains(keys, "zz")).alias("with_zz"))


def reasons(rows: DataFrame) -> DataFrame:
    """The reasons of invoice risks as JSON objects: code, severity and context."""
    context = F.struct(F.col("hs_code_6"), F.col("n").alias("sample_size"))
    return rows.withColumn("reasons", F.to_json(F.struct(F.col("reason_code").alias("code"), F.col("risk_level").alias("severity"), context.alias("context"))))


def v10_json_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = reasons(portable.run(spark, sf_dir, "SELECT * FROM invoice_risk")).withColumn("keys", F.json_object_keys("reasons"))
    code = F.get_json_object("reasons", "$.code")
    return own.groupBy(code.alias("code")).agg(F.count("*").alias("n"), F.count_if(F.array_contains("keys", "severity") & F.array_contains("keys", "context")).alias("whole"), F.sum(F.get_json_object("reasons", "$.context.sample_size").cast("long")).alias("samples"))


def a15_top_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each buyer's five largest products, largest first, as a JSON array of objects with their value in cents and share in basis points."""
    per = portable.ledger(spark, sf_dir).filter("buyer_id IS NOT NULL").groupBy("buyer_id", "hs_code_6").agg((F.sum("value_usd") * 100).cast("long").alias("cents"))
    # One product is one struct, and a buyer has few; largest first, of equal values the smaller code, nulls last.
    ordered = F.struct(F.col("cents").isNull().alias("no_value"), (-F.col("cents")).alias("o"), F.col("hs_code_6").isNull().alias("no_code"), "hs_code_6", "cents")
    each = per.groupBy("buyer_id").agg(F.sum(F.col("cents").cast("decimal(28,0)")).alias("total"), F.array_sort(F.collect_list(ordered)).alias("all"))
    # Whole division: a quotient of decimals is rounded to six places first, which lifts shares just under a whole basis point.
    share = lambda s: F.call_function("div", s["cents"].cast("decimal(38,0)") * 10000, F.col("total"))
    shares = F.transform(F.slice("all", 1, 5), lambda s: F.struct(s["hs_code_6"].alias("hs_code_6"), s["cents"].alias("cents"), share(s).alias("share_bp")))
    return each.select("buyer_id", F.to_json(shares, {"ignoreNullFields": "false"}).alias("top_codes"))


def x30_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = portable.run(spark, sf_dir, "SELECT transaction_id, hs_code_6, value_usd FROM ledger ORDER BY shipment_date DESC, transaction_id LIMIT 50")
    return own.select("transaction_id", F.concat(F.col("hs_code_6"), F.lit(": $"), F.format_number(F.floor("value_usd"), 0)).alias("activity"))


def x31_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of organisations as hashes of their natural keys, so that a run can be repeated."""
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", F.md5(F.concat_ws("|", "c_name", F.col("c_nationkey").cast("string")).cast("binary")).alias("org_id"))


QUERIES = {f.__name__: f for f in (f07_dynamic_filters, f08_levels, o05_page_after_score, o06_rounded_sort, o09_sample, c12_free_email, x20_json_get, x21_json_shape, x22_json_keys, x23_json_build, f11_json_key, v10_json_shape, a15_top_arrays, x30_formats, x31_ids)}

#: Plans in the shared form, each its own oracle.
PLANS = {
    "j03_star": "SELECT c.c_custkey, c.c_name, b.shipments, p.persona, r.risk_level, g.score IS NOT NULL AS ghost, h.score AS opportunity, m.inferred FROM {customer} c LEFT JOIN buyer_360 b ON b.buyer_id = c.c_custkey LEFT JOIN (SELECT buyer_id, max(persona) AS persona FROM buyer_profile GROUP BY buyer_id) p ON p.buyer_id = c.c_custkey LEFT JOIN buyer_risk r ON r.buyer_id = c.c_custkey LEFT JOIN ghost_risk g ON g.buyer_id = c.c_custkey LEFT JOIN hunt_score h ON h.buyer_id = c.c_custkey LEFT JOIN (SELECT imported_buyer, count(*) AS inferred FROM mirror_match GROUP BY imported_buyer) m ON m.imported_buyer = c.c_custkey",
    "j05_aggregate_join": "SELECT b.reporting_country, b.direction, b.hs_code_6, b.year, b.month, b.n, coalesce(r.n, 0) AS without_buyer FROM (SELECT reporting_country, direction, hs_code_6, year, month, count(*) AS n FROM ledger GROUP BY 1, 2, 3, 4, 5) b LEFT JOIN (SELECT reporting_country, direction, hs_code_6, year, month, count(*) AS n FROM ledger WHERE buyer_id IS NULL GROUP BY 1, 2, 3, 4, 5) r ON r.reporting_country = b.reporting_country AND r.direction = b.direction AND r.hs_code_6 = b.hs_code_6 AND r.year = b.year AND r.month = b.month",
    "j21_lookup": "SELECT l.buyer_id, c.c_name, l.destination_country, count(*) AS n FROM ledger l JOIN (SELECT c_custkey, c_name, n_name FROM {customer} JOIN {nation} ON n_nationkey = c_nationkey) c ON c.c_custkey = l.buyer_id AND c.n_name = l.destination_country GROUP BY 1, 2, 3",
    "a22_sets": "SELECT buyer_id, @list(hs_code_6) AS codes, @list(origin_country) AS origins, CAST(sum(value_usd) AS DOUBLE) AS value_usd FROM ledger WHERE buyer_id IS NOT NULL GROUP BY buyer_id",
    "o11_every_hidden": "SELECT count(*) AS n, count(DISTINCT export_id) AS exports FROM mirror_match",
    "o12_chronological": "SELECT year, month, n FROM (SELECT year, month, count(*) AS n FROM ledger WHERE hs_code_6 = 'PROMO' GROUP BY 1, 2 ORDER BY 1 DESC, 2 DESC LIMIT 24) x ORDER BY 1, 2",
    "x19_lookback": f"SELECT direction, count(*) AS n FROM ledger WHERE shipment_date >= {AS_OF} - INTERVAL '360' DAY AND shipment_date < {AS_OF} GROUP BY 1",
    "v09_idempotent": "SELECT a.direction, a.n AS before, b.n AS after FROM (SELECT direction, count(*) AS n FROM ledger GROUP BY 1) a JOIN (SELECT direction, count(*) AS n FROM (SELECT DISTINCT * FROM (SELECT transaction_id, direction, shipment_date, qty_kg, value_usd FROM ledger UNION ALL SELECT transaction_id, direction, shipment_date, qty_kg, value_usd FROM ledger) u) d GROUP BY 1) b ON b.direction = a.direction",
    "q19_alerts": "SELECT CAST(NULL AS STRING) AS alert, CAST(NULL AS BIGINT) AS buyer_id FROM {region} WHERE 1 = 0",
    "q20_favorites": "SELECT CAST(NULL AS BIGINT) AS buyer_id FROM {region} WHERE 1 = 0",
}

_LEVELS = portable.oracle_sql("SELECT count(*) FILTER (WHERE risk_level = 'LOW') AS up_to_low, count(*) FILTER (WHERE risk_level IN ('LOW', 'MEDIUM', 'UNKNOWN', 'UNSCORED')) AS up_to_medium, count(*) FILTER (WHERE risk_level IN ('LOW', 'MEDIUM', 'UNKNOWN', 'UNSCORED', 'HIGH')) AS up_to_high, count(*) AS up_to_all FROM hunted")


def oracles() -> dict[str, str]:
    sql = portable.oracle_sql
    return {
        "f07_dynamic_filters": sql("SELECT buyer_id, buyer_name, value_usd, risk_level FROM buyer_360 WHERE value_usd >= 200000 AND lower(buyer_name) LIKE '%customer%' AND EXISTS (SELECT 1 FROM ledger l WHERE l.buyer_id = buyer_360.buyer_id AND l.hs_code_6 = 'PROMO')"),
        "f08_levels": _LEVELS,
        "o05_page_after_score": sql("SELECT buyer_id, value_usd, score FROM hunt_score WHERE risk_level <> 'CRITICAL' ORDER BY score DESC, value_usd DESC, buyer_id LIMIT 10 OFFSET 5"),
        "o06_rounded_sort": sql("SELECT buyer_id, round(score) AS score, value_usd FROM hunt_score ORDER BY round(score) DESC, value_usd DESC, buyer_id LIMIT 25"),
        "o09_sample": sql("SELECT transaction_id, hs_code_6, md5('42|' || transaction_id) AS place FROM ledger WHERE hidden_buyer ORDER BY place LIMIT 20"),
        "c12_free_email": sql("SELECT buyer_id, 'gmail.com' AS email_domain, CASE WHEN value_usd >= 500000 THEN 40 ELSE 30 END AS score, CASE WHEN value_usd >= 500000 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level, 9e-1 AS confidence, 'EMAIL_DOMAIN' AS scope FROM ghost_risk WHERE buyer_id % 3 = 0"),
        "x20_json_get": "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events",
        "x21_json_shape": "SELECT user_id, count(DISTINCT event_type) AS n, 'array' AS kind FROM events GROUP BY 1",
        "x22_json_keys": "SELECT key, count(*) AS n FROM (SELECT unnest(json_keys(props)) AS key FROM events) GROUP BY 1",
        "x23_json_build": "SELECT event_id, CAST(json_object('type', event_type, 'user', user_id) AS VARCHAR) AS doc FROM events",
        "f11_json_key": "SELECT event_type, count(*) FILTER (json_exists(props, '$.k')) AS with_k, count(*) FILTER (json_exists(props, '$.zz')) AS with_zz FROM events GROUP BY 1",
        "v10_json_shape": sql("SELECT CASE WHEN z < 0 THEN 'UNDER_INVOICE' ELSE 'OVER_INVOICE' END AS code, count(*) AS n, count(*) AS whole, CAST(sum(n) AS BIGINT) AS samples FROM priced WHERE abs(z) > 2 GROUP BY 1"),
        "a15_top_arrays": sql("SELECT buyer_id, CAST(to_json(list({'hs_code_6': hs_code_6, 'cents': cents, 'share_bp': CAST(cents::HUGEINT * 10000 // total AS BIGINT)} ORDER BY rk)) AS VARCHAR) AS top_codes FROM (SELECT *, sum(cents) OVER (PARTITION BY buyer_id) AS total, row_number() OVER (PARTITION BY buyer_id ORDER BY cents DESC, hs_code_6) AS rk FROM (SELECT buyer_id, hs_code_6, CAST(sum(value_usd) * 100 AS BIGINT) AS cents FROM ledger WHERE buyer_id IS NOT NULL GROUP BY 1, 2) a) b WHERE rk <= 5 GROUP BY 1"),
        "x30_formats": sql("SELECT transaction_id, hs_code_6 || ': $' || format('{:,}', CAST(floor(value_usd) AS BIGINT)) AS activity FROM (SELECT * FROM ledger ORDER BY shipment_date DESC, transaction_id LIMIT 50) x"),
        "x31_ids": "SELECT c_custkey, md5(c_name || '|' || c_nationkey) AS org_id FROM customer",
    }
