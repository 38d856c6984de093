"""Profiles, corridors, lanes, risk, mirror matching, target buyers and serving views: the composite operators.

Each is one lazy plan over the ledger, without a query per entity. Decisions where the intended meaning and an obvious
reading differ: buyer risk is taken per buyer (its largest profile); a mirror match needs a lead of over 5 points; one
import may satisfy several exports; thresholds come from RISK; dates are relative to AS_OF, never to the clock.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanewise.operators.ranking import ranked
from lanewise.plans import portable
from lanewise.plans.portable import APART, AS_OF, BUILT, SLICED, run, view

RISK = {"min_sample": 5, "z_medium": 2, "z_high": 3, "z_critical": 5, "ghost_value": 500_000, "spike_months": 3, "spike_z": 2, "spike_pct": 200, "lane_rare": 3, "lane_common": 50}
_V = "CAST(sum(value_usd) AS DOUBLE)"
_Q = "CAST(sum(qty_kg) AS DOUBLE)"
_LEVEL = "CASE WHEN score >= 80 THEN 'CRITICAL' WHEN score >= 60 THEN 'HIGH' WHEN score >= 40 THEN 'MEDIUM' ELSE 'LOW' END"
_CONFIDENCE = "CASE WHEN n < 10 THEN 2e-1 WHEN n < 50 THEN 5e-1 WHEN n < 200 THEN 8e-1 ELSE 95e-2 END"

# Percentiles of whole ten-thousandths: interpolation between whole numbers is exact, so every engine gives the same, and a hot
# corridor holds one count per distinct price, added up before the shuffle, instead of its rows.
view("corridor", """
SELECT hs_code_6, destination_country, year, month, direction, reporting_country, n, least, @at(q; 1) / 10000 AS p25, @at(q; 2) / 10000 AS p50, @at(q; 3) / 10000 AS p75, most, last_day
FROM (SELECT hs_code_6, destination_country, year, month, direction, reporting_country, count(*) AS n, min(round(price_per_kg * 10000)) / 10000 AS least,
             @quartiles[round(price_per_kg * 10000)] AS q, max(round(price_per_kg * 10000)) / 10000 AS most, max(shipment_date) AS last_day
      FROM ledger WHERE price_per_kg > 0 AND qty_kg > 0 GROUP BY hs_code_6, destination_country, year, month, direction, reporting_country) x""", ["direction", "year"])

view("priced", """
SELECT l.transaction_id, l.buyer_id, l.supplier_id, l.hs_code_6, l.direction, l.value_usd, c.n, l.price_per_kg, c.p50,
       CASE WHEN c.p75 - c.p25 <= 0 THEN 0e0 ELSE round((l.price_per_kg - c.p50) / ((c.p75 - c.p25) * 7413e-4), 4) END AS z
FROM ledger l JOIN corridor c ON l.hs_code_6 = c.hs_code_6 AND l.destination_country = c.destination_country AND l.year = c.year AND l.month = c.month
     AND l.direction = c.direction AND l.reporting_country = c.reporting_country
WHERE l.price_per_kg > 0 AND l.qty_kg > 0 AND c.n >= %(min_sample)d""" % RISK)

view("invoice_risk", f"""
SELECT transaction_id, buyer_id, hs_code_6, direction, value_usd, n, z, reason_code, score, {_LEVEL} AS risk_level, {_CONFIDENCE} AS confidence
FROM (SELECT transaction_id, buyer_id, hs_code_6, direction, value_usd, n, z, CASE WHEN z < 0 THEN 'UNDER_INVOICE' ELSE 'OVER_INVOICE' END AS reason_code,
             CASE WHEN abs(z) > {RISK["z_critical"]} THEN 90 WHEN abs(z) > {RISK["z_high"]} THEN 70 ELSE 50 END AS score
      FROM priced WHERE abs(z) > {RISK["z_medium"]}) x""", [])

view("lane", f"""
SELECT origin_country, destination_country, hs_code_6, count(*) AS n, {_V} AS value_usd, {_Q} AS qty_kg, round({_Q} / 20000, 2) AS teu,
       CASE WHEN sum(qty_kg) > 0 THEN round({_V} / NULLIF({_Q}, 0), 6) END AS mean_price, min(shipment_date) AS first_day, max(shipment_date) AS last_day,
       @list(reporting_country) AS reporting_countries
FROM ledger GROUP BY origin_country, destination_country, hs_code_6""", [])

view("buyer_total", f"""
SELECT buyer_id, destination_country, min(shipment_date) AS first_day, max(shipment_date) AS last_day, count(*) AS n, {_V} AS value_usd, {_Q} AS qty_kg,
       CASE WHEN sum(qty_kg) > 0 THEN round({_V} / NULLIF({_Q}, 0), 6) END AS mean_price, count(DISTINCT hs_code_6) AS codes, count(DISTINCT supplier_id) AS suppliers,
       CAST(sum(CASE WHEN shipment_date >= {AS_OF} - INTERVAL '12' MONTH AND shipment_date < {AS_OF} THEN value_usd END) AS DOUBLE) AS current_usd,
       CAST(sum(CASE WHEN shipment_date >= {AS_OF} - INTERVAL '24' MONTH AND shipment_date < {AS_OF} - INTERVAL '12' MONTH THEN value_usd END) AS DOUBLE) AS previous_usd
FROM ledger WHERE direction = 'IMPORT' AND buyer_id IS NOT NULL GROUP BY buyer_id, destination_country""")

view("buyer_profile", """
SELECT buyer_id, destination_country, first_day, last_day, n, value_usd, qty_kg, mean_price, codes, suppliers, growth_pct,
       CASE WHEN value_usd >= 1000000 THEN 'Whale' WHEN value_usd >= 100000 THEN CASE WHEN growth_pct > 50 THEN 'Growing' ELSE 'Mid' END
            WHEN value_usd >= 10000 THEN CASE WHEN growth_pct > 100 THEN 'Growing' ELSE 'Value' END WHEN n <= 2 THEN 'New' ELSE 'Small' END AS persona
FROM (SELECT *, CASE WHEN current_usd > 0 AND previous_usd > 0 THEN round(100 * (current_usd - previous_usd) / previous_usd, 2) END AS growth_pct FROM buyer_total) x""", [])

view("exporter_month", f"""
SELECT supplier_id, origin_country, year, month, count(*) AS n FROM ledger
WHERE direction = 'EXPORT' AND shipment_date >= {AS_OF} - INTERVAL '12' MONTH AND shipment_date < {AS_OF} GROUP BY supplier_id, origin_country, year, month""")

view("exporter_profile", f"""
SELECT t.supplier_id, t.origin_country, t.n, t.value_usd, t.buyers, t.codes, t.first_day, t.last_day,
       CASE WHEN s.months IS NULL THEN 50e0 ELSE round(least(s.months / 12e0 * 50, 50) + greatest(50 - 25 * coalesce(s.spread / s.mean_n, 0), 0), 2) END AS stability,
       least(100, 50 + CASE WHEN t.n >= 100 THEN 20 WHEN t.n >= 50 THEN 15 WHEN t.n >= 20 THEN 10 WHEN t.n >= 5 THEN 5 ELSE 0 END
         + CASE WHEN @days({AS_OF}; t.last_day) <= 30 THEN 20 WHEN @days({AS_OF}; t.last_day) <= 90 THEN 15 WHEN @days({AS_OF}; t.last_day) <= 180 THEN 10 ELSE 0 END
         + CASE WHEN @days(t.last_day; t.first_day) >= 365 THEN 10 WHEN @days(t.last_day; t.first_day) >= 180 THEN 5 ELSE 0 END) AS onboarding
FROM (SELECT supplier_id, origin_country, count(*) AS n, {_V} AS value_usd, count(DISTINCT buyer_id) AS buyers, count(DISTINCT hs_code_6) AS codes, min(shipment_date) AS first_day, max(shipment_date) AS last_day
      FROM ledger WHERE direction = 'EXPORT' GROUP BY supplier_id, origin_country) t
LEFT JOIN (SELECT supplier_id, origin_country, count(*) AS months, CAST(sum(n) AS DOUBLE) / count(*) AS mean_n, round(stddev_samp(CAST(n AS DOUBLE)), 8) AS spread FROM exporter_month GROUP BY supplier_id, origin_country) s
  ON s.supplier_id = t.supplier_id AND s.origin_country = t.origin_country""", [])

# Equality on country pair and product, whoever the supplier: rivals are what the lead over the second guards against. An import
# lies in one bucket of 31 days, and the 31 days that an export looks at lie in one or two, so every pair meets once.
view("mirror_candidate", """
SELECT export_id, import_id, lag_days, imported_buyer, 40 + CASE WHEN same_qty THEN 25 ELSE 0 END + CASE WHEN lag_days BETWEEN 15 AND 45 THEN 20 ELSE 0 END
       + CASE WHEN same_container THEN 10 ELSE 0 END + CASE WHEN same_vessel THEN 5 ELSE 0 END AS score
FROM (SELECT e.transaction_id AS export_id, i.transaction_id AS import_id, @days(i.shipment_date; e.shipment_date) AS lag_days, i.buyer_id AS imported_buyer,
             coalesce(e.qty_kg > 0 AND abs(i.qty_kg - e.qty_kg) <= e.qty_kg * 0.05, FALSE) AS same_qty,
             coalesce(e.container_id = i.container_id, FALSE) AS same_container, coalesce(e.vessel_name = i.vessel_name, FALSE) AS same_vessel
      FROM (SELECT l.*, floor((@days(l.shipment_date; DATE '1970-01-01') + 15 + 30 * k) / 31) AS bucket FROM ledger l CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 AS k) w
            WHERE l.direction = 'EXPORT' AND l.hidden_buyer AND (k = 0 OR (@days(l.shipment_date; DATE '1970-01-01') + 15) % 31 <> 0)) e
      JOIN (SELECT l.*, floor(@days(l.shipment_date; DATE '1970-01-01') / 31) AS bucket FROM ledger l WHERE l.direction = 'IMPORT' AND l.buyer_id IS NOT NULL) i
        ON e.destination_country = i.reporting_country AND e.origin_country = i.origin_country AND e.hs_code_6 = i.hs_code_6 AND e.bucket = i.bucket
      WHERE (e.qty_kg IS NULL OR e.qty_kg <= 0 OR i.qty_kg BETWEEN e.qty_kg * 0.95 AND e.qty_kg * 1.05)
        AND @days(i.shipment_date; e.shipment_date) BETWEEN 15 AND 45) x""")

view("mirror_match", """
SELECT export_id, import_id, imported_buyer, score, lag_days FROM (
  SELECT *, row_number() OVER (PARTITION BY export_id ORDER BY score DESC, import_id) AS rk, lead(score) OVER (PARTITION BY export_id ORDER BY score DESC, import_id) AS second FROM mirror_candidate) x
WHERE rk = 1 AND score >= 70 AND (second IS NULL OR score - second > 5)""", [])

# Candidates grow with the square of the ledger, so Spark counts them by export and score before the shuffle, in sums of fixed
# width that need no sort. A match is alone at its score, so the greatest hashes there are those of its import.
_BY_SCORE = """
SELECT export_id, h1, h2, imported_buyer, score, lag_days FROM (
  SELECT *, row_number() OVER (PARTITION BY export_id ORDER BY score DESC) AS rk, lead(score) OVER (PARTITION BY export_id ORDER BY score DESC) AS second FROM (
    SELECT export_id, score, count(*) AS n, max(imported_buyer) AS imported_buyer, max(lag_days) AS lag_days, max(xxhash64(import_id)) AS h1, max(xxhash64('second', import_id)) AS h2
    FROM mirror_candidate GROUP BY export_id, score) x) y
WHERE rk = 1 AND n = 1 AND score >= 70 AND (second IS NULL OR score - second > 5)"""


def _matches(spark: SparkSession, sf_dir: str, slices: int | None = None) -> Iterator[DataFrame]:
    """The mirror matches in slices by export."""
    every = portable.ledger(spark, sf_dir)
    slices = slices or portable.slices_for(every)
    ids = every.filter("direction = 'IMPORT' AND buyer_id IS NOT NULL").select(F.col("transaction_id").alias("import_id"))
    of = F.xxhash64("import_id"), F.xxhash64(F.lit("second"), "import_id")
    for k in range(slices):
        own = every.filter((F.col("direction") != "EXPORT") | (F.pmod(F.xxhash64("transaction_id"), F.lit(slices)) == k)) if slices > 1 else every
        found = portable.planned(spark, sf_dir, _BY_SCORE, {"ledger": own})
        yield found.join(ids, (of[0] == found["h1"]) & (of[1] == found["h2"])).select("export_id", "import_id", "imported_buyer", "score", "lag_days").distinct()


SLICED["mirror_match"] = _matches
BUILT["mirror_match"] = lambda spark, sf_dir: next(_matches(spark, sf_dir, 1))

view("lane_risk", f"""
SELECT origin_country, destination_country, hs_code_6, n, score, {_LEVEL} AS risk_level FROM (
  SELECT l.*, CASE WHEN l.n = 0 THEN 60 WHEN l.n = 1 THEN 50 ELSE 40 END AS score
  FROM lane l JOIN (SELECT hs_code_6 AS code, sum(n) AS total FROM lane GROUP BY hs_code_6) t ON t.code = l.hs_code_6 WHERE l.n <= {RISK["lane_rare"]} AND t.total >= {RISK["lane_common"]}) x""")

view("ghost_risk", f"""
SELECT buyer_id, value_usd, score, {_LEVEL} AS risk_level, 7e-1 AS confidence FROM (
  SELECT buyer_id, value_usd, CASE WHEN value_usd >= 5000000 THEN 70 WHEN value_usd >= 1000000 THEN 55 ELSE 45 END AS score
  FROM (SELECT buyer_id, max(value_usd) AS value_usd FROM buyer_profile GROUP BY buyer_id) p WHERE value_usd >= {RISK["ghost_value"]}) x""")

view("spike_risk", f"""
SELECT buyer_id, z, pct, CASE WHEN large THEN CASE WHEN z > 4 OR pct > 500 THEN 50 WHEN z > 3 OR pct > 300 THEN 40 ELSE 30 END ELSE CASE WHEN z > 4 OR pct > 500 THEN 70 WHEN z > 3 OR pct > 300 THEN 55 ELSE 45 END END AS score
FROM (SELECT m.buyer_id, CASE WHEN spread > 0 THEN round((latest - mean_usd) / spread, 4) ELSE 0e0 END AS z, CASE WHEN mean_usd > 0 THEN round(100 * (latest - mean_usd) / mean_usd, 4) ELSE 0e0 END AS pct, p.large
      FROM (SELECT buyer_id, max(CASE WHEN rk = 1 THEN usd END) AS latest, round(sum(CAST(usd AS DECIMAL(18,2))) / count(*), 6) AS mean_usd, round(stddev_samp(usd), 4) AS spread, count(*) AS months
            FROM (SELECT buyer_id, year, month, {_V} AS usd, row_number() OVER (PARTITION BY buyer_id ORDER BY year DESC, month DESC) AS rk FROM ledger WHERE direction = 'IMPORT' AND buyer_id IS NOT NULL GROUP BY buyer_id, year, month) a GROUP BY buyer_id) m
      JOIN (SELECT buyer_id, max(CASE WHEN persona IN ('Whale', 'Mid') THEN 1 ELSE 0 END) = 1 AS large FROM buyer_profile GROUP BY buyer_id) p ON p.buyer_id = m.buyer_id WHERE months >= {RISK["spike_months"]}) x
WHERE z > {RISK["spike_z"]} OR pct > {RISK["spike_pct"]}""")

view("buyer_risk", f"""
SELECT buyer_id, score, {_LEVEL} AS risk_level, reason_code FROM (
  SELECT *, row_number() OVER (PARTITION BY buyer_id ORDER BY score DESC, reason_code) AS rk FROM (
    SELECT buyer_id, score, 'GHOST_ENTITY' AS reason_code FROM ghost_risk UNION ALL SELECT buyer_id, score, 'VOLUME_SPIKE' FROM spike_risk) a) x WHERE rk = 1""", [])

# Buyers and suppliers are counted by a second aggregate over one row each: several distinct counts at once would multiply the rows.
view("country_hs_month", """
SELECT b.reporting_country, b.direction, b.hs_code_6, b.year, b.month, b.shipments, b.value_usd, b.qty_kg, b.buyers, s.suppliers, b.risky_shipments, b.risky_buyers
FROM (SELECT reporting_country, direction, hs_code_6, year, month, CAST(sum(n) AS BIGINT) AS shipments, CAST(sum(usd) AS DOUBLE) AS value_usd, CAST(sum(kg) AS DOUBLE) AS qty_kg, count(buyer_id) AS buyers,
             CAST(sum(risky) AS BIGINT) AS risky_shipments, count(CASE WHEN risky > 0 THEN buyer_id END) AS risky_buyers
      FROM (SELECT l.reporting_country, l.direction, l.hs_code_6, l.year, l.month, l.buyer_id, count(*) AS n, sum(l.value_usd) AS usd, sum(l.qty_kg) AS kg, count(r.transaction_id) AS risky
            FROM ledger l LEFT JOIN (SELECT transaction_id FROM invoice_risk WHERE risk_level IN ('HIGH', 'CRITICAL')) r ON r.transaction_id = l.transaction_id
            GROUP BY l.reporting_country, l.direction, l.hs_code_6, l.year, l.month, l.buyer_id) x GROUP BY reporting_country, direction, hs_code_6, year, month) b
JOIN (SELECT reporting_country, direction, hs_code_6, year, month, count(supplier_id) AS suppliers
      FROM (SELECT DISTINCT reporting_country, direction, hs_code_6, year, month, supplier_id FROM ledger) y GROUP BY reporting_country, direction, hs_code_6, year, month) s
  ON s.reporting_country IS NOT DISTINCT FROM b.reporting_country AND s.direction = b.direction AND s.hs_code_6 IS NOT DISTINCT FROM b.hs_code_6 AND s.year IS NOT DISTINCT FROM b.year AND s.month IS NOT DISTINCT FROM b.month""", [])

view("country_hs_dashboard", """
SELECT *, round(100 * value_usd / NULLIF(sum(value_usd) OVER (PARTITION BY reporting_country, direction, year, month), 0), 4) AS share_pct,
       CASE WHEN shipments > 0 THEN round(100 * CAST(risky_shipments AS DOUBLE) / shipments, 4) END AS risky_pct FROM country_hs_month""")

view("buyer_hs_activity", f"""
SELECT buyer_id, hs_code_6, reporting_country, direction, count(*) AS shipments, {_V} AS value_usd, min(shipment_date) AS first_day, max(shipment_date) AS last_day, count(DISTINCT origin_country) AS origins
FROM ledger WHERE buyer_id IS NOT NULL GROUP BY buyer_id, hs_code_6, reporting_country, direction""")

view("buyer_360", f"""
SELECT c.c_custkey AS buyer_id, c.c_name AS buyer_name, a.shipments, a.value_usd, a.codes, a.origins, a.active_years, p.persona, p.growth_pct, coalesce(r.risk_level, 'UNSCORED') AS risk_level, r.score AS risk_score, t.top_code, o.top_origin
FROM {{customer}} c
JOIN (SELECT buyer_id, count(*) AS shipments, {_V} AS value_usd, count(DISTINCT hs_code_6) AS codes, count(DISTINCT origin_country) AS origins, count(DISTINCT year) AS active_years FROM ledger WHERE buyer_id IS NOT NULL GROUP BY buyer_id) a ON a.buyer_id = c.c_custkey
LEFT JOIN (SELECT buyer_id, persona, growth_pct FROM (SELECT buyer_id, persona, growth_pct, row_number() OVER (PARTITION BY buyer_id ORDER BY value_usd DESC, destination_country) AS rk FROM buyer_profile) y WHERE rk = 1) p ON p.buyer_id = a.buyer_id
LEFT JOIN buyer_risk r ON r.buyer_id = a.buyer_id
LEFT JOIN (SELECT buyer_id, hs_code_6 AS top_code FROM (SELECT buyer_id, hs_code_6, row_number() OVER (PARTITION BY buyer_id ORDER BY {_V} DESC, hs_code_6) AS rk FROM ledger GROUP BY buyer_id, hs_code_6) y WHERE rk = 1) t ON t.buyer_id = a.buyer_id
LEFT JOIN (SELECT buyer_id, origin_country AS top_origin FROM (SELECT buyer_id, origin_country, row_number() OVER (PARTITION BY buyer_id ORDER BY {_V} DESC, origin_country) AS rk FROM ledger GROUP BY buyer_id, origin_country) y WHERE rk = 1) o ON o.buyer_id = a.buyer_id""", [])

# Target buyers of one product. The cohort is every buyer that passes the filters, so scores come before any limit.
view("hunted", f"""
SELECT b.buyer_id, b.value_usd, b.n, b.months, b.years, round(100 * b.value_usd / NULLIF(a.value_usd, 0), 4) AS share_pct, coalesce(r.risk_level, 'UNSCORED') AS risk_level, b.destination_country
FROM (SELECT buyer_id, max(destination_country) AS destination_country, {_V} AS value_usd, count(*) AS n, count(DISTINCT year * 100 + month) AS months, count(DISTINCT year) AS years FROM ledger
      WHERE direction = 'IMPORT' AND hs_code_6 = 'PROMO' AND buyer_id IS NOT NULL AND shipment_date >= {AS_OF} - INTERVAL '720' DAY GROUP BY buyer_id) b
JOIN (SELECT buyer_id, {_V} AS value_usd FROM ledger WHERE direction = 'IMPORT' AND buyer_id IS NOT NULL AND shipment_date >= {AS_OF} - INTERVAL '720' DAY GROUP BY buyer_id) a ON a.buyer_id = b.buyer_id
LEFT JOIN buyer_risk r ON r.buyer_id = b.buyer_id WHERE b.value_usd >= 1000""", [])

# The place of each buyer in the cohort: Spark counts the smaller values without bringing all buyers into one task.
view("hunt_rank", "SELECT buyer_id, rank() OVER (ORDER BY value_usd) - 1 AS below FROM hunted")
BUILT["hunt_rank"] = lambda spark, sf_dir: ranked(run(spark, sf_dir, "SELECT buyer_id, value_usd FROM hunted"), "value_usd").select("buyer_id", (F.col("rank") - 1).alias("below"))

# Quality is a known class (the persona of the largest profile), months and years; B3 to B5 are classes that no profile gives yet.
view("hunt_score", """
SELECT buyer_id, destination_country, value_usd, n, share_pct, risk_level,
       round(least(100e0, greatest(0e0, CASE WHEN cohort < 5 THEN 20 + 20 * value_usd / NULLIF(most, 0) ELSE 40 * CAST(below AS DOUBLE) / cohort END
         + least(months, 12) + 2 * least(years, 4) + 15 * least(share_pct / 50, 1e0) + CASE risk_level WHEN 'LOW' THEN 15 WHEN 'MEDIUM' THEN 8 WHEN 'UNSCORED' THEN 6 WHEN 'HIGH' THEN 2 ELSE 0 END
         + CASE WHEN class <> 'Unknown' THEN 4 ELSE 0 END + CASE WHEN months >= 3 THEN 3 ELSE 0 END + CASE WHEN years >= 2 THEN 3 ELSE 0 END
         + CASE WHEN class IN ('B4', 'B5') THEN 3 WHEN class = 'B3' THEN 1 ELSE 0 END)), 1) AS score
FROM (SELECT h.*, coalesce(p.persona, 'Unknown') AS class, k.below, t.cohort, t.most
      FROM hunted h JOIN hunt_rank k ON k.buyer_id = h.buyer_id CROSS JOIN (SELECT count(*) AS cohort, max(value_usd) AS most FROM hunted) t
      LEFT JOIN (SELECT buyer_id, persona, row_number() OVER (PARTITION BY buyer_id ORDER BY value_usd DESC, destination_country) AS rk FROM buyer_profile) p ON p.buyer_id = h.buyer_id AND p.rk = 1) x""")

# A group or a buyer lies in one slice whole; every row of invoice_risk is one of the ledger beside its corridor.
_CORRIDOR = ["hs_code_6", "destination_country", "year", "month", "direction", "reporting_country"]
APART |= {"corridor": _CORRIDOR, "invoice_risk": _CORRIDOR, "country_hs_month": ["reporting_country", "direction", "hs_code_6", "year", "month"], "buyer_profile": ["buyer_id"], "buyer_360": ["buyer_id"]}

_TOP = lambda what, who, where: f"SELECT {who}, {what}, value_usd, n, rk FROM (SELECT {who}, {what}, {_V} AS value_usd, count(*) AS n, row_number() OVER (PARTITION BY {who} ORDER BY {_V} DESC, {what}) AS rk FROM ledger WHERE {where} GROUP BY {who}, {what}) x WHERE rk <= 5"

PLANS: dict[str, str] = {
    "c01_buyer_profile": "SELECT * FROM buyer_profile",
    "c01_buyer_top_suppliers": _TOP("supplier_id", "buyer_id", "direction = 'IMPORT' AND buyer_id IS NOT NULL"),
    "c02_growth": "SELECT buyer_id, destination_country, growth_pct FROM buyer_profile",
    "c03_persona": "SELECT persona, count(*) AS n FROM buyer_profile GROUP BY persona",
    "c04_exporter_profile": "SELECT supplier_id, origin_country, n, value_usd, buyers, codes, first_day, last_day FROM exporter_profile",
    "c04_exporter_top_codes": _TOP("hs_code_6", "supplier_id", "direction = 'EXPORT'"),
    "c05_stability": "SELECT supplier_id, origin_country, stability FROM exporter_profile",
    "c06_onboarding": "SELECT supplier_id, origin_country, CAST(onboarding AS BIGINT) AS onboarding FROM exporter_profile",
    "c07_price_corridor": "SELECT * FROM corridor",
    "c08_lane_stats": "SELECT * FROM lane",
    "c08_lane_carriers": f"SELECT * FROM (SELECT origin_country, destination_country, hs_code_6, coalesce(vessel_name, 'Unknown') AS carrier, count(*) AS n, row_number() OVER (PARTITION BY origin_country, destination_country, hs_code_6 ORDER BY count(*) DESC, coalesce(vessel_name, 'Unknown')) AS rk FROM ledger GROUP BY origin_country, destination_country, hs_code_6, coalesce(vessel_name, 'Unknown')) x WHERE rk <= 5",
    "c09_invoice_outliers": "SELECT transaction_id, hs_code_6, direction, n, z, reason_code, CAST(score AS BIGINT) AS score, risk_level, confidence FROM invoice_risk",
    "c09_anomaly_classes": "SELECT CASE WHEN z > 5 THEN 'EXTREME_HIGH' WHEN z > 3 THEN 'HIGH' WHEN z > 2 THEN 'ELEVATED' WHEN z < -5 THEN 'EXTREME_LOW' WHEN z < -3 THEN 'LOW' WHEN z < -2 THEN 'REDUCED' ELSE 'NORMAL' END AS class, count(*) AS n FROM priced GROUP BY 1",
    "c10_weird_lane": "SELECT origin_country, destination_country, hs_code_6, n, CAST(score AS BIGINT) AS score, risk_level, concat('LANE:', origin_country, '->', destination_country) AS scope FROM lane_risk",
    "c11_ghost_entity": "SELECT buyer_id, value_usd, CAST(score AS BIGINT) AS score, risk_level, confidence FROM ghost_risk",
    "c13_volume_spike": "SELECT buyer_id, CAST(score AS BIGINT) AS score FROM spike_risk",
    "c14_mirror_match": "SELECT export_id, import_id, imported_buyer, CAST(score AS BIGINT) AS score FROM mirror_match",
    "c14_mirror_write_back": "SELECT l.transaction_id, coalesce(l.buyer_id, m.imported_buyer) AS buyer_id, m.export_id IS NOT NULL AS inferred FROM ledger l LEFT JOIN mirror_match m ON m.export_id = l.transaction_id WHERE l.hidden_buyer",
    "c15_mirror_routes": "SELECT l.origin_country, l.destination_country, count(*) AS n FROM mirror_match m JOIN ledger l ON l.transaction_id = m.export_id GROUP BY 1, 2 ORDER BY n DESC, 1, 2 LIMIT 5",
    "c18_buyer_hunter": "SELECT buyer_id, destination_country, value_usd, n, share_pct, risk_level FROM hunted WHERE risk_level IN ('LOW', 'MEDIUM', 'UNSCORED')",
    "c19_opportunity_score": "SELECT buyer_id, value_usd, score FROM hunt_score",
    "c20_top_targets": "SELECT buyer_id, value_usd, score FROM hunt_score ORDER BY score DESC, value_usd DESC, buyer_id LIMIT 20",
    "c21_buyer_360": "SELECT buyer_id, buyer_name, shipments, value_usd, codes, origins, active_years, persona, growth_pct, risk_level, CAST(risk_score AS BIGINT) AS risk_score, top_code, top_origin FROM buyer_360",
    "c22_country_hs_month": "SELECT * FROM country_hs_month",
    "c23_country_hs_dashboard": "SELECT reporting_country, direction, hs_code_6, year, month, shipments, value_usd, share_pct, risky_pct FROM country_hs_dashboard",
    "c24_buyer_hs_activity": "SELECT * FROM buyer_hs_activity",
    "c25_risk_with_names": "SELECT r.buyer_id, c_name, CAST(r.score AS BIGINT) AS score, r.risk_level, r.reason_code FROM buyer_risk r LEFT JOIN {customer} ON c_custkey = r.buyer_id",
    # the benchmark set
    "b01_buyer_hunter_lane_agg": f"SELECT buyer_id, destination_country, {_V} AS value_usd, count(*) AS n, count(DISTINCT year * 100 + month) AS months FROM ledger WHERE hs_code_6 = 'PROMO' AND direction = 'IMPORT' AND shipment_date >= DATE '1999-07-01' AND year >= 1999 GROUP BY 1, 2 ORDER BY value_usd DESC, 1, 2 LIMIT 100",
    "b02_buyer_hunter_full": "SELECT buyer_id, destination_country, value_usd, n, share_pct, risk_level FROM hunted ORDER BY value_usd DESC, buyer_id LIMIT 100",
    "b03_hs_dashboard_monthly": f"SELECT hs_code_6, year, month, count(*) AS shipments, {_V} AS value_usd, count(DISTINCT buyer_id) AS buyers FROM ledger WHERE hs_code_6 = 'PROMO' AND direction = 'IMPORT' GROUP BY 1, 2, 3 ORDER BY year DESC, month DESC LIMIT 24",
    "b04_hs_dashboard_countries": f"SELECT reporting_country, count(*) AS shipments, {_V} AS value_usd FROM ledger WHERE hs_code_6 = 'PROMO' GROUP BY 1 ORDER BY value_usd DESC LIMIT 20",
    "b05_risk_top_shipments": "SELECT transaction_id, CAST(score AS BIGINT) AS score, hs_code_6, CAST(value_usd AS DOUBLE) AS value_usd FROM invoice_risk ORDER BY 2 DESC, 4 DESC, 1 LIMIT 50",
    "b06_risk_top_buyers": f"SELECT r.buyer_id, CAST(max(r.score) AS BIGINT) AS score, count(DISTINCT l.hs_code_6) AS codes, {_V} AS value_usd FROM buyer_risk r LEFT JOIN ledger l ON l.buyer_id = r.buyer_id GROUP BY r.buyer_id ORDER BY score DESC, value_usd DESC, r.buyer_id LIMIT 50",
    "b07_buyer_360_lookup": "SELECT buyer_id, buyer_name, shipments, value_usd, persona, risk_level FROM buyer_360 WHERE buyer_id = (SELECT min(buyer_id) FROM ledger)",
    "b08_country_hs_summary": f"SELECT reporting_country, hs_code_6, count(*) AS shipments, count(DISTINCT buyer_id) AS buyers, count(DISTINCT supplier_id) AS suppliers, {_V} AS value_usd FROM ledger GROUP BY 1, 2",
    "b09_buyer_hs_activity": "SELECT buyer_id, hs_code_6, shipments, value_usd FROM buyer_hs_activity WHERE direction = 'IMPORT' ORDER BY value_usd DESC, buyer_id, hs_code_6 LIMIT 100",
    "b10_full_scan": f"SELECT count(*) AS n, {_V} AS value_usd, {_Q} AS qty_kg, count(DISTINCT hs_code_6) AS codes, count(DISTINCT reporting_country) AS countries FROM ledger",
    # parameterised serving queries, with fixed parameters
    "q01_hs_codes": f"SELECT hs_code_6, count(DISTINCT buyer_id) AS buyers, count(*) AS shipments, {_V} AS value_usd FROM ledger GROUP BY 1 ORDER BY value_usd DESC NULLS LAST LIMIT 50",
    "q02_buyers": "SELECT buyer_id, buyer_name, value_usd, risk_level FROM buyer_360 WHERE risk_level <> 'HIGH' AND buyer_id IN (SELECT buyer_id FROM ledger WHERE hs_code_6 = 'PROMO') ORDER BY value_usd DESC NULLS LAST, buyer_id LIMIT 20 OFFSET 20",
    "q03_buyer": "SELECT buyer_id, buyer_name, shipments, value_usd, top_code, top_origin FROM buyer_360 WHERE buyer_id = 7",
    "q04_trade_history": f"SELECT year, month, count(*) AS n, {_V} AS value_usd, {_Q} AS qty_kg FROM ledger WHERE buyer_id = 7 GROUP BY 1, 2 ORDER BY 1, 2",
    "q05_buyer_suppliers": f"SELECT supplier_id, s_name, count(*) AS n, {_V} AS value_usd FROM ledger LEFT JOIN {{supplier}} ON s_suppkey = supplier_id WHERE buyer_id = 7 GROUP BY 1, 2 ORDER BY value_usd DESC, supplier_id LIMIT 10",
    "q06_buyer_shipments": "SELECT transaction_id, shipment_date, hs_code_6, CAST(value_usd AS DOUBLE) AS value_usd FROM ledger WHERE buyer_id = 7 ORDER BY shipment_date DESC, transaction_id LIMIT 20",
    "q07_similar_buyers": f"SELECT buyer_id, count(DISTINCT hs_code_6) AS shared, {_V} AS value_usd FROM ledger WHERE buyer_id <> 7 AND hs_code_6 IN (SELECT hs_code_6 FROM ledger WHERE buyer_id = 7) GROUP BY 1 ORDER BY shared DESC, value_usd DESC, buyer_id LIMIT 10",
    "q08_business_profile": _TOP("hs_code_6", "buyer_id", "buyer_id = 7"),
    "q09_hs_dashboard": "SELECT year, month, CAST(sum(shipments) AS BIGINT) AS shipments, CAST(sum(buyers) AS BIGINT) AS buyers, CAST(sum(risky_shipments) AS BIGINT) AS risky FROM country_hs_month WHERE hs_code_6 = 'PROMO' GROUP BY 1, 2 ORDER BY 1, 2",
    "q10_top_hs_codes": "SELECT hs_code_6, CAST(sum(shipments) AS BIGINT) AS shipments, count(DISTINCT reporting_country) AS countries FROM country_hs_month GROUP BY 1 ORDER BY shipments DESC, 1 LIMIT 10",
    "q11_top_shipments": "SELECT transaction_id, z, risk_level FROM invoice_risk WHERE risk_level IN ('HIGH', 'CRITICAL') ORDER BY abs(z) DESC, transaction_id LIMIT 25 OFFSET 5",
    "q12_top_buyers": "SELECT b.buyer_id, b.buyer_name, b.value_usd, CAST(r.score AS BIGINT) AS score FROM buyer_risk r JOIN buyer_360 b ON b.buyer_id = r.buyer_id ORDER BY r.score DESC NULLS LAST, b.value_usd DESC, b.buyer_id LIMIT 25",
    "q13_risk_summary": "SELECT 'SHIPMENT' AS entity, risk_level, count(*) AS n FROM invoice_risk GROUP BY 2 UNION ALL SELECT 'BUYER', risk_level, count(*) FROM buyer_risk GROUP BY 2",
    "q14_products": f"SELECT hs_code_6, count(*) AS n, {_V} AS value_usd FROM ledger GROUP BY 1 HAVING count(*) >= 100 ORDER BY value_usd DESC LIMIT 20",
    "q15_suppliers": f"SELECT supplier_id, s_name, count(*) AS n, {_V} AS value_usd FROM ledger JOIN {{supplier}} ON s_suppkey = supplier_id WHERE hs_code_6 = 'PROMO' AND destination_country = 'KENYA' GROUP BY 1, 2 ORDER BY value_usd DESC, supplier_id LIMIT 20",
    "q16_buyer_interest": "SELECT buyer_id, buyer_name, active_years * 12 AS active_months, value_usd FROM buyer_360 ORDER BY value_usd DESC, buyer_id LIMIT 25",
    "q17_stats": "SELECT count(DISTINCT buyer_id) AS buyers, count(DISTINCT supplier_id) AS suppliers, count(DISTINCT hs_code_6) AS codes, count(DISTINCT reporting_country) AS countries, count(DISTINCT CASE WHEN hidden_buyer THEN supplier_id END) AS hiding_suppliers FROM ledger",
    "q18_live_updates": "SELECT transaction_id, hs_code_6, shipment_date, CAST(value_usd AS DOUBLE) AS value_usd FROM ledger ORDER BY shipment_date DESC, transaction_id LIMIT 10",
    "q21_search_by_name": "SELECT buyer_id, buyer_name, value_usd FROM buyer_360 WHERE buyer_name ILIKE '%00001%' ORDER BY value_usd DESC, buyer_id LIMIT 20",
    "q22_meta_stats": f"SELECT count(*) AS shipments, count(DISTINCT buyer_id) AS buyers, min(shipment_date) AS first_day, max(shipment_date) AS last_day, {_V} AS value_usd FROM ledger",
    "q25_context": "SELECT hs_code_6, shipments, value_usd FROM buyer_hs_activity WHERE buyer_id = 7 AND direction = 'IMPORT' ORDER BY value_usd DESC, hs_code_6, reporting_country LIMIT 10",
    # validation
    "v01_reconciliation": "SELECT coalesce(a.direction, b.direction) AS direction, a.n AS ledger_rows, b.n AS corridor_rows FROM (SELECT direction, count(*) AS n FROM ledger GROUP BY 1) a FULL OUTER JOIN (SELECT direction, CAST(sum(n) AS BIGINT) AS n FROM corridor GROUP BY 1) b ON a.direction = b.direction",
    "v02_completeness": "SELECT direction, round(100 * CAST(count(buyer_id) AS DOUBLE) / count(*), 4) AS buyer_pct, round(100 * CAST(count(container_id) AS DOUBLE) / count(*), 4) AS container_pct FROM ledger GROUP BY 1",
    "v03_duplicates": "SELECT transaction_id, count(*) AS n FROM ledger GROUP BY 1 HAVING count(*) > 1",
    "v04_orphans": "SELECT count(*) AS n FROM {lineitem} l WHERE NOT EXISTS (SELECT 1 FROM {orders} o WHERE o.o_orderkey = l.l_orderkey)",
    "v05_recomputed": "SELECT count(*) AS differing FROM buyer_profile p JOIN (SELECT buyer_id, destination_country, count(*) AS n FROM ledger WHERE direction = 'IMPORT' GROUP BY 1, 2) c ON c.buyer_id = p.buyer_id AND c.destination_country = p.destination_country WHERE p.n <> c.n",
    "v06_shares": "SELECT count(*) AS off FROM (SELECT reporting_country, direction, year, month FROM country_hs_dashboard GROUP BY 1, 2, 3, 4 HAVING abs(sum(share_pct) - 100) > 1) x",
    "v07_sanity": "SELECT count(CASE WHEN value_usd < 0 THEN 1 END) AS negative, count(CASE WHEN price_per_kg < 1e-2 OR price_per_kg > 1e4 THEN 1 END) AS odd_price FROM ledger",
    "v08_personas": "SELECT destination_country, persona, count(*) AS n FROM buyer_profile GROUP BY 1, 2",
    "v11_hidden_status": "SELECT CASE WHEN m.export_id IS NOT NULL THEN 'INFERRED' ELSE 'UNKNOWN' END AS status, count(*) AS n FROM ledger l LEFT JOIN mirror_match m ON m.export_id = l.transaction_id WHERE l.hidden_buyer GROUP BY 1",
    "v13_monthly_volumes": f"SELECT year, month, count(*) AS n, {_V} AS value_usd FROM ledger GROUP BY 1, 2",
    "v14_source_totals": f"SELECT a.value_usd AS ledger_usd, b.value_usd AS source_usd, abs(a.value_usd - b.value_usd) <= 1e-2 AS equal FROM (SELECT {_V} AS value_usd FROM ledger WHERE direction = 'EXPORT') a CROSS JOIN (SELECT CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS value_usd FROM {{lineitem}}) b",
    "v15_layer_trace": "SELECT 'ledger' AS layer, count(*) AS n FROM ledger WHERE hs_code_6 = 'PROMO' UNION ALL SELECT 'corridor', count(*) FROM corridor WHERE hs_code_6 = 'PROMO' UNION ALL SELECT 'risk', count(*) FROM invoice_risk WHERE hs_code_6 = 'PROMO'",
}

#: Queries that compute a table in their own plan, from the tables before it, instead of reading it.
ANEW: dict[str, list[str]] = {
    "c01_buyer_profile": ["buyer_profile"], "c04_exporter_profile": ["exporter_profile"], "c07_price_corridor": ["corridor"], "c08_lane_stats": ["lane"], "c09_invoice_outliers": ["invoice_risk"], "c14_mirror_match": ["mirror_match"],
    "c18_buyer_hunter": ["hunted"], "b02_buyer_hunter_full": ["hunted"], "c21_buyer_360": ["buyer_360"], "c22_country_hs_month": ["country_hs_month"], "c25_risk_with_names": ["buyer_risk"],
}
