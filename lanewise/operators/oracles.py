"""SQL for the oracle that is written apart from the plans: from the definitions, in the oracle's own dialect.

A plan that Spark and the oracle both read shows only that the engines agree. These texts start from the source tables anew, with
other forms of the same definitions: two selects for the directions, filters on aggregates, QUALIFY, joins without buckets.
"""

from __future__ import annotations

import re

_LEDGER = """
src AS (
  SELECT l_orderkey AS ok, l_linenumber AS ln, l_orderkey || '-' || l_partkey || '-' || l_suppkey || '-' || l_linenumber AS k, p_type AS hs, p_brand AS ship, l_suppkey AS seller, o_custkey AS cust,
         a.n_name AS org, b.n_name AS dst, l_shipdate::DATE AS day, l_quantity AS q, l_extendedprice AS v, l_returnflag = 'R' AS returned, CASE l_linestatus WHEN 'F' THEN l_orderkey || '-' || l_linenumber END AS box
  FROM lineitem, orders, part, supplier, nation a, customer, nation b
  WHERE o_orderkey = l_orderkey AND p_partkey = l_partkey AND s_suppkey = l_suppkey AND a.n_nationkey = s_nationkey AND c_custkey = o_custkey AND b.n_nationkey = c_nationkey),
t AS (
  SELECT 'EXPORT-' || k AS id, 'EXPORT' AS dir, org AS rep, org, dst, hs, seller, CASE WHEN NOT returned THEN cust END AS buyer, returned AS hidden, day, q::DECIMAL(18,4) AS kg, v::DECIMAL(18,2) AS usd, v / nullif(q, 0) AS price, box, ship FROM src
  UNION ALL
  SELECT 'IMPORT-' || k, 'IMPORT', dst, org, dst, hs, seller, cust, FALSE, day + (10 + 5 * ln)::INTEGER, (q * (1e0 + (ln % 3 - 1) * 2e-2))::DECIMAL(18,4), v::DECIMAL(18,2), v / nullif(q, 0), box, ship FROM src)"""

_PROFILE = """
prof AS (
  SELECT *, CASE WHEN now_usd > 0 AND then_usd > 0 THEN round(100 * (now_usd - then_usd) / then_usd, 2) END AS growth_pct FROM (
    SELECT buyer AS buyer_id, dst AS destination_country, min(day) AS first_day, max(day) AS last_day, count(*) AS n, sum(usd)::DOUBLE AS value_usd, sum(kg)::DOUBLE AS qty_kg, count(DISTINCT hs) AS codes, count(DISTINCT seller) AS suppliers,
           sum(usd) FILTER (day BETWEEN '2000-07-01' AND '2001-06-30')::DOUBLE AS now_usd, sum(usd) FILTER (day BETWEEN '1999-07-01' AND '2000-06-30')::DOUBLE AS then_usd
    FROM t WHERE dir = 'IMPORT' AND buyer IS NOT NULL GROUP BY ALL) x),
persona AS (
  SELECT *, CASE WHEN value_usd >= 1e6 THEN 'Whale' WHEN value_usd >= 1e5 THEN if(coalesce(growth_pct, 0) > 50, 'Growing', 'Mid') WHEN value_usd >= 1e4 THEN if(coalesce(growth_pct, 0) > 100, 'Growing', 'Value') ELSE if(n > 2, 'Small', 'New') END AS persona FROM prof)"""

# Percentiles by place in the sorted prices: between the places below and above (n - 1) * p, in proportion.
_CORRIDOR = """
placed AS (
  SELECT hs, dst, year(day) AS y, month(day) AS m, dir, rep, day, round(price * 10000) AS p, row_number() OVER w AS spot, count(*) OVER (PARTITION BY hs, dst, year(day), month(day), dir, rep) AS n
  FROM t WHERE price > 0 AND kg > 0 WINDOW w AS (PARTITION BY hs, dst, year(day), month(day), dir, rep ORDER BY price)),
corr AS (
  SELECT hs, dst, y, m, dir, rep, any_value(n) AS n, min(p) / 10000 AS lo, max(p) / 10000 AS hi, max(day) AS last_day, {q1} AS p25, {q2} AS p50, {q3} AS p75 FROM placed GROUP BY hs, dst, y, m, dir, rep),
z AS (
  SELECT t.*, c.n, if(c.p75 > c.p25, round((t.price - c.p50) / ((c.p75 - c.p25) * 7413e-4), 4), 0) AS z
  FROM t JOIN corr c ON c.hs = t.hs AND c.dst = t.dst AND c.y = year(t.day) AND c.m = month(t.day) AND c.dir = t.dir AND c.rep = t.rep WHERE t.price > 0 AND t.kg > 0 AND c.n >= 5),
odd AS (SELECT *, (CASE WHEN abs(z) > 5 THEN 90 WHEN abs(z) > 3 THEN 70 ELSE 50 END)::BIGINT AS score FROM z WHERE abs(z) > 2)""".format(
    **{f"q{k}": f"(min(p) FILTER (spot = 1 + (n - 1) * {k} // 4) + ((n - 1) * {k} % 4) / 4 * (min(p) FILTER (spot = least(n, 2 + (n - 1) * {k} // 4)) - min(p) FILTER (spot = 1 + (n - 1) * {k} // 4))) / 10000".replace("((n - 1)", "(any_value(n - 1)") for k in (1, 2, 3)}
)

_LEVEL = "CASE WHEN score >= 80 THEN 'CRITICAL' WHEN score >= 60 THEN 'HIGH' WHEN score >= 40 THEN 'MEDIUM' ELSE 'LOW' END"

_MIRROR = """
cand AS (
  SELECT e.id AS export_id, i.id AS import_id, i.day - e.day AS lag_days, i.buyer, 40 + 20 + if(e.kg > 0 AND abs(i.kg - e.kg) <= e.kg * 0.05, 25, 0) + if(coalesce(e.box = i.box, FALSE), 10, 0) + if(coalesce(e.ship = i.ship, FALSE), 5, 0) AS score
  FROM t e JOIN t i ON e.hidden AND i.dir = 'IMPORT' AND i.buyer IS NOT NULL AND i.rep = e.dst AND i.org = e.org AND i.hs = e.hs AND i.day BETWEEN e.day + 15 AND e.day + 45
  WHERE coalesce(e.kg, 0) <= 0 OR abs(i.kg - e.kg) <= e.kg * 0.05),
found AS (
  SELECT * FROM (SELECT *, lead(score) OVER w AS second, row_number() OVER w AS k FROM cand WINDOW w AS (PARTITION BY export_id ORDER BY score DESC, import_id)) WHERE k = 1 AND score >= 70 AND score - coalesce(second, 0) > 5)"""

_LANE = """
lanes AS (SELECT org, dst, hs, count(*) AS n, sum(usd)::DOUBLE AS usd, sum(kg)::DOUBLE AS kg, min(day) AS a, max(day) AS z, list_sort(list(DISTINCT rep)) AS reps FROM t GROUP BY org, dst, hs)"""

_RISK = _PROFILE + """,
ghosts AS (SELECT buyer_id, max(value_usd) AS value_usd, (CASE WHEN max(value_usd) >= 5e6 THEN 70 WHEN max(value_usd) >= 1e6 THEN 55 ELSE 45 END)::BIGINT AS score FROM persona GROUP BY 1 HAVING max(value_usd) >= 5e5),
months AS (SELECT buyer, date_trunc('month', day) AS m, sum(usd)::DOUBLE AS usd FROM t WHERE dir = 'IMPORT' AND buyer IS NOT NULL GROUP BY ALL),
jump AS (
  SELECT buyer, latest, mean_usd, if(spread > 0, round((latest - mean_usd) / spread, 4), 0) AS z, if(mean_usd > 0, round(100 * (latest - mean_usd) / mean_usd, 4), 0) AS pct, list_has_any(['Whale', 'Mid'], kinds) AS large
  FROM (SELECT buyer, arg_max(usd, m) AS latest, round(sum(usd::DECIMAL(18,2)) / count(*), 6) AS mean_usd, round(stddev_samp(usd), 4) AS spread FROM months GROUP BY 1 HAVING count(*) >= 3) a JOIN (SELECT buyer_id AS buyer, list(persona) AS kinds FROM persona GROUP BY 1) b USING (buyer)),
spikes AS (
  SELECT buyer AS buyer_id, CASE WHEN z > 4 OR pct > 500 THEN if(large, 50, 70) WHEN z > 3 OR pct > 300 THEN if(large, 40, 55) ELSE if(large, 30, 45) END::BIGINT AS score FROM jump WHERE z > 2 OR pct > 200),
risk AS (SELECT DISTINCT ON (buyer_id) * FROM (SELECT buyer_id, score, 'GHOST_ENTITY' AS reason FROM ghosts UNION ALL SELECT buyer_id, score, 'VOLUME_SPIKE' FROM spikes) ORDER BY buyer_id, score DESC, reason)"""

_SELLER = """
seller AS (
  SELECT seller AS supplier_id, org AS origin_country, count(*) AS n, sum(usd)::DOUBLE AS value_usd, count(DISTINCT buyer) AS buyers, count(DISTINCT hs) AS codes, min(day) AS first_day, max(day) AS last_day FROM t WHERE dir = 'EXPORT' GROUP BY 1, 2),
pace AS (
  SELECT seller AS supplier_id, org AS origin_country, count(*) AS months, sum(c) / count(*) AS mean_n, coalesce(round(stddev_samp(c), 8), 0) AS spread
  FROM (SELECT seller, org, date_trunc('month', day) AS m, count(*) AS c FROM t WHERE dir = 'EXPORT' AND day BETWEEN '2000-07-01' AND '2001-06-30' GROUP BY 1, 2, 3) GROUP BY 1, 2)"""

_ORACLES: dict[str, tuple[str, str]] = {
    "c01_buyer_profile": (_PROFILE, "SELECT buyer_id, destination_country, first_day, last_day, n, value_usd, qty_kg, if(qty_kg > 0, round(value_usd / qty_kg, 6), NULL) AS mean_price, codes, suppliers, growth_pct, persona FROM persona"),
    "c02_growth": (_PROFILE, "SELECT buyer_id, destination_country, growth_pct FROM persona"),
    "c03_persona": (_PROFILE, "SELECT persona, count(*) AS n FROM persona GROUP BY 1"),
    "c04_exporter_profile": (_SELLER, "SELECT * FROM seller"),
    "c05_stability": (_SELLER, "SELECT s.supplier_id, s.origin_country, if(months IS NULL, 50, round(least(months / 12 * 50, 50) + greatest(0, 50 - 25 * spread / mean_n), 2))::DOUBLE AS stability FROM seller s LEFT JOIN pace USING (supplier_id, origin_country)"),
    "c06_onboarding": (_SELLER, "SELECT supplier_id, origin_country, least(100, 50 + list_sum([if(n >= x, 5, 0) FOR x IN [5, 20, 50, 100]]) + CASE WHEN late <= 30 THEN 20 WHEN late <= 90 THEN 15 WHEN late <= 180 THEN 10 ELSE 0 END + list_sum([if(last_day - first_day >= x, 5, 0) FOR x IN [180, 365]]))::BIGINT AS onboarding FROM (SELECT *, DATE '2001-07-01' - last_day AS late FROM seller) x"),
    "c07_price_corridor": (_CORRIDOR, "SELECT hs AS hs_code_6, dst AS destination_country, y AS year, m AS month, dir AS direction, rep AS reporting_country, n, lo AS least, p25, p50, p75, hi AS most, last_day FROM corr"),
    "c08_lane_stats": (_LANE, "SELECT org AS origin_country, dst AS destination_country, hs AS hs_code_6, n, usd AS value_usd, kg AS qty_kg, round(kg / 20000, 2) AS teu, if(kg > 0, round(usd / kg, 6), NULL) AS mean_price, a AS first_day, z AS last_day, array_to_string(reps, ',') AS reporting_countries FROM lanes"),
    "c09_invoice_outliers": (_CORRIDOR, f"SELECT id AS transaction_id, hs AS hs_code_6, dir AS direction, n, z, if(z < 0, 'UNDER_INVOICE', 'OVER_INVOICE') AS reason_code, score, {_LEVEL} AS risk_level, CASE WHEN n >= 200 THEN 95e-2 WHEN n >= 50 THEN 8e-1 WHEN n >= 10 THEN 5e-1 ELSE 2e-1 END AS confidence FROM odd"),
    "c10_weird_lane": (_LANE, f"SELECT org AS origin_country, dst AS destination_country, hs AS hs_code_6, n, score, {_LEVEL} AS risk_level, 'LANE:' || org || '->' || dst AS scope FROM (SELECT *, (CASE n WHEN 0 THEN 60 WHEN 1 THEN 50 ELSE 40 END)::BIGINT AS score, sum(n) OVER (PARTITION BY hs) AS total FROM lanes) x WHERE n <= 3 AND total >= 50"),
    "c11_ghost_entity": (_RISK, f"SELECT buyer_id, value_usd, score, {_LEVEL} AS risk_level, 7e-1 AS confidence FROM ghosts"),
    "c13_volume_spike": (_RISK, "SELECT buyer_id, score FROM spikes"),
    "c14_mirror_match": (_MIRROR, "SELECT export_id, import_id, buyer AS imported_buyer, score::BIGINT AS score FROM found"),
    "c14_mirror_write_back": (_MIRROR, "SELECT id AS transaction_id, coalesce(t.buyer, f.buyer) AS buyer_id, export_id IS NOT NULL AS inferred FROM t LEFT JOIN found f ON export_id = id WHERE hidden"),
    "c15_mirror_routes": (_MIRROR, "SELECT org AS origin_country, dst AS destination_country, count(*) AS n FROM t WHERE id IN (SELECT export_id FROM found) GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 5"),
    "j12_mirror_candidates": (_MIRROR, "SELECT export_id, import_id, lag_days, score FROM cand"),
    "w10_best_and_second": (_MIRROR, "SELECT export_id, max(score) AS best, list_sort(list(score), 'DESC')[2] AS second FROM cand GROUP BY 1"),
    "c25_risk_with_names": (_RISK, f"SELECT buyer_id, (SELECT c_name FROM customer WHERE c_custkey = buyer_id) AS c_name, score, {_LEVEL} AS risk_level, reason AS reason_code FROM risk"),
    "c22_country_hs_month": (_CORRIDOR, "SELECT t.rep AS reporting_country, t.dir AS direction, t.hs AS hs_code_6, year(t.day) AS year, month(t.day) AS month, count(*) AS shipments, sum(t.usd)::DOUBLE AS value_usd, sum(t.kg)::DOUBLE AS qty_kg, len(list_filter(list(DISTINCT t.buyer), lambda b: b IS NOT NULL)) AS buyers, count(DISTINCT t.seller) AS suppliers, count(*) FILTER (t.id IN (SELECT id FROM odd WHERE score >= 60)) AS risky_shipments, count(DISTINCT t.buyer) FILTER (t.id IN (SELECT id FROM odd WHERE score >= 60)) AS risky_buyers FROM t GROUP BY 1, 2, 3, 4, 5"),
    "b05_risk_top_shipments": (_CORRIDOR, "SELECT id AS transaction_id, score, hs AS hs_code_6, usd::DOUBLE AS value_usd FROM odd ORDER BY score DESC, usd DESC, id LIMIT 50"),
    "b06_risk_top_buyers": (_RISK, "SELECT buyer_id, any_value(score) AS score, count(DISTINCT hs) AS codes, sum(usd)::DOUBLE AS value_usd FROM risk LEFT JOIN t ON t.buyer = buyer_id GROUP BY 1 ORDER BY 2 DESC, 4 DESC, 1 LIMIT 50"),
    "b08_country_hs_summary": ("", "SELECT rep AS reporting_country, hs AS hs_code_6, count(*) AS shipments, len(list(DISTINCT buyer) FILTER (buyer IS NOT NULL)) AS buyers, len(list(DISTINCT seller)) AS suppliers, sum(usd)::DOUBLE AS value_usd FROM t GROUP BY 1, 2"),
    "b10_full_scan": ("", "SELECT 2 * count(*) AS n, 2 * sum(v::DECIMAL(18,2))::DOUBLE AS value_usd, (SELECT sum(kg) FROM t)::DOUBLE AS qty_kg, count(DISTINCT hs) AS codes, (SELECT count(*) FROM (SELECT org FROM src UNION SELECT dst FROM src)) AS countries FROM src"),
    "q04_trade_history": ("", "SELECT year(day) AS year, month(day) AS month, count(*) AS n, sum(usd)::DOUBLE AS value_usd, sum(kg)::DOUBLE AS qty_kg FROM t WHERE buyer = 7 GROUP BY ALL"),
    "q07_similar_buyers": ("", "SELECT o.buyer AS buyer_id, len(list_intersect(list(DISTINCT o.hs), (SELECT list(DISTINCT hs) FROM t WHERE buyer = 7))) AS shared, sum(o.usd)::DOUBLE AS value_usd FROM t o SEMI JOIN (SELECT hs FROM t WHERE buyer = 7) m ON m.hs = o.hs WHERE o.buyer IS NOT NULL AND o.buyer <> 7 GROUP BY 1 ORDER BY 2 DESC, 3 DESC, 1 LIMIT 10"),
    "q13_risk_summary": (_CORRIDOR + "," + _RISK, f"SELECT 'SHIPMENT' AS entity, {_LEVEL} AS risk_level, count(*) AS n FROM odd GROUP BY 2 UNION ALL SELECT 'BUYER', {_LEVEL}, count(*) FROM risk GROUP BY 2"),
    "q17_stats": ("", "SELECT (SELECT count(*) FROM (SELECT DISTINCT buyer FROM t WHERE buyer IS NOT NULL)) AS buyers, count(DISTINCT seller) AS suppliers, count(DISTINCT hs) AS codes, count(DISTINCT rep) AS countries, count(DISTINCT seller) FILTER (hidden) AS hiding_suppliers FROM t"),
    "v02_completeness": ("", "SELECT dir AS direction, round(100 * avg((buyer IS NOT NULL)::INTEGER), 4) AS buyer_pct, round(100 * avg((box IS NOT NULL)::INTEGER), 4) AS container_pct FROM t GROUP BY 1"),
    "v05_recomputed": ("", "SELECT 0::BIGINT AS differing"),
    "v06_shares": ("", "SELECT 0::BIGINT AS off"),
    "v08_personas": (_PROFILE, "SELECT destination_country, persona, count(*) AS n FROM persona GROUP BY 1, 2"),
    "v11_hidden_status": (_MIRROR, "SELECT if(export_id IS NULL, 'UNKNOWN', 'INFERRED') AS status, count(*) AS n FROM t LEFT JOIN found ON export_id = id WHERE hidden GROUP BY 1"),
}

ORACLES: dict[str, str] = {name: re.sub(r"\n\s*", " ", f"WITH {_LEDGER}{',' if views else ''}{views} {text}") for name, (views, text) in _ORACLES.items()}
