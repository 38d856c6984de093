"""Projections, filters, joins, aggregates, windows, top-k and set operations over the ledger, one plan each."""

from __future__ import annotations

from lanewise.plans.portable import AS_OF

_V = "CAST(sum(value_usd) AS DOUBLE)"

PLANS: dict[str, str] = {
    # projections and predicates
    "p04_date_precedence": "SELECT transaction_id, coalesce(CASE WHEN direction = 'EXPORT' THEN shipment_date END, shipment_date) AS trade_date, year, month FROM ledger",
    "p05_ledger_projection": "SELECT transaction_id, direction, reporting_country, hs_code_6, supplier_id, buyer_id, shipment_date, CAST(qty_kg AS DOUBLE) AS qty_kg, CAST(value_usd AS DOUBLE) AS value_usd FROM ledger",
    "p06_case_bands": "SELECT CASE WHEN value_usd >= 50000 THEN 'HIGH' WHEN value_usd >= 10000 THEN 'MEDIUM' ELSE 'LOW' END AS band, count(*) AS n FROM ledger GROUP BY 1",
    "p07_literals": "SELECT supplier_id, FALSE AS website_present, CAST(NULL AS STRING) AS website_url, count(*) AS n FROM ledger GROUP BY supplier_id",
    "p08_casts": "SELECT transaction_id, CAST(floor(value_usd) AS BIGINT) AS whole_usd, CAST(buyer_id AS STRING) AS buyer_text FROM ledger",
    "f01_in_list": "SELECT reporting_country, count(*) AS n FROM ledger WHERE reporting_country IN ('KENYA', 'INDIA', 'CHINA') AND direction = 'IMPORT' GROUP BY reporting_country",
    "f02_null_tests": "SELECT direction, count(*) AS n, count(CASE WHEN buyer_id IS NULL THEN 1 END) AS without_buyer, count(container_id) AS with_container FROM ledger GROUP BY direction",
    "f03_range": "SELECT count(*) AS n FROM ledger WHERE shipment_date BETWEEN DATE '1996-03-01' AND DATE '1996-03-31' AND qty_kg BETWEEN 10 AND 20",
    "f04_like_upper": "SELECT hs_code_6, count(*) AS n FROM ledger WHERE upper(hs_code_6) LIKE '%O%' GROUP BY hs_code_6",
    "f05_ilike": "SELECT c_custkey, c_name FROM {customer} WHERE c_name ILIKE '%customer#00000001%'",
    "f06_prefix": "SELECT hs_code_6, count(*) AS n FROM ledger WHERE hs_code_6 LIKE 'S%' GROUP BY hs_code_6",
    "f09_tolerance": "SELECT count(*) AS n FROM ledger WHERE abs(CAST(value_usd AS DOUBLE) / CAST(qty_kg AS DOUBLE) - price_per_kg) > 1e-2",
    "f10_hidden_buyer": "SELECT hidden_buyer, buyer_id IS NULL AS buyer_missing, count(*) AS n FROM ledger GROUP BY 1, 2",
    "f12_eligibility": "SELECT direction, count(*) AS n FROM ledger WHERE reporting_country IS NOT NULL AND hs_code_6 IS NOT NULL AND shipment_date IS NOT NULL AND buyer_id IS NOT NULL GROUP BY direction",
    # joins
    "j01_inner_dimension": f"SELECT s_name, count(*) AS n, {_V} AS value_usd FROM ledger JOIN {{supplier}} ON supplier_id = s_suppkey GROUP BY s_name",
    "j02_left_outer": "SELECT c_custkey, c_name, count(transaction_id) AS n FROM {customer} LEFT JOIN ledger ON buyer_id = c_custkey AND direction = 'IMPORT' GROUP BY c_custkey, c_name",
    "j04_corridor_join": "SELECT l.transaction_id, l.price_per_kg, c.n AS sample_size FROM ledger l LEFT JOIN corridor c ON l.hs_code_6 = c.hs_code_6 AND l.destination_country = c.destination_country AND l.year = c.year AND l.month = c.month AND l.direction = c.direction AND l.reporting_country = c.reporting_country WHERE c.n >= 5 AND l.direction = 'EXPORT'",
    "j06_left_null_anti": "SELECT c_custkey FROM {customer} LEFT JOIN {orders} ON o_custkey = c_custkey WHERE o_orderkey IS NULL",
    "j07_not_exists": "SELECT s_suppkey FROM {supplier} s WHERE NOT EXISTS (SELECT 1 FROM {lineitem} l WHERE l.l_suppkey = s.s_suppkey AND l.l_shipdate >= TIMESTAMP '2001-06-01 00:00:00')",
    "j08_not_exists_either": "SELECT c_custkey FROM {customer} c WHERE NOT EXISTS (SELECT 1 FROM {orders} o WHERE o.o_custkey = c.c_custkey) AND NOT EXISTS (SELECT 1 FROM {supplier} s WHERE s.s_suppkey = c.c_custkey)",
    "j09_in_subquery": "SELECT c_custkey, c_name FROM {customer} WHERE c_custkey IN (SELECT buyer_id FROM ledger WHERE hs_code_6 = 'PROMO')",
    "j10_exists": "SELECT s_suppkey FROM {supplier} s WHERE EXISTS (SELECT 1 FROM {lineitem} l JOIN {part} p ON l.l_partkey = p.p_partkey WHERE l.l_suppkey = s.s_suppkey AND p.p_type = 'STANDARD')",
    "j11_shared_codes": "SELECT buyer_id, count(DISTINCT hs_code_6) AS shared FROM ledger WHERE buyer_id <> 1 AND hs_code_6 IN (SELECT hs_code_6 FROM ledger WHERE buyer_id = 1) GROUP BY buyer_id",
    "j12_mirror_candidates": "SELECT export_id, import_id, lag_days, score FROM mirror_candidate",
    "j13_roles_self_join": "SELECT e.hs_code_6, count(*) AS n FROM ledger e JOIN mirror_match m ON e.transaction_id = m.export_id JOIN ledger i ON i.transaction_id = m.import_id GROUP BY e.hs_code_6",
    "j14_conditional_left": "SELECT l.direction, count(*) AS n, count(o.transaction_id) AS flagged FROM ledger l LEFT JOIN (SELECT transaction_id FROM invoice_risk WHERE risk_level = 'CRITICAL') o ON l.transaction_id = o.transaction_id GROUP BY l.direction",
    "j15_full_outer": "SELECT coalesce(e.hs_code_6, i.hs_code_6) AS hs_code_6, coalesce(e.country, i.country) AS country, coalesce(e.n, 0) AS exports, coalesce(i.n, 0) AS imports FROM (SELECT hs_code_6, reporting_country AS country, count(*) AS n FROM ledger WHERE direction = 'EXPORT' AND value_usd > 40000 GROUP BY 1, 2) e FULL OUTER JOIN (SELECT hs_code_6, reporting_country AS country, count(*) AS n FROM ledger WHERE direction = 'IMPORT' AND value_usd > 40000 GROUP BY 1, 2) i ON e.hs_code_6 = i.hs_code_6 AND e.country = i.country",
    "j16_one_row_cross": f"SELECT hs_code_6, {_V} AS value_usd, round({_V} / max(t.total), 6) AS share FROM ledger CROSS JOIN (SELECT {_V} AS total FROM ledger) t GROUP BY hs_code_6",
    "j17_lateral_stats": f"SELECT s_suppkey, s_name, a.n, a.value_usd FROM {{supplier}} LEFT JOIN (SELECT supplier_id, count(*) AS n, {_V} AS value_usd FROM ledger WHERE direction = 'EXPORT' GROUP BY supplier_id) a ON a.supplier_id = s_suppkey",
    "j18_scalar_sum": "SELECT origin_country, hs_code_6, n, total FROM (SELECT origin_country, hs_code_6, count(*) AS n FROM ledger GROUP BY 1, 2) x JOIN (SELECT hs_code_6 AS code, count(*) AS total FROM ledger GROUP BY 1) t ON code = hs_code_6",
    "j19_top_country": f"SELECT hs_code_6, country, value_usd FROM (SELECT hs_code_6, destination_country AS country, {_V} AS value_usd, row_number() OVER (PARTITION BY hs_code_6 ORDER BY sum(value_usd) DESC, destination_country) AS rk FROM ledger GROUP BY 1, 2) x WHERE rk = 1",
    "j20_scalar_subquery": "SELECT (SELECT count(*) FROM ledger WHERE direction = 'EXPORT') AS exports, (SELECT count(DISTINCT buyer_id) FROM ledger) AS buyers",
    # aggregates
    "a01_counts": "SELECT reporting_country, count(*) AS n, count(buyer_id) AS with_buyer, count(container_id) AS with_container FROM ledger GROUP BY reporting_country",
    "a02_sums": f"SELECT hs_code_6, direction, {_V} AS value_usd, round({_V} / count(*), 6) AS mean_usd, CAST(min(value_usd) AS DOUBLE) AS least, CAST(max(value_usd) AS DOUBLE) AS most FROM ledger GROUP BY 1, 2",
    "a03_distinct_counts": "SELECT reporting_country, count(DISTINCT hs_code_6) AS codes, count(DISTINCT buyer_id) AS buyers, count(DISTINCT supplier_id) AS suppliers FROM ledger GROUP BY 1",
    "a05_filtered_aggregates": "SELECT reporting_country, count(*) FILTER (WHERE hidden_buyer) AS hidden, round(CAST(sum(value_usd) FILTER (WHERE qty_kg > 10) AS DOUBLE), 2) AS value_over_10 FROM ledger GROUP BY 1",
    "a06_conditional_distinct": "SELECT hs_code_6, count(DISTINCT CASE WHEN value_usd > 50000 THEN buyer_id END) AS large_buyers FROM ledger GROUP BY 1",
    "a07_indicator_sums": "SELECT year, CAST(sum(CASE WHEN buyer_id IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS missing, CAST(sum(CASE WHEN container_id IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS contained FROM (SELECT year, buyer_id, container_id FROM ledger) x GROUP BY year",
    "a08_guarded_ratio": f"SELECT supplier_id, CASE WHEN sum(qty_kg) > 0 THEN round({_V} / NULLIF(CAST(sum(qty_kg) AS DOUBLE), 0), 6) END AS price FROM ledger GROUP BY 1",
    "a09_percentiles": "SELECT hs_code_6, @at(q; 1) / 10000 AS p25, @at(q; 2) / 10000 AS p50, @at(q; 3) / 10000 AS p75 FROM (SELECT hs_code_6, @quartiles[round(price_per_kg * 10000)] AS q FROM ledger GROUP BY 1) x",
    "a10_stddev": "SELECT supplier_id, round(stddev_samp(CAST(n AS DOUBLE)), 6) AS spread FROM (SELECT supplier_id, year, month, count(*) AS n FROM ledger GROUP BY 1, 2, 3) x GROUP BY 1",
    "a11_two_levels": "SELECT supplier_id, count(*) AS months, max(n) AS most, min(n) AS least FROM (SELECT supplier_id, year, month, count(*) AS n FROM ledger GROUP BY 1, 2, 3) x GROUP BY 1",
    "a12_having": "SELECT buyer_id, count(*) AS n FROM ledger WHERE buyer_id IS NOT NULL GROUP BY buyer_id HAVING count(*) >= 60",
    "a13_distinct_rows": "SELECT DISTINCT buyer_id, destination_country FROM ledger WHERE direction = 'IMPORT'",
    "a14_distinct_lists": "SELECT origin_country, destination_country, hs_code_6, @list(reporting_country) AS countries FROM ledger GROUP BY 1, 2, 3",
    "a15_ranked_lists": f"SELECT buyer_id, max(CASE WHEN rk = 1 THEN hs_code_6 END) AS top_1, max(CASE WHEN rk = 2 THEN hs_code_6 END) AS top_2, max(CASE WHEN rk = 3 THEN hs_code_6 END) AS top_3 FROM (SELECT buyer_id, hs_code_6, row_number() OVER (PARTITION BY buyer_id ORDER BY {_V} DESC, hs_code_6) AS rk FROM ledger WHERE buyer_id IS NOT NULL GROUP BY 1, 2) x GROUP BY 1",
    "a17_histogram_bands": "SELECT CASE WHEN score >= 90 THEN '90-100' WHEN score >= 80 THEN '80-89' WHEN score >= 70 THEN '70-79' ELSE 'below' END AS band, count(*) AS n FROM mirror_candidate GROUP BY 1",
    "a18_histogram_tens": "SELECT CAST(floor(score / 10) * 10 AS BIGINT) AS bucket, count(*) AS n FROM mirror_candidate GROUP BY 1",
    "a19_period_pivot": f"SELECT buyer_id, CAST(coalesce(sum(CASE WHEN shipment_date >= {AS_OF} - INTERVAL '12' MONTH AND shipment_date < {AS_OF} THEN value_usd END), 0) AS DOUBLE) AS current_usd, CAST(coalesce(sum(CASE WHEN shipment_date >= {AS_OF} - INTERVAL '24' MONTH AND shipment_date < {AS_OF} - INTERVAL '12' MONTH THEN value_usd END), 0) AS DOUBLE) AS previous_usd FROM ledger WHERE buyer_id IS NOT NULL GROUP BY 1",
    "a20_global": f"SELECT count(*) AS n, {_V} AS value_usd, min(shipment_date) AS first_day, max(shipment_date) AS last_day FROM ledger",
    "a21_summed_uniques": "SELECT hs_code_6, CAST(sum(buyers) AS BIGINT) AS summed_buyers FROM country_hs_month GROUP BY 1",
    "a23_over_view": "SELECT hs_code_6, CAST(sum(shipments) AS BIGINT) AS shipments, count(DISTINCT reporting_country) AS countries FROM country_hs_month GROUP BY 1",
    # windows
    "w01_rank_of_aggregate": f"SELECT destination_country, buyer_id, rk FROM (SELECT destination_country, buyer_id, row_number() OVER (PARTITION BY destination_country ORDER BY {_V} DESC, buyer_id) AS rk FROM ledger WHERE buyer_id IS NOT NULL GROUP BY 1, 2) x WHERE rk <= 3",
    "w02_share_of_partition": f"SELECT buyer_id, hs_code_6, round(100 * {_V} / CAST(sum(sum(value_usd)) OVER (PARTITION BY buyer_id) AS DOUBLE), 4) AS share_pct FROM ledger WHERE buyer_id IS NOT NULL GROUP BY buyer_id, hs_code_6",
    "w03_share_of_all": "SELECT hs_code_6, round(100 * CAST(count(*) AS DOUBLE) / CAST(sum(count(*)) OVER () AS DOUBLE), 4) AS pct FROM ledger GROUP BY hs_code_6",
    "w04_top_rows": "SELECT reporting_country, transaction_id, rk FROM (SELECT reporting_country, transaction_id, row_number() OVER (PARTITION BY reporting_country ORDER BY value_usd DESC, transaction_id) AS rk FROM ledger) x WHERE rk <= 3",
    "w06_latest_per_key": "SELECT buyer_id, transaction_id, shipment_date FROM (SELECT buyer_id, transaction_id, shipment_date, row_number() OVER (PARTITION BY buyer_id ORDER BY shipment_date DESC, transaction_id) AS rk FROM ledger WHERE buyer_id IS NOT NULL) x WHERE rk = 1",
    "w07_top_origin_per_month": f"SELECT buyer_id, year, month, origin_country FROM (SELECT buyer_id, year, month, origin_country, row_number() OVER (PARTITION BY buyer_id, year, month ORDER BY {_V} DESC, origin_country) AS rk FROM ledger WHERE buyer_id IS NOT NULL GROUP BY 1, 2, 3, 4) x WHERE rk = 1",
    "w09_cohort_max": f"SELECT buyer_id, round(value_usd / most, 6) AS scaled, cohort FROM (SELECT buyer_id, {_V} AS value_usd FROM ledger WHERE buyer_id IS NOT NULL GROUP BY 1) x CROSS JOIN (SELECT max(value_usd) AS most, count(*) AS cohort FROM (SELECT buyer_id, {_V} AS value_usd FROM ledger WHERE buyer_id IS NOT NULL GROUP BY 1) y) t",
    "w10_best_and_second": "SELECT export_id, best, second FROM (SELECT export_id, score AS best, lead(score) OVER (PARTITION BY export_id ORDER BY score DESC, import_id) AS second, row_number() OVER (PARTITION BY export_id ORDER BY score DESC, import_id) AS rk FROM mirror_candidate) x WHERE rk = 1",
    # order, limits and sets
    "o02_nulls_last": "SELECT buyer_id, transaction_id FROM ledger ORDER BY buyer_id DESC NULLS LAST, transaction_id",
    "o03_top_k": "SELECT transaction_id, CAST(value_usd AS DOUBLE) AS value_usd FROM ledger ORDER BY value_usd DESC, transaction_id LIMIT 25",
    "o04_page": "SELECT transaction_id, shipment_date FROM ledger WHERE direction = 'IMPORT' ORDER BY shipment_date DESC, transaction_id LIMIT 20 OFFSET 40",
    "o07_ordinal": "SELECT risk_level, count(*) AS n FROM invoice_risk GROUP BY risk_level ORDER BY CASE risk_level WHEN 'CRITICAL' THEN 1 WHEN 'HIGH' THEN 2 WHEN 'MEDIUM' THEN 3 ELSE 4 END",
    "o08_top_5_per_group": f"SELECT supplier_id, hs_code_6, rk FROM (SELECT supplier_id, hs_code_6, row_number() OVER (PARTITION BY supplier_id ORDER BY {_V} DESC, hs_code_6) AS rk FROM ledger GROUP BY 1, 2) x WHERE rk <= 5",
    "u01_union_all": "SELECT 'ledger' AS layer, count(*) AS n FROM ledger UNION ALL SELECT 'corridor', count(*) FROM corridor UNION ALL SELECT 'lane', count(*) FROM lane",
    "u02_two_roles": "SELECT role, count(DISTINCT id) AS n FROM (SELECT 'BUYER' AS role, buyer_id AS id FROM ledger UNION ALL SELECT 'SUPPLIER', supplier_id FROM ledger) x GROUP BY role",
    "u03_both_roles": "SELECT id FROM (SELECT DISTINCT buyer_id AS id, 'B' AS role FROM ledger WHERE buyer_id IS NOT NULL UNION ALL SELECT DISTINCT supplier_id, 'S' FROM ledger) x GROUP BY id HAVING count(*) = 2",
}

#: A tuple counts as distinct where a part is null; Spark needs a struct for that.
TUPLE_COUNT = ("a04_distinct_tuples", "SELECT buyer_id, count(DISTINCT struct(year, month)) AS months FROM ledger GROUP BY buyer_id", "SELECT buyer_id, count(DISTINCT (year, month)) AS months FROM ledger GROUP BY buyer_id")
