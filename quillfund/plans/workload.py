"""The analytical SQL workload: 24 queries over the star schema, each bounded by what it asks for."""

from __future__ import annotations

from quillfund.plans.views import oracle, run

SQL = {
    "q1_funds_holding_two_stocks": "SELECT f.fund_name FROM {funds} f WHERE f.fund_code IN (SELECT fund_code FROM {holdings} WHERE stock_code = '000001') AND f.fund_code IN (SELECT fund_code FROM {holdings} WHERE stock_code = '000002')",
    "q2_funds_with_a_stock": "SELECT count(DISTINCT fund_code) AS n_funds FROM {holdings_top10} WHERE stock_code = '000007'",
    "q3_lowest_management_fee": "SELECT f.fund_name, e.management_fee FROM {funds} f JOIN {share_classes} s ON s.fund_code = f.fund_code AND s.share_class = 'A' JOIN {fees} e ON e.share_code = s.share_code WHERE e.management_fee = (SELECT min(e2.management_fee) FROM {fees} e2 JOIN {share_classes} s2 ON s2.share_code = e2.share_code AND s2.share_class = 'A')",
    "q4_largest_of_a_theme": "SELECT f.fund_name, s.net_assets FROM {fund_scale} s JOIN {funds} f ON f.fund_code = s.fund_code WHERE f.theme = 'ASIA' AND s.report_period = '1997Q2' ORDER BY s.net_assets DESC, f.fund_name LIMIT 1",
    "q5_dear_c_shares": "SELECT count(*) AS n_shares FROM {fees} e JOIN {share_classes} s ON s.share_code = e.share_code WHERE s.share_class = 'C' AND e.sales_service_fee >= 0.006",
    "q6_assets_of_a_theme": "SELECT round(sum(s.net_assets), 2) AS net_assets FROM {fund_scale} s JOIN {funds} f ON f.fund_code = s.fund_code WHERE f.theme = 'EUROPE' AND s.report_period = '1997Q2'",
    "q7_return_of_a_share": "SELECT ret FROM {period_returns} WHERE share_code = '000003' AND period = '1m'",
    "q8_best_return_of_a_theme": "SELECT f.fund_name, p.ret FROM {period_returns} p JOIN {funds} f ON f.fund_code = p.share_code WHERE f.theme = 'AFRICA' AND p.period = '1m' ORDER BY p.ret DESC, f.fund_name LIMIT 1",
    "q9_dividends_of_a_year": "SELECT round(sum(cash_per_unit), 6) AS cash FROM {dividends} WHERE share_code = '000003' AND ex_date BETWEEN DATE '2024-01-01' AND DATE '2024-12-31'",
    "q10_funds_of_a_custodian": "SELECT count(*) AS n_funds FROM {funds} WHERE custodian = 'NATION_3'",
    "q11_largest_growth": "SELECT f.fund_name, round(b.net_assets - a.net_assets, 2) AS growth FROM {fund_scale} a JOIN {fund_scale} b ON a.fund_code = b.fund_code JOIN {funds} f ON f.fund_code = a.fund_code WHERE a.report_period = '1997Q1' AND b.report_period = '1997Q2' ORDER BY b.net_assets - a.net_assets DESC, f.fund_name LIMIT 1",
    "q12_oldest_fund": "SELECT fund_name, established FROM {funds} ORDER BY established, fund_name LIMIT 1",
    "q13_highest_nav": "SELECT f.fund_name, n.unit_nav FROM {nav_daily} n JOIN {funds} f ON f.fund_code = n.share_code WHERE n.nav_date = DATE '2024-01-15' ORDER BY n.unit_nav DESC, f.fund_name LIMIT 1",
    "q14_nav_on_a_date": "SELECT unit_nav FROM {nav_daily} WHERE share_code = '000003' AND nav_date = DATE '2024-01-15'",
    "q15_highest_weight": "SELECT f.fund_name, round(h.weight, 6) AS weight FROM {holdings_top10} h JOIN {funds} f ON f.fund_code = h.fund_code WHERE h.stock_code = '000007' ORDER BY h.weight DESC, f.fund_name LIMIT 1",
    "q16_assets_of_a_manager": "SELECT total_aum FROM {managers} WHERE manager_name = 'M7'",
    "q17_index_funds": "SELECT count(*) AS n_funds FROM {funds} WHERE style = 'index'",
    "q18_funds_losing_a_manager": "SELECT DISTINCT f.fund_name FROM {tenures} t JOIN {funds} f ON f.fund_code = t.fund_code WHERE t.end_date BETWEEN DATE '1998-01-01' AND DATE '1998-12-31'",
    "q19_average_index_fee": "SELECT round(avg(e.management_fee), 9) AS fee FROM {fees} e JOIN {share_classes} s ON s.share_code = e.share_code AND s.share_class = 'A' JOIN {funds} f ON f.fund_code = s.fund_code WHERE f.style = 'index'",
    "q20_stocks_of_three_funds": "SELECT count(*) AS n_stocks FROM (SELECT stock_code FROM {holdings_top10} WHERE report_period = '1997Q2' GROUP BY stock_code HAVING count(DISTINCT fund_code) >= 3) t",
    "q21_large_top_holding": "SELECT f.fund_name FROM {holdings_top10} h JOIN {funds} f ON f.fund_code = h.fund_code WHERE h.report_period = '1997Q2' AND h.rank_no = 1 AND h.weight > 0.10",
    "q22_scale_history": "SELECT report_period, net_assets FROM {fund_scale} WHERE fund_code = '000003' ORDER BY report_period",
    "q23_top_holdings": "SELECT report_period, rank_no, stock_code, round(weight, 6) AS weight FROM {holdings_top10} WHERE fund_code = '000003' AND rank_no <= 3 ORDER BY report_period, rank_no",
    "q24_most_held_stock": "SELECT h.stock_code, count(DISTINCT h.fund_code) AS n_funds FROM {holdings_top10} h JOIN {funds} f ON f.fund_code = h.fund_code WHERE h.report_period = '1997Q2' AND f.theme = 'ASIA' GROUP BY h.stock_code ORDER BY count(DISTINCT h.fund_code) DESC, h.stock_code LIMIT 1",
    "u2_intersection": "SELECT fund_code FROM {holdings} WHERE stock_code = '000001' INTERSECT SELECT fund_code FROM {holdings} WHERE stock_code = '000002'",
    "u4_set_operations": "SELECT fund_code FROM {fund_scale} WHERE report_period = '1997Q1' EXCEPT SELECT fund_code FROM {holdings_top10} WHERE report_period = '1997Q2' AND weight > 0.3 UNION SELECT fund_code FROM {funds} WHERE style = 'index'",
    "w1_top_holdings": "SELECT fund_code, report_period, stock_code, rank_no, round(weight, 6) AS weight FROM {holdings_top10}",
    "f1_nav_as_of": "SELECT share_code, nav_date, unit_nav FROM {nav_daily} WHERE nav_date <= DATE '2024-01-20'",
    "f3_rejection_reasons": "SELECT reason, count(*) AS n FROM (SELECT CASE WHEN f.established IS NULL THEN 'no date' WHEN f.established > DATE '2000-03-01' THEN 'too young' WHEN s.net_assets IS NULL THEN 'no scale' WHEN s.net_assets < 1000000 THEN 'too small' ELSE 'passed' END AS reason FROM {funds} f LEFT JOIN {fund_scale} s ON s.fund_code = f.fund_code AND s.report_period = '1997Q2') t GROUP BY reason",
    "j2_rows_per_fund": "SELECT coalesce(s.fund_code, 'unmatched') AS fund_code, count(*) AS n FROM {nav_daily} n LEFT JOIN {share_classes} s ON s.fund_code = n.share_code AND s.share_class = 'A' GROUP BY coalesce(s.fund_code, 'unmatched')",
    "j3_nav_gaps": "SELECT b.share_code, d.day FROM (SELECT share_code, min(nav_date) AS first_day FROM {nav_daily} GROUP BY share_code) b JOIN {trading_days} d ON d.day >= b.first_day AND d.day <= DATE '2024-01-30' LEFT JOIN {nav_daily} n ON n.share_code = b.share_code AND n.nav_date = d.day WHERE n.share_code IS NULL",
    "j4_nav_off_days": "SELECT n.share_code, n.nav_date FROM {nav_daily} n LEFT JOIN {trading_days} d ON d.day = n.nav_date WHERE d.day IS NULL",
    "j11_managers_on_a_date": "SELECT fund_code, manager_name FROM {tenures} WHERE (start_date IS NULL OR start_date <= DATE '1997-06-30') AND (end_date IS NULL OR end_date > DATE '1997-06-30')",
    "j15_dangling_codes": "SELECT DISTINCT n.share_code FROM {nav_daily} n LEFT JOIN {funds} f ON f.fund_code = n.share_code WHERE f.fund_code IS NULL",
    "j17_latest_nav": "SELECT share_code, nav_date, unit_nav FROM (SELECT share_code, nav_date, unit_nav, row_number() OVER (PARTITION BY share_code ORDER BY nav_date DESC) AS k FROM {nav_daily}) t WHERE k = 1",
    "a3_funds_by_theme_and_style": "SELECT theme, style, count(*) AS n FROM {funds} GROUP BY theme, style",
    "a4_portfolio_violations": "SELECT 'companies' AS rule FROM {funds} HAVING count(DISTINCT company) < 8 UNION ALL SELECT 'codes' FROM {funds} HAVING count(*) > count(DISTINCT fund_code) UNION ALL SELECT 'active share' FROM {funds} HAVING sum(CASE WHEN style = 'active' THEN 1 ELSE 0 END) < 3 * sum(CASE WHEN style = 'index' THEN 1 ELSE 0 END)",
    "d1_key_violations": "SELECT 'nav_daily' AS name, count(*) AS n FROM (SELECT share_code, nav_date FROM {nav_daily} GROUP BY share_code, nav_date HAVING count(*) > 1) a UNION ALL SELECT 'lineitem', count(*) FROM (SELECT l_orderkey, l_linenumber FROM {lineitem} GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1) b",
    "d3_missing_scale": "SELECT f.fund_code FROM {funds} f LEFT JOIN {fund_scale} s ON s.fund_code = f.fund_code AND s.report_period = '1992Q1' WHERE s.fund_code IS NULL",
    "a18_load_windows": "SELECT CAST(ts AS DATE) AS day, count(*) AS n, sum(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END) AS ok, round(sum(CASE WHEN event_type = 'error' THEN 1.0E0 ELSE 0.0E0 END) / count(*), 6) AS error_rate, round(count(*) / 86400.0E0, 6) AS qps, round(avg(value), 6) AS mean_ms FROM {events} GROUP BY CAST(ts AS DATE)",
    "a25_batch_progress": "SELECT user_id % 5 AS batch_id, sum(CASE WHEN event_type IN ('view', 'click') THEN 1 ELSE 0 END) AS pending, sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS ready, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS failed FROM {events} GROUP BY user_id % 5",
    "a28_daily_usage": "SELECT user_id, CAST(ts AS DATE) AS usage_date, count(*) AS calls, CAST(sum(CAST(round(value) AS BIGINT)) AS BIGINT) AS tokens FROM {events} GROUP BY user_id, CAST(ts AS DATE)",
    "w12_quota_replay": "SELECT event_id, user_id, CASE WHEN prior_calls < 3 AND prior_tokens < 300 THEN 1 ELSE 0 END AS admitted FROM (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) - 1 AS prior_calls, coalesce(sum(CAST(round(value) AS BIGINT)) OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prior_tokens FROM {events}) t",
    "w13_recent_rounds": "SELECT conv_id, turn, reply_turn FROM (SELECT conv_id, turn, reply_turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS reply, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS reply_turn FROM {conversations}) m WHERE back <= 8 AND role = 'user' AND reply = 'assistant') p WHERE k <= 2",
    "t4_recent_events": "SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM {events}) t WHERE k <= 5",
    "u5_distinct_pairs": "SELECT DISTINCT least(l_partkey, l_suppkey) AS a, greatest(l_partkey, l_suppkey) AS b FROM {lineitem}",
    "c8_documents_by_type": "SELECT source, lang, count(*) AS n FROM {documents} GROUP BY source, lang",
    "a15_rater_confusion": "SELECT quality, toxic, count(*) AS n FROM {labels} WHERE quality IS NOT NULL AND toxic IS NOT NULL GROUP BY quality, toxic",
    "a7_metric_rollup": "SELECT coalesce(event_type, 'all') AS topic, coalesce(CAST(user_id % 3 AS STRING), 'all') AS style, count(*) AS n, round(avg(value), 6) AS mean_value FROM {events} GROUP BY GROUPING SETS ((), (event_type), (user_id % 3))",
    "a8_answer_rollup": "SELECT coalesce(event_type, 'all') AS answer_type, count(*) AS n, sum(CASE WHEN value > 100 THEN 1 ELSE 0 END) AS n_correct, round(avg(CASE WHEN user_id % 10 = 0 THEN NULL WHEN value > 100 THEN 1.0E0 ELSE 0.0E0 END), 6) AS acc_completed, round(avg(CASE WHEN user_id % 10 = 0 THEN 0.0E0 WHEN value > 100 THEN 1.0E0 ELSE 0.0E0 END), 6) AS acc_all FROM {events} GROUP BY GROUPING SETS ((), (event_type))",
    "a5_last_wins": "SELECT user_id, max_by(event_type, event_id) AS last_type, max(event_id) AS last_id FROM {events} GROUP BY user_id",
    "a2_primary_share": "SELECT fund_code, coalesce(min(CASE WHEN share_class = 'A' THEN share_code END), min(share_code)) AS primary_share, count(*) AS n_classes FROM {share_classes} GROUP BY fund_code",
    "a14_hit_counts": "SELECT event_type, sum(CASE WHEN value >= 200 THEN 1 ELSE 0 END) AS hits, count(*) AS n FROM {events} GROUP BY event_type",
    "a20_repetition_median": "SELECT user_id % 7 AS level, round(median(value), 3) AS median_value FROM {events} WHERE event_type <> 'error' GROUP BY user_id % 7",
    "a26_batch_completion": "SELECT user_id % 5 AS batch_id, CASE WHEN sum(CASE WHEN event_type IN ('view', 'click') AND value > 250 THEN 1 ELSE 0 END) > 0 THEN 'RUNNING' WHEN sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) > 0 THEN 'COMPLETED_WITH_FAILURES' ELSE 'COMPLETED' END AS state FROM {events} GROUP BY user_id % 5",
    "a27_content_version": "SELECT c_mktsegment AS kb_id, CONCAT(CAST(count(*) AS STRING), '-', CAST(max(c_custkey) AS STRING)) AS version FROM {customer} GROUP BY c_mktsegment",
    "a29_stale_documents": "SELECT o_orderkey FROM {orders} WHERE o_orderstatus IN ('P', 'O') AND CAST(o_orderdate AS DATE) < DATE '1996-01-01'",
    "a30_ingest_summary": "SELECT source, count(*) AS documents, sum(n_chars) AS chars, max(n_chars) AS longest FROM {documents} GROUP BY source",
    "a31_dataset_distribution": "SELECT 'lang' AS dim, lang AS name, count(*) AS n FROM {documents} GROUP BY lang UNION ALL SELECT 'source', source, count(*) FROM {documents} GROUP BY source",
    "a33_cost_projection": "SELECT t.topic, round(t.mean_tokens * c.n, 4) AS projected FROM (SELECT event_type AS topic, avg(value) AS mean_tokens FROM {events} WHERE user_id % 2 = 0 GROUP BY event_type) t JOIN (SELECT event_type AS topic, count(*) AS n FROM {events} GROUP BY event_type) c ON c.topic = t.topic",
    "a36_actual_vs_estimate": "SELECT round(sum(CASE WHEN event_type = 'view' THEN value END) / sum(CASE WHEN event_type = 'click' THEN value END), 6) AS ratio, round(sum(value), 2) AS total FROM {events}",
    "f2_universe_funnel": "SELECT count(*) AS n_all, sum(CASE WHEN style = 'active' THEN 1 ELSE 0 END) AS n_type, sum(CASE WHEN style = 'active' AND fund_name NOT LIKE '%7' THEN 1 ELSE 0 END) AS n_name, sum(CASE WHEN style = 'active' AND fund_name NOT LIKE '%7' AND theme <> 'ASIA' THEN 1 ELSE 0 END) AS n_theme FROM {funds}",
    "f5_recent_announcements": "SELECT o_custkey, count(DISTINCT CAST(o_orderdate AS DATE)) AS n_dates FROM {orders} WHERE o_orderpriority LIKE '%URGENT%' AND CAST(o_orderdate AS DATE) BETWEEN DATE '1995-06-30' AND DATE '1997-06-30' GROUP BY o_custkey",
    "f8_evaluable_items": "SELECT sum(CASE WHEN d.doc_id IS NULL THEN 1 ELSE 0 END) AS unknown, sum(CASE WHEN d.doc_id IS NOT NULL AND l.quality = 1 THEN 1 ELSE 0 END) AS evaluable FROM {labels} l LEFT JOIN {documents} d ON d.doc_id = l.doc_id",
    "j1_accumulated_nav": "SELECT n.share_code, n.nav_date, n.unit_nav, d.cash_per_unit FROM {nav_daily} n LEFT JOIN {dividends} d ON d.share_code = n.share_code AND d.ex_date = n.nav_date",
    "j16_run_differences": "SELECT l_orderkey, l_linenumber FROM {lineitem} WHERE l_quantity > 45 EXCEPT SELECT l_orderkey, l_linenumber FROM {lineitem} WHERE l_discount > 0.05",
    "j19_review_marks": "SELECT d.doc_id, CASE WHEN l.doc_id IS NOT NULL THEN 'verified' ELSE 'draft' END AS mark FROM {documents} d LEFT JOIN (SELECT DISTINCT doc_id FROM {labels}) l ON l.doc_id = d.doc_id",
    "u3_extra_documents": "SELECT doc_id FROM {documents} EXCEPT SELECT doc_id FROM {labels}",
    "u6_content_dedup": "SELECT digest, min(doc_id) AS kept, count(*) AS n FROM (SELECT doc_id, md5(text) AS digest FROM {documents}) x GROUP BY digest",
    "w6_tenure_merge": "SELECT o_custkey AS manager, min_by(o_orderpriority, o_orderkey) AS first_source, max_by(CAST(o_orderdate AS DATE), o_orderkey) AS last_date FROM {orders} GROUP BY o_custkey",
    "w15_rank_within_route": "SELECT event_type, event_id, k FROM (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS k FROM {events}) x WHERE k <= 20",
    "w17_general_fee_table": "SELECT l_suppkey, max_by(l_orderkey, l_extendedprice) AS chosen, max(l_extendedprice) AS rate FROM {lineitem} WHERE l_returnflag <> 'R' GROUP BY l_suppkey",
    "w18_first_of_stratum": "SELECT c_mktsegment, c_custkey FROM (SELECT c_mktsegment, c_custkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) AS k FROM {customer}) x WHERE k <= 10",
    "c2_load_counts": "SELECT 'orders' AS name, count(*) AS n FROM {orders} UNION ALL SELECT 'lineitem', count(*) FROM {lineitem} UNION ALL SELECT 'events', count(*) FROM {events}",
    "d2_missing_returns": "SELECT f.fund_code, CASE WHEN n.share_code IS NULL THEN 'missing' ELSE 'date' END AS problem FROM {funds} f LEFT JOIN (SELECT share_code, max(nav_date) AS last_day FROM {nav_daily} GROUP BY share_code) n ON n.share_code = f.fund_code WHERE n.share_code IS NULL OR n.last_day <> DATE '2024-01-30'",
    "d4_dataset_rules": "SELECT 'duplicate text' AS rule, count(*) AS n FROM (SELECT text FROM {benchmark} GROUP BY text HAVING count(*) > 1) a UNION ALL SELECT 'short text', count(*) FROM {benchmark} WHERE length(text) < 100 UNION ALL SELECT 'unknown document', count(*) FROM {labels} l LEFT JOIN {documents} d ON d.doc_id = l.doc_id WHERE d.doc_id IS NULL",
}


def _query(sql: str):
    return lambda spark, sf_dir: run(spark, sf_dir, sql)


QUERIES = {name: _query(sql) for name, sql in SQL.items()}
ORACLE_SQL = {name: oracle(sql) for name, sql in SQL.items()}
