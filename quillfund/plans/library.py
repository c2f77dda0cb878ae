"""Queries that run the library's own functions over the driver's tables, each with SQL written by hand for DuckDB.

The tables hold no requests, ledgers or rankings, so each query first reads rows of that shape from columns of the tables;
the SQL states the expected answer on its own, not through the function.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillfund.functions.columns import base_name, final_event, markdown_table, rescale
from quillfund.operators import answers, documents, operations, quality, retrieval, statistics
from quillfund.plans.views import oracle, run, view
from quillfund.sources import snapshots
from quillfund.streaming import ingest


def rescaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = F.element_at(F.array(*[F.lit(u) for u in ("万股", "万元", "亿元", "股")]), (F.col("l_linenumber") % 4 + 1).cast("int"))
    rows = run(spark, sf_dir, "SELECT l_orderkey, l_linenumber, l_quantity FROM {lineitem}")
    return rows.select("l_orderkey", "l_linenumber", rescale(F.col("l_quantity"), unit).cast("double").alias("amount"))


def final_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event as a log line; lines of errors are cut short and so no JSON."""
    rows = run(spark, sf_dir, "SELECT event_id, event_type, user_id, value FROM {events}")
    line = F.format_string('{"status":"%s","cache_hit":%s,"timings_ms":{"total":%d,"llm":%d},"tools":[{"name":"sql","duration_ms":%d}],"usage":{"tokens":%d}}', "event_type", (F.col("user_id") % 2 == 0).cast("string"), F.col("user_id"), F.col("user_id") * 2, F.col("user_id") + 1, F.col("user_id") * 3)
    told = final_event(F.when(F.col("event_type") == "error", F.substring(line, 1, 20)).otherwise(line))
    rows = rows.select("event_id", told.alias("e"))
    return rows.select("event_id", "e.status", "e.cache_hit", "e.server_total_ms", "e.server_first_token_ms", "e.server_llm_ms", F.get("e.tools", F.lit(0))["duration_ms"].alias("first_tool_ms"), F.col("e.usage")["tokens"].alias("tokens"))


def markdown_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order as a table of its lines; the second column of even orders has no content."""
    rows = run(spark, sf_dir, "SELECT l_orderkey, l_linenumber, l_returnflag, l_linestatus, CAST(l_quantity AS INT) AS q FROM {lineitem}")
    cells = F.array(F.concat("l_returnflag", F.lit(" | "), "l_linestatus"), F.when(F.col("l_orderkey") % 2 == 1, F.col("q").cast("string")), F.col("l_linenumber").cast("string"))
    tables = rows.groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_returnflag", "l_linestatus", "q", cells.alias("cells")))), lambda r: r["cells"]).alias("rows"))
    blank = F.array(F.array(F.lit("  ").cast("string"), F.lit(None).cast("string")))
    return tables.select("l_orderkey", F.md5(markdown_table(F.concat(blank, "rows"))).alias("table_md5"))


def tenures(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = run(spark, sf_dir, "SELECT o_custkey % 40 AS fund_code, o_custkey % 7 AS manager_name, o_orderkey AS ord, o_orderpriority AS source, CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderdate AS DATE) END AS start_date, CASE WHEN o_orderkey % 3 = 1 THEN CAST(o_orderdate AS DATE) END AS end_date FROM {orders}")
    return quality.merge_tenures(rows, "1996-06-30").select("fund_code", "manager_name", "start_date", "end_date", F.array_join("sources", ",").alias("sources"))


def continuations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = run(spark, sf_dir, "SELECT doc, row_no, array(CASE WHEN row_no % 3 = 1 THEN l_returnflag ELSE '' END, l_linestatus, CAST(l_partkey AS STRING)) AS cells FROM (SELECT l_orderkey AS doc, l_returnflag, l_linestatus, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_returnflag, l_linestatus) AS row_no FROM {lineitem}) x")
    return quality.join_continuations(rows).select("doc", "island", F.array_join("cells", "|").alias("cells"))


def managers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The managers of a fund's tenures against those that began before a date."""
    rows = run(spark, sf_dir, "SELECT o_custkey % 90 AS fund_code, CONCAT('M', CAST(o_orderkey % 5 AS STRING)) AS manager_name, CAST(o_orderdate AS DATE) AS day FROM {orders}")
    found = quality.compare_managers(rows, rows.where("day < DATE '1994-01-01'"))
    return found.select("fund_code", F.array_join("left_names", ",").alias("left_names"), F.array_join("right_names", ",").alias("right_names"), "same")


def returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = run(spark, sf_dir, "SELECT share_code, period, ret FROM {period_returns}")
    own = rows.select("share_code", "period", F.col("ret").alias("reinvest"), (F.col("ret") + 0.00005).alias("unit"), (F.col("ret") - 0.0002).alias("chain"))
    return quality.compare_returns(own, rows).select("basis", "n", F.round("largest", 6).alias("largest"), "within")


def fees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshot fees against stated ones, of which every fourth management fee is another."""
    held = run(spark, sf_dir, "SELECT s.fund_code, s.share_class, e.management_fee, e.custody_fee, e.sales_service_fee FROM {fees} e JOIN {share_classes} s ON s.share_code = e.share_code")
    stated = run(spark, sf_dir, "SELECT fund_code, 'management_fee' AS kind, CAST((3 + CAST(fund_code AS INT) % 10) AS DOUBLE) / 1000 + CASE WHEN CAST(fund_code AS INT) % 4 = 0 THEN 0.001E0 ELSE 0.0E0 END AS rate FROM {funds} UNION ALL SELECT fund_code, 'sales_service_fee', 0.005E0 FROM {funds}")
    return quality.compare_fees(held, stated)


def missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    specs = spark.createDataFrame([("annual",), ("quarterly",)], "spec string")
    found = run(spark, sf_dir, "SELECT fund_code, 'annual' AS spec, CASE WHEN CAST(fund_code AS INT) % 3 = 0 THEN 'http' ELSE 'ok' END AS status, CAST(fund_code AS INT) % 5 > 0 AS extractable FROM {funds} WHERE CAST(fund_code AS INT) % 2 = 0")
    return quality.missing_documents(run(spark, sf_dir, "SELECT fund_code FROM {funds}"), specs, found)


def batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = run(spark, sf_dir, "SELECT user_id AS batch_id, CASE WHEN event_type = 'error' THEN 'FAILED' WHEN event_type = 'click' THEN 'SKIPPED' WHEN value > 150 AND user_id % 2 = 0 THEN 'PENDING' WHEN value > 100 AND user_id % 2 = 0 THEN 'SENT' ELSE 'SUCCEEDED' END AS status FROM {events}")
    return ingest.batch_states(rows)


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event delivers a document: its user's, with the text of its type."""
    requests = run(spark, sf_dir, "SELECT event_id AS task_id, user_id AS doc_id, event_type AS sha256 FROM {events}")
    users = run(spark, sf_dir, "SELECT DISTINCT user_id AS doc_id FROM {events}")
    ready = users.where("doc_id % 3 = 0").select("doc_id", F.lit("view").alias("sha256"), (F.col("doc_id") % 2 == 0).alias("complete"))
    manifest = users.where("doc_id % 5 = 0").select("doc_id", F.lit("click").alias("sha256"))
    return ingest.ingest_decisions(requests, ready, manifest).select("task_id", "action")


def _ranked(spark: SparkSession, sf_dir: str, order: str, route_no: int, most: int) -> DataFrame:
    rows = run(spark, sf_dir, "SELECT user_id AS query_id, event_id AS chunk_id, value AS score, ts FROM {events}")
    w = Window.partitionBy("query_id").orderBy(F.desc(order), "chunk_id")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).select("query_id", "chunk_id", "score", "rank", F.lit(route_no).alias("route_no"))


def fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = _ranked(spark, sf_dir, "score", 0, 20).unionByName(_ranked(spark, sf_dir, "ts", 1, 20))
    return retrieval.rrf(both, 60, 10).select("query_id", "chunk_id", F.round("score", 9).alias("score"), "rank")


def reranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    pool = _ranked(spark, sf_dir, "score", 0, 20)
    scores = pool.where("chunk_id % 2 = 0").select("query_id", "chunk_id", (F.col("chunk_id") % 7).cast("double").alias("rerank_score"))
    return retrieval.rerank(pool, scores, 5).select("query_id", "chunk_id", "rank")


def scoped(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = run(spark, sf_dir, "SELECT doc_id, lang AS kb_id, source AS owner_id FROM {documents}")
    return retrieval.in_scope(rows, rows.where("doc_id % 97 = 5").select("kb_id", "owner_id")).select("doc_id")


def united(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = run(spark, sf_dir, "SELECT user_id AS query_id, event_id AS chunk_id, value AS score FROM {events}")
    return retrieval.union_hits(rows.where("chunk_id % 2 = 0"), rows.where("chunk_id % 3 = 0"), 10).select("query_id", "chunk_id", "origin", "rank")


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = run(spark, sf_dir, "SELECT user_id, count(*) AS n, sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) AS k FROM {events} GROUP BY user_id")
    ci = statistics.wilson(F.col("k"), F.col("n"))
    return rows.select("user_id", statistics.rate(F.col("k"), F.col("n")).alias("share"), F.round(ci["low"], 6).alias("low"), F.round(ci["high"], 6).alias("high"))


def threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = run(spark, sf_dir, "SELECT CASE WHEN event_type = 'purchase' THEN 'same' ELSE 'other' END AS label, CASE WHEN event_type = 'click' THEN 'hard_negative' ELSE 'unrelated' END AS category, CASE WHEN event_type = 'click' THEN 0.5E0 + (user_id % 60) / 200.0E0 ELSE 0.9E0 END AS sim, user_id % 2 = 0 AS guard_ok FROM {events}")
    return statistics.select_threshold(statistics.sweep(rows))


def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The suppliers of nations as results, against gold answers that are right for some nations only."""
    results = run(spark, sf_dir, "SELECT n_nationkey AS query_id, CASE WHEN n_nationkey % 4 < 2 THEN CAST(count(*) AS STRING) ELSE min(s_name) END AS first FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey WHERE n_nationkey % 4 <> 3 GROUP BY n_nationkey UNION ALL SELECT n_nationkey, s_name FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey WHERE n_nationkey % 4 = 3")
    items = run(spark, sf_dir, "SELECT n.n_nationkey AS query_id, CASE n.n_nationkey % 4 WHEN 0 THEN 'numeric' WHEN 1 THEN 'text' WHEN 2 THEN 'entity' ELSE 'list' END AS answer_type, CASE WHEN n.n_nationkey % 4 = 0 THEN 0.5E0 END AS tolerance, count(s.s_suppkey) AS c, min(s.s_name) AS least, collect_list(s.s_name) AS names FROM {nation} n LEFT JOIN {supplier} s ON s.s_nationkey = n.n_nationkey GROUP BY n.n_nationkey")
    off = F.col("query_id") % 8 >= 4
    told = F.when(F.col("answer_type") == "numeric", F.array((F.col("c") + F.when(off, 1).otherwise(0)).cast("string"))).when(F.col("answer_type") == "entity", F.array(F.when(off, F.lit("nobody")).otherwise(F.col("least")))).when(F.col("answer_type") == "list", F.when(off, F.array_append("names", "one more")).otherwise(F.col("names"))).otherwise(F.array().cast("array<string>"))
    return statistics.compare_gold(items.select("query_id", "answer_type", told.alias("gold"), "tolerance"), results)


def boilerplate_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six lines of a document are a page; a digit's value does not tell lines apart."""
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.posexplode(F.split("text", "\n")).alias("k", "text"))
    rows = rows.select("doc_id", F.floor(F.col("k") / 6).alias("page"), (F.col("k") % 6).alias("line_no"), "text")
    return documents.boilerplate(rows).select("doc_id", F.md5("shape").alias("shape_md5"))


def gap_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.nav_gaps(view(spark, sf_dir, "nav_daily"), view(spark, sf_dir, "trading_days"), "2024-01-30")


def share_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares named after one of twenty funds of their theme; the A shares of every third fund have no letter."""
    shares = run(spark, sf_dir, "SELECT f.theme, s.share_code, CONCAT('fund ', CAST(CAST(f.fund_code AS INT) % 20 AS STRING), CASE WHEN s.share_class = 'A' AND CAST(f.fund_code AS INT) % 3 = 0 THEN '' ELSE s.share_class END) AS share_name FROM {share_classes} s JOIN {funds} f ON f.fund_code = s.fund_code")
    codes = F.array_join(F.transform(F.map_entries("codes"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return quality.share_groups(shares.withColumn("base", base_name(F.col("share_name")))).select("theme", "base", codes.alias("codes"), F.col("primary").alias("primary_share"))


def ranking_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return operations.run_differences(_ranked(spark, sf_dir, "score", 0, 10), _ranked(spark, sf_dir, "ts", 1, 10))


def flag_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flags of an order's large lines as expected ones, those of its discounted lines as actual ones."""
    rows = run(spark, sf_dir, "SELECT l_orderkey, collect_set(CASE WHEN l_quantity > 25 THEN flag END) AS expected, collect_set(CASE WHEN l_discount > 0.05 THEN flag END) AS actual FROM (SELECT *, CONCAT(l_returnflag, l_linestatus) AS flag FROM {lineitem}) x GROUP BY l_orderkey")
    both = operations.extra_and_missing(F.col("expected"), F.col("actual"))
    return rows.select("l_orderkey", F.array_join(both["extra"], ",").alias("extra"), F.array_join(both["missing"], ",").alias("missing"))


def medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two metrics of each event type; the second is null for every fifth user."""
    rows = run(spark, sf_dir, "SELECT event_type, user_id % 7 AS level, value AS total_ms, CASE WHEN user_id % 5 > 0 THEN value * 2 END AS first_ms FROM {events}")
    return operations.repetition_median(rows, ["event_type", "level"], ["total_ms", "first_ms"])


def merged_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored usage knows the even events only, fresh usage all events of two thirds of the users."""
    calls = run(spark, sf_dir, "SELECT event_id, user_id, ts, CAST(round(value) AS BIGINT) AS tokens FROM {events}")
    return ingest.merge_usage(ingest.daily_usage(calls.where("event_id % 2 = 0")), ingest.daily_usage(calls.where("user_id % 3 <> 0")))


def upserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order's lines are its chunks; every third order is delivered again as one chunk."""
    stored = run(spark, sf_dir, "SELECT l_orderkey AS doc_id, l_linenumber AS chunk_no, l_returnflag AS text FROM {lineitem}")
    fresh = run(spark, sf_dir, "SELECT o_orderkey AS doc_id, CAST(0 AS BIGINT) AS chunk_no, o_orderpriority AS text FROM {orders} WHERE o_orderkey % 3 = 0")
    return documents.upsert(stored, fresh)


def key_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = run(spark, sf_dir, "SELECT CASE WHEN o_orderkey % 500 > 0 THEN o_custkey END AS custkey, CAST(o_orderdate AS DATE) AS day FROM {orders}")
    return snapshots.key_violations(rows, ["custkey", "day"])


def promoted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as reviews of documents, of which every fourth is no item; reviews without an item have no mark."""
    drafts = run(spark, sf_dir, "SELECT doc_id AS id FROM {documents} WHERE doc_id % 4 <> 1")
    items, orphans = answers.promote_reviewed(drafts, run(spark, sf_dir, "SELECT doc_id AS id FROM {labels}"))
    return items.select("id", "verified").unionByName(orphans.select("id", F.lit(None).cast("boolean").alias("verified")))


def active(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The managers of each fund on the first day of every month with orders."""
    asked = run(spark, sf_dir, "SELECT DISTINCT lpad(CAST(o_custkey % 10 AS STRING), 6, '0') AS fund_code, trunc(CAST(o_orderdate AS DATE), 'month') AS on FROM {orders}")
    held = view(spark, sf_dir, "tenures").withColumn("start_date", F.when(F.substring("manager_name", -1, 1) != "3", F.col("start_date")))
    return quality.active_managers(asked, held).select("fund_code", "on", "manager_name")


QUERIES = {
    "j11_active_managers": active,
    "j3_gap_days": gap_days, "a2_share_groups": share_groups, "j16_ranking_differences": ranking_differences, "u3_flag_sets": flag_sets, "a20_medians": medians, "a28_merged_usage": merged_usage,
    "c7_upsert": upserted, "d1_keys": key_violations, "j19_promoted": promoted,
    "p11_rescale": rescaled, "p33_final_events": final_events, "x8_markdown_tables": markdown_tables, "w6_tenures": tenures, "w8_continuations": continuations,
    "j6_managers": managers, "j7_period_returns": returns, "j12_fees": fees, "d6_missing_documents": missing, "r5_batch_states": batches, "r2_ingest_decisions": decisions,
    "x15_rrf": fused, "x17_rerank": reranked, "f6_scope": scoped, "u1_union_hits": united, "a10_intervals": intervals, "a12_threshold": threshold, "x32_gold_results": gold, "a6_boilerplate": boilerplate_lines,
}
ORACLE_SQL = {
    "j11_active_managers": oracle("""
        SELECT r.fund_code, r."on", t.manager_name FROM (SELECT DISTINCT lpad(CAST(o_custkey % 10 AS STRING), 6, '0') AS fund_code, CAST(date_trunc('month', CAST(o_orderdate AS DATE)) AS DATE) AS "on" FROM {orders}) r
          JOIN {tenures} t ON t.fund_code = r.fund_code AND (right(t.manager_name, 1) = '3' OR t.start_date <= r."on") AND (t.end_date IS NULL OR t.end_date > r."on")"""),
    "j3_gap_days": oracle("""
        SELECT b.share_code, d.day, d.day > b.first + INTERVAL 3 MONTH AS late FROM (SELECT share_code, min(nav_date) AS first FROM {nav_daily} GROUP BY share_code) b JOIN {trading_days} d ON d.day >= b.first AND d.day <= DATE '2024-01-30'
        WHERE NOT EXISTS (SELECT 1 FROM {nav_daily} n WHERE n.share_code = b.share_code AND n.nav_date = d.day)"""),
    "a2_share_groups": """
        WITH s AS (SELECT r_name AS theme, concat('fund ', s_suppkey % 20) AS base, CASE WHEN c = 'C' THEN c WHEN s_suppkey % 3 = 0 THEN '' ELSE c END AS class, concat(CASE c WHEN 'A' THEN '1' ELSE '2' END, lpad(CAST(s_suppkey AS VARCHAR), 5, '0')) AS code
            FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey CROSS JOIN (SELECT 'A' AS c UNION ALL SELECT 'C') x),
          m AS (SELECT theme, base, class, min(code) AS code FROM s GROUP BY ALL)
        SELECT theme, base, string_agg(concat(class, '=', code), ';' ORDER BY class) AS codes, coalesce(min(code) FILTER (class = 'A'), min(code) FILTER (class = ''), min(code)) AS primary_share FROM m GROUP BY theme, base""",
    "j16_ranking_differences": """
        WITH a AS (SELECT user_id AS q, event_id AS c, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS k FROM events), b AS (SELECT user_id AS q, event_id AS c, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS k FROM events)
        SELECT a.q AS query_id, a.k AS rank, a.c AS chunk_id, b.c AS other FROM a JOIN b ON b.q = a.q AND b.k = a.k WHERE a.k <= 10 AND a.c <> b.c""",
    "u3_flag_sets": """
        SELECT l_orderkey, coalesce(string_agg(flag, ',' ORDER BY flag) FILTER (cheap AND NOT large), '') AS extra, coalesce(string_agg(flag, ',' ORDER BY flag) FILTER (large AND NOT cheap), '') AS missing
        FROM (SELECT l_orderkey, concat(l_returnflag, l_linestatus) AS flag, bool_or(l_quantity > 25) AS large, bool_or(l_discount > 0.05) AS cheap FROM lineitem GROUP BY 1, 2) x GROUP BY l_orderkey""",
    "a20_medians": "SELECT event_type, user_id % 7 AS level, round(quantile_cont(value, 0.5), 3) AS total_ms, round(quantile_cont(value * 2, 0.5) FILTER (user_id % 5 > 0), 3) AS first_ms FROM events GROUP BY 1, 2",
    "a28_merged_usage": """
        SELECT user_id, usage_date, CASE WHEN user_id % 3 > 0 THEN n ELSE n_even END AS calls, CAST(CASE WHEN user_id % 3 = 0 THEN t_even ELSE greatest(t, coalesce(t_even, t)) END AS BIGINT) AS tokens
        FROM (SELECT user_id, CAST(ts AS DATE) AS usage_date, count(*) AS n, count(*) FILTER (event_id % 2 = 0) AS n_even, sum(CAST(round(value) AS BIGINT)) AS t, sum(CAST(round(value) AS BIGINT)) FILTER (event_id % 2 = 0) AS t_even FROM events GROUP BY 1, 2) x
        WHERE user_id % 3 > 0 OR n_even > 0""",
    "c7_upsert": "SELECT o_orderkey AS doc_id, 0 AS chunk_no, o_orderpriority AS text FROM orders WHERE o_orderkey % 3 = 0 UNION ALL SELECT l_orderkey, l_linenumber, l_returnflag FROM lineitem WHERE l_orderkey % 3 > 0 OR l_orderkey NOT IN (SELECT o_orderkey FROM orders)",
    "d1_keys": "SELECT CASE WHEN o_orderkey % 500 > 0 THEN o_custkey END AS custkey, CAST(o_orderdate AS DATE) AS day, count(*) AS n FROM orders GROUP BY 1, 2 HAVING count(*) > 1 OR min(o_orderkey % 500) = 0",
    "j19_promoted": "SELECT doc_id AS id, doc_id IN (SELECT doc_id FROM labels) AS verified FROM documents WHERE doc_id % 4 <> 1 UNION ALL SELECT doc_id, NULL FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE doc_id % 4 <> 1)",
    "p11_rescale": "SELECT l_orderkey, l_linenumber, l_quantity * CASE l_linenumber % 4 WHEN 2 THEN 1e8 WHEN 3 THEN 1 ELSE 1e4 END AS amount FROM lineitem",
    "p33_final_events": "SELECT event_id, CASE WHEN ok THEN event_type END AS status, CASE WHEN ok THEN user_id % 2 = 0 END AS cache_hit, CASE WHEN ok THEN CAST(user_id AS DOUBLE) END AS server_total_ms, CAST(NULL AS DOUBLE) AS server_first_token_ms, CASE WHEN ok THEN user_id * 2.0 END AS server_llm_ms, CASE WHEN ok THEN user_id + 1.0 END AS first_tool_ms, CASE WHEN ok THEN user_id * 3.0 END AS tokens FROM (SELECT *, event_type <> 'error' AS ok FROM events) e",
    "x8_markdown_tables": r"""
        SELECT l_orderkey, md5(concat(max(line) FILTER (k = 1), chr(10), CASE WHEN l_orderkey % 2 = 1 THEN '|---|---|---|' ELSE '|---|---|' END, coalesce(string_agg(chr(10) || line, '' ORDER BY k) FILTER (k > 1), ''))) AS table_md5
        FROM (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_returnflag, l_linestatus, l_quantity) AS k,
            concat('| ', l_returnflag, '\|', l_linestatus, ' | ', CASE WHEN l_orderkey % 2 = 1 THEN concat(CAST(l_quantity AS INT), ' | ') ELSE '' END, l_linenumber, ' |') AS line FROM lineitem) x GROUP BY l_orderkey""",
    "w6_tenures": """
        WITH e AS (SELECT o_custkey % 40 AS f, o_custkey % 7 AS m, o_orderkey AS k, o_orderpriority AS s, CAST(o_orderdate AS DATE) AS d FROM orders),
          names AS (SELECT f, m, string_agg(s, ',' ORDER BY k) AS sources FROM (SELECT f, m, s, min(k) AS k FROM e GROUP BY f, m, s) x GROUP BY f, m)
        SELECT e.f AS fund_code, e.m AS manager_name, arg_max(d, k) FILTER (k % 3 = 0) AS start_date,
          CASE WHEN arg_max(d, k) FILTER (k % 3 = 1) <= DATE '1996-06-30' THEN arg_max(d, k) FILTER (k % 3 = 1) END AS end_date, any_value(sources) AS sources
        FROM e JOIN names ON names.f = e.f AND names.m = e.m GROUP BY e.f, e.m""",
    "w8_continuations": """
        SELECT doc, island, concat(string_agg(a, '' ORDER BY k), '|', string_agg(b, '' ORDER BY k), '|', string_agg(c, '' ORDER BY k)) AS cells
        FROM (SELECT doc, k, CASE WHEN k % 3 = 1 THEN l_returnflag ELSE '' END AS a, l_linestatus AS b, CAST(l_partkey AS VARCHAR) AS c, (k + 2) // 3 AS island
          FROM (SELECT l_orderkey AS doc, l_returnflag, l_linestatus, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_returnflag, l_linestatus) AS k FROM lineitem) y) x GROUP BY doc, island""",
    "j6_managers": """
        WITH r AS (SELECT DISTINCT o_custkey % 90 AS f, concat('M', o_orderkey % 5) AS m, CAST(o_orderdate AS DATE) < DATE '1994-01-01' AS early FROM orders),
          a AS (SELECT f, string_agg(m, ',' ORDER BY m) AS x FROM (SELECT DISTINCT f, m FROM r) t GROUP BY f), b AS (SELECT f, string_agg(m, ',' ORDER BY m) AS y FROM r WHERE early GROUP BY f)
        SELECT a.f AS fund_code, x AS left_names, y AS right_names, coalesce(x = y, false) AS same FROM a LEFT JOIN b ON b.f = a.f""",
    "j7_period_returns": oracle("SELECT basis, count(*) AS n, off * 100 AS largest, CASE WHEN off > 0.0001 THEN 0 ELSE count(*) END AS within FROM {period_returns} CROSS JOIN (SELECT 'reinvest' AS basis, 0.0 AS off UNION ALL SELECT 'unit', 0.00005 UNION ALL SELECT 'chain', 0.0002) b WHERE ret IS NOT NULL GROUP BY basis, off"),
    "j12_fees": """
        SELECT lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS fund_code, 'management_fee' AS kind, (3 + s_suppkey % 10) / 1000.0 AS fee, (3 + s_suppkey % 10) / 1000.0 + CASE WHEN s_suppkey % 4 = 0 THEN 0.001 ELSE 0 END AS rate, s_suppkey % 4 <> 0 AS same FROM supplier
        UNION ALL SELECT lpad(CAST(s_suppkey AS VARCHAR), 6, '0'), 'sales_service_fee', (2 + s_suppkey % 7) / 1000.0, 0.005, s_suppkey % 7 = 3 FROM supplier""",
    "d6_missing_documents": """
        SELECT lpad(CAST(k AS VARCHAR), 6, '0') AS fund_code, spec, CASE WHEN spec = 'quarterly' OR k % 2 = 1 THEN 'no announcement' WHEN k % 3 = 0 THEN 'failed: http' ELSE 'not extractable' END AS reason
        FROM (SELECT s_suppkey AS k FROM supplier) s CROSS JOIN (SELECT 'annual' AS spec UNION ALL SELECT 'quarterly') t WHERE spec = 'quarterly' OR k % 2 = 1 OR k % 3 = 0 OR k % 5 = 0""",
    "r5_batch_states": """
        SELECT batch_id, pending, succeeded, skipped, failed, CASE WHEN pending > 0 THEN 'RUNNING' WHEN failed > 0 THEN 'COMPLETED_WITH_FAILURES' ELSE 'COMPLETED' END AS state
        FROM (SELECT user_id AS batch_id, count(*) FILTER (open) AS pending, count(*) FILTER (NOT open AND event_type NOT IN ('error', 'click')) AS succeeded, count(*) FILTER (event_type = 'click') AS skipped, count(*) FILTER (event_type = 'error') AS failed
          FROM (SELECT *, event_type NOT IN ('error', 'click') AND value > 100 AND user_id % 2 = 0 AS open FROM events) e GROUP BY user_id) b""",
    "r2_ingest_decisions": """
        SELECT event_id AS task_id, CASE WHEN user_id % 5 = 0 AND event_type <> 'click' THEN 'FAILED' WHEN user_id % 6 = 0 AND event_type = 'view' OR event_id > min(event_id) OVER (PARTITION BY user_id, event_type) THEN 'SKIPPED' ELSE 'INGEST' END AS action FROM events""",
    "x15_rrf": """
        WITH r AS (SELECT user_id AS q, event_id AS c, 0 AS route, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS k FROM events UNION ALL SELECT user_id, event_id, 1, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) FROM events),
          f AS (SELECT q, c, sum(1.0 / (60 + k)) AS s, min(k * 10 + route) AS best FROM r WHERE k <= 20 GROUP BY q, c)
        SELECT q AS query_id, c AS chunk_id, round(s, 9) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(s, 12) DESC, best, c) AS rank FROM f) x WHERE rank <= 10""",
    "x17_rerank": """
        SELECT q AS query_id, c AS chunk_id, rank FROM (SELECT q, c, row_number() OVER (PARTITION BY q ORDER BY CASE WHEN c % 2 = 0 THEN c % 7 END DESC NULLS LAST, k) AS rank
          FROM (SELECT user_id AS q, event_id AS c, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS k FROM events) r WHERE k <= 20) x WHERE rank <= 5""",
    "f6_scope": "SELECT doc_id FROM documents d WHERE EXISTS (SELECT 1 FROM documents s WHERE s.doc_id % 97 = 5 AND s.lang = d.lang AND s.source = d.source)",
    "u1_union_hits": """
        SELECT query_id, chunk_id, origin, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY value DESC, origin DESC, chunk_id) AS rank
          FROM (SELECT user_id AS query_id, event_id AS chunk_id, value, 'public' AS origin FROM events WHERE event_id % 2 = 0 UNION ALL SELECT user_id, event_id, value, 'private' FROM events WHERE event_id % 3 = 0) u) x WHERE rank <= 10""",
    "a10_intervals": """
        SELECT user_id, round(k / n, 4) AS share, round(greatest(0, (p + z2 / (2 * n) - 1.96 * sqrt(p * (1 - p) / n + z2 / (4 * n * n))) / (1 + z2 / n)), 6) AS low, round(least(1, (p + z2 / (2 * n) + 1.96 * sqrt(p * (1 - p) / n + z2 / (4 * n * n))) / (1 + z2 / n)), 6) AS high
        FROM (SELECT user_id, CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (event_type = 'click') AS DOUBLE) AS k, k / n AS p, 3.8416 AS z2 FROM events GROUP BY user_id) e""",
    "a12_threshold": "SELECT 0.5 + (max(user_id % 60) + 1) * 0.005 AS threshold FROM events WHERE event_type = 'click'",
    "x32_gold_results": """
        SELECT k AS query_id, CASE WHEN k % 4 = 3 THEN c WHEN c > 0 THEN 1 ELSE 0 END AS rows,
          CASE WHEN k % 4 = 1 THEN c > 0 WHEN k % 4 = 3 THEN k % 8 < 4 ELSE c > 0 AND k % 8 < 4 END AS correct
        FROM (SELECT n_nationkey AS k, count(s_suppkey) AS c FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_nationkey) x""",
    "a6_boilerplate": r"""
        WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS k FROM documents),
          e AS (SELECT doc_id, k // 6 AS page, regexp_replace(regexp_replace(line, '\s', '', 'g'), '[0-9]', '#', 'g') AS shape, row_number() OVER (PARTITION BY doc_id, k // 6 ORDER BY k) AS a, row_number() OVER (PARTITION BY doc_id, k // 6 ORDER BY k DESC) AS b FROM l)
        SELECT doc_id, md5(shape) AS shape_md5 FROM e JOIN (SELECT doc_id, count(DISTINCT page) AS pages FROM e GROUP BY doc_id HAVING count(DISTINCT page) >= 3) p USING (doc_id)
        WHERE a <= 2 OR b <= 2 GROUP BY doc_id, shape HAVING count(DISTINCT page) >= greatest(3, 0.3 * max(pages))""",
}
