"""The fund data model as views over the driver's tables.

Each view is one SELECT in the dialect that Spark SQL and DuckDB share, so the same text defines the DataFrame and the
oracle's common table expression. Views name what they read in braces.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

VIEWS = {
    "funds": """
        SELECT lpad(CAST(s.s_suppkey AS STRING), 6, '0') AS fund_code, s.s_name AS fund_name, r.r_name AS theme,
          CASE WHEN s.s_suppkey % 3 = 0 THEN 'index' ELSE 'active' END AS style, n.n_name AS custodian,
          CONCAT('Company ', CAST(s.s_suppkey % 7 AS STRING)) AS company,
          DATE '2000-01-01' + CAST(s.s_suppkey AS INT) AS established
        FROM {supplier} s JOIN {nation} n ON s.s_nationkey = n.n_nationkey JOIN {region} r ON n.n_regionkey = r.r_regionkey""",
    "share_classes": """
        SELECT CONCAT('1', lpad(CAST(s_suppkey AS STRING), 5, '0')) AS share_code, lpad(CAST(s_suppkey AS STRING), 6, '0') AS fund_code, 'A' AS share_class FROM {supplier}
        UNION ALL
        SELECT CONCAT('2', lpad(CAST(s_suppkey AS STRING), 5, '0')), lpad(CAST(s_suppkey AS STRING), 6, '0'), 'C' FROM {supplier}""",
    "fees": """
        SELECT share_code, CAST((3 + CAST(fund_code AS INT) % 10) AS DOUBLE) / 1000 AS management_fee,
          CAST((1 + CAST(fund_code AS INT) % 2) AS DOUBLE) / 1000 AS custody_fee,
          CASE WHEN share_class = 'C' THEN CAST((2 + CAST(fund_code AS INT) % 7) AS DOUBLE) / 1000 ELSE 0.0E0 END AS sales_service_fee
        FROM {share_classes}""",
    "purchase_fee_tiers": """
        SELECT share_code, t.tier_no, t.min_amount, t.max_amount, t.rate, t.fixed_fee
        FROM {share_classes} CROSS JOIN (
          SELECT 1 AS tier_no, 0.0E0 AS min_amount, 1000000.0E0 AS max_amount, 0.015E0 AS rate, CAST(NULL AS DOUBLE) AS fixed_fee
          UNION ALL SELECT 2, 1000000.0E0, CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), 1000.0E0) t
        WHERE share_class = 'A'""",
    "redemption_fee_tiers": """
        SELECT share_code, t.tier_no, t.min_days, t.max_days, t.rate
        FROM {share_classes} CROSS JOIN (
          SELECT 1 AS tier_no, 0 AS min_days, 7 AS max_days, 0.015E0 AS rate
          UNION ALL SELECT 2, 7, 30, 0.0075E0 UNION ALL SELECT 3, 30, CAST(NULL AS INT), 0.0E0) t""",
    "nav_daily": """
        SELECT lpad(CAST(user_id AS STRING), 6, '0') AS share_code, CAST(ts AS DATE) AS nav_date,
          floor((1 + avg(value) / 1000) * 10000 + 0.5000001) / 10000.0E0 AS unit_nav
        FROM {events} GROUP BY user_id, CAST(ts AS DATE)""",
    "dividends": """
        SELECT lpad(CAST(user_id AS STRING), 6, '0') AS share_code, CAST(ts AS DATE) AS ex_date,
          round(max(value) / 10000, 6) AS cash_per_unit
        FROM {events} WHERE event_type = 'purchase' AND value > 150 GROUP BY user_id, CAST(ts AS DATE)""",
    "holdings": """
        SELECT fund_code, report_period, stock_code, amount / sum(amount) OVER (PARTITION BY fund_code, report_period) AS weight,
          row_number() OVER (PARTITION BY fund_code, report_period ORDER BY amount DESC, stock_code) AS rank_no
        FROM (SELECT lpad(CAST(l_suppkey AS STRING), 6, '0') AS fund_code,
            CONCAT(CAST(year(l_shipdate) AS STRING), 'Q', CAST(quarter(l_shipdate) AS STRING)) AS report_period,
            lpad(CAST(l_partkey AS STRING), 6, '0') AS stock_code, CAST(sum(CAST(l_extendedprice AS DECIMAL(18, 2))) AS DOUBLE) AS amount
          FROM {lineitem} GROUP BY l_suppkey, year(l_shipdate), quarter(l_shipdate), l_partkey) x""",
    "holdings_top10": "SELECT fund_code, report_period, stock_code, weight, rank_no FROM {holdings} WHERE rank_no <= 10",
    "fund_scale": """
        SELECT lpad(CAST(l_suppkey AS STRING), 6, '0') AS fund_code,
          CONCAT(CAST(year(l_shipdate) AS STRING), 'Q', CAST(quarter(l_shipdate) AS STRING)) AS report_period,
          CAST(sum(CAST(l_extendedprice AS DECIMAL(18, 2))) AS DOUBLE) AS net_assets
        FROM {lineitem} GROUP BY l_suppkey, year(l_shipdate), quarter(l_shipdate)""",
    "tenures": """
        SELECT fund_code, manager_name, start_date, CASE WHEN last_date < (SELECT max(CAST(o_orderdate AS DATE)) FROM {orders}) THEN last_date END AS end_date
        FROM (SELECT lpad(CAST(o_custkey % 10 AS STRING), 6, '0') AS fund_code, CONCAT('M', CAST(o_custkey AS STRING)) AS manager_name,
            min(CAST(o_orderdate AS DATE)) AS start_date, max(CAST(o_orderdate AS DATE)) AS last_date FROM {orders} GROUP BY o_custkey) x""",
    "managers": """
        SELECT CONCAT('M', CAST(o_custkey AS STRING)) AS manager_name, CAST(sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS DOUBLE) AS total_aum
        FROM {orders} GROUP BY o_custkey""",
    "trading_days": "SELECT DISTINCT CAST(ts AS DATE) AS day FROM {events} WHERE dayofweek(CAST(ts AS DATE)) NOT IN ({sunday}, {saturday})",
    "nav_trading": "SELECT share_code, nav_date, unit_nav FROM {nav_daily} WHERE dayofweek(nav_date) NOT IN ({sunday}, {saturday})",
    "period_returns": """
        SELECT share_code, '1m' AS period, round(max(CASE WHEN k = n THEN unit_nav END) / max(CASE WHEN k = 1 THEN unit_nav END) - 1, 6) AS ret
        FROM (SELECT share_code, unit_nav, row_number() OVER (PARTITION BY share_code ORDER BY nav_date) AS k, count(*) OVER (PARTITION BY share_code) AS n FROM {nav_daily}) x
        GROUP BY share_code""",
}
#: Where the dialects differ: the number of Sunday and Saturday.
_SPARK, _DUCKDB = {"sunday": "1", "saturday": "7"}, {"sunday": "0", "saturday": "6"}


def names(sql: str) -> list[str]:
    return [n for n in dict.fromkeys(re.findall(r"\{(\w+)\}", sql)) if n not in _SPARK]


def run(spark: SparkSession, sf_dir: str, sql: str, **known: DataFrame) -> DataFrame:
    """A query over views and tables named in braces, as a DataFrame."""
    for name in names(sql):
        if name not in known:
            known[name] = run(spark, sf_dir, VIEWS[name], **known) if name in VIEWS else spark.read.parquet(f"{sf_dir}/{name}.parquet")
    used = {n: known[n] for n in names(sql)}
    for key, value in _SPARK.items():
        sql = sql.replace("{" + key + "}", value)
    return spark.sql(sql, **used)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return run(spark, sf_dir, "SELECT * FROM {" + name + "}")


def oracle(sql: str, **more: str) -> str:
    """The same query for DuckDB, its views as common table expressions; ``more`` defines further ones."""
    parts: dict[str, str] = {}

    def need(text: str) -> None:
        for name in names(text):
            if name in more or name in VIEWS:
                need(more.get(name) or VIEWS[name])
                parts.setdefault(name, more.get(name) or VIEWS[name])

    def plain(text: str) -> str:
        for key, value in _DUCKDB.items():
            text = text.replace("{" + key + "}", value)
        return re.sub(r"\{(\w+)\}", r"\1", text)

    need(sql)
    head = ", ".join(f"{name} AS ({plain(text)})" for name, text in parts.items())
    return (f"WITH {head} " if head else "") + plain(sql)
