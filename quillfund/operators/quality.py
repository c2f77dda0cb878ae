"""Reconciliation and data-quality outputs over snapshot tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillfund.functions.columns import norm_code, share_class_of
from quillfund.plans.views import oracle, run, view
from quillfund.scratch import written


def nav_gaps(nav: DataFrame, calendar: DataFrame, as_of: str) -> DataFrame:
    """(share_code, day, late): trading days without a NAV from a share's first NAV to ``as_of``; ``late`` after its first
    three months. The calendar is one row a day, so it is small beside the shares."""
    bounds = nav.groupBy("share_code").agg(F.min("nav_date").alias("first"))
    days = calendar.select("day").distinct().where(F.col("day") <= F.to_date(F.lit(as_of)))
    due = bounds.join(F.broadcast(days), F.col("day") >= F.col("first"))
    return due.join(nav.select("share_code", F.col("nav_date").alias("day")).distinct(), ["share_code", "day"], "left_anti").select("share_code", "day", (F.col("day") > F.add_months("first", 3)).alias("late"))


def continuity(nav: DataFrame, calendar: DataFrame, as_of: str) -> DataFrame:
    """Per share: first, last, rows, gap days, late gaps, the first ten gaps, rows on days that are no trading days."""
    gaps = nav_gaps(nav, calendar, as_of).groupBy("share_code").agg(F.count(F.lit(1)).alias("gap_days"), F.count_if("late").alias("late_gaps"), F.array_join(F.slice(F.sort_array(F.collect_list("day")), 1, 10), ";").alias("first_gaps"))
    off = nav.join(calendar.select(F.col("day").alias("nav_date")).distinct(), "nav_date", "left_anti").groupBy("share_code").agg(F.count(F.lit(1)).alias("off_days"))
    rows = nav.groupBy("share_code").agg(F.min("nav_date").alias("first"), F.max("nav_date").alias("last"), F.count(F.lit(1)).alias("n"))
    return rows.join(gaps, "share_code", "left").join(off, "share_code", "left").fillna({"gap_days": 0, "late_gaps": 0, "first_gaps": "", "off_days": 0})


def share_groups(shares: DataFrame) -> DataFrame:
    """Shares by (theme, base name): class to first code, and the primary share (A, else no class, else the least)."""
    rows = shares.withColumn("class", F.coalesce(share_class_of(F.col("share_name")), F.lit("")))
    codes = rows.groupBy("theme", "base", "class").agg(F.min("share_code").alias("code"))
    pick = lambda c: F.min(F.when(F.col("class") == c, F.col("code")))
    return codes.groupBy("theme", "base").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("class", "code")))).alias("codes"), F.coalesce(pick("A"), pick(""), F.min("code")).alias("primary"))


def compare_holdings(disclosed: DataFrame, stored: DataFrame, tolerance: float = 50.0) -> DataFrame:
    """Disclosed rows against stored ones on the normalised code: the list of issues, and whether there are none. Rows of one
    code (a code that is cut off or missing may stand for several) meet one to one: first those of equal weight, then the
    others in order of weight."""
    key = ["fund_code", "report_period", "code"]
    numbered = lambda df, *by: df.withColumn("nth", F.row_number().over(Window.partitionBy(*key, *by).orderBy("weight", "shares", "market_value")))

    def pair(left: DataFrame, right: DataFrame, *by: str) -> DataFrame:
        on = [*key, *by, "nth"]
        side = numbered(right, *by).select(F.lit(True).alias("held"), *[F.col(c).alias(f"_{c}") for c in [*dict.fromkeys([*on, "weight"]), "shares", "market_value"]])
        return numbered(left, *by).join(side, reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in on]), "full" if by else "left")

    columns = ["fund_code", "report_period", "code", "weight", "shares", "market_value"]
    first = pair(disclosed.withColumn("told", F.lit(True)).withColumn("code", norm_code(F.col("stock_code"))), stored.withColumn("code", norm_code(F.col("stock_code"))).select(*columns), "weight")
    met = first.where("told AND held")
    rest = pair(first.where("told AND held IS NULL").select(*columns, "stock_code"), first.where("told IS NULL").select(*[F.col(f"_{c}").alias(c) for c in columns]))
    far = lambda c: F.abs(F.col(c) - F.col(f"_{c}")) > tolerance
    issues = F.array_compact(F.array(F.when(F.col("held").isNull(), "missing"), F.when(F.col("weight") != F.col("_weight"), "weight"), F.when(far("shares"), "shares"), F.when(far("market_value"), "value")))
    needed = [*columns, *(f"_{c}" for c in columns[3:]), "stock_code", "held"]
    return met.select(*needed).unionByName(rest.select(*needed)).select("fund_code", "report_period", "stock_code", issues.alias("issues"), (F.size(issues) == 0).alias("consistent"))


def compare_managers(a: DataFrame, b: DataFrame) -> DataFrame:
    """Sorted name sets of each fund in both sources, and whether they are equal."""
    names = lambda df, c: df.groupBy("fund_code").agg(F.sort_array(F.collect_set("manager_name")).alias(c))
    return names(a, "left_names").join(names(b, "right_names"), "fund_code", "full").withColumn("same", F.col("left_names").eqNullSafe(F.col("right_names")))


def compare_returns(own: DataFrame, source: DataFrame, within: float = 0.01) -> DataFrame:
    """Per basis: compared pairs, the largest difference in percentage points, and how many are within the bound."""
    rows = own.join(source.select("share_code", "period", "ret"), ["share_code", "period"])
    long = rows.unpivot(["share_code", "period", "ret"], ["reinvest", "unit", "chain"], "basis", "value").withColumn("diff", F.abs(F.col("value") - F.col("ret")) * 100)
    return long.groupBy("basis").agg(F.count(F.lit(1)).alias("n"), F.max("diff").alias("largest"), F.count_if(F.col("diff") <= within).alias("within"))


def compare_fees(fees: DataFrame, stated: DataFrame) -> DataFrame:
    """Snapshot fees against stated ones (fund_code, kind, rate): A shares for management and custody, C for service."""
    a = fees.where("share_class = 'A'").unpivot(["fund_code"], ["management_fee", "custody_fee"], "kind", "fee")
    c = fees.where("share_class = 'C'").unpivot(["fund_code"], ["sales_service_fee"], "kind", "fee")
    return a.unionByName(c).join(stated, ["fund_code", "kind"]).select("fund_code", "kind", "fee", "rate", (F.abs(F.col("fee") - F.col("rate")) < 1e-9).alias("same"))


def merge_tenures(events: DataFrame, as_of: str) -> DataFrame:
    """One tenure from ordered events (ord): later non-null dates win; sources in order; an end after ``as_of`` is open."""
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("ord")))
    rows = events.groupBy("fund_code", "manager_name").agg(last("start_date").alias("start_date"), last("end_date").alias("end_date"), F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("ord", "source"))), lambda s: s["source"])).alias("sources"))
    return rows.withColumn("end_date", F.when(F.col("end_date") <= F.to_date(F.lit(as_of)), F.col("end_date")))


def join_continuations(rows: DataFrame) -> DataFrame:
    """Table rows (doc, row_no, cells): a non-empty row with an empty first cell continues the row before it."""
    w = Window.partitionBy("doc").orderBy("row_no").rowsBetween(Window.unboundedPreceding, 0)
    island = F.sum(F.when((F.get("cells", F.lit(0)) != "") | (F.array_join("cells", "") == ""), 1).otherwise(0)).over(w)
    lists = rows.withColumn("island", island).groupBy("doc", "island").agg(F.transform(F.array_sort(F.collect_list(F.struct("row_no", "cells"))), lambda s: s["cells"]).alias("lists"))
    places = F.sequence(F.lit(0), F.array_max(F.transform("lists", F.size)) - 1)
    joined = F.transform(places, lambda k: F.array_join(F.transform("lists", lambda r: F.get(r, k)), ""))
    return lists.where(F.exists("lists", lambda r: F.size(r) > 0)).select("doc", "island", joined.alias("cells"))


def latest_announcement(matches: DataFrame) -> DataFrame:
    w = Window.partitionBy("fund_code", "spec").orderBy(F.desc("publish_date"), F.desc("report_id"))
    return matches.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")

#: Days of a range that tenures and requests meet in.
RANGE_DAYS = 366


def active_managers(requests: DataFrame, tenures: DataFrame, days: int = RANGE_DAYS) -> DataFrame:
    """Interval join: the managers of each request (fund_code, on) whose tenure (fund_code, manager_name, start_date, end_date)
    holds the date: start null or not after it, end null or after it.

    Both sides meet by fund and range of days, and bounds are tested then, so no pair of a fund's request and tenure is made
    outside a shared range. Open ends reach to the first and last date that is asked for. A null date has no managers."""
    span = requests.agg(F.min("on").alias("_least"), F.max("on").alias("_most"))  # one row
    place = lambda day: F.floor(F.unix_date(day) / days)
    held = tenures.crossJoin(F.broadcast(span))
    begin, end = F.greatest(F.coalesce("start_date", "_least"), "_least"), F.least(F.coalesce("end_date", "_most"), "_most")
    held = held.where(begin <= end).select(F.col("fund_code").alias("_fund"), "manager_name", "start_date", "end_date", F.explode(F.sequence(place(begin), place(end))).alias("_range"))
    pairs = requests.join(held, (F.col("fund_code") == F.col("_fund")) & (place(F.col("on")) == F.col("_range")))
    active = (F.col("start_date").isNull() | (F.col("start_date") <= F.col("on"))) & (F.col("end_date").isNull() | (F.col("end_date") > F.col("on")))
    return pairs.where(active).select(*requests.columns, "manager_name", "start_date", "end_date")


def match_announcements(announcements: DataFrame, specs: DataFrame, as_of: str) -> DataFrame:
    """Announcements whose title matches a spec's pattern and not its exclusion; specs are a handful of rules."""
    rows = announcements.where(F.col("publish_date") <= F.to_date(F.lit(as_of)))
    return rows.join(F.broadcast(specs), F.expr("title RLIKE include AND NOT coalesce(title RLIKE exclude, false)"))


def missing_documents(funds: DataFrame, specs: DataFrame, found: DataFrame) -> DataFrame:
    """Expected (fund, spec) pairs without a usable document, with the reason; specs are a handful of rules."""
    rows = funds.select("fund_code").crossJoin(F.broadcast(specs.select("spec"))).join(found, ["fund_code", "spec"], "left")
    reason = F.when(F.col("status").isNull(), "no announcement").when(F.col("status") != "ok", F.concat(F.lit("failed: "), F.col("status"))).when(~F.col("extractable"), "not extractable")
    return rows.withColumn("reason", reason).where("reason IS NOT NULL").select("fund_code", "spec", "reason")


def quality_report(parts: dict[str, DataFrame], folder: str) -> DataFrame:
    """Writes each check's rows as Parquet below ``folder``; a summary row for each: check, rows."""
    out = None
    for name, rows in parts.items():
        rows.write.mode("overwrite").parquet(f"{folder}/{name}")
        one = rows.sparkSession.read.parquet(f"{folder}/{name}").agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("check"), "rows")
        out = one if out is None else out.unionByName(one)
    return out


def continuity_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return continuity(view(spark, sf_dir, "nav_daily"), view(spark, sf_dir, "trading_days"), "2024-01-30")


def holdings_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top holdings against the same with every fifth value moved and every seventh row taken away. Both sides read one table:
    weights hold a sum of doubles, whose last bits change with the order of the rows when it is formed again."""
    stored = run(spark, sf_dir, "SELECT fund_code, report_period, stock_code, weight, 100.0E0 * rank_no AS shares, 1000.0E0 * rank_no AS market_value, rank_no FROM {holdings_top10}")
    stored = written(stored, "holdings")
    told = stored.withColumn("shares", F.when(F.col("rank_no") % 5 == 0, F.col("shares") + 60).otherwise(F.col("shares") + 40))
    return compare_holdings(told, stored.where("rank_no <> 7")).select("fund_code", "report_period", "stock_code", F.array_join("issues", ",").alias("issues"), "consistent")


def announcements_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as announcements: the latest urgent one of each customer segment before a date."""
    rows = run(spark, sf_dir, "SELECT CAST(o_custkey % 50 AS STRING) AS fund_code, o_orderpriority AS title, CAST(o_orderdate AS DATE) AS publish_date, o_orderkey AS report_id FROM {orders}")
    specs = spark.createDataFrame([("urgent", "URGENT|HIGH", None), ("other", "^[3-5]", "LOW")], "spec string, include string, exclude string")
    return latest_announcement(match_announcements(rows, specs, "1997-06-30")).select("fund_code", "spec", "report_id")


QUERIES = {"a1_nav_continuity": continuity_query, "j5_compare_holdings": holdings_query, "w7_latest_announcement": announcements_query}
ORACLE_SQL = {
    "a1_nav_continuity": oracle(
        """
        SELECT r.share_code, r.first, r.last, r.n, coalesce(g.gap_days, 0) AS gap_days, coalesce(g.late_gaps, 0) AS late_gaps, coalesce(g.first_gaps, '') AS first_gaps, coalesce(o.off_days, 0) AS off_days
        FROM (SELECT share_code, min(nav_date) AS first, max(nav_date) AS last, count(*) AS n FROM {nav_daily} GROUP BY share_code) r
          LEFT JOIN (SELECT share_code, count(*) AS gap_days, count(*) FILTER (day > first + INTERVAL 3 MONTH) AS late_gaps, array_to_string(list_slice(list(day ORDER BY day), 1, 10), ';') AS first_gaps
            FROM (SELECT b.share_code, b.first, d.day FROM (SELECT share_code, min(nav_date) AS first FROM {nav_daily} GROUP BY share_code) b JOIN {trading_days} d ON d.day >= b.first AND d.day <= DATE '2024-01-30'
              LEFT JOIN {nav_daily} n ON n.share_code = b.share_code AND n.nav_date = d.day WHERE n.share_code IS NULL) x GROUP BY share_code) g ON g.share_code = r.share_code
          LEFT JOIN (SELECT n.share_code, count(*) AS off_days FROM {nav_daily} n LEFT JOIN {trading_days} d ON d.day = n.nav_date WHERE d.day IS NULL GROUP BY n.share_code) o ON o.share_code = r.share_code"""
    ),
    "j5_compare_holdings": oracle("SELECT fund_code, report_period, stock_code, CASE WHEN rank_no = 7 THEN 'missing' WHEN rank_no % 5 = 0 THEN 'shares' ELSE '' END AS issues, rank_no <> 7 AND rank_no % 5 <> 0 AS consistent FROM {holdings_top10}"),
    "w7_latest_announcement": """
        SELECT fund_code, spec, report_id FROM (SELECT CAST(o_custkey % 50 AS VARCHAR) AS fund_code, spec, o_orderkey AS report_id, row_number() OVER (PARTITION BY o_custkey % 50, spec ORDER BY CAST(o_orderdate AS DATE) DESC, o_orderkey DESC) AS k
          FROM orders JOIN (SELECT 'urgent' AS spec UNION ALL SELECT 'other') s ON CASE WHEN spec = 'urgent' THEN regexp_matches(o_orderpriority, 'URGENT|HIGH') ELSE regexp_matches(o_orderpriority, '^[3-5]') AND NOT regexp_matches(o_orderpriority, 'LOW') END
          WHERE CAST(o_orderdate AS DATE) <= DATE '1997-06-30') x WHERE k = 1""",
}
