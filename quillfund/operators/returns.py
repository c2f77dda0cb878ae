"""Dividend-adjusted returns, drawdowns and after-fee results for batches of requests.

All work is windows partitioned by share or by request and equi-joins on the share; fee tiers join by share too, with the
range as a condition, so no pair of a request and a foreign tier is ever made. Errors are values of the ``error`` column.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillfund.plans.views import oracle, run, view
from quillfund.scratch import written


def weekdays(df: DataFrame, day: str) -> DataFrame:
    return df.where(F.weekday(day) < 5)


def months(series: DataFrame, key: str, day: str, values: list[str]) -> DataFrame:
    """What an as-of lookup needs of each month: its rows in order (at most one a day) and the last row before it. From a
    key's first month to the month after the last one of all keys, without gaps; that last one stands for all later ones."""
    hit = F.struct(F.col(day).alias("day"), *values)
    held = series.where(F.col(day).isNotNull()).groupBy(key, F.trunc(day, "month").alias("_month")).agg(F.array_sort(F.collect_list(hit)).alias("_days"))
    held = held.crossJoin(F.broadcast(series.agg(F.add_months(F.trunc(F.max(day), "month"), 1).alias("_after"))))  # one row
    w = Window.partitionBy(key).orderBy("_month")
    held = held.withColumn("_before", F.lag(F.element_at("_days", -1)).over(w)).withColumn("_until", F.coalesce(F.lead("_month").over(w), F.add_months("_after", 1)))
    every = held.withColumn("_at", F.explode(F.sequence("_month", F.add_months("_until", -1), F.expr("interval 1 month"))))
    own = F.col("_at") == F.col("_month")
    return every.select(key, "_at", "_after", F.when(own, F.col("_days")).alias("_days"), F.when(own, F.col("_before")).otherwise(F.element_at("_days", -1)).alias("_before"))


def asof(requests: DataFrame, series: DataFrame, key: str, ends: dict[str, str], day: str, values: list[str]) -> DataFrame:
    """As-of join: for each date column of ``requests`` in ``ends`` the last ``series`` row of the key on or before it, as
    columns with the prefix that ``ends`` gives. Requests meet one row of ``months`` by an equi-join on key and month, so
    neither the days nor the requests of a key are sorted, and a key with very many requests can be split."""
    held = months(series, key, day, values)
    after = held.agg(F.max("_after")).first()[0]
    found = requests
    for at, prefix in ends.items():
        side = held.select(F.col(key).alias("_key"), "_at", "_days", "_before")
        month = F.least(F.trunc(at, "month"), F.lit(after).cast("date"))
        found = found.join(side, (found[key] == side["_key"]) & (month == side["_at"]), "left")
        own = F.filter("_days", lambda d: d["day"] <= F.col(at))
        found = found.withColumn("_hit", F.when(F.size(own) > 0, F.element_at(own, -1)).otherwise(F.col("_before")))
        fresh = [F.col("_hit.day").alias(f"{prefix}_used"), *[F.col(f"_hit.{v}").alias(f"{prefix}_{v}") for v in values]]
        found = found.select("*", *fresh).drop("_key", "_at", "_days", "_before", "_hit")
    return found


def adjusted(nav: DataFrame, dividends: DataFrame) -> DataFrame:
    """Adjusted NAV of weekday rows: the running product of (nav + cash that day) / previous nav, 1 on the first row.
    Of several dividends on a day the largest counts; cash on the first row is ignored. Adds ``adj`` and ``place``."""
    cash = dividends.groupBy("share_code", F.col("ex_date").alias("nav_date")).agg(F.max("cash_per_unit").alias("cash"))
    rows = weekdays(nav, "nav_date").join(cash, ["share_code", "nav_date"], "left")
    w = Window.partitionBy("share_code").orderBy("nav_date")
    step = F.coalesce((F.col("unit_nav") + F.coalesce("cash", F.lit(0.0))) / F.lag("unit_nav").over(w), F.lit(1.0))
    rows = rows.withColumn("step", step).withColumn("place", F.row_number().over(w))
    return rows.withColumn("adj", F.product("step").over(w.rowsBetween(Window.unboundedPreceding, 0))).select("share_code", "nav_date", "unit_nav", "adj", "place")


#: Places that a block covers of the level below, and levels of blocks above single days.
SPAN, LEVELS = 16, 2


def fold(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """One node of each key from its nodes in order of ``at``: highest and lowest value, and the deepest fall within it."""
    before = Window.partitionBy(*keys).orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    down = F.least("down", F.col("bottom") / F.max("top").over(before) - 1)
    return nodes.withColumn("down", down).groupBy(*keys).agg(F.max("top").alias("top"), F.min("bottom").alias("bottom"), F.min("down").alias("down"))


def drawdowns(requests: DataFrame, series: DataFrame) -> DataFrame:
    """``request_id, max_drawdown`` within places [start_place, end_place]: the least adj / highest adj so far - 1, at most 0.

    Days are folded into blocks of ``SPAN`` places and those again into blocks of ``SPAN``, once. A request reads the days
    and blocks that make up its range, by an equi-join: about 60 rows and one for each 256 days, not one for each day."""
    days = series.select("share_code", F.lit(0).alias("level"), F.col("place").cast("long").alias("block"), F.col("adj").alias("top"), F.col("adj").alias("bottom"), F.lit(0.0).alias("down"))
    levels = [days]
    for level in range(1, LEVELS + 1):
        below = levels[-1].withColumn("at", F.col("block")).withColumn("block", F.floor(F.col("block") / SPAN)).withColumn("level", F.lit(level))
        levels.append(fold(below, ["share_code", "level", "block"]))
    blocks = reduce(DataFrame.unionByName, levels)

    def span(level: int, begin: Column, end: Column) -> Column:
        found = F.transform(F.sequence(begin, end - 1), lambda b: F.struct(F.lit(level).alias("level"), b.alias("block"), (b * SPAN**level).alias("at")))
        return F.when(begin < end, found).otherwise(F.slice(found, 1, 0))

    begin, end, parts = F.col("start_place").cast("long"), F.col("end_place").cast("long") + 1, []
    for level in range(LEVELS):
        first, last = F.ceil(begin / SPAN), F.floor(end / SPAN)
        whole = first < last
        parts += [span(level, begin, F.when(whole, first * SPAN).otherwise(end)), span(level, F.when(whole, last * SPAN).otherwise(end), end)]
        begin, end = first, last
    asked = requests.select("request_id", "share_code", F.explode(F.concat(*parts, span(LEVELS, begin, end))).alias("b")).select("request_id", "share_code", "b.*")
    return fold(asked.join(blocks, ["share_code", "level", "block"]), ["request_id"]).select("request_id", F.least(F.lit(0.0), "down").alias("max_drawdown"))


def tier(requests: DataFrame, tiers: DataFrame, value: str, low: str, high: str, fields: list[str], prefix: str) -> DataFrame:
    """Range join: the first tier (by ``tier_no``) of the share with ``low <= value < high``; null bounds are open."""
    held = tiers.groupBy("share_code").agg(F.array_sort(F.collect_list(F.struct("tier_no", low, high, *fields))).alias("tiers"))  # a few tiers a share
    hit = F.filter("tiers", lambda t: F.coalesce(t[low] <= F.col(value), F.lit(True)) & F.coalesce(F.col(value) < t[high], F.lit(True)))
    found = requests.join(held, "share_code", "left").withColumn("_tier", F.get(hit, F.lit(0)))
    return found.select(*requests.columns, *[F.col(f"_tier.{f}").alias(f"{prefix}_{f}") for f in fields], F.col("tiers").isNotNull().alias(f"{prefix}_tiers"))


def fund_returns(requests: DataFrame, nav: DataFrame, dividends: DataFrame, purchase_tiers: DataFrame, redemption_tiers: DataFrame) -> DataFrame:
    """One row for each request (request_id, share_code, start_date, end_date, include_fees, amount).

    Result columns are null where ``error`` is set. Dividends on days without a NAV are counted and reported, not
    reinvested. Request ids are unique; null dates, bad codes and amounts give errors."""
    series = written(adjusted(nav, dividends), "adjusted")  # read by as-of lookups, drawdowns and dividends
    bounds = series.groupBy("share_code").agg(F.min("nav_date").alias("first_nav"), F.max("nav_date").alias("last_nav"))
    values = ["unit_nav", "adj", "place"]
    rows = asof(requests, series, "share_code", {"start_date": "start", "end_date": "end"}, "nav_date", values).join(bounds, "share_code", "left")
    bad_amount = F.col("include_fees") & (F.col("amount").isNull() | F.isnan("amount") | (F.col("amount") <= 0))
    error = (
        F.when(F.col("share_code").isNull() | ~F.col("share_code").rlike(r"^\d{6}$"), "bad share code")
        .when(F.col("start_date").isNull() | F.col("end_date").isNull(), "bad date")
        .when(F.col("start_date") > F.col("end_date"), "start after end")
        .when(bad_amount, "bad amount")
        .when(F.col("first_nav").isNull(), "unknown share")
        .when(F.col("start_used").isNull() | F.col("end_used").isNull(), "before the first NAV")
    )
    rows = written(rows.withColumn("error", error), "requests")
    days = F.datediff("end_used", "start_used")
    good = rows.where("error IS NULL").withColumn("calendar_days", days).withColumn("trading_days", F.col("end_place") - F.col("start_place")).withColumn("ret", F.col("end_adj") / F.col("start_adj") - 1)
    good = good.withColumn("annualized", F.when(F.col("calendar_days") > 0, F.pow(1 + F.col("ret"), 365 / F.col("calendar_days")) - 1).otherwise(0.0))
    good = good.join(drawdowns(good, series), "request_id", "left")
    paid = dividends.groupBy("share_code", "ex_date").agg(F.max("cash_per_unit").alias("cash_per_unit"))
    paid = paid.join(series.select("share_code", F.col("nav_date").alias("ex_date"), F.lit(True).alias("matched")), ["share_code", "ex_date"], "left")
    events = good.select("request_id", "share_code", "start_used", "end_used").join(paid, "share_code").where("ex_date > start_used AND ex_date <= end_used")
    events = events.groupBy("request_id").agg(F.count(F.lit(1)).alias("dividends_in_range"), F.array_sort(F.collect_list(F.struct("ex_date", "cash_per_unit"))).alias("dividend_events"), F.array_sort(F.collect_list(F.when(F.col("matched").isNull(), F.col("ex_date")))).alias("unmatched_ex_dates"))
    good = good.join(events, "request_id", "left").withColumn("dividends_in_range", F.coalesce("dividends_in_range", F.lit(0).cast("long")))
    good = tier(good, purchase_tiers, "amount", "min_amount", "max_amount", ["rate", "fixed_fee"], "purchase")
    good = tier(good, redemption_tiers, "calendar_days", "min_days", "max_days", ["rate"], "redemption")
    bought = F.when(F.col("purchase_fixed_fee") > 0, F.col("amount") - F.col("purchase_fixed_fee")).otherwise(F.col("amount") / (1 + F.coalesce("purchase_rate", F.lit(0.0))))
    net = bought * (1 + F.col("ret")) * (1 - F.coalesce("redemption_rate", F.lit(0.0))) / F.col("amount") - 1
    good = good.withColumn("net_return", F.when(F.col("include_fees"), net))
    off = lambda at, used: F.col(used) != F.col(at)
    notes = F.array_compact(
        F.array(
            F.when(off("start_date", "start_used"), F.format_string("start %s is no trading day, used %s", F.col("start_date").cast("string"), F.col("start_used").cast("string"))),
            F.when(off("end_date", "end_used"), F.format_string("end %s %s, used %s", F.col("end_date").cast("string"), F.when(F.col("end_date") <= F.col("last_nav"), F.lit("is no trading day")).otherwise("is after the last NAV"), F.col("end_used").cast("string"))),
            F.when(F.size("unmatched_ex_dates") > 0, F.concat(F.lit("dividends without a NAV: "), F.array_join(F.col("unmatched_ex_dates").cast("array<string>"), ", "))),
            F.when(F.col("include_fees") & ~F.col("purchase_tiers"), F.lit("no purchase fee tiers: no purchase fee")),
        )
    )
    out = ["request_id", "share_code", "start_used", "end_used", "start_unit_nav", "end_unit_nav", "calendar_days", "trading_days", "ret", "annualized", "max_drawdown", "dividends_in_range", "dividend_events", "net_return"]
    return good.select(*out, notes.alias("notes"), "error").unionByName(rows.where("error IS NOT NULL").select("request_id", "share_code", "error"), allowMissingColumns=True)


def three_bases(nav: DataFrame, dividends: DataFrame, as_of: str) -> DataFrame:
    """Period returns on three bases (dividends reinvested at the NAV of the day, unit NAVs, chained daily returns) for
    1m, 3m, 6m, 1y, 2y, 3y and ytd. Weekend rows stay. Shares whose last NAV is not on ``as_of`` are left out."""
    spark = nav.sparkSession
    day = F.to_date(F.lit(as_of))
    periods = spark.range(1).select(F.explode(F.create_map(*[F.lit(x) for p in (("1m", 1), ("3m", 3), ("6m", 6), ("1y", 12), ("2y", 24), ("3y", 36), ("ytd", 0)) for x in p])).alias("period", "months"))
    periods = periods.select("period", F.when(F.col("period") == "ytd", F.make_date(F.year(day) - 1, F.lit(12), F.lit(31))).otherwise(F.add_months(day, -F.col("months"))).alias("start_date"))
    w = Window.partitionBy("share_code").orderBy("nav_date")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    cash = dividends.groupBy("share_code", F.col("ex_date").alias("nav_date")).agg(F.collect_list("cash_per_unit").alias("cash"))
    rows = nav.join(cash, ["share_code", "nav_date"], "left")
    gain = F.aggregate(F.coalesce("cash", F.array().cast("array<double>")), F.lit(1.0), lambda acc, c: acc * (1 + c / F.col("unit_nav")))
    rows = rows.withColumn("gain", F.product(gain).over(so_far)).withColumn("chain", F.product(1 + F.coalesce("daily_return", F.lit(0.0))).over(so_far))
    last = rows.groupBy("share_code").agg(F.max_by(F.struct("nav_date", "unit_nav", "gain", "chain"), "nav_date").alias("last")).where(F.col("last.nav_date") == day)
    asked = last.crossJoin(F.broadcast(periods))  # seven periods
    based = asof(asked, rows, "share_code", {"start_date": "base"}, "nav_date", ["unit_nav", "gain", "chain"]).where("base_used IS NOT NULL")
    unit = F.col("last.unit_nav") / F.col("base_unit_nav")
    return based.select("share_code", "period", F.col("base_used").alias("base_date"), (unit * F.col("last.gain") / F.col("base_gain") - 1).alias("reinvest"), (unit - 1).alias("unit"), (F.col("last.chain") / F.col("base_chain") - 1).alias("chain"))


_LONG = "SELECT lpad(CAST(o_custkey % 10 AS STRING), 6, '0') AS share_code, CAST(o_orderdate AS DATE) AS nav_date, floor((1 + avg(o_totalprice) / 1000000) * 10000 + 0.5000001) / 10000.0E0 AS unit_nav, floor(avg(o_totalprice) / 100 + 0.5000001) / 1000000.0E0 AS daily_return FROM {orders} GROUP BY o_custkey % 10, CAST(o_orderdate AS DATE)"
REQUESTS = """
    SELECT event_id AS request_id, lpad(CAST(user_id AS STRING), 6, '0') AS share_code, CAST(ts AS DATE) AS start_date,
      CAST(ts AS DATE) + CAST(event_id % 15 AS INT) AS end_date, event_id % 2 = 0 AS include_fees, value * 10000 AS amount
    FROM {events} WHERE event_type IN ('click', 'view')"""
_PURCHASE = "SELECT CONCAT('0', substring(share_code, 2, 5)) AS share_code, tier_no, min_amount, max_amount, rate, fixed_fee FROM {purchase_fee_tiers}"
_REDEMPTION = "SELECT CONCAT('0', substring(share_code, 2, 5)) AS share_code, tier_no, min_days, max_days, rate FROM {redemption_fee_tiers} WHERE share_code < '2'"


def returns_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fund_returns(run(spark, sf_dir, REQUESTS), view(spark, sf_dir, "nav_daily"), view(spark, sf_dir, "dividends"), run(spark, sf_dir, _PURCHASE), run(spark, sf_dir, _REDEMPTION))
    return found.select("request_id", "share_code", "start_used", "end_used", "calendar_days", "trading_days", F.round("ret", 6).alias("ret"), F.round("max_drawdown", 6).alias("max_drawdown"), "dividends_in_range", F.round("net_return", 6).alias("net_return"), "error")


_SERIES = """
    SELECT share_code, nav_date, unit_nav, row_number() OVER (PARTITION BY share_code ORDER BY nav_date) AS place,
      exp(sum(ln(step)) OVER (PARTITION BY share_code ORDER BY nav_date)) AS adj
    FROM (SELECT n.share_code, n.nav_date, n.unit_nav, coalesce((n.unit_nav + coalesce(d.cash_per_unit, 0)) / lag(n.unit_nav) OVER (PARTITION BY n.share_code ORDER BY n.nav_date), 1) AS step
      FROM {nav_trading} n LEFT JOIN {dividends} d ON d.share_code = n.share_code AND d.ex_date = n.nav_date) x"""
_USED = """
    SELECT r.*, s.nav_date AS start_used, s.place AS p0, s.adj AS a0, e.nav_date AS end_used, e.place AS p1, e.adj AS a1, b.share_code AS known
    FROM {requests} r LEFT JOIN (SELECT DISTINCT share_code FROM {series}) b ON b.share_code = r.share_code
      LEFT JOIN {series} s ON s.share_code = r.share_code AND s.nav_date = (SELECT max(nav_date) FROM {series} x WHERE x.share_code = r.share_code AND x.nav_date <= r.start_date)
      LEFT JOIN {series} e ON e.share_code = r.share_code AND e.nav_date = (SELECT max(nav_date) FROM {series} x WHERE x.share_code = r.share_code AND x.nav_date <= r.end_date)"""
_DOWN = """
    SELECT request_id, least(0, min(adj / top - 1)) AS max_drawdown
    FROM (SELECT u.request_id, s.adj, max(s.adj) OVER (PARTITION BY u.request_id ORDER BY s.nav_date) AS top
      FROM {used} u JOIN {series} s ON s.share_code = u.share_code AND s.nav_date BETWEEN u.start_used AND u.end_used) x
    GROUP BY request_id"""
_PAID = "SELECT u.request_id, count(*) AS n FROM {used} u JOIN {dividends} d ON d.share_code = u.share_code AND d.ex_date > u.start_used AND d.ex_date <= u.end_used GROUP BY u.request_id"
_FEES = f"""
    SELECT u.request_id, min_by(p.rate, p.tier_no) AS rate, min_by(coalesce(p.fixed_fee, 0), p.tier_no) AS fixed_fee, min_by(q.rate, q.tier_no) AS redemption
    FROM {{used}} u LEFT JOIN ({_PURCHASE}) p ON p.share_code = u.share_code AND p.min_amount <= u.amount AND u.amount < coalesce(p.max_amount, 1e300)
      LEFT JOIN ({_REDEMPTION}) q ON q.share_code = u.share_code AND q.min_days <= u.end_used - u.start_used AND u.end_used - u.start_used < coalesce(q.max_days, 1000000000)
    GROUP BY u.request_id"""
RETURNS_SQL = oracle(
    """
    SELECT u.request_id, u.share_code, CASE WHEN e IS NULL THEN start_used END AS start_used, CASE WHEN e IS NULL THEN end_used END AS end_used,
      CASE WHEN e IS NULL THEN CAST(end_used - start_used AS INT) END AS calendar_days, CASE WHEN e IS NULL THEN CAST(p1 - p0 AS INT) END AS trading_days,
      CASE WHEN e IS NULL THEN round(a1 / a0 - 1, 6) END AS ret, CASE WHEN e IS NULL THEN round(max_drawdown, 6) END AS max_drawdown,
      CASE WHEN e IS NULL THEN coalesce(n, 0) END AS dividends_in_range,
      CASE WHEN e IS NULL AND include_fees THEN round((CASE WHEN fixed_fee > 0 THEN amount - fixed_fee ELSE amount / (1 + coalesce(rate, 0)) END) * (a1 / a0) * (1 - coalesce(redemption, 0)) / amount - 1, 6) END AS net_return,
      e AS error
    FROM (SELECT *, CASE WHEN include_fees AND amount <= 0 THEN 'bad amount' WHEN known IS NULL THEN 'unknown share' WHEN start_used IS NULL OR end_used IS NULL THEN 'before the first NAV' END AS e FROM {used}) u
      LEFT JOIN {down} d ON d.request_id = u.request_id LEFT JOIN {paid} p ON p.request_id = u.request_id LEFT JOIN {feed} f ON f.request_id = u.request_id""",
    requests=REQUESTS, series=_SERIES, used=_USED, down=_DOWN, paid=_PAID, feed=_FEES,
)


def adjusted_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adjusted(view(spark, sf_dir, "nav_daily"), view(spark, sf_dir, "dividends")).select("share_code", "nav_date", F.round("adj", 6).alias("adj"), F.col("place").cast("long").alias("place"))


def asof_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = run(spark, sf_dir, REQUESTS).select("request_id", "share_code", "start_date")
    found = asof(asked, view(spark, sf_dir, "nav_trading"), "share_code", {"start_date": "start"}, "nav_date", ["unit_nav"])
    return found.select("request_id", "start_used", "start_unit_nav")


def bases_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    nav = run(spark, sf_dir, _LONG)
    paid = run(spark, sf_dir, "SELECT share_code, nav_date AS ex_date, 0.01E0 AS cash_per_unit FROM {nav} WHERE day(nav_date) = 15", nav=nav)
    as_of = nav.agg(F.max("nav_date")).first()[0]
    found = three_bases(nav, paid, str(as_of))
    return found.select("share_code", "period", "base_date", *[F.round(c, 6).alias(c) for c in ("reinvest", "unit", "chain")])


_BASES = """
    SELECT x.share_code, p.period, b.nav_date AS base_date, round(x.unit_nav / b.unit_nav * x.gain / b.gain - 1, 6) AS reinvest, round(x.unit_nav / b.unit_nav - 1, 6) AS unit, round(x.chain / b.chain - 1, 6) AS chain
    FROM {rising} x JOIN (SELECT max(nav_date) AS day FROM {long_nav}) m ON x.nav_date = m.day
      CROSS JOIN (SELECT '1m' AS period, 1 AS k UNION ALL SELECT '3m', 3 UNION ALL SELECT '6m', 6 UNION ALL SELECT '1y', 12 UNION ALL SELECT '2y', 24 UNION ALL SELECT '3y', 36 UNION ALL SELECT 'ytd', 0) p
      JOIN {rising} b ON b.share_code = x.share_code AND b.nav_date = (SELECT max(nav_date) FROM {long_nav} y WHERE y.share_code = x.share_code
        AND y.nav_date <= CASE WHEN p.k = 0 THEN CAST(date_trunc('year', m.day) AS DATE) - 1 ELSE CAST(m.day - to_months(p.k) AS DATE) END)"""
_RISING = """
    SELECT share_code, nav_date, unit_nav, exp(sum(ln(CASE WHEN day(nav_date) = 15 THEN 1 + 0.01 / unit_nav ELSE 1 END)) OVER (PARTITION BY share_code ORDER BY nav_date)) AS gain,
      exp(sum(ln(1 + daily_return)) OVER (PARTITION BY share_code ORDER BY nav_date)) AS chain FROM {long_nav}"""

QUERIES = {"fund_returns": returns_query, "w2_adjusted_nav": adjusted_query, "j8_asof_nav": asof_query, "w5_three_bases": bases_query}
ORACLE_SQL = {
    "fund_returns": RETURNS_SQL,
    "w2_adjusted_nav": oracle("SELECT share_code, nav_date, round(adj, 6) AS adj, place FROM {series}", series=_SERIES),
    "j8_asof_nav": oracle("SELECT r.request_id, n.nav_date AS start_used, n.unit_nav AS start_unit_nav FROM {requests} r LEFT JOIN {nav_trading} n ON n.share_code = r.share_code AND n.nav_date = (SELECT max(nav_date) FROM {nav_trading} x WHERE x.share_code = r.share_code AND x.nav_date <= r.start_date)", requests=REQUESTS),
    "w5_three_bases": oracle(_BASES, long_nav=_LONG, rising=_RISING),
}
