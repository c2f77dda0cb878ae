"""Fund universe and portfolio rules, dataset rules, and cost projections: counted funnels and rows of violations.

Every check is one pass of conditional aggregates or an anti join; results are long rows (rule, key, detail), so that new
rules add rows and not columns.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillfund.plans.views import oracle, run, view

VIOLATION = ["rule", "key", "detail"]


def funnel(rows: DataFrame, steps: Sequence[tuple[str, Column]]) -> tuple[DataFrame, DataFrame]:
    """Rows that pass all steps, and (step_no, step, n): how many are left after each, from one aggregate. A condition that
    is null does not pass."""
    passed, conditions = F.lit(True), []
    for name, condition in steps:
        passed = passed & F.coalesce(condition, F.lit(False))
        conditions.append((name, passed))
    counted = rows.agg(F.count(F.lit(1)).alias("n0"), *[F.count_if(c).alias(f"n{k}") for k, (_, c) in enumerate(conditions, 1)])
    names = F.array(*[F.struct(F.lit(k).alias("step_no"), F.lit(name).alias("step"), F.col(f"n{k}").alias("n")) for k, name in enumerate(["all", *[n for n, _ in steps]])])
    return rows.where(passed), counted.select(F.explode(names).alias("s")).select("s.*")


def rejected(candidates: DataFrame, as_of: str, least_years: int = 2, least_scale: float = 2e8) -> DataFrame:
    """Candidates (established, scale, in yuan) with ``reason``: the first rule that they fail, or null."""
    day = F.to_date(F.lit(as_of))
    return candidates.withColumn("reason", F.when(F.col("established").isNull(), "no founding date").when(F.add_months("established", 12 * least_years) > day, "too young").when(F.col("scale").isNull(), "no scale").when(F.col("scale") < least_scale, "too small"))


def recent_announcements(announcements: DataFrame, phrase: str, as_of: str, years: int = 2) -> DataFrame:
    """(fund_code, dates): the distinct days in the last ``years`` on which a title contains the phrase."""
    day = F.to_date(F.lit(as_of))
    rows = announcements.where(F.col("title").contains(phrase) & F.col("published").between(F.add_months(day, -12 * years), day))
    return rows.groupBy("fund_code").agg(F.countDistinct("published").alias("dates"))


def portfolio_violations(funds: DataFrame, shares: DataFrame, most: dict[str, int], ratio: tuple[float, float], companies: int) -> DataFrame:
    """(rule, key, detail) of a portfolio: funds (fund_code, theme, style, company), shares (fund_code, share_code, share_class).

    Themes have at most ``most`` funds; active to index funds stand in the range ``ratio``; at least ``companies`` are
    different; no code stands twice; every fund has an A and a C share."""
    text = lambda c: c.cast("string")
    themes = funds.groupBy("theme").agg(F.count(F.lit(1)).alias("n"))
    limit = F.create_map(*[F.lit(x) for pair in most.items() for x in pair]) if most else F.create_map().cast("map<string,int>")
    crowded = themes.where(F.col("n") > F.try_element_at(limit, F.col("theme"))).select(F.lit("theme size").alias("rule"), F.col("theme").alias("key"), text(F.col("n")).alias("detail"))
    one = funds.agg(F.count_if(F.col("style") == "active").alias("active"), F.count_if(F.col("style") == "index").alias("index"), F.countDistinct("company").alias("companies"))
    share = F.col("active") / F.nullif(F.col("index"), F.lit(0))
    style = one.where(F.coalesce((share < ratio[0]) | (share > ratio[1]), F.lit(True))).select(F.lit("active to index"), F.lit("all"), F.concat_ws(":", text(F.col("active")), text(F.col("index"))))
    few = one.where(F.col("companies") < companies).select(F.lit("companies"), F.lit("all"), text(F.col("companies")))
    twice = funds.groupBy("fund_code").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.lit("repeated code"), "fund_code", text(F.col("n")))
    held = shares.groupBy("fund_code").agg(F.array_join(F.sort_array(F.collect_set("share_class")), "").alias("classes"))
    pairs = funds.select("fund_code").distinct().join(held, "fund_code", "left").where(~F.coalesce(F.col("classes").contains("A") & F.col("classes").contains("C"), F.lit(False))).select(F.lit("share pair"), "fund_code", F.coalesce("classes", F.lit("")))
    return reduce(DataFrame.union, [crowded, style, few, twice, pairs]).toDF(*VIOLATION)


def distribution(items: DataFrame, dims: Sequence[str], crosses: Sequence[tuple[str, str]], lists: str | None = None) -> DataFrame:
    """(dim, name, n): items by each dimension and each pair of them, all items, and the distinct elements of the array column
    ``lists``. A null is the empty name."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    singles = [F.struct(F.lit(d).alias("dim"), name(d).alias("name")) for d in dims]
    pairs = [F.struct(F.lit(f"{a} x {b}").alias("dim"), F.concat(name(a), F.lit(" x "), name(b)).alias("name")) for a, b in crosses]
    cells = F.explode(F.array(F.struct(F.lit("all").alias("dim"), F.lit("").alias("name")), *singles, *pairs)).alias("c")
    out = items.select(cells).groupBy("c.dim", "c.name").agg(F.count(F.lit(1)).alias("n"))
    if lists is not None:
        out = out.unionByName(items.select(F.explode(lists).alias("e")).agg(F.countDistinct("e").alias("n")).select(F.lit(f"distinct {lists}").alias("dim"), F.lit("").alias("name"), "n"))
    return out


def dataset_violations(items: DataFrame, pattern: str, least: dict[str, int], dev_share: tuple[float, float]) -> DataFrame:
    """(rule, key, detail) of a dataset (id, topic, split): ids that break the pattern or stand twice, topics with fewer items
    than ``least`` (missing ones too), and a share of dev items outside the range."""
    ids = items.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    bad = ids.where(~F.coalesce(F.col("id").rlike(pattern), F.lit(False))).select(F.lit("id form"), F.coalesce("id", F.lit("")), F.lit(""))
    twice = ids.where("n > 1").select(F.lit("repeated id"), F.coalesce("id", F.lit("")), F.col("n").cast("string"))
    wanted = items.sparkSession.createDataFrame(sorted(least.items()), "topic string, least int")
    counts = items.groupBy("topic").agg(F.count(F.lit(1)).alias("n"))
    few = F.broadcast(wanted).join(counts, "topic", "left").withColumn("n", F.coalesce("n", F.lit(0))).where("n < least").select(F.lit("few items"), "topic", F.col("n").cast("string"))
    share = items.agg(F.avg((F.col("split") == "dev").cast("double")).alias("share")).where(~F.col("share").between(*dev_share)).select(F.lit("dev share"), F.lit("all"), F.format_string("%.3f", "share"))
    return reduce(DataFrame.union, [bad, twice, few, share]).toDF(*VIOLATION)


def projected_costs(usage: DataFrame, items: DataFrame, prices: DataFrame) -> DataFrame:
    """(topic, peak, items, cost): the mean tokens of a topic's measured answers (topic, tokens_in, tokens_out) times its number
    of items, at each price (peak, price_in, price_out for a million). Topics without a measurement use the mean of all."""
    both = [F.avg("tokens_in").alias("in"), F.avg("tokens_out").alias("out")]
    own = usage.groupBy("topic").agg(*both)
    every = usage.agg(*[c.alias(f"all_{n}") for c, n in zip((F.avg("tokens_in"), F.avg("tokens_out")), ("in", "out"), strict=True)])
    counts = items.groupBy("topic").agg(F.count(F.lit(1)).alias("items"))
    rows = counts.join(own, "topic", "left").crossJoin(F.broadcast(every)).crossJoin(F.broadcast(prices))  # one row, a few prices
    mean = lambda n: F.coalesce(n, f"all_{n}")
    return rows.select("topic", "peak", "items", (F.col("items") * (mean("in") * F.col("price_in") + mean("out") * F.col("price_out")) / 1e6).alias("cost"))


def cost_ratios(actual: DataFrame, estimate: DataFrame, prices: DataFrame) -> DataFrame:
    """(configuration, peak, actual, estimate, ratio): the cost of measured tokens (configuration, tokens_in, tokens_out) by
    price against that of estimated ones."""
    def cost(rows: DataFrame, name: str) -> DataFrame:
        total = rows.groupBy("configuration").agg(F.sum("tokens_in").alias("i"), F.sum("tokens_out").alias("o")).crossJoin(F.broadcast(prices))
        return total.select("configuration", "peak", ((F.col("i") * F.col("price_in") + F.col("o") * F.col("price_out")) / 1e6).alias(name))

    rows = cost(actual, "actual").join(cost(estimate, "estimate"), ["configuration", "peak"], "full")
    return rows.withColumn("ratio", F.col("actual") / F.nullif(F.col("estimate"), F.lit(0.0)))


def evaluable(items: DataFrame, split: str) -> tuple[DataFrame, DataFrame]:
    """Items (split, answerable, evidence) of a split that can be scored, and (reason, n) of its items by what keeps them out."""
    reason = F.when(~F.coalesce(F.col("answerable"), F.lit(False)), "not answerable").when(F.coalesce(F.size("evidence"), F.lit(0)) <= 0, "no evidence").otherwise("kept")
    rows = items.where(F.col("split") == split).withColumn("_reason", reason)
    return rows.where("_reason = 'kept'").drop("_reason"), rows.groupBy(F.col("_reason").alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def content_version(documents: DataFrame) -> DataFrame:
    """(version): the number of READY documents and the latest change among them in milliseconds, 0 if there is none."""
    ready = documents.where(F.col("status") == "READY").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max(F.unix_millis("updated_at")), F.lit(0)).alias("at"))
    return ready.select(F.concat_ws("-", F.col("n").cast("string"), F.col("at").cast("string")).alias("version"))


def stale(documents: DataFrame, now: str, seconds: int) -> DataFrame:
    """Documents that wait or are in work since more than ``seconds``."""
    return documents.where(F.col("status").isin("PENDING", "PROCESSING") & (F.unix_millis(F.to_timestamp(F.lit(now))) - F.unix_millis("updated_at") > 1000 * seconds))


def first_contents(uploads: DataFrame) -> DataFrame:
    """Uploads (upload_id, owner_id, sha256) with ``same_as``: the owner's first upload of the same content, null for that one."""
    w = Window.partitionBy("owner_id", "sha256")
    return uploads.withColumn("_first", F.min("upload_id").over(w)).withColumn("same_as", F.when(F.col("_first") < F.col("upload_id"), F.col("_first"))).drop("_first")


def last_wins(rows: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The last row of each key by ``order``; ties take the greatest of the rest, so the result doesn't depend on how rows
    are dealt out. Partial maxima in each task, no sort of a key's rows."""
    rest = [c for c in rows.columns if c not in keys and c != order]
    best = rows.groupBy(*keys).agg(F.max(F.struct(order, *rest)).alias("_r"))
    return best.select(*keys, "_r.*")


def funnel_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = [("type", F.col("style") == "active"), ("name", ~F.col("fund_name").rlike("7$")), ("theme", F.col("theme") != "ASIA")]
    return funnel(view(spark, sf_dir, "funds"), steps)[1]


def rejected_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = run(spark, sf_dir, "SELECT f.fund_code, CASE WHEN CAST(f.fund_code AS INT) % 9 > 0 THEN f.established END AS established, s.net_assets AS scale FROM {funds} f LEFT JOIN {fund_scale} s ON s.fund_code = f.fund_code AND s.report_period = '1997Q2'")
    return rejected(rows, "2002-02-15", 2, 1_000_000).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def announced_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = run(spark, sf_dir, "SELECT lpad(CAST(o_custkey % 100 AS STRING), 6, '0') AS fund_code, concat('notice ', o_orderpriority) AS title, CAST(o_orderdate AS DATE) AS published FROM {orders}")
    return recent_announcements(rows, "URGENT", "1997-06-30")


def portfolio_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    funds = run(spark, sf_dir, "SELECT * FROM {funds} UNION ALL SELECT * FROM {funds} WHERE fund_code LIKE '%3'")
    shares = view(spark, sf_dir, "share_classes").where("NOT (share_class = 'C' AND fund_code LIKE '%5')")
    return portfolio_violations(funds, shares, {"ASIA": 1, "EUROPE": 1_000_000}, (3.0, 9.0), 8)


def distribution_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = run(spark, sf_dir, "SELECT lang, source, doc_id % 3 AS split, array(doc_id % 7, doc_id % 5) AS funds FROM {documents}")
    return distribution(rows, ["lang", "source", "split"], [("lang", "split")], "funds")


def dataset_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = run(spark, sf_dir, "SELECT CASE WHEN o_orderkey % 50 = 0 THEN 'same' WHEN o_orderkey % 51 = 0 THEN concat('x ', o_orderkey) ELSE concat('q-', o_orderkey) END AS id, o_orderpriority AS topic, CASE WHEN o_orderkey % 4 = 0 THEN 'dev' ELSE 'test' END AS split FROM {orders}")
    return dataset_violations(rows, r"^[a-z]+(-\d+)?$", {"1-URGENT": 1, "2-HIGH": 1_000_000_000, "none": 1}, (0.3, 0.4))


def _prices(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(True, 2.0, 8.0), (False, 1.0, 4.0)], "peak boolean, price_in double, price_out double")


def projection_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    usage = run(spark, sf_dir, "SELECT event_type AS topic, floor(value) AS tokens_in, user_id AS tokens_out FROM {events} WHERE event_type <> 'error' AND user_id % 2 = 0")
    found = projected_costs(usage, run(spark, sf_dir, "SELECT event_type AS topic FROM {events}"), _prices(spark))
    return found.select("topic", "peak", "items", F.round("cost", 6).alias("cost"))


def ratio_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    actual = run(spark, sf_dir, "SELECT user_id % 5 AS configuration, floor(value) AS tokens_in, user_id AS tokens_out FROM {events} WHERE event_type <> 'error'")
    estimate = run(spark, sf_dir, "SELECT user_id % 6 AS configuration, 50 AS tokens_in, 60 AS tokens_out FROM {events}")
    return cost_ratios(actual, estimate, _prices(spark)).select("configuration", "peak", *[F.round(c, 6).alias(c) for c in ("actual", "estimate", "ratio")])


def evaluable_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = run(spark, sf_dir, "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 = 0 THEN 'dev' ELSE 'test' END AS split, CASE WHEN o_orderkey % 5 > 0 THEN o_orderkey % 7 > 0 END AS answerable, CASE WHEN o_orderkey % 3 > 0 THEN array('e') WHEN o_orderkey % 2 = 0 THEN array() END AS evidence FROM {orders}")
    return evaluable(rows, "test")[1]


_UPLOADS = "SELECT event_id AS upload_id, user_id % 9 AS owner_id, sha2(CAST(CAST(floor(value) AS BIGINT) AS STRING), 256) AS sha256 FROM {events}"
_STATES = "SELECT event_id AS doc_id, CASE event_type WHEN 'view' THEN 'READY' WHEN 'error' THEN 'PROCESSING' WHEN 'click' THEN 'PENDING' ELSE 'FAILED' END AS status, CAST(ts AS TIMESTAMP) AS updated_at FROM {events}"


def contents_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return first_contents(run(spark, sf_dir, _UPLOADS)).select("upload_id", "same_as")


QUERIES = {
    "f2_funnel": funnel_query, "f3_rejected": rejected_query, "f5_announced": announced_query, "a4_portfolio": portfolio_query, "a31_distribution": distribution_query, "d4_dataset": dataset_query, "a33_projected": projection_query, "a36_ratios": ratio_query, "f8_evaluable": evaluable_query, "u6_contents": contents_query,
    "a27_version": lambda spark, sf_dir: content_version(run(spark, sf_dir, _STATES)),
    "a29_stale": lambda spark, sf_dir: stale(run(spark, sf_dir, _STATES), "2024-01-20 00:00:00", 86_400).select("doc_id"),
    "a5_latest": lambda spark, sf_dir: last_wins(run(spark, sf_dir, "SELECT user_id, event_type, floor(value) AS place, event_id FROM {events}"), ["user_id", "event_type"], "place").select("user_id", "event_type", F.col("place").cast("long").alias("place"), "event_id"),
}
_COST = "(2 - CAST(NOT peak AS INT))"
ORACLE_SQL = {
    "f2_funnel": oracle("""
        SELECT 0 AS step_no, 'all' AS step, count(*) AS n FROM {funds} UNION ALL SELECT 1, 'type', count(*) FROM {funds} WHERE style = 'active' UNION ALL SELECT 2, 'name', count(*) FROM {funds} WHERE style = 'active' AND right(fund_name, 1) <> '7'
        UNION ALL SELECT 3, 'theme', count(*) FROM {funds} WHERE style = 'active' AND right(fund_name, 1) <> '7' AND theme <> 'ASIA'"""),
    "f3_rejected": oracle("""
        SELECT reason, count(*) AS n FROM (SELECT CASE WHEN CAST(f.fund_code AS INT) % 9 = 0 THEN 'no founding date' WHEN f.established > DATE '2000-02-15' THEN 'too young' WHEN s.net_assets IS NULL THEN 'no scale' WHEN s.net_assets < 1000000 THEN 'too small' END AS reason
          FROM {funds} f LEFT JOIN {fund_scale} s ON s.fund_code = f.fund_code AND s.report_period = '1997Q2') x GROUP BY reason"""),
    "f5_announced": "SELECT lpad(CAST(o_custkey % 100 AS VARCHAR), 6, '0') AS fund_code, count(DISTINCT CAST(o_orderdate AS DATE)) AS dates FROM orders WHERE o_orderpriority LIKE '%URGENT%' AND CAST(o_orderdate AS DATE) >= DATE '1995-06-30' AND CAST(o_orderdate AS DATE) <= DATE '1997-06-30' GROUP BY 1",
    "a4_portfolio": oracle("""
        SELECT 'theme size' AS rule, theme AS key, CAST(count(*) AS VARCHAR) AS detail FROM (SELECT theme, fund_code FROM {funds} UNION ALL SELECT theme, fund_code FROM {funds} WHERE fund_code LIKE '%3') x WHERE theme = 'ASIA' GROUP BY theme HAVING count(*) > 1
        UNION ALL SELECT 'active to index', 'all', concat(a, ':', i) FROM (SELECT sum(CASE WHEN style = 'active' THEN w ELSE 0 END) AS a, sum(CASE WHEN style = 'index' THEN w ELSE 0 END) AS i FROM (SELECT style, CASE WHEN fund_code LIKE '%3' THEN 2 ELSE 1 END AS w FROM {funds}) y) z WHERE i = 0 OR a < 3 * i OR a > 9 * i
        UNION ALL SELECT 'companies', 'all', CAST(count(DISTINCT company) AS VARCHAR) FROM {funds} HAVING count(DISTINCT company) < 8
        UNION ALL SELECT 'repeated code', fund_code, '2' FROM {funds} WHERE fund_code LIKE '%3' UNION ALL SELECT 'share pair', fund_code, 'A' FROM {funds} WHERE fund_code LIKE '%5'"""),
    "a31_distribution": """
        SELECT 'all' AS dim, '' AS name, count(*) AS n FROM documents HAVING count(*) > 0 UNION ALL SELECT 'lang', lang, count(*) FROM documents GROUP BY lang UNION ALL SELECT 'source', source, count(*) FROM documents GROUP BY source UNION ALL SELECT 'split', CAST(doc_id % 3 AS VARCHAR), count(*) FROM documents GROUP BY doc_id % 3
        UNION ALL SELECT 'lang x split', concat(lang, ' x ', doc_id % 3), count(*) FROM documents GROUP BY lang, doc_id % 3 UNION ALL SELECT 'distinct funds', '', count(DISTINCT f) FROM (SELECT doc_id % 7 AS f FROM documents UNION ALL SELECT doc_id % 5 FROM documents) x""",
    "d4_dataset": """
        WITH i AS (SELECT CASE WHEN o_orderkey % 50 = 0 THEN 'same' WHEN o_orderkey % 51 = 0 THEN concat('x ', o_orderkey) ELSE concat('q-', o_orderkey) END AS id, o_orderpriority AS topic, o_orderkey % 4 = 0 AS dev FROM orders)
        SELECT 'id form' AS rule, id AS key, '' AS detail FROM i WHERE id LIKE 'x %' UNION ALL SELECT 'repeated id', id, CAST(count(*) AS VARCHAR) FROM i GROUP BY id HAVING count(*) > 1 UNION ALL SELECT 'few items', '2-HIGH', CAST(count(*) AS VARCHAR) FROM i WHERE topic = '2-HIGH' UNION ALL SELECT 'few items', 'none', '0'
        UNION ALL SELECT 'few items', '1-URGENT', '0' FROM i HAVING count(*) FILTER (topic = '1-URGENT') = 0 UNION ALL SELECT 'dev share', 'all', printf('%.3f', avg(CAST(dev AS INT))) FROM i HAVING avg(CAST(dev AS INT)) NOT BETWEEN 0.3 AND 0.4""",
    "a33_projected": f"""
        WITH u AS (SELECT event_type AS topic, floor(value) AS i, user_id AS o FROM events WHERE event_type <> 'error' AND user_id % 2 = 0), c AS (SELECT event_type AS topic, count(*) AS items FROM events GROUP BY event_type),
          m AS (SELECT topic, avg(i) AS i, avg(o) AS o FROM u GROUP BY topic), a AS (SELECT avg(i) AS i, avg(o) AS o FROM u), p AS (SELECT true AS peak UNION ALL SELECT false)
        SELECT c.topic, peak, items, round(items * (coalesce(m.i, a.i) + 4 * coalesce(m.o, a.o)) * {_COST} / 1e6, 6) AS cost FROM c LEFT JOIN m USING (topic) CROSS JOIN a CROSS JOIN p""",
    "a36_ratios": f"""
        WITH x AS (SELECT user_id % 5 AS configuration, sum(floor(value)) + 4 * sum(user_id) AS c FROM events WHERE event_type <> 'error' GROUP BY 1), y AS (SELECT user_id % 6 AS configuration, count(*) * 290 AS c FROM events GROUP BY 1), p AS (SELECT true AS peak UNION ALL SELECT false)
        SELECT configuration, peak, round(x.c * {_COST} / 1e6, 6) AS actual, round(y.c * {_COST} / 1e6, 6) AS estimate, round((x.c * {_COST} / 1e6) / (y.c * {_COST} / 1e6), 6) AS ratio FROM x FULL JOIN y USING (configuration) CROSS JOIN p""",
    "f8_evaluable": "SELECT CASE WHEN o_orderkey % 5 = 0 OR o_orderkey % 7 = 0 THEN 'not answerable' WHEN o_orderkey % 3 = 0 THEN 'no evidence' ELSE 'kept' END AS reason, count(*) AS n FROM orders WHERE o_orderkey % 4 <> 0 GROUP BY 1",
    "u6_contents": "SELECT event_id AS upload_id, nullif(min(event_id) OVER (PARTITION BY user_id % 9, floor(value)), event_id) AS same_as FROM events",
    "a27_version": "SELECT concat(count(*), '-', coalesce(max(epoch_us(ts) // 1000), 0)) AS version FROM events WHERE event_type = 'view'",
    "a29_stale": "SELECT event_id AS doc_id FROM events WHERE event_type IN ('error', 'click') AND epoch_us(TIMESTAMP '2024-01-20 00:00:00') // 1000 - epoch_us(ts) // 1000 > 86400000",
    "a5_latest": "SELECT user_id, event_type, CAST(floor(value) AS BIGINT) AS place, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY floor(value) DESC, event_id DESC) = 1",
}
