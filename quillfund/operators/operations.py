"""Load tests, costs, answers and the bounded SQL runner."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillfund.operators.statistics import nearest_place, order_values, percentiles, same_keys
from quillfund.plans.views import VIEWS, oracle, run, view


def load_window(rows: DataFrame, start: float | None = None, end: float | None = None) -> DataFrame:
    """Requests that finished in [start, end) (t_end, ok, total_ms, error): counts, error rate, QPS, mean, percentiles, and
    errors by message cut at 80 characters."""
    if start is not None and end is not None:
        rows = rows.where((F.col("t_end") >= start) & (F.col("t_end") < end))
    span = F.lit(end - start) if start is not None and end is not None else F.max("t_end") - F.min("t_end")
    stats = rows.agg(
        F.count(F.lit(1)).alias("n"), F.count_if("ok").alias("n_ok"), F.avg((~F.col("ok")).cast("double")).alias("error_rate"), (F.count(F.lit(1)) / F.nullif(span, F.lit(0.0))).alias("qps"), F.avg("total_ms").alias("mean_ms"),
    )
    found = percentiles(rows.withColumn("total_ms", F.col("total_ms").cast("double")), [], "total_ms", {f"p{p}_ms": p / 100 for p in (50, 95, 99)}).drop("n")
    stats = stats.join(F.broadcast(found), F.lit(True), "left")  # one row, or none without values
    errors = rows.where("NOT ok").groupBy(F.substring("error", 1, 80).alias("message")).agg(F.count(F.lit(1)).alias("n"))
    return stats.crossJoin(errors.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("message", "n")))).alias("errors")))


def resources(samples: DataFrame) -> DataFrame:
    """Per container: samples, mean and highest CPU, highest memory in MiB."""
    return samples.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.avg("cpu_pct").alias("mean_cpu"), F.max("cpu_pct").alias("max_cpu"), (F.max("mem_bytes") / 1048576).alias("max_mib"))


def repetition_median(rows: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """Median of each metric over repetitions, nulls left out, three digits."""
    held = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in metrics])).alias("m")
    found = percentiles(rows.select(*keys, held).select(*keys, "m.*"), [*keys, "metric"], "v", {"median": 0.5})
    # Groups whose values are all null stay, with nulls.
    every = rows.select(*keys).distinct()
    wide = found.groupBy(*keys).agg(*[F.round(F.max(F.when(F.col("metric") == m, F.col("median"))), 3).alias(m) for m in metrics]).withColumnsRenamed({k: f"_{k}" for k in keys})
    return every.join(wide, same_keys(keys), "left").select(*keys, *metrics)


def costs(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """Cost of token usage (model, peak, tokens_in, tokens_out) by a price list, a row a model and mode."""
    rows = usage.join(prices, ["model", "peak"])  # broadcast by Spark if it is as small as it looks
    return rows.groupBy("model", "peak").agg(F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"), (F.sum(F.col("tokens_in") * F.col("price_in") + F.col("tokens_out") * F.col("price_out")) / 1e6).alias("cost"))


def latency_summary(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Planned and good runs with median, p90, least and greatest latency of the good ones, and the distinct failure reasons."""
    good = F.when(F.col("ok"), F.col("ms"))
    base = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("planned"), F.count_if("ok").alias("n_ok"), F.min(good).alias("min_ms"), F.max(good).alias("max_ms"), F.sort_array(F.collect_set(F.when(~F.col("ok"), F.col("reason")))).alias("reasons"))
    ranks = {"median_ms": lambda n: nearest_place(n, 50), "p90_ms": lambda n: nearest_place(n, 90)}
    found = order_values(rows.where("ok"), keys, "ms", ranks).drop("n").withColumnsRenamed({k: f"_{k}" for k in keys})
    joined = base.join(found, same_keys(keys), "left")
    return joined.select(*keys, "planned", "n_ok", *ranks, "min_ms", "max_ms", "reasons")


def tool_scores(expected: Column, called: Column, ignored: str = "get_schema") -> Column:
    """struct(covered, exact, over_call) of expected and called tools; the schema tool does not count."""
    want, got = (F.array_remove(F.array_distinct(c), ignored) for c in (expected, called))
    return F.struct((F.size(F.array_except(want, got)) == 0).alias("covered"), ((F.size(F.array_except(want, got)) == 0) & (F.size(F.array_except(got, want)) == 0)).alias("exact"), ((F.size(want) == 0) & (F.size(got) > 0)).alias("over_call"))


def extra_and_missing(expected: Column, actual: Column) -> Column:
    return F.struct(F.array_sort(F.array_except(actual, expected)).alias("extra"), F.array_sort(F.array_except(expected, actual)).alias("missing"))


def run_differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """(query_id, rank) where two runs rank different chunks."""
    other = b.select("query_id", "rank", F.col("chunk_id").alias("other"))
    return a.join(other, ["query_id", "rank"], "full").where(~F.col("chunk_id").eqNullSafe(F.col("other"))).select("query_id", "rank", "chunk_id", "other")


def read_tables(spark: SparkSession, query: str) -> set[str]:
    """The tables that one SELECT statement reads, lower-case, without the names it defines itself (WITH). Spark parses the
    statement, so comments, quoted names and texts that look like SQL are what they are; nothing runs."""
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(query)
    except Exception as error:  # ParseException of the JVM, by py4j's own type
        raise ValueError("one SELECT statement is allowed") from error
    kind = lambda name: spark._jvm.java.lang.Class.forName(f"org.apache.spark.sql.catalyst.plans.logical.{name}")
    if any(kind(name).isInstance(plan) for name in ("Command", "ParsedStatement")):
        raise ValueError("one SELECT statement is allowed")
    shown = plan.treeString()
    own = {name.strip().strip("`").lower() for names in re.findall(r"CTE \[([^\]]*)\]", shown) for name in names.split(",")}
    return {name.replace(", ", ".").lower() for name in re.findall(r"UnresolvedRelation \[([^\]]*)\]", shown)} - own


def bounded_sql(spark: SparkSession, sf_dir: str, query: str, most: int = 200, limit: int | None = None) -> tuple[DataFrame, bool]:
    """One read-only SELECT over the catalogue of views: at most ``most`` rows, and whether more were cut off. A smaller
    ``limit`` of the user is no cut. Only views of the catalogue can be read: they are the temporary views of a session of
    its own, in which files cannot be named as tables."""
    named = read_tables(spark, query.strip().rstrip(";"))
    if unknown := named - set(VIEWS):
        raise ValueError(f"{', '.join(sorted(unknown))} is not in the catalogue")
    alone = spark.newSession()
    alone.conf.set("spark.sql.runSQLOnFiles", "false")
    for name in named:
        view(alone, sf_dir, name).createOrReplaceTempView(name)
    rows = alone.sql(query.strip().rstrip(";"))
    if limit is not None and limit <= most:
        return rows.limit(limit), False
    taken = rows.take(most + 1)  # one run of the query; ``most`` bounds what comes to the driver
    return spark.createDataFrame(taken[:most], rows.schema), len(taken) > most


def describe(spark: SparkSession, sf_dir: str, names: list[str] | None = None) -> DataFrame:
    """The catalogue: view, number of rows, and columns with their types."""
    out = None
    for name in names or [n for n in VIEWS if "{sunday}" not in VIEWS[n]]:
        df = run(spark, sf_dir, "SELECT * FROM {" + name + "}")
        one = df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("view"), "n_rows", F.lit(", ".join(f"{c} {t}" for c, t in df.dtypes)).alias("columns"))
        out = one if out is None else out.unionByName(one)
    return out


def _load(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir, "SELECT CAST(unix_timestamp(CAST(ts AS TIMESTAMP)) AS DOUBLE) AS t_end, event_type <> 'error' AS ok, value AS total_ms, concat('user ', user_id) AS error, user_id FROM {events}")


def window_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = load_window(_load(spark, sf_dir), 1704844800.0, 1705708800.0)
    return found.select("n", "n_ok", F.round("error_rate", 6).alias("error_rate"), F.round("qps", 6).alias("qps"), F.round("mean_ms", 6).alias("mean_ms"), *[F.round(f"p{p}_ms", 6).alias(f"p{p}_ms") for p in (50, 95, 99)], F.size("errors").alias("messages"))


def latency_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _load(spark, sf_dir).select("user_id", "ok", F.col("total_ms").alias("ms"), F.lit("error").alias("reason"))
    return latency_summary(rows, ["user_id"]).select("user_id", "planned", "n_ok", "median_ms", "p90_ms", "min_ms", "max_ms")


def cost_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    usage = run(spark, sf_dir, "SELECT event_type AS model, user_id % 2 = 0 AS peak, CAST(round(value) AS BIGINT) AS tokens_in, CAST(event_id % 100 AS BIGINT) AS tokens_out FROM {events}")
    prices = spark.createDataFrame([(m, p, 2.0 + p, 8.0) for m in ("view", "click", "purchase") for p in (True, False)], "model string, peak boolean, price_in double, price_out double")
    return costs(usage, prices).withColumn("cost", F.round("cost", 6))


_CATALOGUE = ("funds", "share_classes", "nav_daily", "fund_scale", "managers")
QUERIES = {"a18_load_window": window_query, "a32_latency_summary": latency_query, "p29_token_costs": cost_query, "c10_catalogue": lambda spark, sf_dir: describe(spark, sf_dir, list(_CATALOGUE)).select("view", "n_rows")}
ORACLE_SQL = {
    "c10_catalogue": oracle(" UNION ALL ".join(f"SELECT '{v}' AS view, count(*) AS n_rows FROM {{{v}}}" for v in _CATALOGUE)),
    "a18_load_window": """
        SELECT count(*) AS n, count(*) FILTER (event_type <> 'error') AS n_ok, round(avg(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0 END), 6) AS error_rate, round(count(*) / 864000.0, 6) AS qps, round(avg(value), 6) AS mean_ms,
          round(quantile_cont(value, 0.5), 6) AS p50_ms, round(quantile_cont(value, 0.95), 6) AS p95_ms, round(quantile_cont(value, 0.99), 6) AS p99_ms, CAST(count(DISTINCT user_id) FILTER (event_type = 'error') AS INT) AS messages FROM events WHERE epoch(ts) >= 1704844800 AND epoch(ts) < 1705708800""",
    "a32_latency_summary": """
        SELECT user_id, n AS planned, len(v) AS n_ok, v[greatest(1, CAST(ceil(len(v) * 0.5) AS INT))] AS median_ms, v[greatest(1, CAST(ceil(len(v) * 90 / 100) AS INT))] AS p90_ms, v[1] AS min_ms, v[len(v)] AS max_ms
        FROM (SELECT user_id, count(*) AS n, list_sort(list(value) FILTER (event_type <> 'error')) AS v FROM events GROUP BY user_id) x""",
    "p29_token_costs": "SELECT event_type AS model, user_id % 2 = 0 AS peak, CAST(sum(CAST(round(value) AS BIGINT)) AS BIGINT) AS tokens_in, CAST(sum(event_id % 100) AS BIGINT) AS tokens_out, round(sum(CAST(round(value) AS BIGINT) * CASE WHEN user_id % 2 = 0 THEN 3.0 ELSE 2.0 END + event_id % 100 * 8.0) / 1e6, 6) AS cost FROM events WHERE event_type IN ('view', 'click', 'purchase') GROUP BY ALL",
}
