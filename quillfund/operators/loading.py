"""Load checks, dialogue windows, quotas and roll-ups of evaluation runs.

Rows that break a rule become problem rows and are not loaded; roll-ups are one pass over grouping sets; windows keep the
first rows of a key, which Spark cuts in each task before it shuffles.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillfund.plans.views import oracle, run, view


def with_accumulated(nav: DataFrame, accumulated: DataFrame) -> DataFrame:
    """NAVs (share_code, nav_date, unit_nav) with ``accumulated_nav`` of the same day, null where the other table has none; of
    several the greatest."""
    side = accumulated.groupBy("share_code", "nav_date").agg(F.max("accumulated_nav").alias("accumulated_nav"))
    return nav.join(side, ["share_code", "nav_date"], "left")


def load_returns(ranking: DataFrame, codes: DataFrame, as_of: str, periods: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(loaded, problems): the ranking's period columns as rows (share_code, period, ret) for the codes asked for, nulls left
    out; a code that the ranking lacks, or has for another day, is a problem (share_code, problem) and not loaded."""
    rows = codes.select("share_code").distinct().join(ranking.withColumn("_found", F.lit(True)), "share_code", "left")
    problem = F.when(F.col("_found").isNull(), "missing").when(~F.col("as_of").eqNullSafe(F.to_date(F.lit(as_of))), "date")
    rows = rows.withColumn("problem", problem)
    long = rows.where("problem IS NULL").select("share_code", F.explode(F.create_map(*[x for p in periods for x in (F.lit(p), F.col(p))])).alias("period", "ret"))
    return long.where("ret IS NOT NULL"), rows.where("problem IS NOT NULL").select("share_code", "problem")


def incomplete(expected: DataFrame, actual: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, expected_rows, actual_rows) where a key has fewer or more rows than are expected (``n``); keys that only one side
    has count zero on the other."""
    counts = actual.groupBy(*keys).agg(F.count(F.lit(1)).alias("actual_rows"))
    both = expected.groupBy(*keys).agg(F.sum("n").alias("expected_rows")).join(counts, list(keys), "full")
    both = both.fillna(0, ["expected_rows", "actual_rows"])
    return both.where("expected_rows <> actual_rows").select(*keys, "expected_rows", "actual_rows")


def general_table(tables: DataFrame, special: str) -> DataFrame:
    """Of a document's candidate fee tables (doc_id, table_no, title, max_rate) the one with the highest rate among those whose
    title doesn't match ``special``; ties take the first table."""
    rows = tables.where(~F.coalesce(F.col("title").rlike(special), F.lit(False)))
    best = rows.groupBy("doc_id").agg(F.max(F.struct("max_rate", (-F.col("table_no")).alias("at"))).alias("b"))
    return best.select("doc_id", (-F.col("b.at")).alias("table_no"), F.col("b.max_rate").alias("max_rate"))


def first_of_strata(rows: DataFrame, strata: Sequence[str], order: str, n: int) -> DataFrame:
    """The ``n`` smallest rows of each stratum by ``order``."""
    w = Window.partitionBy(*strata).orderBy(order)
    return rows.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= n).drop("_k")


def recent_rounds(messages: DataFrame, rounds: int) -> DataFrame:
    """(conv_id, question_turn, answer_turn): of the last 4 x ``rounds`` messages (conv_id, turn, role, ok) of a conversation the
    last ``rounds`` pairs of a user's message and the good answer right behind it."""
    back, along = Window.partitionBy("conv_id").orderBy(F.desc("turn")), Window.partitionBy("conv_id").orderBy("turn")
    rows = messages.withColumn("_back", F.row_number().over(back)).where(F.col("_back") <= 4 * rounds)
    rows = rows.select("conv_id", "turn", "role", *[F.lead(c).over(along).alias(f"_{c}") for c in ("role", "ok", "turn")])
    pairs = rows.where((F.col("role") == "user") & (F.col("_role") == "assistant") & F.col("_ok")).withColumn("_k", F.row_number().over(back))
    return pairs.where(F.col("_k") <= rounds).select("conv_id", F.col("turn").alias("question_turn"), F.col("_turn").alias("answer_turn"))


def admitted(calls: DataFrame, most_calls: int, most_tokens: int, zone: str = "UTC") -> DataFrame:
    """Calls (user_id, event_id, ts, tokens) with ``admitted``: fewer than ``most_calls`` calls and ``most_tokens`` tokens came
    before on the user's day in ``zone``. The last admitted call may pass the limit; what is refused is the day's rest, so
    running sums over all calls are exact."""
    day = F.to_date(F.from_utc_timestamp("ts", zone))
    w = Window.partitionBy("user_id", day).orderBy("ts", "event_id")
    before = F.coalesce(F.sum("tokens").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return calls.withColumn("admitted", (F.row_number().over(w) <= most_calls) & (before < most_tokens))


def rolled_up(rows: DataFrame, by: Sequence[str], **measures) -> DataFrame:
    """``measures`` over all rows and by each of the columns ``by``, in one pass: (dim, name, measures); a null is the empty
    name. Grouping sets without the combinations of columns."""
    cells = [F.struct(F.lit("all").alias("dim"), F.lit("").alias("name")), *[F.struct(F.lit(c).alias("dim"), F.coalesce(F.col(c).cast("string"), F.lit("")).alias("name")) for c in by]]
    return rows.withColumn("_c", F.explode(F.array(*cells))).groupBy("_c.dim", "_c.name").agg(*[m.alias(name) for name, m in measures.items()])


def answer_scores(runs: DataFrame, by: Sequence[str]) -> DataFrame:
    """Roll-up of judged answers (completed, correct, tokens, cost; correct null: not judged): ``acc_all`` counts failed runs as
    wrong, ``acc_completed`` leaves them out, both leave out what nobody judged."""
    good = F.col("correct").cast("double")
    failed = ~F.coalesce(F.col("completed"), F.lit(False))
    return rolled_up(runs, by, n=F.count(F.lit(1)), n_failed=F.count_if(failed), acc_all=F.avg(F.when(failed, 0.0).otherwise(good)), acc_completed=F.avg(F.when(~failed, good)), tokens=F.sum("tokens"), cost=F.sum("cost"))


def ingest_summary(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """By document type: documents and pages (doc_id, doc_type, pages, seconds), seconds of work, chunks and chunks of tables
    (doc_id, is_table), documents without chunks."""
    held = chunks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunks"), F.count_if("is_table").alias("tables"))
    rows = documents.join(held, "doc_id", "left").fillna(0, ["chunks", "tables"])
    return rows.groupBy("doc_type").agg(F.count(F.lit(1)).alias("documents"), F.sum("pages").alias("pages"), F.sum("seconds").alias("seconds"), F.sum("chunks").alias("chunks"), F.sum("tables").alias("table_chunks"), F.count_if(F.col("chunks") == 0).alias("empty"))


def accumulated_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = run(spark, sf_dir, "SELECT n.share_code, n.nav_date, n.unit_nav + sum(coalesce(d.cash_per_unit, 0)) OVER (PARTITION BY n.share_code ORDER BY n.nav_date) AS accumulated_nav FROM {nav_daily} n LEFT JOIN {dividends} d ON d.share_code = n.share_code AND d.ex_date = n.nav_date WHERE day(n.nav_date) % 5 <> 0")
    return with_accumulated(view(spark, sf_dir, "nav_daily"), total).select("share_code", "nav_date", F.round("accumulated_nav", 6).alias("accumulated_nav"))


def returns_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranking = run(spark, sf_dir, "SELECT share_code, max(nav_date) AS as_of, max(unit_nav) AS m1, CASE WHEN CAST(share_code AS INT) % 2 = 0 THEN min(unit_nav) END AS m3 FROM {nav_daily} GROUP BY share_code")
    loaded, problems = load_returns(ranking, run(spark, sf_dir, "SELECT lpad(CAST(s_suppkey AS STRING), 6, '0') AS share_code FROM {supplier} UNION ALL SELECT 'none'"), "2024-01-30", ["m1", "m3"])
    return loaded.select("share_code", "period", F.round("ret", 6).alias("ret"), F.lit(None).cast("string").alias("problem")).unionByName(problems.select("share_code", F.lit(None).cast("string").alias("period"), F.lit(None).cast("double").alias("ret"), "problem"))


def incomplete_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    expected = run(spark, sf_dir, "SELECT fund_code, CASE WHEN CAST(fund_code AS INT) % 5 = 0 THEN 3 ELSE 2 END AS n FROM {funds} UNION ALL SELECT 'none', 1")
    return incomplete(expected, run(spark, sf_dir, "SELECT fund_code FROM {share_classes} WHERE fund_code NOT LIKE '%7'"), ["fund_code"])


def table_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = run(spark, sf_dir, "SELECT l_suppkey AS doc_id, CAST(l_orderkey * 8 + l_linenumber AS BIGINT) AS table_no, CASE l_returnflag WHEN 'R' THEN 'pension clients' ELSE 'all clients' END AS title, CAST(floor(l_extendedprice / 1000) AS BIGINT) AS max_rate FROM {lineitem}")
    return general_table(rows, "pension")


def strata_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return first_of_strata(run(spark, sf_dir, "SELECT o_orderpriority, o_custkey % 5 AS part, o_orderkey FROM {orders}"), ["o_orderpriority", "part"], "o_orderkey", 7)


def rounds_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recent_rounds(run(spark, sf_dir, "SELECT conv_id, turn, role, (conv_id + turn) % 5 <> 0 AS ok FROM {conversations}"), 2)


def admitted_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = run(spark, sf_dir, "SELECT user_id, event_id, CAST(ts AS TIMESTAMP) AS ts, CAST(floor(value) AS BIGINT) AS tokens FROM {events}")
    return admitted(calls, 3, 200, "Asia/Shanghai").select("event_id", "admitted")


def scores_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = run(spark, sf_dir, "SELECT event_type AS type, user_id % 4 AS topic, user_id % 10 <> 0 AS completed, CASE WHEN event_id % 3 > 0 THEN value > 100 END AS correct, user_id AS tokens, CAST(event_id % 7 AS DOUBLE) AS cost FROM {events}")
    return answer_scores(runs, ["type", "topic"]).select("dim", "name", "n", "n_failed", F.round("acc_all", 6).alias("acc_all"), F.round("acc_completed", 6).alias("acc_completed"), "tokens", "cost")


def metrics_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = run(spark, sf_dir, "SELECT event_type AS topic, user_id % 3 AS style, CASE WHEN value > 50 THEN 1.0E0 ELSE 0.0E0 END AS hit_1, value / 300 AS mrr FROM {events}")
    return rolled_up(rows, ["topic", "style"], n=F.count(F.lit(1)), hit_1=F.round(F.avg("hit_1"), 6), mrr=F.round(F.avg("mrr"), 6))


def summary_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = run(spark, sf_dir, "SELECT doc_id, lang AS doc_type, n_chars % 7 AS pages, CAST(n_chars % 11 AS DOUBLE) AS seconds FROM {documents}")
    chunks = run(spark, sf_dir, "SELECT doc_id, k % 4 = 0 AS is_table FROM (SELECT doc_id, posexplode(split(text, '\n')) AS (k, line) FROM {documents}) x WHERE line LIKE '% the %'")
    return ingest_summary(chunks, docs)


QUERIES = {
    "j1_accumulated": accumulated_query, "d2_loaded_returns": returns_query, "d3_incomplete": incomplete_query, "w17_general_table": table_query, "w18_first_rows": strata_query, "w13_rounds": rounds_query, "w12_admitted": admitted_query,
    "a8_answer_scores": scores_query, "a7_metrics": metrics_query, "a30_summary": summary_query,
}
_SCORES = "count(*) AS n, count(*) FILTER (user_id % 10 = 0) AS n_failed, round(avg(CASE WHEN user_id % 10 = 0 THEN 0.0 WHEN event_id % 3 > 0 THEN CAST(value > 100 AS INT) END), 6) AS acc_all, round(avg(CASE WHEN user_id % 10 <> 0 AND event_id % 3 > 0 THEN CAST(value > 100 AS INT) END), 6) AS acc_completed, CAST(sum(user_id) AS BIGINT) AS tokens, CAST(sum(event_id % 7) AS DOUBLE) AS cost FROM events"
_METRICS = "count(*) AS n, round(avg(CASE WHEN value > 50 THEN 1 ELSE 0 END), 6) AS hit_1, round(avg(value / 300), 6) AS mrr FROM events"
ORACLE_SQL = {
    "j1_accumulated": oracle("""
        SELECT n.share_code, n.nav_date, CASE WHEN day(n.nav_date) % 5 <> 0 THEN round(n.unit_nav + (SELECT coalesce(sum(d.cash_per_unit), 0) FROM {dividends} d WHERE d.share_code = n.share_code AND d.ex_date <= n.nav_date AND day(d.ex_date) % 5 <> 0), 6) END AS accumulated_nav FROM {nav_daily} n"""),
    "d2_loaded_returns": oracle("""
        SELECT lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS share_code, p.period, CASE p.period WHEN 'm1' THEN round(m1, 6) ELSE round(m3, 6) END AS ret, NULL AS problem
        FROM supplier JOIN (SELECT share_code, max(nav_date) AS last, max(unit_nav) AS m1, min(unit_nav) AS m3 FROM {nav_daily} GROUP BY share_code) n ON n.share_code = lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AND last = DATE '2024-01-30' CROSS JOIN (SELECT 'm1' AS period UNION ALL SELECT 'm3') p WHERE p.period = 'm1' OR s_suppkey % 2 = 0
        UNION ALL SELECT c.share_code, NULL, NULL, CASE WHEN n.share_code IS NULL THEN 'missing' ELSE 'date' END FROM (SELECT lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS share_code FROM supplier UNION ALL SELECT 'none') c LEFT JOIN (SELECT share_code, max(nav_date) AS last FROM {nav_daily} GROUP BY share_code) n ON n.share_code = c.share_code WHERE n.share_code IS NULL OR last <> DATE '2024-01-30'"""),
    "d3_incomplete": """
        SELECT fund_code, CAST(e AS BIGINT) AS expected_rows, CAST(a AS BIGINT) AS actual_rows FROM (SELECT lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS fund_code, CASE WHEN s_suppkey % 5 = 0 THEN 3 ELSE 2 END AS e, CASE WHEN s_suppkey % 10 = 7 THEN 0 ELSE 2 END AS a FROM supplier UNION ALL SELECT 'none', 1, 0) x WHERE e <> a""",
    "w17_general_table": "SELECT doc_id, table_no, max_rate FROM (SELECT l_suppkey AS doc_id, CAST(l_orderkey * 8 + l_linenumber AS BIGINT) AS table_no, CAST(floor(l_extendedprice / 1000) AS BIGINT) AS max_rate FROM lineitem WHERE l_returnflag <> 'R') x QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY max_rate DESC, table_no) = 1",
    "w18_first_rows": "SELECT o_orderpriority, o_custkey % 5 AS part, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderpriority, o_custkey % 5 ORDER BY o_orderkey) <= 7",
    "w13_rounds": """
        WITH m AS (SELECT conv_id, turn, role, max(turn) OVER (PARTITION BY conv_id) AS last, count(*) OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations),
          p AS (SELECT a.conv_id, a.turn AS q, min(b.turn) AS n FROM m a JOIN m b ON b.conv_id = a.conv_id AND b.turn > a.turn AND b.back <= 8 WHERE a.back <= 8 AND a.role = 'user' GROUP BY a.conv_id, a.turn)
        SELECT p.conv_id, q AS question_turn, n AS answer_turn FROM p JOIN m ON m.conv_id = p.conv_id AND m.turn = p.n AND m.role = 'assistant' AND (m.conv_id + m.turn) % 5 <> 0 QUALIFY row_number() OVER (PARTITION BY p.conv_id ORDER BY q DESC) <= 2""",
    "w12_admitted": """
        WITH c AS (SELECT event_id, user_id, CAST(ts + INTERVAL 8 HOUR AS DATE) AS day, ts, floor(value) AS tokens FROM events)
        SELECT event_id, row_number() OVER w <= 3 AND coalesce(sum(tokens) OVER (PARTITION BY user_id, day ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < 200 AS admitted FROM c WINDOW w AS (PARTITION BY user_id, day ORDER BY ts, event_id)""",
    "a8_answer_scores": f"SELECT 'all' AS dim, '' AS name, {_SCORES} UNION ALL SELECT 'type', event_type, {_SCORES} GROUP BY event_type UNION ALL SELECT 'topic', CAST(user_id % 4 AS VARCHAR), {_SCORES} GROUP BY user_id % 4",
    "a7_metrics": f"SELECT 'all' AS dim, '' AS name, {_METRICS} UNION ALL SELECT 'topic', event_type, {_METRICS} GROUP BY event_type UNION ALL SELECT 'style', CAST(user_id % 3 AS VARCHAR), {_METRICS} GROUP BY user_id % 3",
    "a30_summary": """
        WITH c AS (SELECT doc_id, count(*) AS n, count(*) FILTER ((k - 1) % 4 = 0) AS t FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM documents) x WHERE contains(line, ' the ') GROUP BY doc_id)
        SELECT lang AS doc_type, count(*) AS documents, CAST(sum(n_chars % 7) AS BIGINT) AS pages, CAST(sum(n_chars % 11) AS DOUBLE) AS seconds, CAST(coalesce(sum(n), 0) AS BIGINT) AS chunks, CAST(coalesce(sum(t), 0) AS BIGINT) AS table_chunks, count(*) FILTER (n IS NULL) AS empty FROM documents LEFT JOIN c USING (doc_id) GROUP BY lang""",
}
