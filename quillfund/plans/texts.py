"""Queries that run the library's functions on texts, sources and scopes over the driver's tables, each with SQL written by
hand for DuckDB. Lines of documents stand for pages and chunks; the SQL states the expected answer on its own."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillfund.operators import answers, documents, operations, retrieval
from quillfund.plans.views import oracle, run, view
from quillfund.scratch import scratch_path
from quillfund.sources import snapshots


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, k (from 0), text: every line of every document."""
    return run(spark, sf_dir, "SELECT doc_id, text FROM {documents}").select("doc_id", F.posexplode(F.split("text", "\n")).alias("k", "text"))


def line_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as chunks; those with a digit count as tables."""
    return documents.length_stats(_lines(spark, sf_dir).withColumn("is_table", F.col("text").rlike("[0-9]")))


def full_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document cites the head of its second line; every seventh cites something else."""
    lines = _lines(spark, sf_dir)
    snippet = F.when(F.col("doc_id") % 7 == 0, "no such line").otherwise(F.substring("text", 1, 10))
    cited = lines.where("k = 1").select(F.col("doc_id").alias("cite_id"), "doc_id", snippet.alias("snippet"))
    return answers.full_chunks(cited, lines.withColumnRenamed("k", "chunk_no")).select("cite_id", F.md5("full").alias("full_md5"))


def quote_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four lines are a page; quotes are the second line, or for even documents the fourth and fifth, across two pages."""
    lines = _lines(spark, sf_dir)
    pages = lines.groupBy("doc_id", F.floor(F.col("k") / 4).alias("page")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "text"))), lambda s: s["text"]), "\n").alias("text"))
    wanted = F.when(F.col("doc_id") % 2 == 0, F.col("k").isin(3, 4)).otherwise(F.col("k") == 1)
    quotes = lines.where(wanted).groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "text"))), lambda s: s["text"]), "").alias("quote"))
    return answers.locate_quotes(pages, quotes.withColumn("quote_id", F.col("doc_id"))).select("quote_id", F.array_join("pages", ",").alias("pages"))


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two facts, the first with a second choice of pattern; lines are pages."""
    patterns = spark.createDataFrame([("number", 1, "([0-9]{3,})"), ("number", 2, "([0-9]+)"), ("article", 1, "(th[a-z]+)")], "fact string, pattern_no int, pattern string")
    return answers.fact_search(_lines(spark, sf_dir).withColumnRenamed("k", "page"), patterns)


def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = answers.section_slice(_lines(spark, sf_dir).withColumnRenamed("k", "page"), " the ", " and ")
    return found.select("doc_id", "page", F.md5("text").alias("text_md5"))


def scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers are knowledge bases, every tenth public; orders ask for their customer's and a public one, or for all."""
    bases = run(spark, sf_dir, "SELECT c_custkey AS kb_id, c_custkey % 100 AS owner_id, c_custkey % 10 = 0 AS public, c_custkey * 2 AS version FROM {customer}")
    asked = run(spark, sf_dir, "SELECT o_orderkey AS request_id, (o_custkey + CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END) % 100 AS owner_id, CASE WHEN o_orderkey % 4 = 0 THEN CAST(array() AS ARRAY<BIGINT>) ELSE array(o_custkey, 10 * (1 + o_orderkey % 9)) END AS requested FROM {orders}")
    return answers.resolve_scope(asked, bases, lambda private: F.array_join(F.transform(private, lambda b: F.concat_ws(":", b["kb_id"], b["version"])), ","))


def keyword_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = run(spark, sf_dir, "SELECT n_nationkey AS query_id, n_name AS text FROM {nation}")
    held = run(spark, sf_dir, "SELECT p_partkey AS chunk_id, upper(p_type) AS text FROM {part}")
    return retrieval.keyword_score(asked, held, 5).select("query_id", "chunk_id", F.col("score").cast("long").alias("score"), "rank")


def list_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three gold names in each turn of a conversation."""
    rows = run(spark, sf_dir, "SELECT conv_id, turn, text FROM {conversations}")
    found = answers.list_score(F.col("text"), F.array(F.lit("a n d"), F.lit("the"), F.lit("_for_")))
    return rows.select("conv_id", "turn", F.round(found["recall"], 6).alias("recall"), found["all_present"].alias("all_present"))


def tool_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event types as tools: a user's large events name the expected ones, the even ones the called ones."""
    rows = run(spark, sf_dir, "SELECT user_id, collect_set(CASE WHEN value > 100 THEN event_type END) AS expected, collect_set(CASE WHEN event_id % 2 = 0 THEN event_type END) AS called FROM (SELECT user_id, event_id, value, CASE WHEN event_type = 'view' THEN 'get_schema' ELSE event_type END AS event_type FROM {events}) x GROUP BY user_id")
    return rows.select("user_id", operations.tool_scores(F.col("expected"), F.col("called")).alias("s")).select("user_id", "s.*")


def namespaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = run(spark, sf_dir, "SELECT event_id, user_id, event_type, CAST(ts AS DATE) AS day FROM {events}")
    return rows.select("event_id", answers.cache_namespace([F.col("user_id"), F.when(F.col("event_type") != "view", F.col("event_type")), F.col("day")]).alias("namespace"))


def pools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tools of an order: one for each kind of line it has."""
    rows = run(spark, sf_dir, "SELECT l_orderkey, collect_set(CASE l_returnflag WHEN 'A' THEN 'search_docs' WHEN 'R' THEN 'run_fund_sql' ELSE 'get_schema' END) AS tools FROM {lineitem} GROUP BY l_orderkey")
    return rows.select("l_orderkey", answers.scenario(F.col("tools")).alias("pool"))


def _written(spark: SparkSession, sf_dir: str, columns: dict[str, dict[str, Column]]) -> str:
    """A snapshot of views, with further columns that their declaration asks for; its folder."""
    folder = scratch_path(spark, "snapshot")
    for name, more in columns.items():
        kept = view(spark, sf_dir, name).withColumns({"source": F.lit("views"), "as_of": F.to_date(F.lit("2024-01-31")), **more})
        snapshots.write_table(kept, folder, name)
    return folder


def reloaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two views written as a snapshot, loaded from it, and counted on both sides."""
    folder = _written(spark, sf_dir, {"redemption_fee_tiers": {"tier_text": F.lit("")}, "period_returns": {"end_date": F.lit(None)}})
    return snapshots.reload(spark, folder, f"{folder}/loaded", ["redemption_fee_tiers", "period_returns"])


def reread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A view after a round trip through its snapshot: codes with zeros in front, nulls and decimals."""
    folder = _written(spark, sf_dir, {"redemption_fee_tiers": {"tier_text": F.lit("")}})
    found = snapshots.read_table(spark, folder, "redemption_fee_tiers")
    return found.select("share_code", "tier_no", "min_days", "max_days", F.col("rate").cast("double").alias("rate"), F.col("tier_text").isNull().alias("no_text"), "as_of")


_LINES = "SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS k FROM documents"
QUERIES = {
    "a23_line_lengths": line_lengths, "j14_full_chunks": full_chunks, "x31_quote_pages": quote_pages, "x34_facts": facts, "x35_sections": sections, "f13_scopes": scopes, "x12_keyword_scores": keyword_scores,
    "x26_list_scores": list_scores, "x27_tool_choices": tool_choices, "x22_namespaces": namespaces, "f14_pools": pools, "c2_reloaded": reloaded, "c3_reread": reread,
}
ORACLE_SQL = {
    "a23_line_lengths": f"""
        WITH l AS (SELECT length(text) AS n, regexp_matches(text, '[0-9]') AS listed FROM ({_LINES}) x)
        SELECT kind, count(*) AS n, count(*) FILTER (l.n < 50) AS under_50, count(*) FILTER (l.n < 100) AS under_100, count(*) FILTER (l.n < 150) AS under_150,
          quantile_cont(l.n, 0.1) AS p10, quantile_cont(l.n, 0.5) AS median, quantile_cont(l.n, 0.9) AS p90, max(l.n) AS max
        FROM l JOIN (SELECT 'all' AS kind UNION ALL SELECT 'table' UNION ALL SELECT 'body') g ON kind = 'all' OR (kind = 'table') = listed GROUP BY kind""",
    "j14_full_chunks": f"""
        WITH l AS ({_LINES}), c AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'no such line' ELSE substring(text, 1, 10) END AS snippet FROM l WHERE k = 1)
        SELECT c.doc_id AS cite_id, md5(coalesce((SELECT arg_min(l.text, l.k) FROM l WHERE l.doc_id = c.doc_id AND starts_with(l.text, c.snippet)), c.snippet)) AS full_md5 FROM c""",
    "x31_quote_pages": rf"""
        WITH l AS (SELECT doc_id, k, regexp_replace(text, '[\s|]', '', 'g') AS t FROM ({_LINES}) x),
          p AS (SELECT doc_id, k // 4 AS page, string_agg(t, '' ORDER BY k) AS body FROM l GROUP BY 1, 2),
          q AS (SELECT doc_id, string_agg(t, '' ORDER BY k) AS q FROM l WHERE CASE WHEN doc_id % 2 = 0 THEN k IN (3, 4) ELSE k = 1 END GROUP BY doc_id),
          h AS (SELECT p.doc_id, page, contains(body, q) AS own, contains(concat(body, lead(body) OVER (PARTITION BY p.doc_id ORDER BY page)), q) AS across FROM p JOIN q ON q.doc_id = p.doc_id WHERE q <> '')
        SELECT doc_id AS quote_id, coalesce(string_agg(page, ',' ORDER BY page) FILTER (own), string_agg(page, ',' ORDER BY page) FILTER (across), '') AS pages FROM h GROUP BY doc_id""",
    "x34_facts": f"""
        WITH h AS (SELECT doc_id, fact, n, k, regexp_extract(text, pattern, 1) AS value FROM ({_LINES}) x JOIN (SELECT 'number' AS fact, 1 AS n, '([0-9][0-9][0-9]+)' AS pattern UNION ALL SELECT 'number', 2, '([0-9]+)' UNION ALL SELECT 'article', 1, '(th[a-z]+)') p ON regexp_matches(text, pattern))
        SELECT doc_id, fact, value, k AS page FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, fact ORDER BY n, k) AS place FROM h) y WHERE place = 1""",
    "x35_sections": f"""
        WITH o AS (SELECT doc_id, k, CASE WHEN contains(text, ' the ') THEN substring(text, strpos(text, ' the ') + 5) ELSE text END AS t, k >= min(k) FILTER (contains(text, ' the ')) OVER (PARTITION BY doc_id) AS opened FROM ({_LINES}) x),
          c AS (SELECT *, min(k) FILTER (contains(t, ' and ')) OVER (PARTITION BY doc_id) AS last FROM o WHERE opened)
        SELECT doc_id, k AS page, md5(CASE WHEN contains(t, ' and ') THEN substring(t, 1, strpos(t, ' and ') - 1) ELSE t END) AS text_md5 FROM c WHERE last IS NULL OR k <= last""",
    "f13_scopes": """
        WITH b AS (SELECT c_custkey AS kb, c_custkey % 100 AS owner, c_custkey % 10 = 0 AS public FROM customer),
          r AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN o_custkey + 1 ELSE o_custkey END % 100 AS asker, o_custkey AS own FROM orders),
          n AS (SELECT id, asker, unnest([own, 10 + 10 * (id % 9)]) AS kb FROM r WHERE id % 4 > 0)
        SELECT id AS request_id, bool_or(owner IS NULL OR NOT (public OR owner = asker)) AS denied, bool_or(coalesce(public, false)) AS include_public, coalesce(string_agg(concat(b.kb, ':', 2 * b.kb), ',' ORDER BY b.kb) FILTER (NOT public), '') AS private FROM n LEFT JOIN b ON b.kb = n.kb GROUP BY id
        UNION ALL SELECT id, false, true, coalesce(string_agg(concat(b.kb, ':', 2 * b.kb), ',' ORDER BY b.kb) FILTER (b.kb IS NOT NULL), '') FROM r LEFT JOIN b ON owner = asker AND NOT public WHERE id % 4 = 0 GROUP BY id""",
    "x12_keyword_scores": """
        WITH q AS (SELECT DISTINCT n_nationkey AS query_id, unnest(list_transform(range(1, length(n_name)), lambda k: substring(n_name, k, 2))) AS g FROM nation),
          s AS (SELECT query_id, p_partkey AS chunk_id, count(*) AS score FROM part JOIN q ON contains(upper(p_type), g) GROUP BY 1, 2)
        SELECT query_id, chunk_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM s) x WHERE rank <= 5""",
    "x26_list_scores": r"""
        SELECT conv_id, turn, round(n / 3, 6) AS recall, n = 3 AS all_present FROM (SELECT conv_id, turn, CAST(contains(t, 'and') AS INT) + CAST(contains(t, 'the') AS INT) + CAST(contains(t, 'for') AS INT) AS n
          FROM (SELECT conv_id, turn, regexp_replace(regexp_replace(text, '\[\d{1,3}\]', '', 'g'), '[\s*_`|]', '', 'g') AS t FROM conversations) x) y""",
    "x27_tool_choices": """
        SELECT user_id, count(*) FILTER (want AND NOT got) = 0 AS covered, count(*) FILTER (want <> got) = 0 AS exact, count(*) FILTER (want) = 0 AND count(*) FILTER (got) > 0 AS over_call
        FROM (SELECT user_id, event_type, event_type <> 'view' AND bool_or(value > 100) AS want, event_type <> 'view' AND bool_or(event_id % 2 = 0) AS got FROM events GROUP BY user_id, event_type) x GROUP BY user_id""",
    "x22_namespaces": """SELECT event_id, substring(sha256(concat('{"p0":"', user_id, '","p1":"', CASE WHEN event_type = 'view' THEN '' ELSE event_type END, '","p2":"', CAST(ts AS DATE), '"}')), 1, 24) AS namespace FROM events""",
    "f14_pools": "SELECT l_orderkey, CASE WHEN bool_or(l_returnflag = 'A') THEN 'documents' WHEN bool_or(l_returnflag = 'R') THEN 'database' ELSE 'other' END AS pool FROM lineitem GROUP BY l_orderkey",
    "c2_reloaded": "SELECT 'redemption_fee_tiers' AS \"table\", 6 * count(*) AS source_rows, 6 * count(*) AS target_rows, true AS same FROM supplier UNION ALL SELECT 'period_returns', count(DISTINCT user_id), count(DISTINCT user_id), true FROM events",
    "c3_reread": oracle("SELECT share_code, tier_no, min_days, max_days, rate, true AS no_text, DATE '2024-01-31' AS as_of FROM {redemption_fee_tiers}"),
}
