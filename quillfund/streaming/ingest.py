"""The document ingest state machine as Structured Streaming: parsing and routing, idempotent ingest, status reducers,
daily usage and token buckets. Every function also takes batch DataFrames, so the logic is the same in both."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window

from quillfund.plans.views import run

REQUEST = "schema int, batch_id string, task_id long, doc_id string, file_path string, sha256 string, fund_code string, fund_name string, doc_type string, report_period string, title string, requested_at string"
RESULT = "batch_id string, task_id long, doc_id string, status string, sha256 string, chunks int, attempts int, error string, consumer_id string, finished_at string"
REQUIRED = ("batch_id", "doc_id", "file_path", "sha256", "doc_type")
DONE = ("SUCCEEDED", "SKIPPED", "FAILED")
#: From which states a document may enter a state.
MOVES = {"PROCESSING": ("PENDING",), "READY": ("PROCESSING",), "FAILED": ("PENDING", "PROCESSING")}


def parse_requests(raw: DataFrame, column: str = "value") -> DataFrame:
    """The request fields and ``problem``: null for a good record, else why it goes to the dead letters (with what ids
    could be read)."""
    parsed = raw.withColumn("r", F.from_json(F.col(column).cast("string"), REQUEST))
    missing = F.array_join(F.array_compact(F.array(*[F.when(F.coalesce(F.col(f"r.{c}"), F.lit("")) == "", F.lit(c)) for c in REQUIRED])), ",")
    problem = (
        F.when(F.col("r").isNull() | F.coalesce(F.forall(F.array(*[F.col(f"r.{c}").isNull() for c in ("schema", "batch_id", "task_id", "doc_id")]), lambda x: x), F.lit(True)), "no JSON object")
        .when(~F.col("r.schema").eqNullSafe(F.lit(1)), "unknown schema")
        .when(F.col("r.task_id").isNull() | (missing != ""), F.concat(F.lit("missing: "), F.when(F.col("r.task_id").isNull(), F.lit("task_id ")).otherwise(""), missing))
        .when(~F.col("r.doc_id").rlike(r"^[A-Za-z0-9_.-]{1,128}$"), "bad doc_id")
        .when(~F.col("r.sha256").rlike("^[0-9a-f]{64}$"), "bad sha256")
    )
    return parsed.select(column, "r.*", problem.alias("problem"))


def ingest_decisions(requests: DataFrame, ready: DataFrame, manifest: DataFrame) -> DataFrame:
    """What to do with each good request of a micro-batch: SKIPPED (the same text is READY with a full count, or the batch
    delivers it twice), FAILED (the hash is not the manifest's), or INGEST."""
    w = Window.partitionBy("doc_id", "sha256").orderBy("task_id")
    known = ready.select("doc_id", F.col("sha256").alias("ready_sha"), F.col("complete"))
    listed = manifest.select("doc_id", F.col("sha256").alias("listed_sha"))
    rows = requests.withColumn("copy", F.row_number().over(w)).join(known, "doc_id", "left").join(listed, "doc_id", "left")
    action = F.when(F.col("listed_sha").isNotNull() & (F.col("listed_sha") != F.col("sha256")), "FAILED").when(F.coalesce((F.col("ready_sha") == F.col("sha256")) & F.col("complete"), F.lit(False)) | (F.col("copy") > 1), "SKIPPED").otherwise("INGEST")
    return rows.withColumn("action", action).drop("copy", "ready_sha", "listed_sha", "complete")


def reduce_results(tasks: DataFrame, results: DataFrame) -> DataFrame:
    """Status of each task after its results in order of arrival (``seq``): only PENDING and SENT move, the first final
    status with matching ids wins, unknown statuses and later results change nothing."""
    good = results.where(F.col("status").isin(*DONE)).join(tasks.select("task_id", "batch_id", "doc_id"), ["task_id", "batch_id", "doc_id"], "left_semi")
    first = good.groupBy("task_id").agg(F.min_by("status", "seq").alias("fresh"))
    open_ = F.col("status").isin("PENDING", "SENT")
    return tasks.join(first, "task_id", "left").withColumn("status", F.when(open_ & F.col("fresh").isNotNull(), F.col("fresh")).otherwise(F.col("status"))).drop("fresh")


def batch_states(tasks: DataFrame) -> DataFrame:
    """Counts by status of each batch, and its state."""
    n = lambda *s: F.count_if(F.col("status").isin(*s)).alias
    rows = tasks.groupBy("batch_id").agg(n("PENDING", "SENT")("pending"), n("SUCCEEDED")("succeeded"), n("SKIPPED")("skipped"), n("FAILED")("failed"))
    return rows.withColumn("state", F.when(F.col("pending") > 0, "RUNNING").when(F.col("failed") > 0, "COMPLETED_WITH_FAILURES").otherwise("COMPLETED"))


def _move(pdfs: Iterator[pd.DataFrame], status: str) -> str:
    rows = pd.concat(list(pdfs)).sort_values("seq", kind="stable")
    for wanted in rows["status"]:
        if status in MOVES.get(wanted, ()):
            status = wanted
    return status


def document_status(events: DataFrame) -> DataFrame:
    """Streaming status of documents (doc_id, seq, status): a change applies only from the states that allow it."""

    def step(key, pdfs, state: GroupState):
        status = _move(pdfs, state.get[0] if state.exists else "PENDING")
        state.update((status,))
        yield pd.DataFrame({"doc_id": [key[0]], "status": [status]})

    return events.groupBy("doc_id").applyInPandasWithState(step, "doc_id string, status string", "status string", "update", GroupStateTimeout.NoTimeout)


def daily_usage(calls: DataFrame, zone: str = "UTC", late: str = "1 day") -> DataFrame:
    """Calls and tokens per user and local day (user_id, ts, tokens); the watermark bounds the state of a stream."""
    local = F.from_utc_timestamp("ts", zone)
    rows = calls.withColumn("local", local).withWatermark("local", late)
    return rows.groupBy("user_id", F.window("local", "1 day").alias("day")).agg(F.count(F.lit(1)).alias("calls"), F.sum("tokens").alias("tokens")).select("user_id", F.to_date("day.start").alias("usage_date"), "calls", "tokens")


def merge_usage(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Keeps the greater counts of each user and day."""
    keys = ["user_id", "usage_date"]
    return stored.unionByName(fresh).groupBy(*keys).agg(F.max("calls").alias("calls"), F.max("tokens").alias("tokens"))


def buckets(pdf: pd.DataFrame, level: float | None, at: float | None, capacity: float, per_second: float, cost: float) -> tuple[pd.DataFrame, float | None, float | None]:
    """Replays one user's calls in order (column ``ms``); a denied call changes nothing."""
    allowed, wait = [], []
    for now in pdf["ms"]:
        have = capacity if level is None or at is None else min(capacity, level + max(0.0, now - at) * per_second / 1000)
        if have >= cost:
            level, at = have - cost, now
            allowed.append(True)
            wait.append(0)
        else:
            allowed.append(False)
            wait.append(math.ceil((cost - have) / per_second * 1000) if per_second > 0 else 3_600_000)
    return pdf.assign(allowed=allowed, wait_ms=wait), level, at


def token_bucket(calls: DataFrame, capacity: float, per_second: float, cost: float = 1.0) -> DataFrame:
    """Batch replay of (user_id, event_id, ms). Calls come sorted, and only the level and time of one user are carried from
    batch to batch, so a user's calls need not fit in memory."""

    def replay(batches):
        user, level, at = None, None, None
        for batch in batches:
            pdf, users = batch.to_pandas(), batch.column(0).to_pylist()
            cuts = [0, *(k for k in range(1, len(users)) if users[k] != users[k - 1]), len(users)]
            parts = []
            for begin, end in zip(cuts[:-1], cuts[1:], strict=True):
                if begin == end:
                    continue
                if users[begin] != user:
                    user, level, at = users[begin], None, None
                part, level, at = buckets(pdf.iloc[begin:end], level, at, capacity, per_second, cost)
                parts.append(part)
            allowed, wait = ([x for part in parts for x in part[c]] for c in ("allowed", "wait_ms"))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(allowed, pa.bool_()), pa.array(wait, pa.int64())], ["user_id", "event_id", "ms", "allowed", "wait_ms"])

    rows = calls.select(*[F.col(c).cast("long").alias(c) for c in ("user_id", "event_id", "ms")])
    rows = rows.repartition("user_id").sortWithinPartitions("user_id", F.col("ms").asc_nulls_last(), F.col("event_id").asc_nulls_last())
    return rows.mapInArrow(replay, "user_id long, event_id long, ms long, allowed boolean, wait_ms long")


def token_bucket_stream(calls: DataFrame, capacity: float, per_second: float, cost: float = 1.0) -> DataFrame:
    """The same on a stream: level and time are the state of a user."""

    def step(key, pdfs, state: GroupState):
        level, at = state.get if state.exists else (None, None)
        rows = pd.concat(list(pdfs)).sort_values(["ms", "event_id"])
        rows, level, at = buckets(rows, level, at, capacity, per_second, cost)
        if level is not None:
            state.update((float(level), float(at)))
        yield rows

    return calls.select("user_id", "event_id", "ms").groupBy("user_id").applyInPandasWithState(step, "user_id long, event_id long, ms long, allowed boolean, wait_ms long", "level double, at double", "append", GroupStateTimeout.NoTimeout)


def to_json_rows(rows: DataFrame) -> Column:
    return F.to_json(F.struct(*rows.columns))


def route(batch: DataFrame, good_path: str, dead_path: str) -> None:
    """``foreachBatch`` sink: good requests and dead letters, each appended to its folder (or swap in Kafka topics)."""
    parsed = parse_requests(batch)
    parsed.where("problem IS NULL").drop("problem", "value").write.mode("append").parquet(good_path)
    parsed.where("problem IS NOT NULL").select("value", "batch_id", "task_id", "doc_id", "problem").write.mode("append").parquet(dead_path)


def kafka_requests(spark: SparkSession, servers: str, topic: str) -> DataFrame:
    """Request records of a topic as a stream with the column ``value``; the query's checkpoint holds the offsets."""
    return spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("startingOffsets", "earliest").load().select(F.col("value").cast("string").alias("value"))


def publish(batch: DataFrame, results: DataFrame, servers: str, result_topic: str, dead_topic: str) -> None:
    """``foreachBatch`` sink: results keyed by document, and the batch's bad records as dead letters. Offsets are committed
    after both writes, so delivery is at least once; ``reduce_results`` ignores repeats."""
    dead = parse_requests(batch).where("problem IS NOT NULL")
    out = {result_topic: results.select(F.col("doc_id").alias("key"), to_json_rows(results).alias("value")), dead_topic: dead.select(F.col("doc_id").alias("key"), F.to_json(F.struct("value", "batch_id", "task_id", "doc_id", "problem")).alias("value"))}
    for topic, rows in out.items():
        rows.write.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).save()


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Request records from events: every seventh has no document, every eleventh a bad hash."""
    return run(spark, sf_dir, """
        SELECT event_id, to_json(named_struct('schema', CASE WHEN event_id % 13 = 0 THEN 2 ELSE 1 END, 'batch_id', concat('b', user_id), 'task_id', event_id, 'doc_id', CASE WHEN event_id % 7 = 0 THEN '' ELSE concat('d', event_id % 50) END,
          'file_path', 'f', 'sha256', CASE WHEN event_id % 11 = 0 THEN 'x' ELSE sha2(cast(event_id % 50 as string), 256) END, 'doc_type', 't')) AS value FROM {events}""")


def parse_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_requests(_requests(spark, sf_dir)).select("task_id", "problem")


def reducer_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    tasks = run(spark, sf_dir, "SELECT concat('b', user_id % 4) AS batch_id, user_id AS task_id, concat('d', user_id) AS doc_id, 'SENT' AS status FROM {events} GROUP BY user_id")
    results = run(spark, sf_dir, "SELECT concat('b', user_id % 4) AS batch_id, user_id AS task_id, concat('d', CASE WHEN event_id % 5 = 0 THEN 0 ELSE user_id END) AS doc_id, CASE event_type WHEN 'purchase' THEN 'SUCCEEDED' WHEN 'error' THEN 'FAILED' ELSE 'RUNNING' END AS status, event_id AS seq FROM {events}")
    return reduce_results(tasks, results).select("task_id", "status")


def usage_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = run(spark, sf_dir, "SELECT user_id, ts, CAST(round(value) AS BIGINT) AS tokens FROM {events}")
    return daily_usage(calls)


def bucket_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = run(spark, sf_dir, "SELECT user_id, event_id, unix_millis(CAST(ts AS TIMESTAMP)) AS ms FROM {events}")
    return token_bucket(calls, 2, 1 / 36_000).select("user_id", "event_id", "allowed", "wait_ms")


QUERIES = {"r1_parse_requests": parse_query, "r4_result_reducer": reducer_query, "r6_daily_usage": usage_query, "r7_token_bucket": bucket_query}
ORACLE_SQL = {
    "r1_parse_requests": "SELECT event_id AS task_id, CASE WHEN event_id % 13 = 0 THEN 'unknown schema' WHEN event_id % 7 = 0 THEN 'missing: doc_id' WHEN event_id % 11 = 0 THEN 'bad sha256' END AS problem FROM events",
    "r4_result_reducer": "SELECT user_id AS task_id, coalesce(min_by(CASE event_type WHEN 'purchase' THEN 'SUCCEEDED' ELSE 'FAILED' END, event_id) FILTER (event_type IN ('purchase', 'error') AND (event_id % 5 <> 0 OR user_id = 0)), 'SENT') AS status FROM events GROUP BY user_id",
    "r6_daily_usage": "SELECT user_id, CAST(ts AS DATE) AS usage_date, count(*) AS calls, CAST(sum(CAST(round(value) AS BIGINT)) AS BIGINT) AS tokens FROM events GROUP BY ALL",
    # epoch_ms rounds; the query's milliseconds are floored.
    "r7_token_bucket": """
        WITH RECURSIVE c AS (SELECT user_id, event_id, ms, row_number() OVER (PARTITION BY user_id ORDER BY ms, event_id) AS k FROM (SELECT *, epoch_us(ts) // 1000 AS ms FROM events) e),
          r AS (
            SELECT user_id, event_id, k, CAST(2 AS DOUBLE) AS have, CAST(1 AS DOUBLE) AS level, ms AS since FROM c WHERE k = 1
            UNION ALL
            SELECT user_id, event_id, k, have, CASE WHEN have >= 1 THEN have - 1 ELSE level END, CASE WHEN have >= 1 THEN ms ELSE since END
            FROM (SELECT c.user_id, c.event_id, c.k, c.ms, r.level, r.since, least(2, r.level + greatest(0, c.ms - r.since) * (CAST(1 AS DOUBLE) / 36000) / 1000) AS have FROM r JOIN c ON c.user_id = r.user_id AND c.k = r.k + 1) x)
        SELECT user_id, event_id, have >= 1 AS allowed, CASE WHEN have >= 1 THEN 0 ELSE CAST(ceil((1 - have) / (CAST(1 AS DOUBLE) / 36000) * 1000) AS BIGINT) END AS wait_ms FROM r""",
}
