"""Exactly-once ingest: a ``foreachBatch`` sink whose writes are named by the micro-batch, and a ledger of accepted texts.

Each micro-batch has a folder of its own in every table, so a batch that runs again replaces what it wrote before. A batch
counts only once its commit is written, after everything else, so a failure between two writes leaves nothing visible.
Decisions look at the commits of earlier batches alone, and so are the same each time a batch runs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillfund.plans.views import run
from quillfund.scratch import scratch_path, written
from quillfund.streaming.ingest import REQUEST, ingest_decisions, parse_requests

TABLES = {
    "decided": f"{REQUEST}, action string",
    "dead": "value string, batch_id string, task_id long, doc_id string, problem string",
    "commits": "n long",
}


def prepare(spark: SparkSession, folder: str) -> None:
    """Empty tables, so that the first batch finds a ledger; leaves tables that are there alone."""
    for name, schema in TABLES.items():
        spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{folder}/{name}/epoch=-1")


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    path = f"{folder}/{name}"
    return spark.read.schema(f"{TABLES[name]}, epoch long").option("basePath", path).parquet(path)


def delivered(spark: SparkSession, folder: str, name: str = "decided") -> DataFrame:
    """The rows of committed batches: ``decided`` requests with their action, or ``dead`` letters."""
    commits = _table(spark, folder, "commits").select("epoch").distinct()
    return _table(spark, folder, name).join(F.broadcast(commits), "epoch", "left_semi")  # a number for each micro-batch


def deliver(folder: str, manifest: DataFrame | None = None) -> Callable[[DataFrame, int], None]:
    """The sink. A text (doc_id, sha256) that an earlier batch accepted is SKIPPED, whatever came between; of equal requests
    in one batch the smallest task is taken. ``manifest`` (doc_id, sha256) tells which hashes are right, if given."""

    def sink(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        parsed = written(parse_requests(batch.select("value")), "parsed")  # read by both writes
        earlier = delivered(spark, folder).where((F.col("epoch") < epoch) & (F.col("action") == "INGEST"))
        # Of a document with several accepted texts each counts; ``ingest_decisions`` compares one text of a document.
        known = earlier.select("doc_id", "sha256").distinct()
        listed = manifest if manifest is not None else spark.createDataFrame([], "doc_id string, sha256 string")
        good = parsed.where("problem IS NULL").drop("problem", "value")
        fresh = good.join(known, ["doc_id", "sha256"], "left_anti")
        again = good.join(known, ["doc_id", "sha256"], "left_semi").withColumn("action", F.lit("SKIPPED"))
        none = spark.createDataFrame([], "doc_id string, sha256 string, complete boolean")
        decided = ingest_decisions(fresh, none, listed).unionByName(again)
        columns = [c.split()[0] for c in TABLES["decided"].split(", ")]
        decided.select(*columns).write.mode("overwrite").parquet(f"{folder}/decided/epoch={epoch}")
        parsed.where("problem IS NOT NULL").select("value", "batch_id", "task_id", "doc_id", "problem").write.mode("overwrite").parquet(f"{folder}/dead/epoch={epoch}")
        spark.range(1).select(F.col("id").alias("n")).write.mode("overwrite").parquet(f"{folder}/commits/epoch={epoch}")

    return sink


def delivered_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests from events as a stream of three arrivals that is then run again from the start, as after a lost checkpoint."""
    rows = run(spark, sf_dir, """
        SELECT event_id % 3 AS part, to_json(named_struct('schema', 1, 'batch_id', concat('b', user_id), 'task_id', event_id, 'doc_id', CASE WHEN event_id % 7 = 0 THEN '' ELSE concat('d', event_id % 50) END,
          'file_path', 'f', 'sha256', sha2(cast(user_id % 4 as string), 256), 'doc_type', 't')) AS value FROM {events}""")
    source, folder = scratch_path(spark, "requests"), scratch_path(spark, "delivered")
    prepare(spark, folder)
    for k in range(3):
        rows.where(F.col("part") == k).select("value").write.parquet(f"{source}/part={k}")
    for _ in range(2):
        for k in range(3):
            stream = spark.readStream.schema("value string").parquet(f"{source}/part={k}")
            # A checkpoint of its own gives every arrival the epoch 0; the sink's number is that of the arrival.
            sink = deliver(folder)
            stream.writeStream.foreachBatch(lambda batch, _, k=k, sink=sink: sink(batch, k)).option("checkpointLocation", scratch_path(spark, "checkpoint")).trigger(availableNow=True).start().awaitTermination()
    good = delivered(spark, folder).groupBy("doc_id", "sha256").agg(F.count_if(F.col("action") == "INGEST").alias("ingested"), F.count_if(F.col("action") == "SKIPPED").alias("skipped"))
    dead = delivered(spark, folder, "dead").groupBy("problem").agg(F.count(F.lit(1)).alias("skipped"))
    return good.unionByName(dead.select(F.lit("").alias("doc_id"), F.col("problem").alias("sha256"), F.lit(0).cast("long").alias("ingested"), "skipped"))


QUERIES = {"r3_exactly_once": delivered_query}
ORACLE_SQL = {
    "r3_exactly_once": """
        WITH e AS (SELECT CASE WHEN event_id % 7 = 0 THEN '' ELSE concat('d', event_id % 50) END AS doc_id, sha256(CAST(user_id % 4 AS VARCHAR)) AS sha256 FROM events)
        SELECT doc_id, sha256, CAST(1 AS BIGINT) AS ingested, count(*) - 1 AS skipped FROM e WHERE doc_id <> '' GROUP BY ALL
        UNION ALL SELECT '', 'missing: doc_id', 0, count(*) FROM e WHERE doc_id = '' HAVING count(*) > 0""",
}
