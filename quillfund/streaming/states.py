"""Keyed state machines over streams: the status of documents, with a timer for stale ones, and the state of batches.

State lives in RocksDB. Every call to its store costs a trip from Python to the JVM, so documents and batches are dealt out to
``BUCKETS`` keys of the stream and a call carries a row of many entries; a key's entries spread over more rows as they grow,
so none outgrows a row. Timers fire by event time, when the watermark passes them.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quillfund.plans.views import run
from quillfund.scratch import scratch_path
from quillfund.streaming.ingest import DONE, MOVES

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Least instances of the store; a cluster takes as many as it has cores. Fixed for the life of a checkpoint.
STATE_PARTITIONS = 8
#: Keys that documents and batches are dealt out to, fixed for the life of a checkpoint.
BUCKETS = 4096
#: Entries of a row of the store, on average, beyond which a key's entries take twice as many rows.
ROW_ENTRIES = 4096
#: Failures of a batch that its row names.
NAMED_FAILURES = 50
STATUS = "doc_id string, status string, stale boolean"
BATCH = "batch_id string, pending long, succeeded long, skipped long, failed long, state string, failures array<string>"


class Entries:
    """Named entries of the current key in 2^bits rows of a map variable, each entry in the row that a hash of its name tells.
    A row is a JSON list of entries, each its name, of ``parts`` parts, and its values: one text costs far less on the way to
    the JVM than an array of as many elements."""

    def __init__(self, handle: StatefulProcessorHandle, label: str, parts: int = 1):
        self.parts = parts
        self.rows = handle.getMapState(label, "place long", "entries string")
        self.size = handle.getValueState(f"{label}_size", "bits long, n long")

    def open(self, names: Iterable[tuple]) -> None:
        """Reads the rows of these names, the only ones that ``get`` and ``put`` take until ``close``."""
        self.bits, self.n = self.size.get() or (0, 0)
        self.held = {place: self._read(place) for place in {self._place(name) for name in names}}
        self.changed: set[int] = set()

    def get(self, name: tuple) -> list | None:
        return self.held[self._place(name)].get(name)

    def put(self, name: tuple, values: list) -> None:
        place = self._place(name)
        self.n += name not in self.held[place]
        self.held[place][name] = values
        self.changed.add(place)

    def close(self) -> None:
        """Writes what changed; if there are too many entries, each row is split by more bits of the hash."""
        old = self.bits
        while self.n > ROW_ENTRIES << self.bits:
            self.bits += 1
        for place in range(1 << old) if self.bits > old else self.changed:
            split: dict[int, dict] = {to: {} for to in range(place, 1 << self.bits, 1 << old)}
            for name, values in (self.held[place] if place in self.held else self._read(place)).items():
                split[self._place(name)][name] = values
            for to, entries in split.items():
                self._write(to, entries)
        if self.changed:
            self.size.update((self.bits, self.n))

    def rewrite(self, change: Callable[[dict], bool]) -> None:
        """Calls ``change`` with the entries of every row, one row at a time; it returns whether it changed some."""
        for place in range(1 << (self.size.get() or (0, 0))[0]):
            entries = self._read(place)
            if change(entries):
                self._write(place, entries)

    def _place(self, name: tuple) -> int:
        return zlib.crc32("\0".join(map(str, name)).encode()) & ((1 << self.bits) - 1) if self.bits else 0

    def _read(self, place: int) -> dict[tuple, list]:
        row = self.rows.getValue((place,))
        return {tuple(entry[: self.parts]): entry[self.parts :] for entry in json.loads(row[0])} if row else {}

    def _write(self, place: int, entries: dict[tuple, list]) -> None:
        self.rows.updateValue((place,), (json.dumps([[*name, *values] for name, values in entries.items()], separators=(",", ":")),))


class DocumentStates(StatefulProcessor):
    """Changes (doc_id, seq, status, at) apply in order of ``seq`` and only from the states that allow them. A document that
    is not settled ``stale_ms`` after its last event, at ``at`` in milliseconds, fails; without ``stale_ms`` there are no
    timers. A bucket has one timer, for its first document to become stale."""

    def __init__(self, stale_ms: int | None = None):
        self.stale_ms = stale_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.documents = Entries(handle, "documents")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = pd.concat(list(rows)).sort_values("seq", kind="stable")
        names = list(zip(held["doc_id"].tolist()))
        self.documents.open(names)
        status = {name: (self.documents.get(name) or ("PENDING",))[0] for name in set(names)}
        for name, wanted in zip(names, held["status"].tolist(), strict=True):
            if status[name] in MOVES.get(wanted, ()):
                status[name] = wanted
        due: dict[tuple, int] = {}
        if self.stale_ms is not None:
            for name, at in zip(names, held["at"].tolist(), strict=True):
                if status[name] in ("PENDING", "PROCESSING"):
                    due[name] = max(int(at) + self.stale_ms, due.get(name, 0))
        for name, told in status.items():
            self.documents.put(name, [told, due.get(name)])
        self.documents.close()
        if due:
            self._wake(min(due.values()))
        yield pd.DataFrame({"doc_id": [name[0] for name in status], "status": list(status.values()), "stale": False})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        stale: list[str] = []
        ahead: list[int] = []

        def fail(entries: dict[tuple, list]) -> bool:
            late = [name for name, (_, due) in entries.items() if due is not None and due <= passed]
            ahead.extend([min(times)] if (times := [due for _, due in entries.values() if due is not None and due > passed]) else [])
            entries.update({name: ["FAILED", None] for name in late})
            stale.extend(name[0] for name in late)
            return bool(late)

        self.documents.rewrite(fail)
        if ahead:
            self._wake(min(ahead), passed)
        yield pd.DataFrame({"doc_id": pd.Series(stale, dtype=object), "status": "FAILED", "stale": True})

    def _wake(self, due: int, passed: int = -1) -> None:
        """The bucket's timer rings at ``due`` or sooner. It may ring for a document that has moved on since; then none fails.
        Timers up to ``passed`` are ringing and still listed."""
        set_for = [at for at in self.handle.listTimers() if at > passed]
        if not set_for or due < min(set_for):
            for at in set_for:
                self.handle.deleteTimer(at)
            self.handle.registerTimer(due)

    def close(self) -> None:
        pass


class BatchStates(StatefulProcessor):
    """Tasks of a batch (batch_id, task_id, seq, status): PENDING announces one, the first final status after that settles it,
    all else changes nothing. A row for each change: counts, the batch's state and its first failures by task."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.tasks = Entries(handle, "tasks", parts=2)
        self.batches = Entries(handle, "batches")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = pd.concat(list(rows)).sort_values("seq", kind="stable")
        names = list(zip(held["batch_id"].tolist(), held["task_id"].tolist(), strict=True))
        batches = dict.fromkeys(name[:1] for name in names)
        self.tasks.open(names)
        self.batches.open(batches)
        counts = {batch: self.batches.get(batch) or [0, 0, 0, 0, []] for batch in batches}
        for name, status in zip(names, held["status"].tolist(), strict=True):
            known = self.tasks.get(name)
            told = counts[name[:1]]
            if status == "PENDING" and known is None:
                told[0] += 1
            elif status in DONE and known == ["PENDING"]:
                told[0] -= 1
                told[1 + DONE.index(status)] += 1
                if status == "FAILED":
                    told[4].append(name[1])
            else:
                continue
            self.tasks.put(name, [status])
        for batch, told in counts.items():
            told[4] = sorted(told[4])[:NAMED_FAILURES]
            self.batches.put(batch, told)
        self.tasks.close()
        self.batches.close()
        out = pd.DataFrame([(*batch, *told[:4]) for batch, told in counts.items()], columns=["batch_id", "pending", "succeeded", "skipped", "failed"])
        out["state"] = ["RUNNING" if pending else "COMPLETED_WITH_FAILURES" if failed else "COMPLETED" for pending, failed in zip(out["pending"], out["failed"], strict=True)]
        out["failures"] = [[str(x) for x in told[4]] for told in counts.values()]
        yield out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        return iter(())

    def close(self) -> None:
        pass


def _bucket(name: str):
    return F.pmod(F.xxhash64(name), F.lit(BUCKETS)).alias("bucket")


def document_states(events: DataFrame, stale_ms: int | None = None, late: str = "0 seconds") -> DataFrame:
    """``DocumentStates`` over a stream; with ``stale_ms`` the watermark on ``ts`` decides when a document is stale."""
    rows = [_bucket("doc_id"), "doc_id", "seq", "status"]
    if stale_ms is None:
        return events.select(*rows).groupBy("bucket").transformWithStateInPandas(DocumentStates(), STATUS, "Update", "None")
    timed = events.withWatermark("ts", late).select(*rows, "ts", F.unix_millis("ts").alias("at"))
    return timed.groupBy("bucket").transformWithStateInPandas(DocumentStates(stale_ms), STATUS, "Update", "EventTime")


def batch_progress(results: DataFrame) -> DataFrame:
    """``BatchStates`` over a stream; a row without a task changes nothing."""
    task, status = F.coalesce("task_id", F.lit(0)), F.when(F.col("task_id").isNotNull(), F.col("status"))
    return results.select(_bucket("batch_id"), "batch_id", task.alias("task_id"), "seq", status.alias("status")).groupBy("bucket").transformWithStateInPandas(BatchStates(), BATCH, "Update", "None")


@contextmanager
def rocksdb(spark: SparkSession, partitions: int | None = None) -> Iterator[None]:
    """State variables and timers need this store; keys are dealt to so many of its instances."""
    wanted = {PROVIDER: ROCKSDB, "spark.sql.shuffle.partitions": str(partitions or max(STATE_PARTITIONS, spark.sparkContext.defaultParallelism))}
    before = {name: spark.conf.get(name) for name in wanted}
    try:
        for name, value in wanted.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def replay(slices: list[DataFrame], build: Callable[[DataFrame], DataFrame], label: str, partitions: int | None = None) -> DataFrame:
    """What a stream gives out with its ``epoch``, if the slices arrive one after the other: each is added to the source's
    folder and the query is started again from its checkpoint, so state passes from run to run."""
    spark = slices[0].sparkSession
    source, out, checkpoint = (scratch_path(spark, f"{label}-{part}") for part in ("source", "out", "checkpoint"))

    def keep(rows: DataFrame, epoch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{out}/epoch={epoch}")  # again with the same rows after a failure

    with rocksdb(spark, partitions):
        for part in slices:
            part.write.mode("append").parquet(source)
            stream = build(spark.readStream.schema(slices[0].schema).parquet(source))
            stream.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.option("basePath", out).parquet(out)


def _slices(rows: DataFrame, order: str, n: int = 3) -> list[DataFrame]:
    """``rows`` in ``n`` parts by ranges of ``order``."""
    low, high = rows.agg(F.min(order), F.max(order)).first()
    part = F.floor((F.col(order) - (low or 0)) * n / ((high or 0) - (low or 0) + 1))
    return [rows.where(part == k) for k in range(n)]


def document_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user's events as status changes of a document, in three micro-batches; the last status of each."""
    rows = run(spark, sf_dir, "SELECT concat('d', user_id) AS doc_id, event_id AS seq, CASE event_type WHEN 'view' THEN 'PROCESSING' WHEN 'purchase' THEN 'READY' WHEN 'error' THEN 'FAILED' ELSE 'ODD' END AS status FROM {events}")
    told = replay(_slices(rows, "seq"), document_states, "documents")
    return told.groupBy("doc_id").agg(F.max_by("status", "epoch").alias("status"))


def batch_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch for each user with a task for each tenth event id; results come in three micro-batches."""
    planned = run(spark, sf_dir, "SELECT concat('b', user_id) AS batch_id, event_id div 10 AS task_id, CAST(-1 AS BIGINT) AS seq, 'PENDING' AS status FROM {events} WHERE event_id % 3 <> 0").distinct()
    results = run(spark, sf_dir, "SELECT concat('b', user_id) AS batch_id, event_id div 10 AS task_id, event_id AS seq, CASE event_type WHEN 'view' THEN 'SUCCEEDED' WHEN 'purchase' THEN 'SKIPPED' WHEN 'error' THEN 'FAILED' ELSE 'ODD' END AS status FROM {events}")
    told = replay([planned, *_slices(results, "seq")], batch_progress, "batches")
    last = told.groupBy("batch_id").agg(F.max_by(F.struct("pending", "succeeded", "skipped", "failed", "state", "failures"), "epoch").alias("s"))
    return last.select("batch_id", "s.pending", "s.succeeded", "s.skipped", "s.failed", "s.state", F.array_join("s.failures", ",").alias("failures"))


QUERIES = {"r8_document_stream": document_query, "r5_batch_stream": batch_query}
ORACLE_SQL = {
    "r8_document_stream": """
        WITH e AS (SELECT concat('d', user_id) AS doc_id, event_id AS seq, CASE event_type WHEN 'view' THEN 'PROCESSING' WHEN 'purchase' THEN 'READY' WHEN 'error' THEN 'FAILED' END AS status FROM events),
          f AS (SELECT doc_id, min(seq) FILTER (status = 'PROCESSING') AS p, min(seq) FILTER (status = 'FAILED') AS f FROM e GROUP BY doc_id),
          n AS (SELECT e.doc_id, min_by(status, seq) AS last FROM e JOIN f USING (doc_id) WHERE seq > p AND status IN ('READY', 'FAILED') GROUP BY e.doc_id)
        SELECT doc_id, CASE WHEN f < coalesce(p, f + 1) THEN 'FAILED' WHEN p IS NULL THEN 'PENDING' ELSE coalesce(last, 'PROCESSING') END AS status FROM f LEFT JOIN n USING (doc_id)""",
    "r5_batch_stream": """
        WITH t AS (SELECT DISTINCT concat('b', user_id) AS batch_id, event_id // 10 AS task_id FROM events WHERE event_id % 3 <> 0),
          r AS (SELECT concat('b', user_id) AS batch_id, event_id // 10 AS task_id, min_by(CASE event_type WHEN 'view' THEN 'SUCCEEDED' WHEN 'purchase' THEN 'SKIPPED' ELSE 'FAILED' END, event_id) AS status FROM events WHERE event_type IN ('view', 'purchase', 'error') GROUP BY ALL),
          s AS (SELECT t.batch_id, t.task_id, coalesce(status, 'PENDING') AS status FROM t LEFT JOIN r USING (batch_id, task_id)),
          b AS (SELECT batch_id, count(*) FILTER (status = 'PENDING') AS pending, count(*) FILTER (status = 'SUCCEEDED') AS succeeded, count(*) FILTER (status = 'SKIPPED') AS skipped, count(*) FILTER (status = 'FAILED') AS failed,
            list_sort(list(task_id) FILTER (status = 'FAILED'))[1:50] AS ids FROM s GROUP BY batch_id),
          u AS (SELECT DISTINCT concat('b', user_id) AS batch_id FROM events)
        SELECT batch_id, coalesce(pending, 0) AS pending, coalesce(succeeded, 0) AS succeeded, coalesce(skipped, 0) AS skipped, coalesce(failed, 0) AS failed,
          CASE WHEN pending > 0 THEN 'RUNNING' WHEN failed > 0 THEN 'COMPLETED_WITH_FAILURES' ELSE 'COMPLETED' END AS state, coalesce(array_to_string(ids, ','), '') AS failures FROM u LEFT JOIN b USING (batch_id)""",
}
