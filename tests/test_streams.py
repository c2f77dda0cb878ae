"""Keyed states with timers, and exactly-once delivery."""

import datetime as dt
import json

import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from quillfund.streaming import delivery, states

EVENTS = "doc_id string, seq long, status string, ts timestamp"
SHA = "a" * 64


def at(minute):
    return dt.datetime(2026, 1, 1, 0, minute)


def test_stale_documents_fail_by_timer(spark):
    """Half an hour without an event: only the watermark, moved by other documents, makes a document stale."""
    slices = [
        [("a", 1, "PROCESSING", at(0)), ("b", 2, "PROCESSING", at(5)), ("b", 3, "READY", at(6)), ("c", 4, "ODD", at(7))],
        [("a", 5, "PROCESSING", at(20)), ("z", 6, "PROCESSING", at(40))],
        [("z", 7, "READY", at(55))],
        [("a", 8, "READY", at(57))],
    ]
    frames = [spark.createDataFrame(rows, EVENTS) for rows in slices]
    told = states.replay(frames, lambda df: states.document_states(df, 30 * 60_000), "stale").orderBy("epoch").collect()
    last = {r.doc_id: (r.status, r.stale) for r in told}
    assert last["b"] == ("READY", False) and last["z"] == ("READY", False)
    assert last["c"] == ("FAILED", True) and last["a"] == ("FAILED", False)  # the late READY of a changes nothing
    assert [r.status for r in told if r.doc_id == "a" and r.stale] == ["FAILED"]


def test_batches_name_their_first_failures(spark):
    schema = "batch_id string, task_id long, seq long, status string"
    planned = spark.createDataFrame([("b", k, -1, "PENDING") for k in range(120)] + [("c", 1, -1, "PENDING")], schema)
    first = spark.createDataFrame([("b", k, k, "FAILED") for k in range(60, 120)] + [("b", 0, 500, "ODD"), ("b", 999, 1, "FAILED"), ("c", 1, 1, "SKIPPED")], schema)
    second = spark.createDataFrame([("b", k, k, "FAILED" if k < 10 else "SUCCEEDED") for k in range(60)] + [("b", 70, 900, "SUCCEEDED"), ("c", 1, 2, "FAILED")], schema)
    told = states.replay([planned, first, second], states.batch_progress, "failures").orderBy("epoch").collect()
    rows = [r for r in told if r.batch_id == "b"]
    assert [r.pending for r in rows] == [120, 60, 0] and (rows[-1].succeeded, rows[-1].failed, rows[-1].state) == (50, 70, "COMPLETED_WITH_FAILURES")
    assert rows[-1].failures == [str(k) for k in [*range(10), *range(60, 100)]]
    assert [r.state for r in told if r.batch_id == "c"] == ["RUNNING", "COMPLETED", "COMPLETED"]


def test_stale_documents_of_one_bucket(spark, monkeypatch):
    """Documents that share a timer fail at their own times, and only those that are due."""
    monkeypatch.setattr(states, "BUCKETS", 1)
    slices = [
        [("a", 1, "PROCESSING", at(0)), ("b", 2, "PROCESSING", at(5)), ("c", 3, "ODD", at(9)), ("d", 4, "PROCESSING", at(1)), ("d", 5, "READY", at(2))],
        [("a", 6, "ODD", at(12)), ("z", 7, "PROCESSING", at(35))],  # the timer rings for a, which has moved on; b is just due
        [("z", 8, "READY", at(41))],  # c is due
        [("z", 9, "ODD", at(43))],  # a is due
        [("z", 10, "ODD", at(50))],
    ]
    told = states.replay([spark.createDataFrame(rows, EVENTS) for rows in slices], lambda df: states.document_states(df, 30 * 60_000), "shared").orderBy("epoch").collect()
    stale = [r for r in told if r.stale]
    assert [(r.doc_id, r.status) for r in stale] == [("b", "FAILED"), ("c", "FAILED"), ("a", "FAILED")]
    assert len({r.epoch for r in stale}) == 3
    assert {r.doc_id: r.status for r in told if not r.stale} == {"a": "PROCESSING", "b": "PROCESSING", "c": "PENDING", "d": "READY", "z": "READY"}


def test_documents_share_rows_of_the_store(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.sql("SELECT concat('d', id % 20000) AS doc_id, id AS seq, if(id < 20000, 'PROCESSING', if(id % 2 = 0, 'READY', 'ODD')) AS status FROM range(40000)").write.parquet(source)
    told = []
    with states.rocksdb(spark):
        stream = states.document_states(spark.readStream.schema("doc_id string, seq long, status string").parquet(source))
        query = stream.writeStream.outputMode("update").foreachBatch(lambda df, _: told.extend(df.groupBy("status").count().collect())).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        query.awaitTermination()
    assert {r["status"]: r["count"] for r in told} == {"READY": 10000, "PROCESSING": 10000}
    assert sum(p["numRowsTotal"] for q in query.recentProgress for p in q["stateOperators"]) < 10000  # one for each document before


class Store:
    """A map variable and a value variable of one key, with the number of calls."""

    def __init__(self):
        self.rows, self.value, self.calls = {}, None, 0

    def getMapState(self, *_):
        return self

    getValueState = getMapState

    def getValue(self, key):
        self.calls += 1
        return self.rows.get(key)

    def updateValue(self, key, row):
        self.calls += 1
        self.rows[key] = row

    def get(self):
        return self.value

    def update(self, value):
        self.value = value


def test_entries_of_a_key_spread_over_rows(monkeypatch):
    monkeypatch.setattr(states, "ROW_ENTRIES", 100)
    store, expected = Store(), {}
    for batch in ([("a", k) for k in range(30)], [(None, k) for k in range(5000)], [("a", k) for k in range(20, 60)], [("\x00é", 7)]):
        entries = states.Entries(store, "e", parts=2)
        entries.open(batch)
        for name in batch:
            assert entries.get(name) == expected.get(name)
            expected[name] = [len(expected), None]
            entries.put(name, expected[name])
        entries.close()
    assert {tuple(e[:2]): e[2:] for row in store.rows.values() for e in json.loads(row[0])} == expected
    assert len(store.rows) == 64 and max(len(json.loads(row[0])) for row in store.rows.values()) < 200
    assert store.calls < 300  # not one for each entry


def test_tasks_of_a_batch_take_few_rows_of_the_store(spark, tmp_path):
    source = str(tmp_path / "in")
    planned = "SELECT concat('b', id % 3) AS batch_id, id AS task_id, -1L AS seq, 'PENDING' AS status FROM range(30000)"
    spark.sql(planned + " UNION ALL SELECT 'b0', id * 3, id, if(id % 2 = 0, 'FAILED', 'ODD') FROM range(9000) UNION ALL SELECT 'c', NULL, 1L, 'PENDING'").write.parquet(source)
    told = []
    with states.rocksdb(spark):
        stream = states.batch_progress(spark.readStream.schema("batch_id string, task_id long, seq long, status string").parquet(source))
        query = stream.writeStream.outputMode("update").foreachBatch(lambda df, _: told.extend(df.collect())).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        query.awaitTermination()
    got = {r.batch_id: (r.pending, r.failed, r.state) for r in told}
    assert got == {"b0": (5500, 4500, "RUNNING"), "b1": (10000, 0, "RUNNING"), "b2": (10000, 0, "RUNNING"), "c": (0, 0, "COMPLETED")}
    assert [r.failures for r in told if r.batch_id == "b0"] == [[str(6 * k) for k in range(50)]]
    assert sum(p["numRowsTotal"] for q in query.recentProgress for p in q["stateOperators"]) < 100  # one for each task before


def requests(spark, *docs):
    return spark.createDataFrame([(json.dumps({"schema": 1, "batch_id": "b", "task_id": task, "doc_id": doc, "file_path": "f", "sha256": sha, "doc_type": "t"}),) for task, doc, sha in docs], "value string")


def seen(spark, folder):
    return sorted((r.task_id, r.doc_id, r.action) for r in delivery.delivered(spark, folder).collect())


def test_a_batch_that_runs_twice_counts_once(spark, tmp_path):
    folder = str(tmp_path / "out")
    delivery.prepare(spark, folder)
    sink = delivery.deliver(folder)
    first = requests(spark, (1, "d", SHA), (2, "d", SHA), (3, "", SHA))
    for _ in range(2):
        sink(first, 0)
        assert seen(spark, folder) == [(1, "d", "INGEST"), (2, "d", "SKIPPED")]
        assert [r.problem for r in delivery.delivered(spark, folder, "dead").collect()] == ["missing: doc_id"]
    for _ in range(2):
        sink(requests(spark, (4, "d", SHA), (5, "d", "b" * 64), (6, "e", SHA)), 1)
        assert seen(spark, folder) == [(1, "d", "INGEST"), (2, "d", "SKIPPED"), (4, "d", "SKIPPED"), (5, "d", "INGEST"), (6, "e", "INGEST")]
    sink(first, 0)  # an old batch again: later ones are not looked at
    assert seen(spark, folder)[:2] == [(1, "d", "INGEST"), (2, "d", "SKIPPED")]


def test_failures_between_writes_leave_nothing(spark, tmp_path, monkeypatch):
    folder = str(tmp_path / "out")
    delivery.prepare(spark, folder)
    delivery.prepare(spark, folder)
    listed = spark.createDataFrame([("d", SHA), ("e", "b" * 64)], "doc_id string, sha256 string")
    sink = delivery.deliver(folder, listed)
    plain = DataFrameWriter.parquet
    for broken in ("/dead/", "/commits/"):
        def fail(self, path, *a, broken=broken, **b):
            if broken in path:
                raise OSError("disk full")
            return plain(self, path, *a, **b)

        monkeypatch.setattr(DataFrameWriter, "parquet", fail)
        with pytest.raises(OSError, match="full"):
            sink(requests(spark, (1, "d", SHA), (2, "e", SHA)), 0)
        monkeypatch.setattr(DataFrameWriter, "parquet", plain)
        assert seen(spark, folder) == [] and delivery.delivered(spark, folder, "dead").count() == 0
    sink(requests(spark, (1, "d", SHA), (2, "e", SHA)), 0)
    assert seen(spark, folder) == [(1, "d", "INGEST"), (2, "e", "FAILED")]
