"""Sources and the streaming state machine."""

import datetime as dt
import json
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillfund.sources import snapshots as S
from quillfund.streaming import ingest as R


def test_snapshot_round_trip(spark, tmp_path):
    rows = [("000001", "1", "one, two", None, None, None, None, None, dt.date(2001, 2, 3), None, None, "s", dt.date(2026, 9, 28))]
    df = spark.createDataFrame(rows, S.schema("funds"))
    S.write_table(df, str(tmp_path), "funds")
    assert S.read_table(spark, str(tmp_path), "funds").collect() == df.collect()
    got = S.reload(spark, str(tmp_path), str(tmp_path / "out"), ["funds"]).collect()
    assert got[0].same and got[0].source_rows == 1
    with pytest.raises(ValueError, match="missing"):
        S.write_table(df.drop("theme"), str(tmp_path), "funds")
    fees = spark.createDataFrame([("1", "0.012", "0", "0.001000", "s", "2026-09-28")], "share_code string, management_fee string, custody_fee string, sales_service_fee string, source string, as_of string")
    S.write_table(fees, str(tmp_path), "fees")
    assert "1,0.012,0,0.001,s,2026-09-28" in "\n".join(r.value for r in spark.read.text(f"{tmp_path}/fees.csv").collect())
    (tmp_path / "managers.csv").write_text("manager_name,company\nx,y\n")
    with pytest.raises(ValueError, match="header"):
        S.read_table(spark, str(tmp_path), "managers")
    assert S.key_violations(spark.createDataFrame([(1, None), (1, 2), (1, 2), (3, 4)], "a int, b int"), ["a", "b"]).count() == 2


def test_logs(spark, tmp_path):
    (tmp_path / "sse").write_bytes(b"event: final\r\ndata: {\"a\": 1}\n\n: ping\n\ndata: x\ndata: y\n\n")
    got = S.read_sse(spark, str(tmp_path / "sse")).collect()
    assert [(r.event, r.data, r.heartbeat) for r in got] == [("final", '{"a": 1}', False), (None, None, True), (None, "x\ny", False)]
    (tmp_path / "stats").write_text('12.5 {"Name": "a", "CPUPerc": "3.5%", "MemUsage": "654.3MiB / 8GiB"}\nbad\n13 {"Name": "b", "CPUPerc": "1%", "MemUsage": "12kB / 1GB"}\n')
    got = S.read_stats(spark, str(tmp_path / "stats")).orderBy("t").collect()
    assert [(r.name, r.cpu_pct, r.mem_bytes) for r in got] == [("a", 3.5, pytest.approx(654.3 * 1024**2)), ("b", 1.0, 12000.0)]
    (tmp_path / "folded").write_text("main;a;b;a 3\nmain;a;c 2\nmain;x y\n")
    got = {r.frame: (r.self, r.inclusive) for r in S.stack_profile(S.read_folded(spark, str(tmp_path / "folded"))).collect()}
    assert got == {"a": (3, 5), "b": (0, 3), "c": (2, 2)}


def test_stream_routes_and_suppresses_copies(spark, tmp_path):
    good = {"schema": 1, "batch_id": "b", "task_id": 1, "doc_id": "d1", "file_path": "f", "sha256": "a" * 64, "doc_type": "t"}
    lines = [json.dumps(good), json.dumps(good | {"task_id": 2}), "not json", json.dumps(good | {"schema": 2}), json.dumps(good | {"sha256": "x"}), json.dumps(good | {"doc_id": "a b"}), json.dumps({k: v for k, v in good.items() if k != "file_path"})]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("\n".join(lines))
    query = spark.readStream.text(str(tmp_path / "in")).writeStream.foreachBatch(lambda df, _: R.route(df, str(tmp_path / "good"), str(tmp_path / "dead"))).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    passed, dead = spark.read.parquet(str(tmp_path / "good")), spark.read.parquet(str(tmp_path / "dead"))
    assert passed.count() == 2 and sorted(r.problem for r in dead.collect()) == ["bad doc_id", "bad sha256", "missing: file_path", "no JSON object", "unknown schema"]
    ready = spark.createDataFrame([("d9", "b" * 64, True)], "doc_id string, sha256 string, complete boolean")
    manifest = spark.createDataFrame([("d1", "a" * 64), ("d2", "c" * 64)], "doc_id string, sha256 string")
    more = passed.unionByName(spark.createDataFrame([(3, "d9", "b" * 64), (4, "d2", "a" * 64)], "task_id long, doc_id string, sha256 string"), allowMissingColumns=True)
    got = {r.task_id: r.action for r in R.ingest_decisions(more, ready, manifest).collect()}
    assert got == {1: "INGEST", 2: "SKIPPED", 3: "SKIPPED", 4: "FAILED"}


def test_reducers(spark):
    tasks = spark.createDataFrame([("b", 1, "d1", "SENT"), ("b", 2, "d2", "PENDING"), ("b", 3, "d3", "FAILED"), ("c", 4, "d4", "SENT")], "batch_id string, task_id long, doc_id string, status string")
    results = spark.createDataFrame([("b", 1, "d1", "SUCCEEDED", 2), ("b", 1, "d1", "FAILED", 5), ("b", 2, "dx", "SUCCEEDED", 1), ("b", 2, "d2", "ODD", 1), ("b", 3, "d3", "SUCCEEDED", 1), ("c", 4, "d4", "SKIPPED", 1)], "batch_id string, task_id long, doc_id string, status string, seq long")
    got = R.reduce_results(tasks, results)
    assert {r.task_id: r.status for r in got.collect()} == {1: "SUCCEEDED", 2: "PENDING", 3: "FAILED", 4: "SKIPPED"}
    assert {r.batch_id: r.state for r in R.batch_states(got).collect()} == {"b": "RUNNING", "c": "COMPLETED"}


def test_document_status_stream(spark, tmp_path):
    schema = "doc_id string, seq long, status string"
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.json").write_text("\n".join(json.dumps(x) for x in [{"doc_id": "a", "seq": 1, "status": "PROCESSING"}, {"doc_id": "b", "seq": 1, "status": "READY"}]))
    stream = R.document_status(spark.readStream.schema(schema).json(str(tmp_path / "in")))
    start = lambda: stream.writeStream.outputMode("update").foreachBatch(lambda df, k: df.write.mode("append").json(str(tmp_path / "out"))).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    start()
    (tmp_path / "in" / "2.json").write_text("\n".join(json.dumps(x) for x in [{"doc_id": "a", "seq": 2, "status": "READY"}, {"doc_id": "a", "seq": 3, "status": "FAILED"}]))
    start()
    got = sorted((r.doc_id, r.status) for r in spark.read.json(str(tmp_path / "out")).collect())
    assert got == [("a", "PROCESSING"), ("a", "READY"), ("b", "PENDING")]


def test_token_bucket(spark):
    rng = random.Random(1)
    rows = [(u, k, rng.randrange(100_000)) for u in range(5) for k in range(40)]
    got = {(r.user_id, r.event_id): (r.allowed, r.wait_ms) for r in R.token_bucket(spark.createDataFrame(rows, "user_id long, event_id long, ms long"), 3, 0.2).collect()}
    for user in range(5):
        level, at = 3.0, None
        for _, k, ms in sorted((r for r in rows if r[0] == user), key=lambda r: (r[2], r[1])):
            have = 3.0 if at is None else min(3.0, level + (ms - at) * 0.2 / 1000)
            assert got[user, k][0] == (have >= 1)
            if have >= 1:
                level, at = have - 1, ms
            else:
                assert got[user, k][1] > 0


def test_usage_merge(spark):
    calls = spark.createDataFrame([(1, dt.datetime(2026, 1, 1, 23, 30), 5), (1, dt.datetime(2026, 1, 1, 10), 7), (2, dt.datetime(2026, 1, 2, 1), 1)], "user_id long, ts timestamp, tokens long")
    fresh = R.daily_usage(calls, "Asia/Shanghai")
    assert sorted((r.user_id, str(r.usage_date), r.calls, r.tokens) for r in fresh.collect()) == [(1, "2026-01-01", 1, 7), (1, "2026-01-02", 1, 5), (2, "2026-01-02", 1, 1)]
    stored = spark.createDataFrame([(1, dt.date(2026, 1, 1), 9, 1)], fresh.schema)
    assert {r.usage_date: (r.calls, r.tokens) for r in R.merge_usage(stored, fresh).where(F.col("user_id") == 1).collect()}[dt.date(2026, 1, 1)] == (9, 7)


def test_manifest_and_dumps(spark, tmp_path):
    manifest = {"documents": [{"doc_id": "a", "extract": {"ok": True}}, {"doc_id": "b", "extract": {"ok": False}}, {"doc_id": "c", "extract": {"ok": True}}]}
    (tmp_path / "m.json").write_text(json.dumps(manifest, indent=1))
    assert [r.doc_id for r in S.read_manifest(spark, str(tmp_path / "m.json")).collect()] == ["a", "c"]
    assert [r.doc_id for r in S.read_manifest(spark, str(tmp_path / "m.json"), ["c"]).collect()] == ["c"]
    (tmp_path / "lines.json").write_text(f"{json.dumps(manifest)}\n" * 2)
    assert [r.doc_id for r in S.read_manifest(spark, str(tmp_path / "lines.json"), lines=True).collect()] == ["a", "c"] * 2
    (tmp_path / "items.jsonl").write_text('{"id": 1, "evidence": [{"doc_id": "d"}]}\n{"id": 2}\n')
    assert S.read_jsonl(spark, str(tmp_path / "items.jsonl"), "id int, evidence array<struct<doc_id:string>>").where("size(evidence) > 0").count() == 1
    sample = 'jdk.ExecutionSample {\n  startTime = 12:00:%02d.1\n  stackTrace = [\n    a.B.c() line: 1\n    d.E.f(int) line: 2\n  ]\n}\n'
    (tmp_path / "dump.txt").write_text(sample % 5 + sample % 30)
    got = S.read_jfr(spark, str(tmp_path / "dump.txt"), "12:00:00", "12:00:20").collect()
    assert [(r.time, r.frames) for r in got] == [("12:00:05", ["a.B.c()", "d.E.f(int)"])]


def test_token_bucket_carries_a_user_across_batches(spark):
    rows = [(user, k, (k * 7919) % 1000) for user, n in ((1, 300), (2, 5), (None, 40), (3, 1)) for k in range(n)]
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        found = R.token_bucket(spark.createDataFrame(rows, "user_id long, event_id long, ms long"), 3, 20.0)
        assert "FlatMapGroups" not in found._jdf.queryExecution().toString()
        got = {(r.user_id, r.event_id): (r.allowed, r.wait_ms) for r in found.collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    expected = {}
    for user in (1, 2, None, 3):
        calls = pd.DataFrame([r for r in rows if r[0] == user], columns=["user_id", "event_id", "ms"]).sort_values(["ms", "event_id"])
        for r in R.buckets(calls, None, None, 3, 20.0, 1.0)[0].itertuples():
            expected[user, r.event_id] = (r.allowed, r.wait_ms)
    assert got == expected
