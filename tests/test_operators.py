"""Hand-made cases of parsing, documents, retrieval, statistics, quality and operations."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from quillfund.functions import columns as C
from quillfund.operators import answers as A
from quillfund.operators import documents as D
from quillfund.operators import operations as O
from quillfund.operators import quality as Q
from quillfund.operators import retrieval as R
from quillfund.operators import statistics as S


def one(spark, column, *values):
    rows = spark.createDataFrame([(v,) for v in values], "v string").select("v", column(F.col("v")).alias("r")).collect()
    return {r.v: r.r for r in rows}


def test_parsers(spark):
    got = one(spark, C.pct_to_decimal, "1.20%（每年）", "1,234.5", "---", None, "none here")
    assert [None if got[k] is None else float(got[k]) for k in ("1.20%（每年）", "1,234.5", "---", None, "none here")] == [0.012, 12.345, None, None, None]
    got = one(spark, C.holding_period, "小于7天", "大于等于7天，小于30天", "大于等于730天", "1年≤N<2年", "大于3天", "小于等于 5 天", "随便")
    assert [got[k] and tuple(got[k]) for k in got] == [(0, 7), (7, 30), (730, None), (365, 730), (4, None), (0, 6), None]
    got = one(spark, C.amount_range, "M<100万元", "100万元≤M<500万元", "M≥500万元", "100万以下", "500万元以上（含）", "无")
    assert [got[k] and tuple(got[k]) for k in got] == [(0, 1e6), (1e6, 5e6), (5e6, None), (0, 1e6), (5e6, None), None]
    got = one(spark, C.fee_value, "1.50%", "每笔1000元", "0")
    assert [tuple(got[k]) for k in got] == [(0.015, None), (None, 1000.0), (0.0, None)]
    got = one(spark, C.parse_date, "2026-09-28", "2026年09月28日", "20260928", "2026-09-28T00:00:00.000", "x")
    assert list(got.values()) == [dt.date(2026, 9, 28)] * 4 + [None]
    assert one(spark, C.size_bytes, "654.3MiB", "12kB", "x") == {"654.3MiB": pytest.approx(654.3 * 1024**2), "12kB": 12000.0, "x": None}
    assert one(spark, C.iso_dates, "on 2026-1-5 and 2026年01月05日, 2025/12/31")["on 2026-1-5 and 2026年01月05日, 2025/12/31"] == ["2026-01-05", "2025-12-31"]
    assert one(spark, C.sql_tables, "select 1 from A join `b` x")["select 1 from A join `b` x"] == ["a", "b"]
    assert one(spark, C.ascii_year, "二〇二六年报告", "x") == {"二〇二六年报告": "2026年报告", "x": "x"}
    row = spark.range(1).select(C.shift_back(F.lit(dt.date(2026, 3, 31)), 0, 1).alias("a"), C.shift_back(F.lit(dt.date(2026, 11, 30)), 0, -3).alias("b")).first()
    assert (row.a, row.b) == (dt.date(2026, 2, 28), dt.date(2027, 2, 28))


def test_chunks(spark):
    text = "第一部分 概览\n一、甲\n" + "字" * 200 + "。\n" + "短句。\n" + "长" * 700 + "。" + "尾" * 30 + "。\n二、乙\n" + "词" * 500 + "。\n" + "末" * 300 + "。"
    docs = spark.createDataFrame([(1, text), (2, ""), (3, "﻿hello\nworld")], "doc_id long, text string")
    units = D.units(D.blocks(docs))
    rows = {d: sorted((r for r in units.collect() if r.doc_id == d), key=lambda r: r.unit_no) for d in (1, 3)}
    canon = "\n".join(r.text for r in rows[1])
    assert all(canon[r.start : r.end] == r.text for r in rows[1]) and [r.kind for r in rows[1]][:2] == ["heading", "heading"]
    assert [r.text for r in rows[3]] == ["hello world"]
    got = sorted((r for r in D.chunks(units).collect() if r.doc_id == 1), key=lambda r: r.chunk_no)
    assert all(r.text == canon[r.char_start : r.char_end] and len(r.text) <= 750 for r in got)
    assert got[0].section_path == "第一部分 概览 > 一、甲" and got[-1].section_path == "第一部分 概览 > 二、乙"
    covered = set().union(*(range(r.char_start, r.char_end) for r in got))
    assert all(i in covered or c == "\n" for i, c in enumerate(canon))
    assert D.upsert(D.chunks(units), D.chunks(units)).count() == D.chunks(units).count()


def test_boilerplate(spark):
    rows = [(1, p, k, t) for p in range(1, 6) for k, t in enumerate([f"Report page {p}", "Top", f"body {'abcde'[p - 1]}", "Foot"])]
    got = D.strip_boilerplate(spark.createDataFrame(rows, "doc_id long, page int, line_no int, text string"))
    assert sorted(r.text for r in got.collect()) == [f"body {c}" for c in "abcde"]


def test_fusion_and_metrics(spark):
    ranked = spark.createDataFrame([(1, c, k + 1, route) for route, names in ((0, "abc"), (1, "cad")) for k, c in enumerate(names)], "query_id int, chunk_id string, rank int, route_no int")
    got = R.rrf(ranked).orderBy("rank").collect()
    assert [r.chunk_id for r in got] == list("acbd") and got[0].score == pytest.approx(1 / 61 + 1 / 62)
    tie = spark.createDataFrame([(1, "y", 1, 1), (1, "x", 1, 0)], ranked.schema)
    assert [r.chunk_id for r in R.rrf(tie).orderBy("rank").collect()] == ["x", "y"]
    hits = spark.createDataFrame([(1, 2, 0), (1, 4, 0), (1, 4, 1), (1, 5, 1)], "query_id int, rank int, ev_no int")
    asked = spark.createDataFrame([(1,), (2,)], "query_id int")
    row = {r.query_id: r for r in R.query_metrics(asked, hits, spark.createDataFrame([(1, 2), (2, 1)], "query_id int, n int")).collect()}
    dcg = 1 / math.log2(3) + 1 / math.log2(5)
    assert row[1].mrr_10 == 0.5 and row[1].ndcg_10 == pytest.approx(dcg / (1 + 1 / math.log2(3))) and row[1].hit_1 == 0 and row[1].hit_3 == 1 and row[1].recall_5 == 1
    assert row[2].ndcg_10 == 0 and row[2].first_rank == 0


def test_evidence(spark):
    chunks = spark.createDataFrame([(1, 7, "ab cd | ef gh"), (2, 7, "xx"), (3, 8, "abcdefgh")], "chunk_id int, doc_id int, text string")
    ranked = spark.createDataFrame([(1, 1, 1), (1, 2, 2), (1, 3, 3)], "query_id int, chunk_id int, rank int")
    evidence = spark.createDataFrame([(1, 7, 0, "cdefZZZZ"), (1, 7, 1, "  "), (1, 8, 2, "abcZZZZZ")], "query_id int, doc_id int, ev_no int, quote string")
    assert [(r.rank, r.ev_no) for r in R.evidence_hits(ranked, chunks, evidence).collect()] == [(1, 0)]


def test_modes(spark):
    chunks = spark.createDataFrame([(k, t, [float(k == 0), float(k == 1), float(k == 2)]) for k, t in enumerate(["red fox", "blue fox fox", "green"])], "chunk_id int, text string, embedding array<double>")
    asked = spark.createDataFrame([(1, "blue fox", [0.0, 0.0, 1.0])], "query_id int, text string, embedding array<double>")
    order = lambda mode, **k: [r.chunk_id for r in R.retrieve(asked, chunks, mode, 2, **k).orderBy("rank").collect()]
    assert order("vector")[0] == 2 and order("bm25") == [1, 0]
    assert set(order("hybrid")) == {0, 1}
    scores = spark.createDataFrame([(1, 0, 9.0)], "query_id int, chunk_id int, rerank_score double")
    assert order("hybrid_rerank", scores=scores)[0] == 0
    with pytest.raises(ValueError):
        R.retrieve(asked, chunks, "other")


def test_bm25_with_and_without_a_broadcast(spark, monkeypatch):
    words = ["fund", "bond", "fee", "rate", "net"]
    chunks = spark.createDataFrame([(k, " ".join(words[j] for j in range(5) if k >> j & 1) + " common" * (k % 3 + 1)) for k in range(32)] + [(40, None), (41, "")], "chunk_id int, text string")
    asked = spark.createDataFrame([(1, "common fund fee"), (2, "common"), (3, "absent"), (4, None), (5, "rate rate net")], "query_id int, text string")
    found = lambda: sorted(tuple(r) for r in R.bm25(asked, chunks, 4).collect())
    near = found()
    monkeypatch.setattr(R, "BROADCAST_TERMS", 0)
    assert found() == near
    assert {r[0] for r in near} == {1, 2, 5} and len(near) == 12
    df, n, mean = 16, 34, sum(k.bit_count() + k % 3 + 1 for k in range(32)) / 34  # null is an empty text
    idf = math.log(1 + (n - df + 0.5) / (df + 0.5))
    monkeypatch.undo()
    assert "Exchange hashpartitioning(chunk_id" not in R.bm25(asked, chunks, 4)._jdf.queryExecution().toString()  # was: all postings
    monkeypatch.setattr(R, "MOST_PAIRS", 3)  # chunks one by one
    assert found() == near
    best = next(r for r in near if r[0] == 5 and r[3] == 1)
    size = best[1].bit_count() + best[1] % 3 + 1
    assert best[1] == 24 and best[2] == pytest.approx(2 * idf * 2.2 / (1 + 1.2 * (0.25 + 0.75 * size / mean)), abs=1e-8)


def test_statistics(spark):
    row = spark.range(1).select(F.array(*[F.lit(k) for k in range(1, 21)]).alias("v")).select(S.nearest_rank(F.col("v"), 50).alias("a"), S.nearest_rank(F.col("v"), 95).alias("b"), S.floor_index(F.col("v"), 0.99).alias("c"), S.wilson(F.lit(0), F.lit(0)).alias("w"), S.wilson(F.lit(8), F.lit(10)).alias("x")).first()
    assert (row.a, row.b, row.c, row.w) == (10, 19, 20, None) and row.x.low == pytest.approx(0.4902, abs=1e-3)
    same = spark.createDataFrame([(1, 1), (1, 1)], "x int, y int")
    assert S.kappa(same, "x", "y").first().kappa == 1.0
    pairs = spark.createDataFrame([(k, float(k), float(k) + 1 + (k % 3) / 10) for k in range(50)] + [(50, None, 1.0)], "id int, a double, b double")
    row = S.paired_bootstrap(pairs, "id", "a", "b", draws=500).first()
    assert row.low <= row.mean <= row.high and row.share_not_better == 0 and row.mean == pytest.approx(1.098)


def test_quality(spark):
    day = lambda d: dt.date(2026, 9, d)
    nav = spark.createDataFrame([("a", day(22)), ("a", day(25)), ("a", day(26)), ("a", day(28))], "share_code string, nav_date date")
    calendar = spark.createDataFrame([(day(d),) for d in (21, 22, 23, 24, 25, 28)], "day date")
    (row,) = Q.continuity(nav, calendar, "2026-09-28").collect()
    assert (row.gap_days, row.first_gaps, row.off_days, row.late_gaps) == (2, "2026-09-23;2026-09-24", 1, 0)
    shares = spark.createDataFrame([("2", "t", "x", "xC"), ("1", "t", "x", "xA"), ("5", "t", "y", "y"), ("4", "t", "y", "yC")], "share_code string, theme string, base string, share_name string")
    assert {r.base: r.primary for r in Q.share_groups(shares).collect()} == {"x": "1", "y": "5"}
    rows = spark.createDataFrame([("d", 1, ["a", "b"]), ("d", 2, ["", "c"]), ("d", 3, ["e", "f"])], "doc string, row_no int, cells array<string>")
    assert sorted(r.cells for r in Q.join_continuations(rows).collect()) == [["a", "bc"], ["e", "f"]]
    events = spark.createDataFrame([("f", "m", 1, dt.date(2020, 1, 1), None, "x"), ("f", "m", 2, None, dt.date(2030, 1, 1), "y"), ("f", "m", 3, dt.date(2020, 2, 1), None, "x")], "fund_code string, manager_name string, ord int, start_date date, end_date date, source string")
    (row,) = Q.merge_tenures(events, "2026-09-28").collect()
    assert (row.start_date, row.end_date, row.sources) == (dt.date(2020, 2, 1), None, ["x", "y"])


def test_bounded_sql(spark):
    data = "/root/testdata/sf0.001"
    rows, cut = O.bounded_sql(spark, data, "SELECT fund_code FROM funds ORDER BY fund_code", most=4)
    assert rows.count() == 4 and cut
    rows, cut = O.bounded_sql(spark, data, "SELECT f.fund_code FROM funds f JOIN share_classes s ON s.fund_code = f.fund_code", limit=3)
    assert rows.count() == 3 and not cut
    nested = "WITH a AS (SELECT 'from secrets; drop' AS t, fund_code FROM `funds` -- FROM nowhere\n), b AS (WITH c AS (SELECT * FROM a) SELECT * FROM c) SELECT t, count(*) AS n FROM b /* JOIN x */ GROUP BY t"
    assert O.read_tables(spark, nested) == {"funds"} and O.read_tables(spark, "SELECT 1 WHERE EXISTS (SELECT * FROM Fees, x.y)") == {"fees", "x.y"}
    assert [r.t for r in O.bounded_sql(spark, data, nested)[0].collect()] == ["from secrets; drop"]
    for bad in ("DROP TABLE funds", "SELECT 1; SELECT 2", "SELECT * FROM secrets", "INSERT INTO funds SELECT 1", f"SELECT * FROM parquet.`{data}/part.parquet`", "SET a = 1", "SELECT * FROM (SELECT * FROM secrets)", ""):
        with pytest.raises(ValueError):
            O.bounded_sql(spark, data, bad)


def test_more_statistics(spark, tmp_path):
    scored = spark.createDataFrame([(1, "see 000001 5", "x"), (2, "see 999999 5", "x"), (3, "999999", "1")], "id int, q1 string, q2 string")
    good, bad = S.without_malformed(scored, spark.createDataFrame([("000001",)], "code string"))
    assert sorted(r.id for r in good.collect()) == [1, 3] and [r.id for r in bad.collect()] == [2]
    keys = "query_id int, ev_no int"
    got = S.reachability(spark.createDataFrame([(1, 0)], keys), spark.createDataFrame([(1, 0), (1, 1)], keys), spark.createDataFrame([], keys))
    assert sorted((r.ev_no, r.reached, r.whole) for r in got.collect()) == [(0, True, False), (1, False, False)]
    got = Q.quality_report({"gaps": scored, "none": scored.limit(0)}, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == [("gaps", 3), ("none", 0)]


def test_order_values(spark):
    import random

    random.seed(3)
    groups = {"flat": [7.0] * 40, "tail": [random.random() for _ in range(500)] + [1e9], "odd": [float("-inf"), 2.0, float("nan"), float("inf"), None], None: [3.0, 1.0, 2.0]}
    rows = spark.createDataFrame([(k, v) for k, vs in groups.items() for v in vs] + [("none", None)], "k string, v double")
    ranks = {"first": lambda n: F.lit(1), "p30": lambda n: S.nearest_place(n, 30), "mid": lambda n: S.floor_place(n, 0.5), "last": lambda n: n}
    found = {r["k"]: r for r in S.order_values(rows, ["k"], "v", ranks).collect()}
    assert set(found) == set(groups)
    for k, values in groups.items():
        v = sorted((x for x in values if x is not None), key=lambda x: (x != x, x))
        n = len(v)
        told = [n, v[0], v[-(-n * 30 // 100) - 1], v[min(n - 1, n // 2)], v[-1]]
        assert str(list(found[k])[1:]) == str(told)
    assert S.order_values(rows.where("k = 'none'"), ["k"], "v", ranks).count() == 0


def test_searches_by_broadcast_and_by_parts(spark):
    rng = random.Random(4)
    vector = lambda: [rng.uniform(-1, 1) for _ in range(5)]
    chunks = spark.createDataFrame([(k, vector(), "n", k % 2) for k in range(300)] + [(301, [1.0], "n", 0), (302, None, "n", 0)], "chunk_id int, embedding array<double>, namespace string, signature int")
    asked = spark.createDataFrame([(k, vector(), "n", k % 2) for k in range(40)], "query_id int, embedding array<double>, namespace string, signature int")
    near, far = (R.vector_top_k(asked, chunks, 4, bound) for bound in (1 << 20, 0))
    assert sorted(map(tuple, near.collect())) == sorted(map(tuple, far.collect())) and near.count() == 160
    assert "hashpartitioning(size" not in near._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    near, far = (A.semantic_match(asked, chunks.where("chunk_id < 300"), 0.3, 3, bound) for bound in (1 << 20, 0))
    assert sorted(map(tuple, near.collect())) == sorted(map(tuple, far.collect())) and near.count() > 20


def test_active_managers(spark):
    rng = random.Random(9)
    day = lambda n: dt.date(2020, 1, 1) + dt.timedelta(n)
    tenures = [("f", f"m{k}", rng.choice([None, day(rng.randrange(900))]), rng.choice([None, day(rng.randrange(900))])) for k in range(60)]
    asked = [(rng.choice("fg"), day(rng.randrange(-50, 1000))) for _ in range(80)] + [("f", None)]
    frames = spark.createDataFrame(asked, "fund_code string, on date"), spark.createDataFrame(tenures, "fund_code string, manager_name string, start_date date, end_date date")
    expected = sorted((f, d, m) for f, d in asked if d for g, m, a, b in tenures if f == g and (a is None or a <= d) and (b is None or b > d))
    for days in (30, 366, 5000):
        assert sorted((r.fund_code, r.on, r.manager_name) for r in Q.active_managers(*frames, days).collect()) == expected
    assert Q.active_managers(frames[0].limit(0), frames[1]).count() == 0 and "NestedLoopJoin Inner" not in Q.active_managers(*frames)._jdf.queryExecution().toString()


def test_holdings_of_one_code_meet_one_to_one(spark):
    """Two rows with one code, and rows without a code: before, each met all of its code, or none."""
    schema = "fund_code string, report_period string, stock_code string, weight double, shares double, market_value double"
    rows = [("f", "q", "1", 0.3, 300.0, 1.0), ("f", "q", "1", 0.2, 700.0, 1.0), ("f", "q", None, 0.1, 5.0, 1.0), ("f", "q", "2", 0.1, 1.0, 1.0)]
    held = [("f", "q", "1", 0.2, 700.0, 1.0), ("f", "q", None, 0.1, 100.0, 1.0), ("f", "q", "2", 0.4, 1.0, 90.0), ("f", "q", "3", 0.4, 1.0, 90.0)]
    found = Q.compare_holdings(spark.createDataFrame(rows, schema), spark.createDataFrame(held, schema)).collect()
    assert sorted((str(r.stock_code), r.issues, r.consistent) for r in found) == [("1", [], True), ("1", ["missing"], False), ("2", ["weight", "value"], False), ("None", ["shares"], False)]


def test_best_of_keeps_ties_by_chunk():
    best = R.BestOf(2, 2, R.pa.int64())
    for query, score, chunk in (([0, 0, 1], [1.0, 2.0, 5.0], [9, 8, 7]), ([0, 0, 0], [2.0, 1.0, 2.0], [7, 1, 9])):
        best.add(R.np.array(query), R.np.array(score), R.pa.array(chunk))
    query, score, chunk = best.rows()
    assert (list(query), list(score), chunk.to_pylist()) == ([0, 0, 1], [2.0, 2.0, 5.0], [7, 8, 7])
    assert list(best.bar) == [2.0, -R.np.inf]


def test_search_forms_no_pair_in_a_row(spark):
    """Equal vectors tie by chunk, wherever they lie; pairs are blocks of a task, not rows of a join or of a sort."""
    rng = random.Random(5)
    kinds = [[rng.uniform(-1, 1) for _ in range(7)] for _ in range(3)]
    chunks = spark.createDataFrame([(k, kinds[k % 3]) for k in range(400)] + [(900, [1.0, None]), (901, [])], "chunk_id long, embedding array<float>")
    asked = spark.createDataFrame([(k, kinds[k]) for k in range(3)], "query_id long, embedding array<float>")
    found = R.vector_top_k(asked, chunks, 4)
    got = {q: [r.chunk_id for r in sorted(found.where(f"query_id = {q}").collect(), key=lambda r: r.rank)] for q in range(3)}
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True))
    best = {q: max(range(3), key=lambda j: dot(kinds[q], kinds[j])) for q in range(3)}
    assert got == {q: [best[q] + 3 * j for j in range(4)] for q in range(3)}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "BroadcastHashJoin [size" not in plan


def test_continuations_make_no_row_of_a_cell(spark):
    rows = spark.createDataFrame([("d", 1, ["a", "b"]), ("d", 2, ["", None, "x"]), ("d", 3, []), ("d", 4, ["", "y"]), ("e", 1, [])], "doc string, row_no int, cells array<string>")
    found = Q.join_continuations(rows)
    assert "posexplode" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r.doc, r.cells) for r in found.collect()) == [("d", ["", "y"]), ("d", ["a", "b", "x"])]


def test_tables_form_their_grid_once(spark):
    """Before, the cleaned grid stood many times in the expression and was formed again for every row and column."""
    rows = spark.createDataFrame([([["a |b", None, " "], ["", ""], ["c", "", "d"], ["e"]],), ([],), (None,)], "rows array<array<string>>")
    found = rows.select(C.markdown_table(F.col("rows")).alias("t"))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace") == 1
    assert [r.t for r in found.collect()] == ["| a\\|b |  |\n|---|---|\n| c | d |\n| e |  |", "", ""]
