"""Funnels, portfolio and dataset rules, cost projections: edge cases."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from quillfund.operators import portfolio as P


def test_funnel_counts_every_step(spark):
    rows = spark.createDataFrame([(1, "a"), (2, None), (3, "b"), (4, "a")], "k int, t string")
    steps = [("small", F.col("k") < 4), ("typed", F.col("t") == "a")]
    kept, counts = P.funnel(rows, steps)
    assert [r.k for r in kept.collect()] == [1]
    assert sorted(map(tuple, counts.collect())) == [(0, "all", 4), (1, "small", 3), (2, "typed", 1)]
    assert sorted(r.n for r in P.funnel(rows.limit(0), steps)[1].collect()) == [0, 0, 0]


def test_first_failing_rule_wins(spark):
    day = dt.date
    rows = spark.createDataFrame([(1, None, None), (2, day(2025, 2, 1), None), (3, day(2020, 1, 1), None), (4, day(2020, 1, 1), 1e8), (5, day(2024, 1, 31), 3e8), (6, day(2024, 2, 1), 3e8)], "k int, established date, scale double")
    assert {r.k: r.reason for r in P.rejected(rows, "2026-01-31").collect()} == {1: "no founding date", 2: "too young", 3: "no scale", 4: "too small", 5: None, 6: "too young"}
    told = spark.createDataFrame([("f", "x leaves", day(2024, 1, 31)), ("f", "x leaves", day(2024, 1, 31)), ("f", "leaves", day(2024, 1, 30)), ("g", "other", day(2025, 1, 1)), ("h", None, None)], "fund_code string, title string, published date")
    assert [(r.fund_code, r.dates) for r in P.recent_announcements(told, "leaves", "2026-01-31").collect()] == [("f", 1)]


def test_portfolio_rules(spark):
    funds = spark.createDataFrame([("1", "t", "active", "x"), ("2", "t", "active", "y"), ("2", "t", "active", "y"), ("3", "u", "index", "x")], "fund_code string, theme string, style string, company string")
    shares = spark.createDataFrame([("1", "1A", "A"), ("1", "1C", "C"), ("2", "2C", "C")], "fund_code string, share_code string, share_class string")
    found = sorted(map(tuple, P.portfolio_violations(funds, shares, {"t": 2}, (1.0, 2.0), 3).collect()))
    assert found == [("active to index", "all", "3:1"), ("companies", "all", "2"), ("repeated code", "2", "2"), ("share pair", "2", "C"), ("share pair", "3", ""), ("theme size", "t", "3")]
    fine = P.portfolio_violations(funds.where("fund_code IN ('1', '3')"), shares.unionByName(shares.withColumn("fund_code", F.lit("3"))), {}, (1.0, 2.0), 1)
    assert fine.count() == 0
    assert [r.rule for r in P.portfolio_violations(funds.limit(0), shares, {"t": 1}, (0.0, 9.0), 0).collect()] == ["active to index"]


def test_dataset_rules_and_distribution(spark):
    items = spark.createDataFrame([("q-1", "a", "dev", ["f"]), ("q-1", "a", "test", ["f", "g"]), ("Q", None, "test", None), (None, "b", "test", [])], "id string, topic string, split string, funds array<string>")
    found = sorted(map(tuple, P.dataset_violations(items, r"^q-\d+$", {"a": 2, "b": 2, "c": 0, "d": 1}, (0.3, 0.5)).collect()))
    assert found == [("dev share", "all", "0.250"), ("few items", "b", "1"), ("few items", "d", "0"), ("id form", "", ""), ("id form", "Q", ""), ("repeated id", "q-1", "2")]
    told = {(r.dim, r.name): r.n for r in P.distribution(items, ["topic"], [("topic", "split")], "funds").collect()}
    assert told == {("all", ""): 4, ("topic", "a"): 2, ("topic", ""): 1, ("topic", "b"): 1, ("topic x split", "a x dev"): 1, ("topic x split", "a x test"): 1, ("topic x split", " x test"): 1, ("topic x split", "b x test"): 1, ("distinct funds", ""): 2}


def test_costs_and_states(spark):
    prices = spark.createDataFrame([(True, 2.0, 4.0)], "peak boolean, price_in double, price_out double")
    usage = spark.createDataFrame([("a", 100, 10), ("a", 300, 30)], "topic string, tokens_in long, tokens_out long")
    items = spark.createDataFrame([("a",)] * 3 + [("b",)], "topic string")
    assert {r.topic: (r["items"], r.cost) for r in P.projected_costs(usage, items, prices).collect()} == {"a": (3, pytest.approx(3 * 480e-6)), "b": (1, pytest.approx(480e-6))}
    tokens = lambda rows: spark.createDataFrame(rows, "configuration string, tokens_in long, tokens_out long")
    told = {r.configuration: (r.actual, r.estimate, r.ratio) for r in P.cost_ratios(tokens([("x", 10, 5), ("y", 1, 1)]), tokens([("x", 10, 0), ("z", 0, 0)]), prices).collect()}
    assert told["x"] == (pytest.approx(40e-6), pytest.approx(20e-6), pytest.approx(2.0)) and told["y"][1:] == (None, None) and told["z"] == (None, 0.0, None)
    states = spark.createDataFrame([(1, "READY", dt.datetime(2026, 1, 1, 0, 0, 1)), (2, "PENDING", dt.datetime(2026, 1, 1)), (3, "PROCESSING", dt.datetime(2026, 1, 1, 0, 9, 59)), (4, "FAILED", None)], "doc_id int, status string, updated_at timestamp")
    assert [r.doc_id for r in P.stale(states, "2026-01-01 00:10:00", 60).collect()] == [2]
    assert P.content_version(states).first().version == "1-1767225601000" and P.content_version(states.limit(0)).first().version == "0-0"
    kept = P.last_wins(spark.createDataFrame([(1, 2, "a"), (1, 2, "b"), (1, 1, "z"), (None, 1, None)], "k int, at int, v string"), ["k"], "at")
    assert sorted(map(tuple, kept.collect()), key=str) == [(1, 2, "b"), (None, 1, None)]
    uploads = spark.createDataFrame([(3, 1, "s"), (1, 1, "s"), (2, 2, "s")], "upload_id int, owner_id int, sha256 string")
    assert {r.upload_id: r.same_as for r in P.first_contents(uploads).collect()} == {1: None, 2: None, 3: 1}
