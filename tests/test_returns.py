"""Hand-computed cases of the return calculator, and a plain-Python comparison on random windows."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from quillfund.operators.returns import drawdowns, fund_returns, three_bases

D = dt.date
NAV = [(D(2024, 1, 2), 1.0), (D(2024, 1, 3), 1.1), (D(2024, 1, 4), 0.99), (D(2024, 1, 5), 1.0), (D(2024, 1, 6), 1.2345), (D(2024, 1, 8), 0.9), (D(2024, 1, 9), 0.99), (D(2024, 1, 10), 1.05)]


@pytest.fixture(scope="module")
def tables(spark):
    nav = spark.createDataFrame([(s, d, n) for s in ("000001", "000002") for d, n in NAV], "share_code string, nav_date date, unit_nav double")
    dividends = spark.createDataFrame([("000001", D(2024, 1, 8), 0.1), ("000001", D(2024, 1, 7), 0.02), ("000002", D(2024, 1, 8), 0.1)], "share_code string, ex_date date, cash_per_unit double")
    purchase = spark.createDataFrame([("000001", 1, 0.0, 1e6, 0.015, None), ("000001", 2, 1e6, None, None, 1000.0)], "share_code string, tier_no int, min_amount double, max_amount double, rate double, fixed_fee double")
    redemption = spark.createDataFrame([("000001", 1, 0, 7, 0.015), ("000001", 2, 7, 30, 0.0075), ("000001", 3, 30, None, 0.0)], "share_code string, tier_no int, min_days int, max_days int, rate double")
    return nav, dividends, purchase, redemption


def ask(spark, tables, rows):
    requests = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "request_id int, share_code string, start_date date, end_date date, include_fees boolean, amount double")
    return [r for r in sorted(fund_returns(requests, *tables).collect(), key=lambda r: r.request_id)]


def test_hand_computed(spark, tables):
    day = lambda d: D(2024, 1, d)
    got = ask(spark, tables, [
        ("000001", day(2), day(9), False, None), ("000001", day(6), day(13), False, None), ("000001", day(3), day(3), False, None), ("000001", day(2), D(2030, 1, 1), False, None),
        ("000001", day(2), day(9), True, 10_000.0), ("000001", day(2), day(9), True, 2_000_000.0), ("000002", day(2), day(9), True, 5000.0),
    ])
    assert got[0].ret == pytest.approx(0.1) and got[0].max_drawdown == pytest.approx(-0.1) and (got[0].calendar_days, got[0].trading_days) == (7, 5)
    assert got[0].annualized == pytest.approx(1.1 ** (365 / 7) - 1) and got[0].dividends_in_range == 2 and "2024-01-07" in got[0].notes[-1]
    assert (got[1].start_used, got[1].end_used) == (day(5), day(10)) and got[1].ret == pytest.approx(1.1 * 1.05 / 0.99 - 1) and len(got[1].notes) == 3
    assert (got[2].ret, got[2].annualized, got[2].max_drawdown, got[2].calendar_days) == (0, 0, 0, 0)
    assert got[3].end_used == day(10) and "after the last NAV" in got[3].notes[0]
    assert got[4].net_return == pytest.approx(1.1 * (1 - 0.0075) / 1.015 - 1)
    assert got[5].net_return == pytest.approx((2_000_000 - 1000) * 1.1 * (1 - 0.0075) / 2_000_000 - 1)
    assert got[6].net_return == pytest.approx(got[6].ret) and "no purchase fee" in got[6].notes[-1]


def test_errors(spark, tables):
    a, b = D(2024, 1, 2), D(2024, 1, 9)
    got = ask(spark, tables, [("1", a, b, False, None), (None, a, b, False, None), ("000009", a, b, False, None), ("000001", None, b, False, None), ("000001", b, a, False, None), ("000001", D(2023, 1, 1), b, False, None), ("000001", a, b, True, None), ("000001", a, b, True, 0.0), ("000001", a, b, True, -1.0)])
    assert [r.error for r in got] == ["bad share code", "bad share code", "unknown share", "bad date", "start after end", "before the first NAV", "bad amount", "bad amount", "bad amount"]


def test_random_windows(spark, tables):
    rng = random.Random(7)
    days, value = [], 1.0
    for k in range(200):
        day = D(2023, 1, 1) + dt.timedelta(days=k)
        if rng.random() < 0.8:
            value *= rng.uniform(0.95, 1.06)
            days.append((day, round(value, 4)))
    cash = {d: round(rng.uniform(0.001, 0.1), 6) for d, _ in rng.sample(days, 8)}
    nav = spark.createDataFrame([("000005", d, n) for d, n in days], "share_code string, nav_date date, unit_nav double")
    paid = spark.createDataFrame([("000005", d, c) for d, c in cash.items()], "share_code string, ex_date date, cash_per_unit double")
    asked = []
    for _ in range(60):
        a, b = sorted(rng.sample(range(210), 2))
        asked.append(("000005", D(2023, 1, 1) + dt.timedelta(days=a), D(2023, 1, 1) + dt.timedelta(days=b), False, None))
    got = ask(spark, (nav, paid, *tables[2:]), asked)
    series = [(d, n) for d, n in days if d.weekday() < 5]
    adj = [1.0]
    for (_, before), (d, n) in zip(series, series[1:]):
        adj.append(adj[-1] * (n + cash.get(d, 0.0)) / before)
    for (_, start, end, _, _), row in zip(asked, got, strict=True):
        i, j = (max((k for k, (d, _) in enumerate(series) if d <= x), default=None) for x in (start, end))
        if i is None:
            assert row.error == "before the first NAV"
            continue
        assert row.ret == pytest.approx(adj[j] / adj[i] - 1)
        top, low = adj[i], 0.0
        for v in adj[i : j + 1]:
            top = max(top, v)
            low = min(low, v / top - 1)
        assert row.max_drawdown == pytest.approx(low)


def test_three_bases(spark):
    nav = spark.createDataFrame([("a", D(2026, 8, 28), 1.0, None), ("a", D(2026, 9, 10), 0.95, 0.05), ("a", D(2026, 9, 28), 1.045, 0.1)], "share_code string, nav_date date, unit_nav double, daily_return double")
    paid = spark.createDataFrame([("a", D(2026, 9, 10), 0.1)], "share_code string, ex_date date, cash_per_unit double")
    (row,) = three_bases(nav, paid, "2026-09-28").where(F.col("period") == "1m").collect()
    assert row.base_date == D(2026, 8, 28) and row.unit == pytest.approx(0.045) and row.chain == pytest.approx(1.05 * 1.1 - 1) and row.reinvest == pytest.approx(1.045 * (1 + 0.1 / 0.95) - 1)


def test_drawdowns_by_blocks(spark):
    random.seed(5)
    adj = [1.0]
    for _ in range(1500):
        adj.append(adj[-1] * random.uniform(0.97, 1.031))
    series = spark.createDataFrame([("000001", k + 1, a) for k, a in enumerate(adj)], "share_code string, place int, adj double")
    spans = [(1, 1), (1, 1501), (15, 16), (16, 31), (256, 512), (255, 513)] + [tuple(sorted(random.sample(range(1, 1502), 2))) for _ in range(150)]
    asked = spark.createDataFrame([(k, "000001", a, b) for k, (a, b) in enumerate(spans)], "request_id long, share_code string, start_place int, end_place int")
    found = {r[0]: r[1] for r in drawdowns(asked, series).collect()}
    assert len(found) == len(spans)
    for k, (a, b) in enumerate(spans):
        top, least = 0.0, 0.0
        for x in adj[a - 1 : b]:
            top = max(top, x)
            least = min(least, x / top - 1)
        assert found[k] == least
