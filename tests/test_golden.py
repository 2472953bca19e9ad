"""Closed-form and scenario values."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.functions import guards
from tidemark.operators import joins as J
from tidemark.operators import metrics as M
from tidemark.operators import simulate as S
from tidemark.operators import validation as V


def test_profit_factor(spark):
    pf = lambda x, v="inf": spark.createDataFrame([(float(i),) for i in x], "p double").agg(M.profit_factor(F.col("p"), v).alias("r")).first().r
    assert pf([1, 2, -1]) == 3.0 and pf([-1, -2]) == 0.0 and pf([1, 2]) == float("inf") and pf([1, 2], "capped") == 999.0 and pf([1, 2], "zero") == 0.0


def test_expected_max_sharpe():
    got = [V.expected_max_sharpe(n) for n in (10, 100, 1000, 10000)]
    assert got == sorted(got)
    assert all(abs(a - b) < 0.03 for a, b in zip(got, (1.575, 2.531, 3.255, 3.861)))


def test_block_length():
    assert 2 <= V.block_length(1000) <= 250 and V.block_length(5) == 2


def test_bootstrap_is_seeded(spark):
    d = spark.createDataFrame([(i, float((i * 7919) % 13 - 6)) for i in range(60)], "day int, pnl double")
    a, b = (sorted(map(tuple, V.bootstrap(d, 40).repartition(k).collect())) for k in (1, 3))
    assert a == b and len(a) == 40


def test_drawdown(spark):
    t0 = datetime(2024, 1, 1)
    log = lambda x: spark.createDataFrame([("b", t0 + timedelta(days=20 * i), i, float(p)) for i, p in enumerate(x)], "book string, t timestamp, id int, pnl double")
    dd = lambda x: M.max_drawdown(M.equity(log(x), ["book"], ["t", "id"], "pnl", 1000.0), ["book"]).first()
    assert dd([1, 1, 1, 1]).max_dd_pct == 0 and dd([1, -500, 1]).max_dd_pct > 40


def test_blackout_bounds(spark):
    at = lambda h, m: datetime(2026, 1, 2, h, m)
    e = spark.createDataFrame([(at(12, 30),)], "e timestamp")
    t = spark.createDataFrame([(at(*x),) for x in ((12, 30), (12, 20), (12, 50), (12, 15), (13, 0), (12, 10), (13, 5))], "t timestamp")
    got = {(r.t.hour, r.t.minute) for r in J.near_event(t, e, "t", "e", 900, 1800).collect()}
    assert got == {(12, 30), (12, 20), (12, 50), (12, 15), (13, 0)}
    assert J.near_event(t, e, "t", "e", 900, 1800, keep=False).count() == 2


@pytest.mark.parametrize("rows,want", [
    ([("EUR", None, None, 0, None), ("GBP", 0.23, 99.85, 9, None), ("JPY", 0.04, 99.81, 9, None), ("XAG", 0.49, 96.44, 9, None)], "C"),
    ([("EUR", 1.4, 9.0, 99, None), ("GBP", 1.2, 12.0, 99, None), ("JPY", 1.1, 20.0, 99, None)], "A"),
    ([("EUR", 0.9, 9.0, 99, None), ("GBP", 1.2, 12.0, 99, None), ("JPY", 1.1, 20.0, 99, None)], "B"),
    ([("EUR", 1.4, 9.0, 99, "x"), ("GBP", 1.2, 12.0, 99, None)], "ERROR"),
])
def test_tiers(spark, rows, want):
    df = spark.createDataFrame([("s", *r) for r in rows], "k string, symbol string, pf double, dd_pct double, trades int, error string")
    assert V.tier(df, ["k"], "EUR").first().tier == want


def test_kill_switch(spark):
    t0 = datetime(2024, 1, 1)
    log = lambda x: spark.createDataFrame([("b", t0 + timedelta(hours=h), i, p) for i, (h, p) in enumerate(x)], "book string, t timestamp, id int, pnl double")
    run = lambda x: M.kill_switch(log(x), ["book"], ["t", "id"], "pnl", 1000.0).first()
    a = run([(i, -5.0 if i != 2 else 1.0) for i in range(8)])
    assert a.trips_daily >= 1 and a.admitted < 8
    b = run([(24 * i, -15.0) for i in range(20)])
    assert b.latched and b.final_equity > 880
    c = run([(24 * i, 5.0) for i in range(10)])
    assert c.admitted == 10 and not c.latched


def test_fnv(spark):
    def plain(t):
        h = 2166136261
        for ch in t:
            h = ((h ^ ord(ch)) * 16777619) & 0xFFFFFFFF
        return h

    words = ["", "a", "EURUSD", "XAUUSD"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    assert {r.w: r.h for r in df.select("w", guards.fnv1a32(F.col("w")).alias("h")).collect()} == {w: plain(w) for w in words}


def test_position_size(spark):
    r = spark.range(1).select(S.position_size(F.lit(10000.0), F.lit(1.0), F.lit(500.0)).alias("a"), S.position_size(F.lit(10000.0), F.lit(1.0), F.lit(0.0)).alias("b"), S.kelly(F.lit(0.6), F.lit(1.0)).alias("k")).first()
    assert (r.a, r.b) == (0.2, 0.0) and abs(r.k - 0.2) < 1e-12
