"""Operators that do the whole job, against plain Python."""

import random
from datetime import date, datetime, timedelta
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from tidemark.operators import implausible
from tidemark.operators import joins as J
from tidemark.operators import simulate as S
from tidemark.operators import validation as V
from tidemark.plans import ref_more as P
from tidemark.plans import ref_trades as R

T0 = datetime(2024, 1, 1)


def test_bias_modes(spark):
    """Wide bars, so that many touch both levels: stop, target or a coin decides those, and nothing else changes."""
    random.seed(5)
    bars, c = [], 1000.0
    for i in range(900):
        c += random.randint(-20, 20)
        bars.append(("x", T0 + timedelta(hours=i), c, c + random.randint(0, 30), c - random.randint(0, 30), c))
    sig = [("x", b[1], b[5] + 5, b[5] - 5, 10.0, 20.0) for b in bars[::3]]
    want = {}
    for n, (_, t, buy, sell, sl, tp) in enumerate(sig):
        for side, level, d in (("long", buy, 1), ("short", sell, -1)):
            ahead = [(h if d > 0 else -lo, lo if d > 0 else -h, d * x) for _, _, _, h, lo, x in bars[3 * n + 1 : 3 * n + 13]]
            at = d * level
            e = next((k for k, b in enumerate(ahead[:6]) if b[0] >= at), None)
            if e is None:
                continue
            held = ahead[e + 1 : e + 7]
            outs = {(held[-1][2] - at if held else 0.0,)}
            for hi, lo, _ in held:
                if lo <= at - sl or hi >= at + tp:
                    outs = {((-sl if lo <= at - sl else tp), (tp if hi >= at + tp else -sl))}
                    break
            (o,) = outs
            want[t, side] = (o[0] - 1, o[-1] - 1)
    b = S.bracket(spark.createDataFrame(sig, "symbol string, t timestamp, buy double, sell double, sl_dist double, tp_dist double"), spark.createDataFrame(bars, "symbol string, t timestamp, o double, h double, l double, c double"), 6, 1.0)
    got = {}
    for r in S.bias_modes(b).collect():
        got.setdefault(r.mode, {})[r.t, r.side] = r.pnl
    assert got["stop_first"] == {k: v[0] for k, v in want.items()}
    assert got["target_first"] == {k: v[1] for k, v in want.items()}
    torn = [k for k, v in want.items() if v[0] != v[1]]
    wins = sum(got["coin"][k] == want[k][1] for k in torn)
    assert len(torn) > 20 and len(torn) * 0.2 < wins < len(torn) * 0.8
    assert all(got["coin"][k] in v for k, v in want.items())


def log(spark, cents, per_day=1):
    return spark.createDataFrame([(i, "b", T0 + timedelta(days=i // per_day, minutes=i % per_day), c) for i, c in enumerate(cents)], "log_id bigint, book string, open_time timestamp, cents bigint")


def drawdown(order, start=1000):
    e = top = start
    worst = 0
    for p in order:
        e += p
        top = max(top, e)
        worst = max(worst, top - e)
    return worst


@pytest.mark.parametrize("most", [V.DAYS, 0])
def test_drawdown_orders(spark, most):
    """All orders of four trades (two alike but for their time), drawn alike often, by list and by window."""
    x = [50, -30, -30, 20]
    r = {t.sim: t.max_dd for t in V.drawdown_replicates(log(spark, x), ["open_time", "log_id"], "cents", 600, 1000.0, most=most).collect()}
    every = [drawdown(p) for p in permutations(x)]
    assert len(r) == 601 and r[0] == drawdown(x) and set(r.values()) == set(every)
    assert abs(sum(r.values()) / 601 - sum(every) / 24) < 2


def test_drawdown_query_takes_trades(spark, monkeypatch):
    """Losses within a day count, and the real order is no draw: of two trades, half of the orders lose first."""
    monkeypatch.setattr(R, "trades", lambda s, d: log(spark, [100, -100], 2))
    seen = []
    draw = V.drawdown_replicates
    monkeypatch.setattr(V, "drawdown_replicates", lambda *a, **k: seen.append(draw(*a, **k)) or seen[0])
    r = R.k16(spark, "").first()
    assert (r.real, r.p50, r.p99) == (100, 100, 100) and seen[0].where("sim > 0").count() == 1000


def test_null_summary(spark, monkeypatch):
    """A log without losses reaches a profit factor that no sign flip does; each replicate has signs of its own."""
    monkeypatch.setattr(R, "trades", lambda s, d: log(spark, [10] * 30 + [-1]))
    r = R.k15(spark, "").first()
    pfs = [x.pf for x in V.sign_null(R._days(spark, ""), 500).where("replicate > 0").collect()]
    assert r.real == 300 and r.p_value == sum(p >= 300 for p in pfs) / 500 < 0.01
    assert r.edge_ratio == pytest.approx(300 / r.median) and r.passed and r.p5 < 0.7 < r.median < 1.5 < r.p95 and len(set(pfs)) > 10


def test_block_bootstrap_size(spark, monkeypatch):
    monkeypatch.setattr(R, "trades", lambda s, d: log(spark, [3, -2, 5, -1] * 10))
    n = []
    draw = V.bootstrap
    monkeypatch.setattr(V, "bootstrap", lambda *a, **k: n.append(draw(*a, **k)) or n[0])
    assert R.k01(spark, "").count() == 1 and n[0].count() == 10_000


def test_rolling_folds():
    """Six months to the next one over all months across a year's end; every day after the first window is tested once, with its train before it."""
    f = V.rolling_folds(date(2023, 8, 17), date(2024, 5, 3))
    assert [x[1] for x in f] == [date(2024, m, 1) for m in range(3, 6)] and f[0][0] == date(2023, 9, 1) and f[-1][2] == date(2024, 6, 1)
    days = V.rolling_folds(date(2024, 1, 1), date(2024, 1, 30))
    assert [x[1].day for x in days] == [13, 17, 21, 25, 29]
    for x in (f, days):
        assert all(a < b < c for a, b, c in x) and all(p[2] == q[1] for p, q in zip(x, x[1:]))


def test_every_row_is_scored_once(spark, monkeypatch):
    monkeypatch.setattr(P, "ROUNDS", 1)
    monkeypatch.setattr(P, "ROLLING_ROUNDS", 1)
    d = "/root/testdata/sf0.01"
    rows = [(r.symbol, r.t, r.pos, r.n) for r in P._rows(spark, d).collect()]
    got = sorted((r.symbol, r.t, r.fold) for r in P.l04(spark, d).collect())
    assert got == sorted((s, t, 4 - (n - pos) // (n // 7)) for s, t, pos, n in rows if pos > n - n // 7 * 5)
    first = min(t for _, t, _, _ in rows).date()
    got = sorted((r.symbol, r.t) for r in P.l07(spark, d).collect())
    assert got == sorted((s, t) for s, t, _, _ in rows if t.date() >= first + timedelta(days=12))


def test_rows_in_bars_over_a_hole(spark):
    """A weekend without bars is over 288 buckets of five minutes: its rows belong to the bar before."""
    m = lambda *x: [T0 + timedelta(minutes=k) for k in x]
    bars = [("x", t) for t in m(0, 5, 3000, 20000)] + [("y", t) for t in m(10)]
    rows = [("x", t, i) for i, t in enumerate(m(-1, 0, 4, 5, 2999, 3000, 19999, 20004, 20005))] + [("y", t, 20 + i) for i, t in enumerate(m(9, 10, 14, 15))] + [("x", None, 90), ("z", T0, 91)]
    out = J.within_bars(spark.createDataFrame(bars, "symbol string, b timestamp"), spark.createDataFrame(rows, "symbol string, ts timestamp, seq int"), ["symbol"], "b", "ts", 300)
    want = {}
    for k, t, seq in rows:
        b = [x for s, x in bars if s == k and t and x <= t]
        if b and (t < b[-1] + timedelta(minutes=5) or any(s == k and x > t for s, x in bars)):
            want[seq] = b[-1]
    assert {r.seq: r.bar_t for r in out.collect()} == want and {4, 6} < set(want)


@pytest.mark.parametrize("step", [0, 7])
def test_most_readings_over_the_limit(spark, step):
    """Few usable bars of range 1, and more without ticks that reach 100 and over beyond their body: alike (the median itself) or spread."""
    good = [(i, "f", "s", 10.0, 10.5, 9.5, 10.0, 3, i * 60000) for i in range(5)]
    bad = [(100 + i, "f", "s", 10.0, 110.0 + step * i, 10.0, 10.0, 0, (10 + i) * 60000) for i in range(9)]
    df = spark.createDataFrame(good + bad, "bar_id bigint, feed string, symbol string, open double, high double, low double, close double, tick_volume bigint, t_ms bigint")
    got = {r.bar_id for r in implausible.implausible_bars(df).where("spike").collect()}
    assert got == {b[0] for b in bad}


def test_blocks_are_the_whole_series(spark):
    """Windows over blocks and running exponential means give what one sort of the whole series gives, over holes, nulls and null keys."""
    import numpy as np
    import pandas as pd
    from pyspark.sql import Window

    from tidemark.functions import indicators as I

    rng = np.random.default_rng(4)
    rows = [(s, datetime(2024, 1, 1) + timedelta(hours=int(h)), float(x) if x > -1.2 else None) for s in ("a", "b", None) for h, x in zip(np.cumsum(rng.integers(1, 30, 700)), rng.normal(0, 1, 700))]
    df = spark.createDataFrame(rows, "symbol string, t timestamp, x double")
    b = I.in_blocks(df, ["symbol"], "t", 9, 3, size=16)
    w, whole = I.block_window("symbol"), Window.partitionBy("symbol").orderBy("t")
    agg = lambda w: {"m": F.avg("x").over(w.rowsBetween(-9, 0)), "n": F.max("x").over(w.rowsBetween(1, 3)), "g": F.lag("x", 4).over(w)}
    key = lambda r: (r.symbol or "", r.t)
    got, want = (sorted(x.select("symbol", "t", "m", "n", "g").collect(), key=key) for x in (I.own(b.withColumns(agg(w))), df.withColumns(agg(whole))))
    assert got == want and len(got) == len(rows)
    e = I.with_ema(I.with_position(df, ["symbol"], "t", 5 * 86_400), ["symbol"], "t", {"e8": ("x", 8), "e50": ("x", 50)})
    pdf = e.toPandas().sort_values("t")
    for s in ("a", "b", None):
        g = pdf[pdf.symbol.isna()] if s is None else pdf[pdf.symbol == s]
        for name, span in (("e8", 8), ("e50", 50)):
            np.testing.assert_allclose(g[name].to_numpy(float), g.x.astype(float).ewm(span=span, adjust=True).mean().to_numpy(), rtol=1e-9, atol=1e-12)
