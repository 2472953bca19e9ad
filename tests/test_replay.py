"""Replays against a plain row-by-row state machine."""

import random

import pytest

from tidemark.operators import replay as R

HOUR, FIVE, DAY = 3_600_000_000, 300_000_000, 86_400_000_000
RULES = R.Rules(wait=2, hold=2, stops=2.0, freeze=0.5, gap_us=2 * FIVE, cost=1.0, slip=0.25, trades_a_day=3, daily_loss=0.03)


def market(seed, days=6):
    random.seed(seed)
    p, rows = 1000.0, []
    for i in range(days * 288):
        if random.random() < 0.02:
            continue
        o = p
        p += random.gauss(0, 4)
        rows.append((i * FIVE, max(o, p) + random.random() * 3, min(o, p) - random.random() * 3, p))
    return rows


def brackets(rows, symbol):
    close = {}
    for u, _, _, c in rows:
        close[u // HOUR * HOUR] = c
    out = []
    for i, (u, c) in enumerate(sorted(close.items())):
        if random.random() < 0.5:
            out.append((symbol, i, u, c + random.choice([1.0, 4.0, 9.0]) if random.random() < 0.8 else None, c - random.choice([3.0, 8.0]) if random.random() < 0.8 else None, random.choice([1.0, 6.0, 12.0, 70.0]), random.choice([5.0, 20.0, 90.0]), random.choice([0.0, 4.0]), random.choice([0.0, 5.0]), c, 0.75))
    return out


def by_bars(s, rows, r):
    """Outcome of one signal, row by row."""
    _, _, u0, buy, sell, sl, tp, be, trail, close, spread = s
    ok_b = buy is not None and buy - close - spread >= r.stops and sl >= r.stops and tp >= r.stops
    ok_s = sell is not None and close - sell >= r.stops and sl >= r.stops and tp >= r.stops
    if not (ok_b or ok_s):
        return None
    pos = None
    for u, h, low, c in rows:
        if u < u0 + HOUR:
            continue
        if pos is None:
            if u >= u0 + HOUR * (1 + r.wait):
                return "unfilled"
            for k, ok, hit in ((1, ok_b, ok_b and h >= buy), (-1, ok_s, ok_s and low <= sell)):
                if hit:
                    lv = buy if k > 0 else sell
                    pos = [k, lv + k * (spread + r.slip), lv - k * sl, lv + k * tp, u, False, lv + k * (spread + r.slip)]
                    break
            continue
        k, entry, stop, goal, at, even, best = pos
        full = u // HOUR > at // HOUR
        top, bottom = (h, low) if k > 0 else (low, h)
        if full:
            best = max(best, top) if k > 0 else min(best, top)
            pos[6] = best
        if k * (bottom - stop) <= 0:
            return k, entry, stop, "sl", at, u
        if k * (top - goal) >= 0:
            return k, entry, goal, "tp", at, u
        if full:
            if be > 0 and not even and k * (best - entry) >= be and k * (c - entry - k * spread) >= r.freeze:
                pos[2], pos[5] = entry + k * spread, True
            if trail > 0 and pos[5]:
                new = best - k * trail
                if k * (new - pos[2]) > 0 and k * (c - new) >= r.freeze:
                    pos[2] = new
            if u - at >= r.hold * HOUR and k * (c - entry) < 0:
                return k, entry, c, "time_stop", at, u
    if pos is None:
        return "unfilled"
    return pos[0], pos[1], rows[-1][3], "end_of_data", pos[4], rows[-1][0]


def book(found, r, by_exit, after, gain):
    """Taken trades of one symbol, bar by bar: {id: balance}."""
    free, balance, days, out = -1, r.start, {}, {}
    for u, i, o in sorted((u, i, o) for (u, i), o in found.items() if o is not None):
        if u < free:
            continue
        n, lost = days.get(u // DAY, (0, 0.0))
        if n >= r.trades_a_day or (lost < 0 and -lost >= balance * r.daily_loss):
            continue
        if o == "unfilled":
            free = u + (r.wait + 1) * HOUR
            continue
        g = gain(o)
        balance += g
        d = (o[5] if by_exit else u) // DAY
        n, lost = days.get(d, (0, 0.0))
        days[d] = (n + 1, lost + g)
        free = (o[5] // HOUR + after) * HOUR
        out[i] = balance
    return out


SIGNAL = "symbol string, id bigint, u bigint, buy double, sell double, sl_dist double, tp_dist double, be_dist double, trail_dist double, close double, spread double"


def test_bracket_ea(spark):
    rows = {s: market(k) for k, s in ((1, "a"), (2, "b"))}
    sig = [x for s in rows for x in brackets(rows[s], s)]
    bars = spark.createDataFrame([(s, *r) for s in rows for r in rows[s]] + [(None, 0, 1.0, 1.0, 1.0)], "symbol string, u bigint, h double, l double, c double")
    df = spark.createDataFrame(sig, SIGNAL)
    got = {(r.symbol, r.id): (r.side, r.exit, r.reason, r.entry_u, r.exit_u, r.balance) for r in R.bracket_ea(df, bars, RULES).collect()}
    want = {}
    for s in rows:
        found = {(x[2], x[1]): by_bars(x, rows[s], RULES) for x in sig if x[0] == s}
        taken = book(found, RULES, True, 1, lambda o: o[0] * (o[2] - o[1]) - RULES.cost)
        ids = {i: o for (_, i), o in found.items()}
        want |= {(s, i): ("long" if ids[i][0] > 0 else "short", ids[i][2], ids[i][3], ids[i][4], ids[i][5], b) for i, b in taken.items()}
    assert got.keys() == want.keys() and len(want) > 20
    for k in want:
        assert got[k][2:5] == want[k][2:5] and got[k][0] == want[k][0] and got[k][1] == pytest.approx(want[k][1]) and got[k][5] == pytest.approx(want[k][5]), k
    assert {w[2] for w in want.values()} >= {"sl", "tp", "time_stop"}
    assert R.bracket_ea(df.limit(0), bars, RULES).count() == 0 and R.bracket_ea(df, bars.limit(0), RULES).count() == 0


def by_ticks(s, ticks, r):
    _, _, u0, buy, sell, sl, tp, be, trail, _, _ = s
    if sl < r.stops or tp < r.stops or (buy is None and sell is None):
        return None
    pos, before = None, None
    window = [t for t in ticks if u0 + HOUR <= t[0] < u0 + HOUR * (2 + r.hold)]
    for u, bid, ask in window:
        gap = before is not None and u - before > r.gap_us
        before = u
        if pos is None:
            if gap:
                return "unfilled"
            k = 1 if buy is not None and ask >= buy else -1 if sell is not None and bid <= sell else 0
            if k:
                lv, e = (buy, ask) if k > 0 else (sell, bid)
                pos = [k, e, lv - k * sl, lv + k * tp, u, False, e, ask - bid]
            continue
        k, e, stop, goal, at, even, best, spread = pos
        out, other = (bid, ask) if k > 0 else (ask, bid)
        if gap:
            return k, e, out, "session_gap", at, u, spread
        if u >= at + r.hold * HOUR and k * (out - e) < 0:
            return k, e, out, "time", at, u, spread
        best = pos[6] = max(best, other) if k > 0 else min(best, other)
        if k * (out - stop) <= 0:
            return k, e, out, "sl", at, u, spread
        if k * (out - goal) >= 0:
            return k, e, out, "tp", at, u, spread
        if be > 0 and not even and k * (best - e) >= be:
            new = e + k * spread
            if k * (new - stop) > 0 and k * (out - new) >= r.freeze:
                pos[2], pos[5] = new, True
        if trail > 0 and pos[5]:
            new = best - k * trail
            if k * (new - pos[2]) > 0 and k * (out - new) >= r.freeze:
                pos[2] = new
    if pos is None:
        return "unfilled"
    u, bid, ask = window[-1]
    return pos[0], pos[1], bid if pos[0] > 0 else ask, "time", pos[4], u, pos[7]


def test_tick_book(spark):
    rows = market(3)
    sig = brackets(rows, "a")
    ticks = [(u + 1000 * j, v - 0.4, v + 0.4) for u, h, low, c in rows for j, v in enumerate(random.sample([h, low, c], 3))]
    df = spark.createDataFrame(sig, SIGNAL)
    t = spark.createDataFrame([("a", *x) for x in ticks], "symbol string, u bigint, bid double, ask double")
    found = {(x[2], x[1]): by_ticks(x, ticks, RULES) for x in sig}
    alone = {r.id: (r.state, r.exit, r.reason, r.exit_u) for r in R.tick_outcomes(df, t, RULES).collect()}
    for (_, i), o in found.items():
        want = ("rejected", None, None, None) if o is None else ("unfilled", None, None, None) if o == "unfilled" else ("filled", o[2], o[3], o[5])
        assert alone[i][0] == want[0] and alone[i][2:] == want[2:] and (want[1] is None or alone[i][1] == pytest.approx(want[1])), (i, alone[i], o)
    got = {r.id: r.balance for r in R.tick_book(df, t, RULES).collect()}
    assert got == pytest.approx(book(found, RULES, False, 0, lambda o: o[0] * (o[2] - o[1]) - o[6] - RULES.cost)) and len(got) > 10


def test_night_fade(spark):
    import numpy as np
    import pandas as pd

    from tidemark.operators import signals as G

    rows = market(11, 8)
    b = pd.DataFrame(rows, columns=["u", "h", "l", "c"])
    b["t"] = pd.to_datetime(b.u, unit="us") + pd.Timedelta(days=19_000)
    b["o"] = b.c.shift().fillna(b.c)
    b["v"] = 1
    m = b.groupby(b.t.dt.floor("15min")).agg(o=("o", "first"), h=("h", "max"), l=("l", "min"), c=("c", "last"))
    p = m.c.shift().fillna(m.c)
    m["a"] = np.maximum(m.h - m.l, np.maximum(abs(m.h - p), abs(m.l - p))).rolling(14).mean()
    m["m"] = m.c.ewm(span=50, adjust=True).mean()
    m["end"] = m.index + pd.Timedelta(minutes=15)
    x = pd.merge_asof(b, m[["end", "a", "m"]], left_on="t", right_on="end")
    want, free, hold = [], -1, 12
    for i in range(len(x) - hold):
        r = x.iloc[i]
        if not (r.t.hour >= 22 or r.t.hour < 7) or i <= free or not r.a > 0 or abs(r.c - r.m) < 2 * r.a:
            continue
        k = -1 if r.c > r.m else 1
        stop, goal = r.c - k * r.a, r.c + k * 1.5 * r.a
        for j in range(i + 1, i + hold + 1):
            y = x.iloc[j]
            if (y.l <= stop) if k > 0 else (y.h >= stop):
                out, why = stop, "sl"
                break
            if (y.h >= goal) if k > 0 else (y.l <= goal):
                out, why = goal, "tp"
                break
        else:
            out, why = y.c, "timeout"
        free = j
        want.append((r.t, "long" if k > 0 else "short", y.t, out, why))
    df = spark.createDataFrame(b.assign(symbol="a")[["symbol", "t", "o", "h", "l", "c", "v"]])
    got = sorted((r.t, r.side, r.exit_t, r.exit, r.reason) for r in G.night_fade(df, 2.0, 1.0, 1.5, hold, 0.0).collect())
    assert len(want) > 5 and [g[:3] + g[4:] for g in got] == [w[:3] + w[4:] for w in want]
    assert [g[3] for g in got] == pytest.approx([w[3] for w in want])
    assert G.night_fade(df.limit(0), 2.0, 1.0, 1.5, hold, 0.0).count() == 0
