"""Bracket orders replayed over a finer frame: bars within bars, or ticks.

What becomes of a signal (fill, exit, gain) rests on prices alone, so every signal is replayed by itself, in tasks of one (symbol, block of time). What rests on
the trades before it (is a position open, how many trades and how much loss today) is settled afterwards by one pass over the outcomes, of which there is one per signal.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written

#: Least length of the blocks of time in which a symbol is split over tasks.
BLOCK_US = 86_400 * 1_000_000
OUTCOME = "symbol string, id bigint, u bigint, state string, side string, entry double, exit double, sl double, tp double, pnl double, reason string, entry_u bigint, exit_u bigint, spread double"
COLUMNS = [c.split()[0] for c in OUTCOME.split(", ")]


@dataclass(frozen=True)
class Rules:
    """Of an order and a book. Times in microseconds, distances in price units.

    bar_us: length of the signals' bars; wait: bars a bracket waits for its fill; hold: bars after which a losing position is closed; stops, freeze: least distance of a new order and of
    a moved stop from the price; gap_us: a longer step between ticks ends a replay (ticks only); cost: charged once a trade; slip: added to the entry; size: money per price unit.
    """

    bar_us: int = 3_600_000_000
    wait: int = 3
    hold: int = 24
    stops: float = 0.0
    freeze: float = 0.0
    gap_us: int = 60_000_000
    cost: float = 0.0
    slip: float = 0.0
    size: float = 1.0
    trades_a_day: int = 5
    daily_loss: float = 0.05
    start: float = 1000.0


def _first(hit) -> int:
    """Place of the first true value, or the length."""
    i = int(hit.argmax()) if len(hit) else 0
    return i if len(hit) and hit[i] else len(hit)


def _moved_stop(sign: int, entry: float, stop: float, best, near, spread: float, be: float, trail: float, freeze: float, only_up: bool):
    """The stop in force at each row (moves made by the rows before it), the row's own move excluded.

    best: running best price; near: the price a new stop is measured from. Once the best price is `be` beyond the entry the stop goes to the entry and spread; from then on
    it follows the best price at `trail`; a move nearer than `freeze` to the price is not made. only_up: the first move, too, must not loosen the stop.
    """
    import numpy as np

    n = len(best)
    path = np.full(n + 1, stop)
    even = entry + sign * spread
    if be > 0:
        ok = (sign * (best - entry) >= be) & (sign * (near - even) >= freeze)
        b = _first(ok) if not only_up or sign * (even - stop) > 0 else n
        if b < n:
            path[b + 1 :] = even
            if trail > 0:
                follow = np.where(sign * (near - (best - sign * trail)) >= freeze, sign * (best - sign * trail), -np.inf)
                follow[:b] = -np.inf
                path[b + 1 :] = sign * np.maximum(sign * even, np.maximum.accumulate(follow)[b:])
    return path[:-1]


def _replay_bars(s, u, h, low, c, r: Rules, last_u: int):
    """One signal over finer bars (u, h, low, c) from its bar's end on. The buy side fills first, the stop comes before the target; in the rest of the bar of the fill only stop and target are looked at."""
    import numpy as np

    levels = {1: s.buy, -1: s.sell}
    ok = {k: v == v and k * (v - s.close) - (s.spread if k > 0 else 0.0) >= r.stops and s.sl_dist >= r.stops and s.tp_dist >= r.stops for k, v in levels.items()}
    if not any(ok.values()):
        return "rejected", None
    end = np.searchsorted(u, s.u + r.bar_us * (1 + r.wait))
    up = h[:end] >= levels[1] if ok[1] else np.zeros(end, bool)
    down = low[:end] <= levels[-1] if ok[-1] else np.zeros(end, bool)
    f = _first(up | down)
    if f == end:
        return "unfilled", None
    k = 1 if up[f] else -1
    level = levels[k]
    entry, stop, goal = level + k * (s.spread + r.slip), level - k * s.sl_dist, level + k * s.tp_dist
    top, bottom = (h, low) if k > 0 else (low, h)
    rest = np.searchsorted(u, (u[f] // r.bar_us + 1) * r.bar_us)
    a = f + 1
    best = np.maximum.accumulate(k * np.concatenate([[entry], top[rest:]]))[1:] * k
    path = np.concatenate([np.full(max(rest - a, 0), stop), _moved_stop(k, entry, stop, best, c[rest:], s.spread, s.be_dist, s.trail_dist, r.freeze, False)])
    lost, won = k * (bottom[a:] - path) <= 0, k * (top[a:] - goal) >= 0
    held = u[a:] - u[f] >= r.hold * r.bar_us
    late = held & (k * (c[a:] - entry) < 0) & (np.arange(a, len(u)) >= rest)
    i = _first(lost | won | late)
    if a + i == len(u):
        if not len(u) or u[-1] < last_u:
            return "open", None
        i, out, why = len(u) - 1 - a, c[-1], "end_of_data"
    else:
        out, why = (path[i], "sl") if lost[i] else (goal, "tp") if won[i] else (c[a + i], "time_stop")
    x = a + i
    return "filled", (k, entry, out, path[i] if 0 <= i < len(path) else stop, goal, (k * (out - entry) - r.cost) * r.size, why, u[f], u[x], s.spread)


def _replay_ticks(s, u, bid, ask, r: Rules, last_u: int):
    """One signal over ticks from its bar's end on: entry at the ask (bid for a short), exit at the other; a step over gap_us leaves it unfilled, or closes it. The spread is charged once more."""
    import numpy as np

    ok = {k: v == v and s.sl_dist >= r.stops and s.tp_dist >= r.stops for k, v in ((1, s.buy), (-1, s.sell))}
    if not any(ok.values()):
        return "rejected", None
    end = np.searchsorted(u, s.u + r.bar_us * (2 + r.hold))
    u, bid, ask = u[:end], bid[:end], ask[:end]
    gap = np.zeros(end, bool)
    gap[1:] = np.diff(u) > r.gap_us
    up = ask >= s.buy if ok[1] else np.zeros(end, bool)
    down = bid <= s.sell if ok[-1] else np.zeros(end, bool)
    f = _first(gap | up | down)
    if f == end or gap[f]:
        return "unfilled", None
    k = 1 if up[f] else -1
    level, entry, spread = (s.buy if k > 0 else s.sell), (ask[f] if k > 0 else bid[f]), ask[f] - bid[f]
    stop, goal = level - k * s.sl_dist, level + k * s.tp_dist
    out_, in_ = (bid, ask) if k > 0 else (ask, bid)
    a = f + 1
    best = np.maximum.accumulate(k * np.concatenate([[entry], in_[a:]]))[1:] * k
    path = _moved_stop(k, entry, stop, best, out_[a:], spread, s.be_dist, s.trail_dist, r.freeze, True)
    late = (u[a:] >= u[f] + r.hold * r.bar_us) & (k * (out_[a:] - entry) < 0)
    lost, won = k * (out_[a:] - path) <= 0, k * (out_[a:] - goal) >= 0
    i = _first(gap[a:] | late | lost | won)
    if a + i == end:
        i, why = end - 1 - a, "time"
    else:
        why = "session_gap" if gap[a + i] else "time" if late[i] else "sl" if lost[i] else "tp"
    x = a + i
    out = out_[x]
    return "filled", (k, entry, out, path[i] if 0 <= i < len(path) else stop, goal, (k * (out - entry) - spread - r.cost) * r.size, why, u[f], u[x], spread)


def outcomes(signals: DataFrame, rows: DataFrame, prices: list[str], replay: Callable, r: Rules, horizon_us: int) -> DataFrame:
    """One row per signal (OUTCOME): state rejected, unfilled or filled, and if filled how it went, whatever else was going on.

    signals: symbol, id, u (start of its bar, microseconds), buy, sell (null: none), sl_dist, tp_dist, be_dist, trail_dist, close, spread; rows: symbol, u and `prices`, as `replay` takes them. Rows of one time go
    by their prices. Null symbols and times take no part; signals without rows after them are unfilled.

    A signal and the rows of `horizon_us` after it meet in the block of time in which it begins: a row goes to the blocks that can reach it, mostly one or two. Positions that outlast
    the horizon are replayed over four times of it, and so on; each turn leaves few.
    """
    known = "symbol IS NOT NULL AND u IS NOT NULL"
    sig = signals.where(known).select("symbol", "id", "u", *(F.col(c).cast("double").alias(c) for c in ("buy", "sell", "sl_dist", "tp_dist", "be_dist", "trail_dist", "close", "spread")))
    rows = rows.where(known).select("symbol", "u", *(F.col(c).cast("double").alias(c) for c in prices))
    ends = rows.groupBy(F.col("symbol").alias("_s")).agg(F.max("u").alias("last_u"))
    sig = written(sig.join(ends, F.col("symbol") == F.col("_s"), "left").drop("_s").withColumn("last_u", F.coalesce("last_u", F.lit(0))), "replay-signals")

    def run(key, s, x):
        import pandas as pd

        x = x.sort_values(["u", *prices], kind="stable")
        u, arrays = x["u"].to_numpy(), [x[p].to_numpy(float) for p in prices]
        out = []
        for g in s.itertuples():
            lo = u.searchsorted(g.u + r.bar_us)
            hi = u.searchsorted(g.u + r.bar_us + key[2])
            state, v = replay(g, u[lo:hi], *(a[lo:hi] for a in arrays), r, g.last_u)
            side = None if v is None else "long" if v[0] > 0 else "short"
            out.append((g.symbol, g.id, g.u, state, side, *(v[1:] if v else [None] * 9)))
        return pd.DataFrame(out, columns=COLUMNS).astype({"entry_u": "Int64", "exit_u": "Int64"})

    done, todo, reach = None, sig, horizon_us
    while True:
        block = max(BLOCK_US, reach)
        at = lambda c: F.floor(c / block)  # noqa: E731, B023
        s = todo.withColumns({"_b": at(F.col("u")), "_h": F.lit(reach)})
        x = rows.withColumn("_b", F.explode(F.sequence(at(F.col("u") - r.bar_us - reach), at(F.col("u") - r.bar_us)))).withColumn("_h", F.lit(reach))
        x = x.join(s.select("symbol", "_b").distinct(), ["symbol", "_b"], "left_semi")
        got = written(s.groupBy("symbol", "_b", "_h").cogroup(x.groupBy("symbol", "_b", "_h")).applyInPandas(run, OUTCOME), "replay")
        part = got.where("state <> 'open'")
        done = part if done is None else done.unionByName(part)
        left = got.where("state = 'open'")
        if left.isEmpty():
            return done
        todo = sig.join(left.select("symbol", "id"), ["symbol", "id"], "left_semi")
        reach *= 4


def in_turn(found: DataFrame, r: Rules, by_exit: bool, after: int) -> DataFrame:
    """The trades of `outcomes` that a book of one position per symbol takes, with the balance after each.

    Signals go in order of time (then id). One is passed over while a bracket waits or a position is open, after trades_a_day trades or a loss of daily_loss of the balance on its day (the day of the signal, or of
    the exit with by_exit). An unfilled bracket is given up after `wait` bars; a signal counts again from `after` bars past the bar of the exit. One pass per symbol over its signals, each decision
    resting on all before it; no price is looked at.
    """
    day = 86_400 * 1_000_000

    def run(key, x):
        import pandas as pd

        x = x[x["state"] != "rejected"].sort_values(["u", "id"], kind="stable")
        free, balance, today, n, lost, out = None, r.start, None, 0, 0.0, []
        waiting = []  # (day, gain) of trades that count on a day yet to come
        for s in x.itertuples():
            if free is not None and s.u < free:
                continue
            d = s.u // day
            if d != today:
                mine = [p for e, p in waiting if e == d]
                today, n, lost = d, len(mine), sum(mine)
                waiting = [w for w in waiting if w[0] > d]
            if n >= r.trades_a_day or (lost < 0 and -lost >= balance * r.daily_loss):
                continue
            if s.state == "unfilled":
                free = s.u + (r.wait + 1) * r.bar_us
                continue
            balance += s.pnl
            counts = int(s.exit_u) // day if by_exit else d
            if counts == d:
                n, lost = n + 1, lost + s.pnl
            else:
                waiting.append((counts, s.pnl))
            free = (int(s.exit_u) // r.bar_us + after) * r.bar_us
            out.append((*(getattr(s, c) for c in COLUMNS), balance))
        return pd.DataFrame(out, columns=[*COLUMNS, "balance"])

    return found.groupBy("symbol").applyInPandas(run, OUTCOME + ", balance double").drop("state")


def bracket_ea(signals: DataFrame, bars: DataFrame, r: Rules) -> DataFrame:
    """One bracket position at a time per symbol, by bars (symbol, u, h, l, c) finer than the signals': fills, stops, break-even, trailing, time stop of losers, expiry, daily limits, end of data."""
    return in_turn(outcomes(signals, bars, ["h", "l", "c"], _replay_bars, r, r.bar_us * (1 + r.wait + 2 * r.hold)), r, True, 1)


def tick_outcomes(signals: DataFrame, ticks: DataFrame, r: Rules) -> DataFrame:
    """Each signal by itself over ticks (symbol, u, bid, ask)."""
    return outcomes(signals, ticks, ["bid", "ask"], _replay_ticks, r, r.bar_us * (1 + r.hold))


def tick_book(signals: DataFrame, ticks: DataFrame, r: Rules) -> DataFrame:
    """One position at a time per symbol over ticks, with daily limits."""
    return in_turn(tick_outcomes(signals, ticks, r), r, False, 0)
