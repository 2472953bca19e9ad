"""Bracket simulators over bars, every signal by itself; position by position in `replay`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.guards import drawn, drawn_below
from ..functions.indicators import block_window, in_blocks, own


def bracket(signals: DataFrame, bars: DataFrame, hold: int, cost: float) -> DataFrame:
    """Every (signal, side) by itself: fill at the level within the next `hold` bars, then stop or target within `hold` bars of the entry bar, exits from the bar after it.

    signals: symbol, t, buy, sell, sl_dist, tp_dist; bars: symbol, t, o, h, l, c. A bar that touches both is a stop. Without either the
    trade closes at the close of the last held bar (`timeout`, or `eod` if the series ends before). No state between trades, so the bars ahead of each
    bar are one bounded window and everything else is per row. Result: symbol, t, side, entry_i, exit_i, entry, exit, pnl, exit_reason, and for
    other readings of such bars `both` (the exit bar touched stop and target) and `pnl_target` (pnl had the target come first in it).
    """
    w = block_window("symbol").rowsBetween(1, 2 * hold)
    ahead = own(in_blocks(bars, ["symbol"], "t", 0, 2 * hold).withColumn("n", F.collect_list(F.struct("h", "l", "c")).over(w))).select("symbol", "t", "n")
    legs = F.array(*(F.struct(F.lit(s).alias("side"), F.col(c).alias("level"), F.lit(k).alias("dir")) for s, c, k in (("long", "buy", 1), ("short", "sell", -1))))
    x = signals.join(ahead, ["symbol", "t"]).select("symbol", "t", "n", "sl_dist", "tp_dist", F.explode(legs).alias("g")).select("symbol", "t", "n", "sl_dist", "tp_dist", "g.*").where("level IS NOT NULL")
    d, level = F.col("dir"), F.col("level")
    fill = F.array_position(F.transform(F.slice("n", 1, hold), lambda b: F.when(d > 0, b["h"] >= level).otherwise(b["l"] <= level)), True)
    x = x.withColumn("entry_i", fill.cast("int")).where("entry_i > 0")
    x = x.withColumn("m", F.slice("n", F.col("entry_i") + 1, hold))
    sl, tp = level - d * F.col("sl_dist"), level + d * F.col("tp_dist")
    stop = lambda b: F.when(d > 0, b["l"] <= sl).otherwise(b["h"] >= sl)
    goal = lambda b: F.when(d > 0, b["h"] >= tp).otherwise(b["l"] <= tp)
    x = x.withColumns({"si": F.array_position(F.transform("m", stop), True).cast("int"), "ti": F.array_position(F.transform("m", goal), True).cast("int")})
    si, ti = F.col("si"), F.col("ti")
    why = F.when((si > 0) & ((ti == 0) | (si <= ti)), "sl").when(ti > 0, "tp").when(F.size("m") >= hold, "timeout").otherwise("eod")
    x = x.withColumn("exit_reason", why)
    at = F.when(F.col("exit_reason") == "sl", si).when(F.col("exit_reason") == "tp", ti).otherwise(F.size("m"))
    out = F.when(F.col("exit_reason") == "sl", sl).when(F.col("exit_reason") == "tp", tp).otherwise(F.coalesce(F.get("m", F.size("m") - 1)["c"], level))
    return x.withColumns({"exit_i": (F.col("entry_i") + at).cast("int"), "exit": out}).select("symbol", "t", "side", "entry_i", "exit_i", F.col("level").alias("entry"), "exit", (d * (F.col("exit") - level) - cost).alias("pnl"), "exit_reason", ((si > 0) & (si == ti)).alias("both"), (d * (F.when((si > 0) & (si == ti), tp).otherwise(F.col("exit")) - level) - cost).alias("pnl_target"))


def bias_modes(b: DataFrame, seed: int = 42) -> DataFrame:
    """(symbol, t, side, mode, pnl): each bracket trade under stop_first, target_first and coin; they differ only where one bar touched both levels."""
    coin = drawn_below(drawn(seed, F.col("symbol"), F.unix_micros("t"), F.col("side")), 2) == 0
    modes = {"stop_first": F.col("pnl"), "target_first": F.col("pnl_target"), "coin": F.when(F.col("both") & coin, F.col("pnl_target")).otherwise(F.col("pnl"))}
    return b.select("symbol", "t", "side", F.explode(F.array(*(F.struct(F.lit(n).alias("mode"), c.alias("pnl")) for n, c in modes.items()))).alias("m")).select("symbol", "t", "side", "m.*")


def threshold_long(cands: DataFrame, bars: DataFrame, hold: int, sl: float, tp: float, cost: float) -> DataFrame:
    """Long at the next bar's open; stop (first) or target, by average range, from the entry bar on for `hold` bars, else out at the open of the last of them. cands: symbol, t, atr."""
    w = block_window("symbol").rowsBetween(1, hold + 1)
    ahead = own(in_blocks(bars, ["symbol"], "t", 0, hold + 1).withColumn("n", F.collect_list(F.struct("o", "h", "l")).over(w))).select("symbol", "t", "n")
    x = cands.join(ahead, ["symbol", "t"]).where(F.size("n") >= hold + 1).withColumn("entry", F.col("n")[0]["o"])
    stop, goal = F.col("entry") - sl * F.col("atr"), F.col("entry") + tp * F.col("atr")
    x = x.withColumns({"si": F.array_position(F.transform("n", lambda b: b["l"] <= stop), True), "ti": F.array_position(F.transform("n", lambda b: b["h"] >= goal), True)})
    lost, won = (F.col("si") > 0) & ((F.col("ti") == 0) | (F.col("si") <= F.col("ti"))), F.col("ti") > 0
    out = F.when(lost, stop).when(won, goal).otherwise(F.col("n")[hold]["o"])
    return x.select("symbol", "t", "entry", out.alias("exit"), (out - F.col("entry") - cost).alias("pnl"), F.when(lost, "sl").when(won, "tp").otherwise("time").alias("exit_reason"))


def position_size(equity: Column, risk_pct: Column, stop_value: Column, lot_min: float = 0.01, lot_max: float = 100.0, step: float = 0.01) -> Column:
    """Lots for a risk in per cent of equity, floored to the lot step and clamped; 0 without a stop."""
    raw = equity * risk_pct / 100 / stop_value
    return F.when(stop_value > 0, F.greatest(F.lit(lot_min), F.least(F.lit(lot_max), F.floor(F.round(raw / step, 6)) * step))).otherwise(0.0)


def kelly(p: Column, ratio: Column) -> Column:
    """Kelly fraction of a win chance and a win to loss ratio, not below 0."""
    return F.when(ratio > 0, F.greatest(F.lit(0.0), p - (1 - p) / ratio)).otherwise(0.0)
