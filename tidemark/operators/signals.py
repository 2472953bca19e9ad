"""Entry signals: every strategy is a pair of level expressions, the driver one window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from ..functions import indicators as I
from .bars import bars_to_bars
from .joins import asof_backward
from .metrics import greedy_no_overlap



def night_range(bars: DataFrame) -> DataFrame:
    """(symbol, day, hi, lo) of 22:00 the day before to 07:00."""
    h = F.hour("t")
    day = F.to_date(F.when(h >= 22, F.col("t") + F.expr("interval 1 day")).otherwise(F.col("t")))
    return bars.where((h >= 22) | (h < 7)).groupBy("symbol", day.alias("day")).agg(F.max("h").alias("hi"), F.min("l").alias("lo"))


def inside(w: WindowSpec) -> Column:
    """Two inside bars in a row."""
    h, lo = (lambda k: F.lag("h", k).over(w)), (lambda k: F.lag("l", k).over(w))
    return (F.col("h") < h(1)) & (F.col("l") > lo(1)) & (h(1) < h(2)) & (lo(1) > lo(2))


#: Rows the indicators of `context` look back (the band's mean width over 30 of 20 rows, channels of 48).
BACK = 64


def context(bars: DataFrame) -> DataFrame:
    """All indicators the strategies look at: symbol, t, o, h, l, c, v and they. Series are taken in blocks with the rows before them, exponential means as running sums."""
    c = F.col("c")
    df = I.with_ema(I.with_position(bars, ["symbol"], "t"), ["symbol"], "t", {"ema8": ("c", 8), "ema21": ("c", 21)})
    df, w = I.in_blocks(df, ["symbol"], "t", BACK), I.block_window("symbol")
    df = df.withColumns({"tr": I.true_range(w, seed=True), "diff": F.coalesce(c - F.lag("c").over(w), F.lit(0.0)), "tp": F.col("h") + F.col("l") + c})
    n20 = F.count("c").over(I.rows(w, 20)) >= 20
    df = df.withColumns({
        "atr": F.round(I.sma(F.col("tr"), w, 14), 6), "ret5": c - F.lag("c", 5).over(w), "rsi": I.rsi(F.col("diff"), w, 14, 100.0), "vma": I.sma(F.col("v"), w, 20),
        "ema8": F.when(F.count("c").over(I.rows(w, 8)) >= 8, F.col("ema8")), "ema21": F.when(F.count("c").over(I.rows(w, 21)) >= 21, F.col("ema21")),
        "cci": I.cci(F.col("tp"), w, 20), "bbm": F.when(n20, F.avg("c").over(I.rows(w, 20))), "bbs": F.when(n20, F.stddev_samp("c").over(I.rows(w, 20))), "inside": inside(w), "h2": F.lag("h", 2).over(w), "l2": F.lag("l", 2).over(w),
        **{f"hi{k}": I.full(F.col("h"), w, k, F.max("h").over(I.rows(w, k))) for k in (12, 24, 48)}, **{f"lo{k}": I.full(F.col("l"), w, k, F.min("l").over(I.rows(w, k))) for k in (12, 24, 48)},
    })
    df = I.own(df.withColumn("bbw", 4 * F.col("bbs")).withColumn("bbwma", I.sma(F.col("bbw"), w, 30))).withColumn("_day", F.to_date("t"))
    night = night_range(bars).select(F.col("symbol").alias("_ns"), F.col("day").alias("_nd"), F.col("hi").alias("ahi"), F.col("lo").alias("alo"))
    return df.join(night, (F.col("symbol") == F.col("_ns")) & (F.col("_day") == F.col("_nd")), "left").drop("_ns", "_nd")


def _not(c: Column) -> Column:
    """Guards let a missing value pass, as comparisons with NaN do."""
    return ~F.coalesce(c, F.lit(False))


def _levels(**p) -> dict[str, tuple[Column | None, Column | None]]:
    """(buy level, sell level) of each strategy; null where it does not fire."""
    bo = p.get("offset", 0.3)
    c, atr, v, vma, ret5, rsi = (F.col(x) for x in ("c", "atr", "v", "vma", "ret5", "rsi"))
    up, dn = c + bo * atr, c - bo * atr
    has_vma = vma > 0
    loud, quiet = has_vma & (v >= p.get("vol_mult", 2.0) * vma), has_vma & (v < 0.5 * vma)
    e8, e21 = F.col("ema8"), F.col("ema21")
    rng = F.col("ahi") - F.col("alo")
    night = (rng > 0) & (rng <= p.get("max_night_atr", 10.0) * atr)
    k = p.get("lookback", 12) if p.get("lookback", 12) in (12, 24) else 48
    tight = F.col("bbw") < 0.7 * F.col("bbwma")
    upper, lower = F.col("bbm") + 2 * F.col("bbs"), F.col("bbm") - 2 * F.col("bbs")
    edge = p.get("inside_offset", 0.0)
    rise, fall = _not(ret5 <= 0), _not(ret5 >= 0)
    over_, under = _not(e8 <= e21), _not(e8 >= e21)
    on = lambda cond, level: F.when(cond, level)
    return {
        "atr_bracket": (up, dn), "atr_breakout": (up, dn), "null_bracket": (up, dn),
        "night_range": (on(night, F.col("ahi")), on(night, F.col("alo"))),
        "momentum_long": (on(rise, up), None), "momentum_short": (None, on(fall, dn)), "momentum_bracket": (on(rise, up), on(fall, dn)),
        "fade_long": (on(rsi < 35, up), None), "fade_short": (None, on(rsi > 65, dn)),
        "rsi_long": (on(rsi > 55, up), None), "rsi_short": (None, on(rsi < 45, dn)),
        "ema_cross_long": (on(over_, up), None), "ema_cross_short": (None, on(under, dn)), "ema_trend_bracket": (on(over_, up), on(under, dn)),
        "ema_fade_long": (on(under, up), None), "ema_fade_short": (None, on(over_, dn)),
        "breakout_range": (F.col(f"hi{k}"), F.col(f"lo{k}")),
        "vol_spike_bracket": (on(loud, up), on(loud, dn)), "vol_quiet_bracket": (on(quiet, up), on(quiet, dn)),
        "high_vol_long": (on(loud & rise, up), None), "high_vol_short": (None, on(loud & fall, dn)),
        "cci_fade_long": (on(F.col("cci") <= -200, up), None), "cci_fade_short": (None, on(F.col("cci") >= 200, dn)),
        "bb_squeeze_long": (on(tight & (c > upper), up), None), "bb_squeeze_short": (None, on(tight & (c < lower), dn)),
        "inside_inside_long": (on(F.col("inside"), F.col("h2") + edge * atr), None), "inside_inside_short": (None, on(F.col("inside"), F.col("l2") - edge * atr)),
    }


# The strategies' names.
STRATEGIES = [
    "atr_bracket", "atr_breakout", "null_bracket", "night_range", "momentum_long", "momentum_short", "momentum_bracket", "fade_long", "fade_short", "rsi_long", "rsi_short", "ema_cross_long", "ema_cross_short", "ema_trend_bracket",
    "ema_fade_long", "ema_fade_short", "breakout_range", "vol_spike_bracket", "vol_quiet_bracket", "high_vol_long", "high_vol_short", "cci_fade_long", "cci_fade_short", "bb_squeeze_long", "bb_squeeze_short", "inside_inside_long", "inside_inside_short",
]


def generate(ctx: DataFrame, strategy: str, start: int = 7, end: int = 20, min_prob: float | None = None, **params) -> DataFrame:
    """(symbol, t, buy, sell): the first signal of each side per symbol and day.

    Bars outside hours [start, end), without a positive average range or (with min_prob) below that `prob` are passed over; a side whose level the bar itself touched
    is dropped. Only what is emitted counts for the day, so "one a day" is a running count of what is left.
    """
    buy, sell = _levels(**params)[strategy]
    null = F.lit(None).cast("double")
    hour = F.hour("t")
    df = ctx.where((F.col("atr") > 0) & (hour >= start) & (hour < end))
    if min_prob is not None:
        df = df.where(F.col("prob") >= min_prob)
    df = df.select("symbol", "t", "h", "l", (null if buy is None else buy).alias("buy"), (null if sell is None else sell).alias("sell"))
    df = df.withColumns({"buy": F.when(_not(F.col("h") >= F.col("buy")), F.col("buy")), "sell": F.when(_not(F.col("l") <= F.col("sell")), F.col("sell"))})
    day = Window.partitionBy("symbol", F.to_date("t")).orderBy("t")
    df = df.withColumns({"_b": F.count("buy").over(day), "_s": F.count("sell").over(day)})
    df = df.select("symbol", "t", F.round(F.when(F.col("_b") == 1, F.col("buy")), 4).alias("buy"), F.round(F.when(F.col("_s") == 1, F.col("sell")), 4).alias("sell"))
    return df.where("buy IS NOT NULL OR sell IS NOT NULL")


def night_fade(bars: DataFrame, stretch: float, sl: float, tp: float, hold: int, cost: float, start: int = 22, end: int = 7) -> DataFrame:
    """Trades (symbol, t, side, entry, exit_t, exit, pnl, reason) that fade closes `stretch` average ranges or more from the exponential mean (50) in the night hours, one at a time per symbol.

    Mean and average range (14) are those of the last closed quarter hour, carried on to the bars. Stop (first) or target, in average ranges, within `hold` bars, else the close of the last of them;
    candidates with fewer bars left are passed over. What becomes of a candidate rests on prices alone, so all are followed at once in blocks; those that open before the bar after
    the last kept one's exit are dropped afterwards.
    """
    quarter = F.window("t", "15 minutes")["start"]
    slow = I.with_ema(I.with_position(bars_to_bars(bars, ["symbol"], quarter), ["symbol"], "t"), ["symbol"], "t", {"mean": ("c", 50)})
    slow, w = I.in_blocks(slow, ["symbol"], "t", 16), I.block_window("symbol")
    slow = slow.withColumn("tr", I.true_range(w, seed=True)).withColumn("a15", F.round(I.sma(F.col("tr"), w, 14), 6))
    slow = I.own(slow).select("symbol", F.col("t").alias("st"), F.round("mean", 4).alias("mean"), "a15")
    rows = I.with_position(bars.select("symbol", "t", "h", "l", "c"), ["symbol"], "t").withColumn("pos", F.col("_p"))
    # the last quarter that ended at or before the bar's start
    rows = _with_quarter(rows, slow)
    b, wb = I.in_blocks(rows, ["symbol"], "t", 0, hold), I.block_window("symbol")
    b = I.own(b.withColumn("n", F.collect_list(F.struct("h", "l", "c", "t", "pos")).over(wb.rowsBetween(1, hold))))
    h, a, far = F.hour("t"), F.col("a15"), F.col("c") - F.col("mean")
    night = ((h >= start) | (h < end)) if end <= start else ((h >= start) & (h < end))
    x = b.where(night & (F.size("n") == hold) & (a > 0) & (F.abs(far) >= stretch * a)).withColumn("k", F.when(far > 0, -1).otherwise(1))
    k, c = F.col("k"), F.col("c")
    stop, goal = c - k * sl * a, c + k * tp * a
    first = lambda hit: F.array_position(F.transform("n", hit), True).cast("int")
    x = x.withColumns({"si": first(lambda y: F.when(k > 0, y["l"] <= stop).otherwise(y["h"] >= stop)), "ti": first(lambda y: F.when(k > 0, y["h"] >= goal).otherwise(y["l"] <= goal))})
    si, ti = F.col("si"), F.col("ti")
    x = x.withColumn("reason", F.when((si > 0) & ((ti == 0) | (si <= ti)), "sl").when(ti > 0, "tp").otherwise("timeout"))
    at = F.when(F.col("reason") == "sl", si).when(F.col("reason") == "tp", ti).otherwise(hold)
    out = F.when(F.col("reason") == "sl", stop).when(F.col("reason") == "tp", goal).otherwise(F.get("n", F.lit(hold - 1))["c"])
    x = x.withColumns({"exit": out, "_z": F.get("n", at - 1)})
    x = x.select("symbol", "t", F.when(k > 0, "long").otherwise("short").alias("side"), c.alias("entry"), F.col("_z.t").alias("exit_t"), "exit", (k * (F.col("exit") - c) - cost).alias("pnl"), "reason", "pos", F.col("_z.pos").alias("_zp"))
    turn = lambda p: F.timestamp_seconds(p)
    kept = greedy_no_overlap(x.select("symbol", "pos", turn("pos").alias("_o"), turn(F.col("_zp") + 1).alias("_c")), ["symbol"], "_o", "_c", "pos")
    return x.join(kept, ["symbol", "pos"], "left_semi").drop("pos", "_zp")


def _with_quarter(rows: DataFrame, slow: DataFrame) -> DataFrame:
    """`rows` with mean and a15 of the last quarter hour that has ended by their start, of any age."""
    s = slow.withColumn("_end", F.col("st") + F.expr("interval 15 minutes")).withColumn("_o", F.unix_micros("st"))
    return asof_backward(rows, s, ["symbol"], "t", "_end", ["mean", "a15"], "_o")
