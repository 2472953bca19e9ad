"""Feature assembly and gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import calendar as cal
from ..functions import indicators as I
from . import labels as L
from .bars import last_with_gaps

# The features' names in contract order.
FEATURES = [
    "sess_asia", "sess_london", "sess_overlap", "sess_ny", "min_since_london_open", "min_to_ny_fix", "near_ny_fix", "dow", "ret_1", "ret_5", "ret_20", "atr14", "vol_of_vol", "ema20_dist", "ema50_dist", "bar_of_sess_mom",
    "range_exp", "h1_ema50_slope", "rsi14", "tickvol_z", "other_ret_5", "other_z50", "cross_ratio",
]


def gates(df: DataFrame, vol: Column, usual: Column, t: str) -> DataFrame:
    """Each row once for every regime gate it passes (`gate`)."""
    h = F.hour(t)
    day = (h >= 7) & (h <= 21)
    tests = {"all": F.lit(True), "high_vol": vol > usual, "low_vol": vol <= usual, "hours": day, "no_wednesday": ~((F.weekday(t) == 2) & (h >= 13) & (h <= 15)), "high_vol_hours": (vol > usual) & day, "low_vol_hours": (vol <= usual) & day}
    return df.withColumn("gate", F.explode(F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in tests.items())))))


def divergence_state(z: Column) -> Column:
    a = F.abs(z)
    return F.when(a >= 3.5, "extreme").when(a >= 2.5, "diverged").when(a >= 2, "stretched").when(a >= 1, "normal").otherwise("coupled")


def hour_slope(bars: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, hour, slope): sign of the change over three hours of the exponential mean (50) of the hourly closes, told to the hour after, so that no bar sees its own hour's close. Empty hours have no weight but age the others."""
    x = I.with_position(last_with_gaps(bars, keys, "hour", "1 hour"), keys, "t")
    x = I.in_blocks(I.with_ema(x, keys, "t", {"e": ("c", 50)}).withColumn("e", F.round("e", 4)), keys, "t", 4)
    x = I.own(x.withColumn("slope", F.signum(F.col("e") - F.lag("e", 3).over(I.block_window(*keys)))))
    return x.select(*keys, (F.col("t") + F.expr("interval 1 hour")).alias("hour"), "slope")


#: Rows the features look back and the targets ahead.
BACK, AHEAD = 64, 8


def assemble(bars: DataFrame, other: DataFrame) -> DataFrame:
    """symbol, t, c, the 23 FEATURES in order, target_next and target_5 for rows where all features have a value.

    other: (t, other), the close of a second instrument, joined on time. Series are taken in blocks with the rows before and after them. The hourly slope uses closed hours only; the session's momentum
    starts at the first open of each hour of each day.
    """
    c = F.col("c")
    slope = hour_slope(bars, ["symbol"]).select(F.col("symbol").alias("_hs"), F.col("hour").alias("_hh"), F.col("slope").alias("h1_ema50_slope"))
    df = I.with_ema(I.with_position(bars.join(other, "t", "left"), ["symbol"], "t"), ["symbol"], "t", {"e20": ("c", 20), "e50": ("c", 50)})
    df, w = I.in_blocks(df, ["symbol"], "t", BACK, AHEAD), I.block_window("symbol")
    df = df.withColumns({"tr": I.true_range(w), "diff": c - F.lag("c").over(w), "rng": F.col("h") - F.col("l")})
    df = df.withColumn("atr14", I.sma(F.col("tr"), w, 14))
    sess = cal.sessions(F.col("t"))
    up = F.when(F.col("diff").isNotNull(), F.greatest(F.col("diff"), F.lit(0.0)))
    dn = F.when(F.col("diff").isNotNull(), F.greatest(-F.col("diff"), F.lit(0.0)))
    df = df.withColumns({"_u": I.full(F.col("diff"), w, 14, F.avg(up).over(I.rows(w, 14))), "_d": F.avg(dn).over(I.rows(w, 14)), "atr": F.col("atr14")})
    df = I.own(df.withColumns({
        **{f"sess_{k}": v.cast("int") for k, v in sess.items()}, "min_since_london_open": cal.since_london_open(F.col("t")), "min_to_ny_fix": cal.to_ny_fix(F.col("t")), "near_ny_fix": cal.near_ny_fix(F.col("t")).cast("int"), "dow": F.weekday("t"),
        "ret_1": F.try_divide(c, F.lag("c").over(w)) - 1, "ret_5": F.try_divide(c, F.lag("c", 5).over(w)) - 1, "ret_20": F.try_divide(c, F.lag("c", 20).over(w)) - 1,
        "vol_of_vol": F.try_divide(I.stdev(F.col("atr14"), w, 20), I.sma(F.col("atr14"), w, 20)), "ema20_dist": F.try_divide(c - F.col("e20"), F.col("atr14")), "ema50_dist": F.try_divide(c - F.col("e50"), F.col("atr14")),
        "range_exp": F.col("rng") / F.nullif(I.rolling_median(F.col("rng"), w, 20), F.lit(0.0)),
        "rsi14": F.when(F.col("_d") != 0, 100 - 100 / (1 + F.col("_u") / F.col("_d"))), "tickvol_z": I.zscore(F.col("v"), w, 50), "other_ret_5": F.coalesce(F.try_divide(F.col("other"), F.lag("other", 5).over(w)) - 1, F.lit(0.0)),
        "other_z50": F.coalesce(I.zscore(F.col("other"), w, 50), F.lit(0.0)), "cross_ratio": F.coalesce(F.try_divide(c, F.col("other")), F.lit(0.0)), "target_next": L.next_up(w), "target_5": L.excursion(w, 5),
    }))
    hour = F.date_trunc("hour", "t")
    df = df.withColumn("bar_of_sess_mom", c - F.first("o").over(Window.partitionBy("symbol", hour).orderBy("t")))
    df = df.join(slope, (F.col("symbol") == F.col("_hs")) & (hour == F.col("_hh")), "left")
    return df.select("symbol", "t", "c", *FEATURES, "target_next", "target_5").dropna(subset=FEATURES)


def assemble_short(bars: DataFrame) -> DataFrame:
    """The generic set of 11 features, over blocks of a series."""
    c = F.col("c")
    df, w = I.in_blocks(bars, ["symbol"], "t", 256), I.block_window("symbol")
    df = df.withColumns({"rng": F.col("h") - F.col("l"), "r1": F.ln(c / F.lag("c").over(w))})
    df = df.withColumn("atr", I.sma(F.col("rng"), w, 14))
    cols = {
        "r_1": F.col("r1"), "r_3": F.ln(c / F.lag("c", 3).over(w)), "r_12": F.ln(c / F.lag("c", 12).over(w)), "atr_rel": F.col("atr") / c, "range_rel": F.col("rng") / F.nullif(F.col("atr"), F.lit(0.0)), "vol_z": I.zscore(F.col("v"), w, 20),
        "ew_sd": I.ewm_std(F.col("r1"), w, 20, 200), "hour_sin": F.sin(2 * F.pi() * F.hour("t") / 24), "hour_cos": F.cos(2 * F.pi() * F.hour("t") / 24), "dow": F.weekday("t"), "close_pos": F.when(F.col("rng") > 0, (c - F.col("l")) / F.col("rng")).otherwise(0.5),
    }
    return I.own(df.withColumns(cols)).select("symbol", "t", *cols).dropna()
