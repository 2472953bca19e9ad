"""Targets that look ahead a bounded number of bars. Bars without enough ahead have label 0, not null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from ..functions.guards import drawn
from ..functions.indicators import forward


def _flag(c: Column) -> Column:
    return F.coalesce(c, F.lit(False)).cast("int")


def next_up(w: WindowSpec) -> Column:
    return _flag(F.lead("c").over(w) > F.col("c"))


def excursion(w: WindowSpec, n: int) -> Column:
    """The high of the next n bars is more than one average range above the close."""
    return _flag(forward(F.col("h"), w, n, F.max) - F.col("c") > F.col("atr"))


def triple_barrier(w: WindowSpec, n: int, tp: float, sl: float, high: str = "h", low: str = "l", stop_first: bool = True) -> Column:
    """1 if within the next n bars the target (tp average ranges up) is touched before the stop (sl down); on one bar the stop counts first, or the target."""
    ahead = F.collect_list(F.struct(F.col(high).alias("x"), F.col(low).alias("y"))).over(w.rowsBetween(1, n))
    up, down = F.col("c") + tp * F.col("atr"), F.col("c") - sl * F.col("atr")
    first = lambda hit: F.array_position(F.transform(ahead, hit), True)
    ti, si = first(lambda b: b["x"] >= up), first(lambda b: b["y"] <= down)
    won = (ti > 0) & ((si == 0) | ((ti < si) if stop_first else (ti <= si)))
    return _flag(F.col("atr").isNotNull() & (F.size(ahead) >= n) & won)


def outcome(w: WindowSpec, n: int) -> Column:
    """win, loss, ambiguous (both reached) or timeout within the next n bars, at one average range; null without look-ahead."""
    win = forward(F.col("h"), w, n, F.max) - F.col("c") >= F.col("atr")
    loss = F.col("c") - forward(F.col("l"), w, n, F.min) >= F.col("atr")
    return F.when(win & loss, "ambiguous").when(win, "win").when(loss, "loss").when(~win & ~loss, "timeout")


def permuted(df: DataFrame, keys: list[str], t: str, label: str, seed: int) -> DataFrame:
    """Labels dealt anew to the rows of each key: ranks by time meet ranks by a seeded hash."""
    w = Window.partitionBy(*keys)
    a = df.drop(label).withColumn("_i", F.row_number().over(w.orderBy(t)))
    b = df.select(*keys, label, F.row_number().over(w.orderBy(drawn(seed, F.unix_micros(t)), t)).alias("_i"))
    return a.join(b, [*keys, "_i"]).drop("_i")
