"""Trade-log aggregates. `pnl` is any numeric column; whole cents give exact sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK_S = 30 * 86_400


def gross(pnl: Column) -> tuple[Column, Column]:
    """Sums of gains and of losses (as a positive number)."""
    return F.coalesce(F.sum(F.when(pnl > 0, pnl)), F.lit(0)), F.coalesce(-F.sum(F.when(pnl < 0, pnl)), F.lit(0))


def profit_factor(pnl: Column, variant: str = "capped") -> Column:
    """Gains over losses. Without a loss: `capped` 999 (0 without gains either), `zero` 0, `inf` infinity (0 without gains), `null` null."""
    g, b = gross(pnl)
    none = {"capped": F.when(g > 0, 999.0).otherwise(0.0), "zero": F.lit(0.0), "inf": F.when(g > 0, float("inf")).otherwise(0.0), "null": F.lit(None).cast("double")}[variant]
    return F.when(b > 0, g / b).otherwise(none)


def summary(pnl: Column) -> dict[str, Column]:
    n, wins, losses = F.count(pnl), F.count_if(pnl > 0), F.count_if(pnl < 0)
    return {"trades": n, "wins": wins, "losses": losses, "net": F.coalesce(F.sum(pnl), F.lit(0)), "win_rate": F.try_divide(wins, n), "avg_win": F.avg(F.when(pnl > 0, pnl)), "avg_loss": F.avg(F.when(pnl < 0, pnl))}


def equity(log: DataFrame, keys: list[str], order: list[str], pnl: str, start: float = 0.0, seed_peak: bool = False) -> DataFrame:
    """Each trade with `equity` (start + running sum), `peak` (running maximum, with seed_peak also of the start) and `dd` (peak - equity).

    Running sums and maxima are taken within (keys, chunk of the first order column, a timestamp), with offsets from one row per chunk, so a log of any length spreads over tasks. Rows with a null key are left out.
    """
    df = log.withColumn("_c", F.floor(F.unix_timestamp(order[0]) / CHUNK_S))
    w = Window.partitionBy(*keys, "_c").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("_s", F.sum(pnl).over(w)).withColumn("_m", F.max("_s").over(w))
    parts = df.groupBy(*keys, "_c").agg(F.sum(pnl).alias("_ps"), F.max("_s").alias("_pm"))
    before = Window.partitionBy(*keys).orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_off", F.coalesce(F.sum("_ps").over(before), F.lit(0))).withColumn("_top", F.max(F.col("_off") + F.col("_pm")).over(before)).drop("_ps", "_pm")
    df = df.join(parts, [*keys, "_c"])
    peak = F.greatest("_top", F.col("_off") + F.col("_m"), *([F.lit(0)] if seed_peak else []))
    df = df.withColumns({"equity": start + F.col("_off") + F.col("_s"), "peak": start + peak})
    return df.withColumn("dd", F.col("peak") - F.col("equity")).drop("_c", "_s", "_m", "_off", "_top")


def max_drawdown(eq: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, max_dd, max_dd_pct): largest fall from the peak, and largest in per cent of its peak (peaks above 0)."""
    return eq.groupBy(*keys).agg(F.max("dd").alias("max_dd"), F.coalesce(F.max(F.when(F.col("peak") > 0, F.col("dd") / F.col("peak") * 100)), F.lit(0.0)).alias("max_dd_pct"))


def drawdown_events(eq: DataFrame, keys: list[str], order: list[str], top: int) -> DataFrame:
    """The deepest `top` falls between new highs per key: peak time, trough time, depth, recovery time (null: not recovered).

    Highs are counted within (keys, chunk of time), with offsets from one row per chunk.
    """
    ts = order[0]
    df = eq.withColumns({"_high": (F.col("dd") == 0).cast("int"), "_c": F.floor(F.unix_timestamp(ts) / CHUNK_S)})
    df = df.withColumn("_in", F.sum("_high").over(Window.partitionBy(*keys, "_c").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    parts = df.groupBy(*keys, "_c").agg(F.sum("_high").alias("_n"))
    parts = parts.withColumn("_off", F.coalesce(F.sum("_n").over(Window.partitionBy(*keys).orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    df = df.join(parts, [*keys, "_c"]).withColumn("_seg", F.col("_in") + F.col("_off"))
    ev = df.groupBy(*keys, "_seg").agg(F.min(ts).alias("peak_time"), F.max("dd").alias("depth"), F.min_by(ts, F.struct(-F.col("dd"), *order)).alias("trough_time"))
    ev = ev.withColumn("recovery_time", F.lead("peak_time").over(Window.partitionBy(*keys).orderBy("_seg"))).where("depth > 0")
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("depth"), "peak_time", "_seg"))
    return ev.withColumn("rank", rank).where(F.col("rank") <= top).drop("_seg")


def greedy_no_overlap(log: DataFrame, keys: list[str], o: str, c: str, id: str) -> DataFrame:
    """Trades of each key kept in order of opening, skipping those that open before the last kept one has closed.

    Only trades that overlap others depend on one another: the fold runs within each maximal run of touching intervals, which bounds what is gathered.
    """
    rows = log.where(F.col(c) >= F.col(o))
    w = Window.partitionBy(*keys).orderBy(o, id)
    before = F.max(c).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_new", F.when(before.isNull() | (F.col(o) >= before), 1).otherwise(0)).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = rows.groupBy(*keys, "_run").agg(F.array_sort(F.collect_list(F.struct(F.unix_micros(o).alias("o"), F.col(id).alias("id"), F.unix_micros(c).alias("c")))).alias("x"))
    empty = F.filter("x", lambda e: F.lit(False))
    keep = F.aggregate("x", empty, lambda a, e: F.when((F.size(a) == 0) | (e["o"] >= F.element_at(a, -1)["c"]), F.concat(a, F.array(e))).otherwise(a))
    return runs.select(*keys, F.explode(keep).alias("e")).select(*keys, F.col("e.id").alias(id))


def kill_switch(log: DataFrame, keys: list[str], order: list[str], pnl: str, start: float, daily: float = 0.02, account: float = 0.08, streak: int = 5, pause_s: int = 240 * 60) -> DataFrame:
    """Replay with a daily stop (loss of `daily` of the day's first equity), a latch (fall of `account` from the peak) and a pause after `streak` losses in a row.

    One fold per key over its trades in order; a key's trades (a portfolio's log) must fit a task, for each decision rests on all before it. Result: keys, trades, admitted, final_equity, trips_daily, latched, pauses.
    """
    x = F.array_sort(F.collect_list(F.struct(F.unix_timestamp(order[0]).alias("t"), *order[1:], F.col(pnl).cast("double").alias("p"))))
    z = lambda v, t: F.lit(v).cast(t)
    init = F.struct(z(start, "double").alias("eq"), z(start, "double").alias("peak"), z(-1, "bigint").alias("day"), z(start, "double").alias("open"), z(False, "boolean").alias("stop"), z(False, "boolean").alias("latch"), z(0, "int").alias("run"), z(0, "bigint").alias("until"), z(0, "int").alias("n"), z(0, "int").alias("trips"), z(0, "int").alias("pauses"))

    def step(a: Column, e: Column) -> Column:
        day = F.floor(e["t"] / 86_400)
        new = day != a["day"]
        opened = F.when(new, a["eq"]).otherwise(a["open"])
        stopped = F.when(new, False).otherwise(a["stop"])
        go = ~a["latch"] & ~stopped & (e["t"] >= a["until"])
        eq = a["eq"] + F.when(go, e["p"]).otherwise(0.0)
        peak = F.greatest(a["peak"], eq)
        run = F.when(go, F.when(e["p"] < 0, a["run"] + 1).otherwise(0)).otherwise(a["run"])
        trip = go & (opened - eq >= daily * opened)
        hit = run >= streak
        return F.struct(
            eq.alias("eq"), peak.alias("peak"), day.alias("day"), opened.alias("open"), (stopped | trip).alias("stop"), (a["latch"] | (peak - eq >= account * peak)).alias("latch"),
            F.when(hit, 0).otherwise(run).cast("int").alias("run"), F.when(hit, e["t"] + pause_s).otherwise(a["until"]).alias("until"), (a["n"] + go.cast("int")).alias("n"), (a["trips"] + trip.cast("int")).alias("trips"), (a["pauses"] + hit.cast("int")).alias("pauses"),
        )

    out = log.groupBy(*keys).agg(x.alias("x")).withColumn("r", F.aggregate("x", init, step))
    return out.select(*keys, F.size("x").alias("trades"), F.col("r.n").alias("admitted"), F.col("r.eq").alias("final_equity"), F.col("r.trips").alias("trips_daily"), F.col("r.latch").alias("latched"), F.col("r.pauses").alias("pauses"))
