"""Implausible readings: spikes, frozen stretches and impossible values, per source.

Spikes are found by phase-space thresholding: each reading is a point (value, first difference,
second difference); points outside a robust ellipsoid, fitted anew without the points found before until
no more are found, are candidates, and only these are held against the exact limit. Zero-difference runs and bounds catch the other faults.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written
from .selection import exact_median

#: Chunks of time in which a series is split over tasks.
CHUNK_MS = 7 * 86_400_000
#: Rounds of fitting the ellipsoid, at most.
ROUNDS = 3
#: A normal distribution's standard deviation over its quartile distance, and over its median absolute value.
IQR_SD, ABS_SD = 1 / 1.349, 1.4826
#: Rank error of the quantiles the ellipsoid is fitted to is 1 / this of the readings (the limits checked afterwards are exact).
ACCURACY = 1000


def phase_space(readings: DataFrame, keys: list[str], id: str, time: str, value: str, same: list[str], ok: str, keep: list[str]) -> DataFrame:
    """Each reading with `_d1`, `_d2` (differences to the readings before it in time) and its run of equal `same` values.

    Rows without time have null differences and no run. Differences and runs are taken within chunks of CHUNK_MS, so no task sorts a whole series; `_pos` counts a
    chunk's rows from 1 to 3 (then stays), its first two get their differences from `with_heads`, and runs are joined over the edges by `frozen`. Rows where `ok` is false take no part in runs.
    """
    cols = [*keys, id, time, value, ok, *keep]
    timed = readings.where(F.col(time).isNotNull()).withColumn("_chunk", F.floor(F.col(time) / CHUNK_MS).cast("int"))
    w = Window.partitionBy(*keys, "_chunk").orderBy(time, id)
    x = F.col(value)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    timed = timed.withColumns({
        "_x1": F.lag(value, 1).over(w), "_x2": F.lag(value, 2).over(w), "_pos": F.least(F.row_number().over(w), F.lit(3)), "_end": F.lead(id).over(w).isNull(),
        "_p": F.last(F.when(F.col(ok), F.struct(time, *same)), ignorenulls=True).over(before),
    })
    equal = None
    for c in same:
        eq = F.col(c) == F.col(f"_p.{c}")
        equal = eq if equal is None else equal & eq
    timed = timed.withColumns({"_new": F.col(ok) & ~F.coalesce(equal, F.lit(False)), "_step": F.col(ok) & ~F.coalesce(equal & (F.col(time) == F.col(f"_p.{time}")), F.lit(False))})
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    timed = timed.withColumns({"_run": F.when(F.col(ok), F.sum(F.col("_new").cast("int")).over(so_far)), "_steps": F.sum(F.col("_step").cast("int")).over(so_far)})
    # different times of the run up to this row: all so far less those before the run began
    timed = timed.withColumn("_times", F.when(F.col(ok), F.col("_steps") - F.max(F.when(F.col("_new"), F.col("_steps") - 1)).over(so_far)))
    made = {"_d1": x - F.col("_x1"), "_d2": x - 2 * F.col("_x1") + F.col("_x2"), "_x1": F.col("_x1"), **{c: F.col(c) for c in ("_pos", "_end", "_chunk", "_run", "_times")}}
    timed = timed.select(*dict.fromkeys([*cols, *same]), *(c.alias(n) for n, c in made.items()))
    kinds = {"_pos": "int", "_end": "boolean", "_chunk": "int", "_run": "bigint", "_times": "bigint"}
    loose = readings.where(F.col(time).isNull()).select(*dict.fromkeys([*cols, *same]), *(F.lit(None).cast(kinds.get(n, "double")).alias(n) for n in made))
    return timed.unionByName(loose)


def with_heads(phase: DataFrame, keys: list[str], value: str) -> DataFrame:
    """`phase` with the differences of each chunk's first two rows taken over its edge: two rows of a chunk meet one row of the chunks before."""
    ends = phase.where("_end").select(*keys, "_chunk", F.col(value).alias("_z1"), F.col("_x1").alias("_z2"), (F.col("_pos") > 1).alias("_two"))
    w = Window.partitionBy(*keys).orderBy("_chunk")  # one row per chunk
    lag = lambda c, n=1: F.lag(c, n).over(w)
    ends = ends.select(*(F.col(k).alias(f"_r_{k}") for k in [*keys, "_chunk"]), lag("_z1").alias("_p1"), F.when(lag("_two"), lag("_z2")).otherwise(lag("_z1", 2)).alias("_p2"))
    heads = phase.where("_pos <= 2").join(ends, _all_equal([*keys, "_chunk"]))
    x, first = F.col(value), F.col("_pos") == 1
    heads = heads.withColumns({"_d1": F.when(first, x - F.col("_p1")).otherwise(F.col("_d1")), "_d2": F.when(first, x - 2 * F.col("_p1") + F.col("_p2")).otherwise(x - 2 * F.col("_x1") + F.col("_p1"))})
    return phase.where("_pos > 2 OR _pos IS NULL").unionByName(heads.select(*phase.columns))


def frozen(phase: DataFrame, keys: list[str], same: list[str], least: int) -> DataFrame:
    """(keys, _chunk, _run) of the runs that, joined over the edges of chunks, hold at least `least` different times.

    Runs long enough by themselves show in their rows' running length. Of each chunk only the first and the last run can go on in another: one row per chunk, reduced map-side.
    """
    runs = phase.where("_run IS NOT NULL")
    long = runs.where(F.col("_times") >= least).select(*keys, "_chunk", "_run").distinct()
    one = F.struct("_run", "_times", *same)
    ends = runs.groupBy(*keys, "_chunk").agg(F.max(F.when(F.col("_run") == 1, one)).alias("_a"), F.max(one).alias("_z"))
    both = F.array_compact(F.array(F.struct(F.lit(True).alias("_first"), (F.col("_z._run") == 1).alias("_last"), F.col("_a").alias("_e")), F.when(F.col("_z._run") > 1, F.struct(F.lit(False).alias("_first"), F.lit(True).alias("_last"), F.col("_z").alias("_e")))))
    edges = ends.select(*keys, "_chunk", F.explode(both).alias("_x")).select(*keys, "_chunk", "_x._first", "_x._last", "_x._e.*")
    order = Window.partitionBy(*keys).orderBy("_chunk", "_run")
    edges = edges.withColumn("_p", F.lag(F.struct("_last", *same)).over(order))
    joined = F.col("_first") & F.col("_p._last")
    for c in same:
        joined &= F.col(c) == F.col(f"_p.{c}")
    # two rows per chunk at most: the number of chunks bounds a series here
    edges = edges.withColumn("_chain", F.sum(F.when(joined, 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    edges = edges.withColumn("_n", F.sum("_times").over(Window.partitionBy(*keys, "_chain"))).where(F.col("_n") >= least)
    return long.unionByName(edges.select(*keys, "_chunk", "_run")).distinct()


def ellipsoid(points: DataFrame, keys: list[str], value: str, size: str | None = None, factor: float = 1.0) -> DataFrame:
    """(keys, centre, half-axes, points): a robust fit per series of the points with a value, with half-axes of sqrt(2 ln n) robust deviations (the expected maximum of n normal values).

    With `size`, also `_most`: `factor` times a lower bound of the median size. A spike's limit is at or above it, so a value's half-axis never reaches beyond it: however
    wide a series scatters, no case lies inside.
    """
    q = lambda c, *p: F.percentile_approx(c, F.array(*(F.lit(v) for v in p)), F.lit(ACCURACY))
    has = F.col(value).isNotNull()
    if size:
        low = F.percentile_approx(F.when(~F.isnan(size), F.col(size)), F.lit(0.5 - 4 / ACCURACY), F.lit(ACCURACY)) * factor
    else:
        low, points = F.lit(None).cast("double"), points.where(has)
    d = lambda c: F.when(has, F.abs(c))
    s = points.groupBy(*keys).agg(q(F.col(value), 0.25, 0.5, 0.75).alias("_q"), q(d("_d1"), 0.5).alias("_q1"), q(d("_d2"), 0.5).alias("_q2"), F.count_if(has).alias("_n"), low.alias("_most"))
    reach = F.sqrt(2 * F.log(F.greatest(F.col("_n"), F.lit(3))))
    half = lambda c: reach * ABS_SD * F.coalesce(F.col(c)[0], F.lit(0.0))
    return s.where("_n > 0").select(*keys, F.col("_q")[1].alias("_c"), (reach * IQR_SD * (F.col("_q")[2] - F.col("_q")[0])).alias("_a"), half("_q1").alias("_b1"), half("_q2").alias("_b2"), "_n", "_most")


def _axis(d: Column, half: Column) -> Column:
    """Squared distance in half-axes; an axis of length 0 counts any other value as outside."""
    return F.when(half > 0, (d / half) * (d / half)).when(d != 0, F.lit(4.0)).otherwise(0.0)


def outside(points: DataFrame, fit: DataFrame, keys: list[str], value: str) -> DataFrame:
    """`points` with `_out`: true outside its series' ellipsoid (keys, _c, _a, _b1, _b2, _most). Series without a fit, and null values, are not outside."""
    fit = fit.select(*(F.col(k).alias(f"_r_{k}") for k in keys), "_c", "_a", "_b1", "_b2", "_most")
    half = F.least(F.col("_a"), F.greatest(F.col("_most") - F.col("_c"), F.lit(0.0)))
    r = _axis(F.col(value) - F.col("_c"), half) + _axis(F.coalesce("_d1", F.lit(0.0)), F.col("_b1")) + _axis(F.coalesce("_d2", F.lit(0.0)), F.col("_b2"))
    # a centre beyond _most leaves nothing of the value's axis: then all above _most is outside
    out = F.coalesce(r > 1, F.lit(False)) | F.coalesce((F.col("_c") > F.col("_most")) & (F.col(value) > F.col("_most")), F.lit(False))
    return points.join(fit, _all_equal(keys), "left").withColumn("_out", out).drop(*(f"_r_{k}" for k in keys), "_c", "_a", "_b1", "_b2", "_most")


def candidates(points: DataFrame, keys: list[str], value: str, size: str, factor: float) -> DataFrame:
    """The points outside their series' ellipsoid, fitted again without them until a round finds no further one (ROUNDS at most).

    Each round is one aggregate over the written points; the fits are one row per series.
    """
    fit = written(ellipsoid(points, keys, value, size, factor), "ellipsoid")
    first, before = fit, fit.agg(F.sum("_n")).first()[0]
    other = lambda df, *c: df.select(*(F.col(k).alias(f"_r_{k}") for k in keys), *c)
    for _ in range(ROUNDS - 1):
        new = ellipsoid(outside(points, fit, keys, value).where("NOT _out").select(*points.columns), keys, value).drop("_most")
        # a series without calm points keeps the fit it had
        new = new.unionByName(fit.drop("_most").join(other(new), _all_equal(keys), "left_anti"))
        fit = written(new.join(other(first, "_most"), _all_equal(keys), "left").drop(*(f"_r_{k}" for k in keys)), "ellipsoid")
        inside = fit.agg(F.sum("_n")).first()[0]
        if inside == before:
            break
        before = inside
    return outside(points.where(F.col(value).isNotNull()), fit, keys, value).where("_out").drop("_out")


def flag_implausible(readings: DataFrame, keys: list[str], id: str, time: str, *, value: str, size: str, bad: str, same: list[str], ok: str, least: int, factor: float = 10.0) -> DataFrame:
    """(keys, id, spike, frozen, impossible): the readings that are implausible for their own series.

    value: the reading's excursion (null: none); size: what the series' normal size M is the exact median of (null: takes no part). A reading is a spike if it lies
    outside its series' ellipsoid in phase space (`candidates`) and its value exceeds factor * M; the latter is looked at for candidates alone. It is impossible where `bad` holds, and
    frozen in a run of equal `same` values over at least `least` different times among the rows where `ok` holds, in order of time (then id). Readings without time can
    be spikes or impossible. Series without M have no spikes. Nulls in `bad` or `ok` count as false. Empty tables give no rows.
    """
    f = lambda c: F.coalesce(F.col(c), F.lit(False))
    df = readings.select(*dict.fromkeys([*keys, id, time, value, size, *same]), f(bad).alias("_bad"), f(ok).alias("_ok"))
    phase = written(phase_space(df, keys, id, time, value, same, "_ok", ["_bad", size]), "phase-space")
    points = written(with_heads(phase, keys, value).select(*keys, id, value, size, "_d1", "_d2"), "points")
    far = written(candidates(points, keys, value, size, factor).select(*keys, id, value), "candidates")
    # exact medians of the series that have a candidate
    series = far.select(*(F.col(k).alias(f"_r_{k}") for k in keys)).distinct()
    usual = exact_median(points.where(F.col(size).isNotNull()).join(series, _all_equal(keys), "left_semi").select(*keys, size), keys, size)
    usual = usual.select(*(F.col(k).alias(f"_r_{k}") for k in keys), (F.col("median") * factor).alias("_limit"))
    found = lambda df, kind: df.select(*keys, id, *((F.lit(k == kind)).alias(k) for k in ("spike", "frozen", "impossible")))
    spikes = found(far.join(usual, _all_equal(keys)).where(F.col(value) > F.col("_limit")), "spike")
    ids = [*keys, "_chunk", "_run"]
    runs = frozen(phase, keys, same, least).select(*(F.col(c).alias(f"_r_{c}") for c in ids))
    stuck = found(phase.where("_run IS NOT NULL").join(runs, _all_equal(ids), "left_semi"), "frozen")
    every = spikes.unionByName(stuck).unionByName(found(phase.where("_bad"), "impossible"))
    return every.groupBy(*keys, id).agg(*(F.bool_or(k).alias(k) for k in ("spike", "frozen", "impossible")))


def _all_equal(cols: list[str]) -> Column:
    cond = None
    for c in cols:
        eq = F.col(c).eqNullSafe(F.col(f"_r_{c}"))
        cond = eq if cond is None else cond & eq
    return cond


def implausible_bars(bars: DataFrame) -> DataFrame:
    """Implausible bars (bar_id, feed, symbol, open, high, low, close, tick_volume, t_ms) by high and low."""
    keys = ["feed", "symbol"]
    top, bottom = F.greatest("open", "close"), F.least("open", "close")
    h, lo = F.col("high"), F.col("low")
    df = bars.select(
        *keys, "bar_id", "t_ms", "high", "low", F.greatest(h - top, bottom - lo).alias("_x"),
        ((h <= 0) | (lo <= 0) | (h < lo) | F.coalesce(h < top, F.lit(False)) | F.coalesce(lo > bottom, F.lit(False))).alias("_impossible"),
        (h.isNotNull() & lo.isNotNull() & (F.col("tick_volume") > 0)).alias("_running"),
        F.when((h >= lo) & (lo > 0) & (F.col("tick_volume") > 0), h - lo).alias("_range"),
    )
    return flag_implausible(df, keys, "bar_id", "t_ms", value="_x", size="_range", bad="_impossible", same=["high", "low"], ok="_running", least=6)


def implausible_spreads(trades: DataFrame) -> DataFrame:
    """Implausible fills (trade_id, feed, symbol, exit_reason, spread_at_fill, t_ms) by their spread."""
    keys = ["feed", "symbol"]
    s = F.col("spread_at_fill")
    filled = trades.where(s.isNotNull() & ~F.col("exit_reason").eqNullSafe("unfilled")).select(*keys, "trade_id", "t_ms", "spread_at_fill", (s <= 0).alias("_impossible"), F.lit(True).alias("_running"))
    filled = filled.withColumn("_size", F.when(s > 0, s))
    return flag_implausible(filled, keys, "trade_id", "t_ms", value="spread_at_fill", size="_size", bad="_impossible", same=["spread_at_fill"], ok="_running", least=8)
