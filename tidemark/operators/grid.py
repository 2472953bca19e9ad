"""Irregular readings -> a regular grid per series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLOT_S = 300
# Trading hours run from Sunday 22:00 (inclusive) to Friday 22:00 UTC (exclusive).
WEEK_S, OPEN_S = 604_800, 432_000
FIRST_OPEN_S = 338_400  # the first Sunday 22:00 after the epoch
WEEK_SLOTS = OPEN_S // SLOT_S
#: Slots per block: the unit in which a series is split over tasks, so no series is ever sorted as a whole.
BLOCK = 8192
#: Grid cells made per exploded array.
CHUNK = 4096


def _div(a: Column, b: int) -> Column:
    return F.floor(a / b).cast("bigint")


def slot_of(ms: Column) -> Column:
    """Start, in whole seconds, of the 5-minute slot of a UTC millisecond."""
    s = F.call_function("div", ms - F.pmod(ms, F.lit(1000)), F.lit(1000))
    return s - F.pmod(s, F.lit(SLOT_S))


def open_index(slot_s: Column, always_open: Column) -> Column:
    """Number of the slot among the open slots, counted without holes; null if the slot is closed."""
    at = slot_s - FIRST_OPEN_S
    inside = F.pmod(at, F.lit(WEEK_S))
    week = F.call_function("div", at - inside, F.lit(WEEK_S))
    return F.when(always_open, F.call_function("div", slot_s - F.pmod(slot_s, F.lit(SLOT_S)), F.lit(SLOT_S))).when(inside < OPEN_S, week * WEEK_SLOTS + F.call_function("div", inside, F.lit(SLOT_S)))


def open_slot(index: Column, always_open: Column) -> Column:
    """The slot with that number: inverse of `open_index`."""
    inside = F.pmod(index, F.lit(WEEK_SLOTS))
    week = F.call_function("div", index - inside, F.lit(WEEK_SLOTS))
    return F.when(always_open, index * SLOT_S).otherwise(week * WEEK_S + inside * SLOT_S + FIRST_OPEN_S)


def regular_grid(readings: DataFrame, keys: list[str], index: str, values: dict[str, str], *, order: list[str], max_interpolated: int = 3, bounds: DataFrame | None = None) -> DataFrame:
    """One row per key and grid cell from the first to the last reading of each series.

    readings: `keys`, `index` (bigint number of the grid cell; rows with a null index are not on the
    grid), value columns. `values` maps a value column to how a missing cell gets it: `linear`
    (interpolated where at most `max_interpolated` cells in a row are missing, else null) or `null`.
    Of several readings in a cell the last by `order` counts; order must be total for a defined
    result. `bounds` (keys, `first_index`, `last_index`, one row per series) extends each series, if it
    has a reading, to these cells; cells outside the readings have null values, status `before` or `after`.

    Result: keys, `index`, values, `status` (`filled`, `interpolated`, `empty`, `before`, `after`) and
    `gap_cells` (length of the run of missing cells, null for filled ones). Series without readings
    give no rows. Other columns are dropped.

    Work is split by (keys, block of BLOCK cells): readings are first reduced to one per cell, so no
    task holds more than BLOCK rows of a series. Pairs that reach over a block's edge come from
    one row per block. Only missing cells are exploded, at most CHUNK at a time.
    """
    names = list(values)
    row = F.struct(*(F.col(c) for c in names)) if names else F.lit(0)
    cells = readings.where(F.col(index).isNotNull()).groupBy(*keys, F.col(index).alias("_i")).agg(F.max_by(row, F.struct(*order)).alias("_v"))
    cells = cells.withColumn("_b", _div(F.col("_i"), BLOCK))
    per_block = Window.partitionBy(*keys, "_b").orderBy("_i")
    cells = cells.withColumns({"_n": F.lead("_i").over(per_block), "_nv": F.lead("_v").over(per_block)})
    # the last cell of each block, with the block's first: one row per block, from the same sort
    so_far = per_block.rowsBetween(Window.unboundedPreceding, 0)
    cells = cells.withColumns({"_lo": F.first("_i").over(so_far), "_lov": F.first("_v").over(so_far)})
    inner = cells.where("_n > _i + 1").select(*keys, "_i", "_v", "_n", "_nv")
    edges = cells.where("_n IS NULL").select(*keys, "_b", "_i", "_v", "_lo", "_lov")
    per_series = Window.partitionBy(*keys).orderBy("_b")
    outer = edges.withColumns({"_n": F.lead("_lo").over(per_series), "_nv": F.lead("_lov").over(per_series)}).where("_n > _i + 1").select(*keys, "_i", "_v", "_n", "_nv")
    gaps = inner.unionByName(outer).withColumn("_gap", F.col("_n") - F.col("_i") - 1)
    out = _explode(gaps, F.col("_i") + 1, F.col("_n") - 1)
    short = F.col("_gap") <= max_interpolated
    share = (F.col("_at") - F.col("_i")) / (F.col("_n") - F.col("_i"))
    types = dict(readings.dtypes)

    def missing(c: str) -> Column:
        if values[c] != "linear":
            return F.lit(None).cast(types[c])
        a, b = F.col(f"_v.{c}"), F.col(f"_nv.{c}")
        return F.when(short, a + (b - a) * share).cast(types[c])

    lin = any(v == "linear" for v in values.values())
    empty = out.select(*keys, F.col("_at").alias("index"), *(missing(c).alias(c) for c in names), (F.when(short, "interpolated").otherwise("empty") if lin else F.lit("empty")).alias("status"), F.col("_gap").alias("gap_cells"))
    full = cells.select(*keys, F.col("_i").alias("index"), *(F.col(f"_v.{c}").alias(c) for c in names), F.lit("filled").alias("status"), F.lit(None).cast("bigint").alias("gap_cells"))
    result = full.unionByName(empty)
    if bounds is not None:
        ends = edges.groupBy(*keys).agg(F.min("_lo").alias("_first"), F.max("_i").alias("_last")).join(bounds, keys)
        for status, a, b in (("before", F.col("first_index"), F.col("_first") - 1), ("after", F.col("_last") + 1, F.col("last_index"))):
            part = _explode(ends.withColumn("_gap", b - a + 1).where("_gap > 0"), a, b)
            result = result.unionByName(part.select(*keys, F.col("_at").alias("index"), *(F.lit(None).cast(types[c]).alias(c) for c in names), F.lit(status).alias("status"), F.col("_gap").alias("gap_cells")))
    return result


def _explode(df: DataFrame, first: Column, last: Column) -> DataFrame:
    """A row per number `_at` from first to last, in two steps, so that no row ever holds more than CHUNK of them (or their CHUNKth part)."""
    df = df.withColumns({"_a": first, "_z": last}).withColumn("_c", F.explode(F.sequence(F.lit(0).cast("bigint"), _div(F.col("_z") - F.col("_a"), CHUNK))))
    lo = F.col("_a") + F.col("_c") * CHUNK
    return df.withColumn("_at", F.explode(F.sequence(lo, F.least(F.col("_z"), lo + (CHUNK - 1)))))


def bar_grid(bars: DataFrame, instruments: DataFrame, **kw) -> DataFrame:
    """The regular 5-minute series of every (feed, symbol) in open hours.

    bars: feed, symbol, bar_id, close, tick_volume, t_ms. A bar is usable with a time, a close and
    tick_volume > 0. A symbol `instruments` lacks keeps market hours. Result: feed, symbol, slot_s, close, tick_volume, status, gap_cells.
    """
    known = instruments.select(F.col("symbol").alias("_s"), F.col("always_open").alias("_open"))
    usable = bars.where("t_ms IS NOT NULL AND close IS NOT NULL AND tick_volume > 0").join(known, F.col("symbol") == F.col("_s"), "left")
    usable = usable.select("feed", "symbol", F.coalesce("_open", F.lit(False)).alias("_open"), "bar_id", "close", "tick_volume", "t_ms")
    usable = usable.withColumn("_index", open_index(slot_of(F.col("t_ms")), F.col("_open")))
    grid = regular_grid(usable, ["feed", "symbol", "_open"], "_index", {"close": "linear", "tick_volume": "null"}, order=["t_ms", "bar_id"], **kw)
    return grid.select("feed", "symbol", open_slot(F.col("index"), F.col("_open")).alias("slot_s"), "close", "tick_volume", "status", "gap_cells")
