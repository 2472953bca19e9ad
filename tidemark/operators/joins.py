"""As-of, range and interval joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Width of the time blocks in which an entity is split over tasks.
BLOCK_S = 7 * 86_400


def asof_backward(left: DataFrame, right: DataFrame, keys: list[str], lt: str, rt: str, values: list[str], order: str, block: int = BLOCK_S) -> DataFrame:
    """Every left row with the `values` of the last right row at or before its time (null: none), of any age.

    Both sides go through one sort per (keys, block of time) with the last value carried forward; what a block
    inherits comes from one row per block. Right rows of one time: the highest `order` wins. Left columns must differ from right value names. Null keys match nothing.
    """
    blk = lambda c: F.floor(F.unix_timestamp(c) / block)
    lcols = left.columns
    known = F.col(rt).isNotNull()
    for k in keys:
        known &= F.col(k).isNotNull()
    r = right.where(known).select(*keys, F.col(rt).alias("_t"), F.struct(*values).alias("_v"), F.col(order).cast("bigint").alias("_o"), blk(rt).alias("_b"))
    l_ = left.select(*keys, F.col(lt).alias("_t"), blk(lt).alias("_b"), F.struct(*lcols).alias("_row"))
    both = l_.unionByName(r, allowMissingColumns=True)
    w = Window.partitionBy(*keys, "_b").orderBy("_t", F.col("_row").isNotNull(), "_o").rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("_seen", F.last("_v", ignorenulls=True).over(w)).where("_row IS NOT NULL")
    ends = r.groupBy(*keys, "_b").agg(F.max_by("_v", F.struct("_t", "_o")).alias("_e"))
    need = l_.select(*keys, "_b").distinct()
    blocks = need.unionByName(ends, allowMissingColumns=True).groupBy(*keys, "_b").agg(F.max("_e").alias("_e"))
    blocks = blocks.withColumn("_before", F.last("_e", ignorenulls=True).over(Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))).drop("_e")
    out = both.join(blocks, [*keys, "_b"], "left").withColumn("_seen", F.coalesce("_seen", "_before"))
    return out.select("_row.*", *(F.col(f"_seen.{v}").alias(v) for v in values))


def carry_rows(df: DataFrame, keys: list[str], t: str, value: str, limit: int) -> DataFrame:
    """Fill nulls of `value` from at most `limit` rows before; `stale` tells which rows were filled."""
    w = Window.partitionBy(*keys).orderBy(t).rowsBetween(-limit, 0)
    return df.withColumn("filled", F.last(value, ignorenulls=True).over(w)).withColumn("stale", F.col(value).isNull() & F.col("filled").isNotNull())


def within_bars(bars: DataFrame, rows: DataFrame, keys: list[str], bt: str, rt: str, seconds: int) -> DataFrame:
    """Rows that fall into [bar start, next bar's start), however long that is, a series' last bar lasting `seconds`: the last bar at or before the row, if it has not ended."""
    w = Window.partitionBy(*keys).orderBy(bt)
    b = bars.where(F.col(bt).isNotNull()).select(*keys, F.col(bt).alias("bar_t"), F.coalesce(F.lead(bt).over(w), F.timestamp_seconds(F.unix_timestamp(bt) + seconds)).alias("bar_end"))
    # of bars with one start only the last has a length
    b = b.withColumn("_end", F.unix_micros("bar_end"))
    return asof_backward(rows, b, keys, rt, "bar_t", ["bar_t", "bar_end"], "_end").where(F.col(rt) < F.col("bar_end"))


def near_event(rows: DataFrame, events: DataFrame, rt: str, et: str, before_s: int, after_s: int, keep: bool = True) -> DataFrame:
    """Rows with (or, keep=False, without) an event e such that e - before <= t <= e + after, both ends included.

    Each event is put into the few time buckets its window touches and the join is on the bucket, so no pair outside is ever looked at.
    """
    us = 1_000_000
    before, after = before_s * us, after_s * us
    size = before + after + 1
    block = lambda c: F.floor(c / size)
    e = events.select(F.unix_micros(et).alias("_e")).distinct().withColumn("_k", F.explode(F.sequence(block(F.col("_e") - before), block(F.col("_e") + after))))
    r = rows.withColumn("_rt", F.unix_micros(rt)).withColumn("_rk", block(F.col("_rt")))
    cond = (F.col("_rk") == F.col("_k")) & (F.col("_rt") >= F.col("_e") - before) & (F.col("_rt") <= F.col("_e") + after)
    return r.join(e, cond, "left_semi" if keep else "left_anti").drop("_rk", "_rt")


def concurrency(log: DataFrame, keys: list[str], o: str, c: str, id: str, block: int = BLOCK_S) -> DataFrame:
    """(keys, id, concurrent): intervals of the same key open at this one's start (itself included): opens <= o and closes > o.

    A sweep over +1 and -1 events, with running sums within (keys, time block) and offsets from one row per block; at one time closings come first and all openings count. Null keys and empty or reversed intervals give no row.
    """
    t = lambda x: F.unix_micros(x)
    rows = log.where(F.col(o).isNotNull() & (F.col(c) > F.col(o)))
    ev = rows.select(*keys, t(o).alias("_t"), F.lit(1).alias("_d")).unionByName(rows.select(*keys, t(c).alias("_t"), F.lit(-1).alias("_d")))
    ev = ev.groupBy(*keys, "_t").agg(F.sum("_d").alias("_d")).withColumn("_b", F.floor(F.col("_t") / (block * 1_000_000)))
    run = F.sum("_d").over(Window.partitionBy(*keys, "_b").orderBy("_t").rowsBetween(Window.unboundedPreceding, 0))
    ev = ev.withColumn("_n", run)
    off = ev.groupBy(*keys, "_b").agg(F.sum("_d").alias("_s")).withColumn("_o", F.coalesce(F.sum("_s").over(Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_s")
    at = ev.join(off, [*keys, "_b"]).select(*keys, "_t", (F.col("_n") + F.col("_o")).alias("concurrent"))
    return rows.select(*keys, F.col(id), t(o).alias("_t")).join(at, [*keys, "_t"]).select(*keys, id, "concurrent")
