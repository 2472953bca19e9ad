"""Exact medians per group without gathering a group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def order_bin(v):
    """A bin number that never falls as v rises: 32 bins to each doubling, mirrored for negative values."""
    step = F.floor(F.least(F.log2(F.abs(v)), F.lit(1100.0)) * 32).cast("int") + 40_000
    return F.when(v > 0, step).when(v < 0, -step).otherwise(0)


def exact_median(df: DataFrame, keys: list[str], value: str, out: str = "median", count: str = "n") -> DataFrame:
    """(keys, out, count): the exact median of `value` per group (mean of the two middle values for an even count).

    Nulls and NaN take no part; a group without a value gives no row; null keys form a group.

    First pass: counts per (group, order-preserving bin), reduced map-side, so a group holding a third of all rows
    is as cheap as any other. The bins that hold the two middle ranks are then known, and only
    their rows (about a fiftieth) are counted by value and ranked. Both passes read `df`.
    """
    v = F.col(value).cast("double")
    keys_ = [f"_k{i}" for i in range(len(keys))]
    rows = df.select(*(F.col(k).alias(a) for k, a in zip(keys, keys_)), v.alias("_v")).where("_v IS NOT NULL AND NOT isnan(_v)").withColumn("_bin", order_bin(F.col("_v")))
    bins = rows.groupBy(*keys_, "_bin").agg(F.count(F.lit(1)).alias("_c"))
    all_bins = Window.partitionBy(*keys_)
    bins = bins.withColumns({"_n": F.sum("_c").over(all_bins), "_to": F.sum("_c").over(all_bins.orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0))})
    bins = bins.withColumns({"_below": F.col("_to") - F.col("_c"), "_r1": F.expr("(_n + 1) div 2"), "_r2": F.expr("_n div 2 + 1")})
    bins = bins.where("(_r1 > _below AND _r1 <= _to) OR (_r2 > _below AND _r2 <= _to)").select(*(F.col(k).alias(f"{k}_r") for k in keys_), F.col("_bin").alias("_bin_r"), "_n", "_below", "_r1", "_r2")
    cond = F.col("_bin") == F.col("_bin_r")
    for k in keys_:
        cond &= F.col(k).eqNullSafe(F.col(f"{k}_r"))
    near = rows.join(bins, cond).groupBy(*keys_, "_bin", "_n", "_below", "_r1", "_r2", "_v").agg(F.count(F.lit(1)).alias("_c"))
    near = near.withColumn("_to", F.col("_below") + F.sum("_c").over(Window.partitionBy(*keys_, "_bin", "_n", "_below", "_r1", "_r2").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)))
    got = near.groupBy(*keys_).agg(F.min(F.when(F.col("_to") >= F.col("_r1"), F.col("_v"))).alias("_a"), F.min(F.when(F.col("_to") >= F.col("_r2"), F.col("_v"))).alias("_b"), F.first("_n").alias(count))
    return got.select(*(F.col(a).alias(k) for k, a in zip(keys, keys_)), ((F.col("_a") + F.col("_b")) / 2).alias(out), count)
