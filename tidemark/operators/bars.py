"""Ticks and bars: dedup, resampling, audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.calendar import market_closed


def dedup(df: DataFrame, keys: list[str], order: list, keep: str = "first") -> DataFrame:
    """One row per key: the first or last by `order` (total, so that the survivor is defined). Null keys form one key. Pre-aggregated, no sort: `min_by` keeps one row per key on each task."""
    whole = F.struct(*df.columns)
    pick = (F.min_by if keep == "first" else F.max_by)(whole, F.struct(*order))
    return df.groupBy(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys))).agg(pick.alias("_row")).select("_row.*")


def union_all(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def ticks_to_bars(ticks: DataFrame, keys: list[str], ts: str, seq: str, price: str, bucket: Column) -> DataFrame:
    """Open, high, low, close and tick count per bucket (left-closed, left-labelled); buckets without ticks give no row. Ties in time go by `seq`."""
    at = F.struct(ts, seq)
    return ticks.groupBy(*keys, bucket.alias("t")).agg(F.min_by(price, at).alias("o"), F.max(price).alias("h"), F.min(price).alias("l"), F.max_by(price, at).alias("c"), F.count(F.lit(1)).alias("v"))


def bars_to_bars(bars: DataFrame, keys: list[str], bucket: Column) -> DataFrame:
    """Coarser bars of bars (t, o, h, l, c, v): first, max, min, last, sum."""
    return bars.withColumn("_to", bucket).groupBy(*keys, "_to").agg(F.min_by("o", "t").alias("o"), F.max("h").alias("h"), F.min("l").alias("l"), F.max_by("c", "t").alias("c"), F.sum("v").alias("v")).withColumnRenamed("_to", "t")


def last_with_gaps(bars: DataFrame, keys: list[str], unit: str, step: str) -> DataFrame:
    """Last close per bucket with a row, null, for each empty bucket between the first and the last of a series."""
    got = bars.groupBy(*keys, F.date_trunc(unit, "t").alias("t")).agg(F.max_by("c", "t").alias("c"))
    ends = got.groupBy(*keys).agg(F.min("t").alias("a"), F.max("t").alias("z"))
    spine = ends.select(*keys, F.explode(F.expr(f"sequence(a, z, interval {step})")).alias("t"))
    return spine.join(got, [*keys, "t"], "left")


def ohlc_violation() -> Column:
    """High below or low above any of the other prices, or a price not above 0."""
    return (F.col("high") < F.greatest("open", "close", "low")) | (F.col("low") > F.least("open", "close", "high")) | (F.least("open", "high", "low", "close") <= 0)


def repeated(df: DataFrame, keys: list[str]) -> DataFrame:
    """All rows whose key occurs more than once. The repeated keys are counted first (map-side), so no hot key is sorted."""
    many = df.groupBy(*keys).count().where("count > 1").select(*keys)
    return df.join(many, keys, "left_semi")


def gap_kind(minutes: Column, step: int = 5) -> Column:
    """Kind of the step between two bars, by the first rule that holds; null for a regular step, a weekend (47 to 65 hours) or a step of up to twice the regular one."""
    weekend = (minutes >= 47 * 60) & (minutes <= 65 * 60)
    return (
        F.when(minutes == step, F.lit(None).cast("string")).when(weekend, F.lit(None).cast("string")).when(minutes == 55, "dst_spring_ok")
        .when(minutes < step, "backward_or_zero_delta").when(minutes > 2 * step, "intraday_gap")
    )


def gaps(bars: DataFrame, keys: list[str], step: int) -> DataFrame:
    """Each irregular step between neighbouring bars of a series."""
    w = Window.partitionBy(*keys).orderBy("t")
    df = bars.withColumn("prev", F.lag("t").over(w)).withColumn("minutes", (F.unix_timestamp("t") - F.unix_timestamp("prev")) / 60)
    return df.withColumn("kind", gap_kind(F.col("minutes"), step)).where("kind IS NOT NULL").select(*keys, "prev", "t", "minutes", "kind")


def expected_bars(first: Column, last: Column) -> Column:
    """Bars of five minutes in five of seven days."""
    return F.floor(F.datediff(last, first) * 5 / 7 * 288).cast("bigint")


def open_market(df: DataFrame, ts: str) -> DataFrame:
    return df.where(~market_closed(F.col(ts)))
