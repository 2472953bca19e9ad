"""Overlapping and gapped intervals -> continuous periods and the gaps between them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Width of the start-time chunks in which an entity is split over tasks.
CHUNK_MS = 86_400_000


def periods_and_gaps(intervals: DataFrame, keys: list[str], start: str, end: str, chunk: int = CHUNK_MS) -> DataFrame:
    """(keys, kind, from, to): kind `period` for each maximal union of overlapping or touching intervals, `gap` between two of them.

    start and end are bigint; rows where either is null or end <= start are left out. Null keys form
    an entity of their own. Repeated rows change nothing. Other columns are dropped; an empty table gives no rows.

    Intervals are sorted by start within (keys, chunk of start times); the running maximum of the
    ends before each chunk comes from one row per chunk, so the comparison with all earlier
    intervals needs no task that sees a whole entity. A row that starts after that maximum opens an
    island; islands are numbered by a running count (count of earlier chunks + count within).
    """
    keys_ = [f"_k{i}" for i in range(len(keys))]
    df = intervals.select(*(F.col(k).alias(a) for k, a in zip(keys, keys_)), F.col(start).alias("_s"), F.col(end).alias("_e")).where("_e > _s").groupBy(*keys_, "_s").agg(F.max("_e").alias("_e"))
    df = df.withColumn("_c", F.floor(F.col("_s") / chunk))
    local = Window.partitionBy(*keys_, "_c").orderBy("_s")
    before = local.rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("_m", F.max("_e").over(before))
    over_chunks = Window.partitionBy(*keys_).orderBy("_c")
    ends = df.groupBy(*keys_, "_c").agg(F.max("_e").alias("_e"))
    ends = ends.select(*keys_, "_c", F.max("_e").over(over_chunks.rowsBetween(Window.unboundedPreceding, -1)).alias("_p"))
    df = _null_safe(df, ends, [*keys_, "_c"]).withColumn("_m", F.greatest("_m", "_p")).drop("_p")
    df = df.withColumn("_new", (F.col("_m").isNull() | (F.col("_s") > F.col("_m"))).cast("bigint"))
    counts = df.groupBy(*keys_, "_c").agg(F.sum("_new").alias("_n"))
    counts = counts.select(*keys_, "_c", F.coalesce(F.sum("_n").over(over_chunks.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_p"))
    df = _null_safe(df.withColumn("_i", F.sum("_new").over(local.rowsBetween(Window.unboundedPreceding, 0))), counts, [*keys_, "_c"])
    df = df.withColumn("_i", F.col("_i") + F.col("_p"))
    periods = df.groupBy(*keys_, "_i").agg(F.min("_s").alias("from"), F.max("_e").alias("to")).select(*keys_, F.lit("period").alias("kind"), "from", "to")
    gaps = df.where("_new = 1 AND _m IS NOT NULL").select(*keys_, F.lit("gap").alias("kind"), F.col("_m").alias("from"), F.col("_s").alias("to"))
    return periods.unionByName(gaps).select(*(F.col(a).alias(k) for k, a in zip(keys, keys_)), "kind", "from", "to")


def _null_safe(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Left join in which null keys are equal."""
    right = right.select(*(F.col(c).alias(f"{c}_r") for c in on), *(c for c in right.columns if c not in on))
    cond = None
    for c in on:
        eq = F.col(c).eqNullSafe(F.col(f"{c}_r"))
        cond = eq if cond is None else cond & eq
    return left.join(right, cond, "left").drop(*(f"{c}_r" for c in on))
