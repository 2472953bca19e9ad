"""Exact percentiles of large numeric columns from value counts that add up over feeds and loads."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import written

KEYS = ["dimension", "member", "metric"]
PERCENTILES = [1, 5, 25, 50, 75, 95, 99]


def value_counts(df: DataFrame, dimensions: dict[str, list[str]], metrics: list[str]) -> DataFrame:
    """(dimension, member, metric, value, n): how often each value occurs per member of each dimension.

    This is the form that is kept and combined: counts of separate partitions, feeds or days add up (`merge_counts`). A dimension is a name and its
    columns; the member is their values joined by "/". Null members form the member null (a null part is written empty). Null and NaN values are left
    out; -0.0 counts as 0.0. Reduced map-side, so a member with a third of all rows spreads by value.
    """
    members = [F.struct(F.lit(d).alias("dimension"), (F.col(c[0]).cast("string") if len(c) == 1 else F.concat_ws("/", *(F.coalesce(F.col(x).cast("string"), F.lit("")) for x in c))).alias("member")) for d, c in dimensions.items()]
    values = [F.struct(F.lit(m).alias("metric"), (F.col(m).cast("double") + 0.0).alias("value")) for m in metrics]
    rows = df.select(F.array(*members).alias("_m"), F.explode(F.array(*values)).alias("_v")).where("_v.value IS NOT NULL AND NOT isnan(_v.value)")
    return rows.select(F.explode("_m").alias("_d"), "_v").groupBy("_d.dimension", "_d.member", "_v.metric", "_v.value").agg(F.count(F.lit(1)).alias("n"))


def merge_counts(*counts: DataFrame) -> DataFrame:
    """Counts of several parts -> counts of the whole."""
    both = counts[0]
    for c in counts[1:]:
        both = both.unionByName(c)
    return both.groupBy(*KEYS, "value").agg(F.sum("n").alias("n"))


def percentiles(counts: DataFrame, at: list[int] = PERCENTILES, partitions: int | None = None) -> DataFrame:
    """(dimension, member, metric, percentile, value, n, rank_error): the smallest value whose cumulative count reaches ceil(percentile / 100 * n).

    Exact: rank_error, the stated bound on how far the given value's rank can be from the target, is 0 rows. No counts give no rows.

    Counts are range-sorted by (member, value) and written once with the number of their partition. Each partition's sum per member is one row; sums
    of earlier partitions are the offsets of the running sums within partitions. No task sees more of a member than one range partition.
    """
    spark = counts.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = written(counts.repartitionByRange(n, *KEYS, "value").withColumn("pid", F.spark_partition_id()), "percentile-counts")
    sums = ranged.groupBy(*KEYS, "pid").agg(F.sum("n").alias("c"))
    members = Window.partitionBy(*KEYS)
    before = members.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*(F.col(k).alias(f"_{k}") for k in KEYS), F.col("pid").alias("_pid"), F.sum("c").over(members).alias("total"), F.coalesce(F.sum("c").over(before), F.lit(0)).alias("offset"), "c")
    # target ranks that fall into a partition: only these partitions' counts go on
    ranks = F.array(*(F.struct(F.lit(p).alias("p"), F.expr(f"({p} * total + 99) div 100").alias("k")) for p in at))
    hit = F.filter(ranks, lambda r: (r.k > F.col("offset")) & (r.k <= F.col("offset") + F.col("c")))
    sums = sums.withColumn("ranks", hit).where(F.size("ranks") > 0)
    cond = F.col("pid") == F.col("_pid")
    for k in KEYS:
        cond &= F.col(k).eqNullSafe(F.col(f"_{k}"))
    rows = ranged.join(sums, cond).select(*KEYS, "pid", "value", "n", "total", "offset", "ranks")
    run = Window.partitionBy(*KEYS, "pid").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("to", F.col("offset") + F.sum("n").over(run))
    got = F.filter("ranks", lambda r: (r.k > F.col("to") - F.col("n")) & (r.k <= F.col("to")))
    return rows.select(*KEYS, "value", "total", F.explode(got).alias("r")).select(*KEYS, F.col("r.p").alias("percentile"), "value", F.col("total").alias("n"), F.lit(0).alias("rank_error"))
