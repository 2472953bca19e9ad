"""Checks on feature pipelines."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def look_ahead(build: Callable[[DataFrame], DataFrame], bars: DataFrame, keys: list[str], t: str, values: list[str], cut) -> DataFrame:
    """(feature, rows, changed): how many rows at or before the time `cut` (a column) change if the bars after it are other ones.

    `build` is run on the bars as they are and on bars whose `values` after `cut` are those of the series' rows in seeded random order, moved by a tenth: a feature that looks
    at no later bar stays the same, row by row. Rows that appear or vanish count as changed for every feature. Null equals null.
    """
    later = F.col(t) > cut
    mixed = {c: F.when(later, F.col(c) * (1 + 0.1 * ((F.pmod(F.xxhash64(*keys, t), F.lit(2001)) - 1000) / 1000))).otherwise(F.col(c)) for c in values}
    a, b = (build(x).where(F.col(t) <= cut) for x in (bars, bars.withColumns(mixed)))
    names = [c for c in a.columns if c not in (*keys, t)]
    one = lambda df, n: df.select(*(F.col(c).alias(f"_{n}_{c}") for c in (*keys, t)), F.struct(*names).alias(f"_{n}"))
    same = None
    for c in (*keys, t):
        eq = F.col(f"_a_{c}").eqNullSafe(F.col(f"_b_{c}"))
        same = eq if same is None else same & eq
    both = one(a, "a").join(one(b, "b"), same, "full")
    differs = [F.struct(F.lit(c).alias("feature"), (F.col("_a").isNull() | F.col("_b").isNull() | ~F.col(f"_a.{c}").eqNullSafe(F.col(f"_b.{c}"))).alias("x")) for c in names]
    rows = both.select(F.explode(F.array(*differs)).alias("d")).select("d.*")
    return rows.groupBy("feature").agg(F.count(F.lit(1)).alias("rows"), F.count_if("x").alias("changed"))
