"""Column profile per load from value counts, and its change against the load before."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .intervals import _null_safe
from .selection import order_bin

LOAD = ["harvester", "load_no"]
#: Limits of the change between two loads.
NULLS_UP, MEDIAN_FACTOR, DISTINCT_LEFT = 0.10, 1.5, 0.5
#: Order-preserving histogram classes (32 to a doubling) are joined to this many per doubling for the stability index.
PSI_SHARE = 1e-4


def value_counts(df: DataFrame, load: list[str], columns: list[str]) -> DataFrame:
    """(load, column_name, value, rows): one row per distinct printed value, null included. Pre-aggregated map-side; later steps read only this."""
    cells = F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in columns))
    return df.select(*load, F.explode(cells).alias("_cell")).groupBy(*load, "_cell.column_name", "_cell.value").agg(F.count(F.lit(1)).alias("rows"))


def judged(counts: DataFrame, rules: DataFrame) -> DataFrame:
    """Add `matches` (the whole value fits the column's pattern), `number` (of matching values) and `out_of_range`."""
    rules = rules.select(F.col("column_name").alias("_rc"), "value_pattern", "min_value", "max_value")
    df = counts.join(rules, F.col("column_name") == F.col("_rc"), "left").drop("_rc")
    whole = F.concat(F.lit(r"\A(?:"), F.col("value_pattern"), F.lit(r")\z"))
    df = df.withColumn("matches", F.when(F.col("value").isNotNull(), F.col("value_pattern").isNull() | F.call_function("rlike", F.col("value"), whole)))
    df = df.withColumn("number", F.when(F.col("matches"), F.col("value").try_cast("double")))
    return df.withColumn("out_of_range", F.coalesce(F.col("matches") & ((F.col("number") < F.col("min_value")) | (F.col("number") > F.col("max_value"))), F.lit(False)))


def ruled_columns(df: DataFrame, rules: DataFrame) -> list[str]:
    """The columns of `df` that have a rule (rules of other columns are of no use here); as many as the table has at most."""
    named = {r.column_name for r in rules.where(F.col("column_name").isin(df.columns)).select("column_name").distinct().collect()}
    return [c for c in df.columns if c in named]


def profile_loads(df: DataFrame, rules: DataFrame, columns: list[str] | None = None, load: list[str] = LOAD) -> DataFrame:
    """One row per load and column: rows, nulls, distinct printed values and numbers, pattern and range violations, minimum, maximum, exact median.

    `load` names the key columns, the last being the load's number. Without rules for a column every
    value matches and no range holds. A null key is a source of its own. Empty tables give no rows; a column that is all null has null
    minimum, maximum and median. Columns of `df` not named are ignored.
    """
    columns = columns or ruled_columns(df, rules)
    counts = judged(value_counts(df, load, columns), rules)
    by = [*load, "column_name"]
    base = counts.groupBy(*by).agg(
        F.sum("rows").alias("rows"),
        F.sum(F.when(F.col("value").isNull(), F.col("rows")).otherwise(0)).alias("nulls"),
        F.count("value").alias("distinct_values"),
        F.sum(F.when(~F.col("matches"), F.col("rows")).otherwise(0)).alias("pattern_violations"),
        F.sum(F.when(F.col("out_of_range"), F.col("rows")).otherwise(0)).alias("range_violations"),
        F.min("number").alias("min_value"), F.max("number").alias("max_value"),
    )
    # spellings of one number ("1.0", "1.00") are one distinct number: count in two steps, each reduced map-side
    numbers = counts.where("number IS NOT NULL").groupBy(*by, "number").agg(F.sum("rows").alias("rows"))
    distinct = numbers.groupBy(*by).agg(F.count(F.lit(1)).alias("distinct_numbers"), F.sum("rows").alias("matching"))
    medians = weighted_median(numbers, by, "number", "rows")
    for part in (distinct, medians):
        base = _null_safe(base, part, by)
    return base.withColumns({"distinct_numbers": F.coalesce("distinct_numbers", F.lit(0)), "matching": F.coalesce("matching", F.lit(0))})


def weighted_median(counts: DataFrame, by: list[str], value: str, weight: str) -> DataFrame:
    """(by, median) of value counts, by cumulative counts over order-preserving bins first and within the middle bins then."""
    rows = counts.withColumn("_bin", order_bin(F.col(value)))
    bins = rows.groupBy(*by, "_bin").agg(F.sum(weight).alias("_c"))
    w = Window.partitionBy(*by)
    bins = bins.withColumns({"_n": F.sum("_c").over(w), "_to": F.sum("_c").over(w.orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0))})
    bins = bins.withColumns({"_below": F.col("_to") - F.col("_c"), "_r1": F.expr("(_n + 1) div 2"), "_r2": F.expr("_n div 2 + 1")})
    bins = bins.where("(_r1 > _below AND _r1 <= _to) OR (_r2 > _below AND _r2 <= _to)").drop("_c", "_to", "_n")
    near = _null_safe(rows, bins, [*by, "_bin"]).where("_below IS NOT NULL")
    near = near.withColumn("_to", F.col("_below") + F.sum(weight).over(Window.partitionBy(*by, "_bin").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)))
    got = near.groupBy(*by).agg(F.min(F.when(F.col("_to") >= F.col("_r1"), F.col(value))).alias("_a"), F.min(F.when(F.col("_to") >= F.col("_r2"), F.col(value))).alias("_b"))
    return got.select(*by, ((F.col("_a") + F.col("_b")) / 2).alias("median"))


def against_before(profile: DataFrame, load: list[str] = LOAD) -> DataFrame:
    """Each profile row with the figures of the load before (number less by one) of the same source, as `b_*`; null where there was none."""
    *source, number = load
    before = F.lag(F.struct(*profile.columns)).over(Window.partitionBy(*source, "column_name").orderBy(number))
    df = profile.withColumn("_b", before).withColumn("_b", F.when(F.col(f"_b.{number}") == F.col(number) - 1, F.col("_b")))
    return df.select(*profile.columns, *(F.col(f"_b.{c}").alias(f"b_{c}") for c in profile.columns if c not in (*load, "column_name")))


def findings(df: DataFrame, rules: DataFrame, load: list[str] = LOAD) -> DataFrame:
    """(load, column_name, finding): `pattern` and `range` of a load by itself; `nulls`, `shift` and `distinct` against the load before.

    The null share must have risen by more than NULLS_UP; the medians of the matching values differ by a factor over
    MEDIAN_FACTOR (both positive); the distinct numbers per row fall under DISTINCT_LEFT of those before. A load without a load before has none of the last three.
    """
    p = against_before(profile_loads(df, rules, load=load), load)
    up = F.col("nulls") / F.col("rows") - F.col("b_nulls") / F.col("b_rows") > NULLS_UP
    hi, lo = F.greatest("median", "b_median"), F.least("median", "b_median")
    shift = F.col("median").isNotNull() & F.col("b_median").isNotNull() & (hi > lo * MEDIAN_FACTOR)
    fewer = F.col("distinct_numbers") / F.col("rows") < DISTINCT_LEFT * (F.col("b_distinct_numbers") / F.col("b_rows"))
    tests = {"pattern": F.col("pattern_violations") > 0, "range": F.col("range_violations") > 0, "nulls": up, "shift": shift, "distinct": fewer}
    found = F.array_compact(F.array(*(F.when(t, F.lit(k)) for k, t in tests.items())))
    return p.select(*load, "column_name", F.explode(found).alias("finding"))


def stability_index(df: DataFrame, rules: DataFrame, load: list[str] = LOAD) -> DataFrame:
    """Population stability index of the matching numbers of each load against the load before, over half-octave classes of their size, negative ones and zero apart.

    PSI = sum over classes of (a - b) ln(a / b), shares floored at PSI_SHARE. Loads without a load before, or without numbers in either, have no row.
    """
    columns = ruled_columns(df, rules)
    *source, number = load
    counts = judged(value_counts(df, load, columns), rules).where("number IS NOT NULL")
    half = F.floor(F.log2(F.abs("number")) * 2) + 10_000
    cls = F.when(F.col("number") > 0, half).when(F.col("number") < 0, -half).otherwise(0).cast("int")
    hist = counts.groupBy(*load, "column_name", cls.alias("class")).agg(F.sum("rows").alias("n"))
    now = hist.select(*load, "column_name", "class", "n", F.lit(0).cast("bigint").alias("m"))
    then = hist.select(*source, (F.col(number) + 1).alias(number), "column_name", "class", F.lit(0).cast("bigint").alias("n"), F.col("n").alias("m"))
    both = now.unionByName(then).groupBy(*load, "column_name", "class").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))
    totals = both.groupBy(*load, "column_name").agg(F.sum("n").alias("_n"), F.sum("m").alias("_m")).where("_n > 0 AND _m > 0")
    a, b = F.greatest(F.col("n") / F.col("_n"), F.lit(PSI_SHARE)), F.greatest(F.col("m") / F.col("_m"), F.lit(PSI_SHARE))
    return both.join(totals, [*load, "column_name"]).groupBy(*load, "column_name").agg(F.round(F.sum((a - b) * F.log(a / b)), 6).alias("psi"))
