"""Rolling indicators as window expressions.

Each takes the window of a series in time order (`w`, without a frame) and gives null until its
look-back is full, as a rolling window with full periods does. NaN never arises from nulls.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec


def rows(w: WindowSpec, n: int) -> WindowSpec:
    return w.rowsBetween(-(n - 1), 0)


def full(x: Column, w: WindowSpec, n: int, agg: Column) -> Column:
    """`agg` once the last n rows all have a value."""
    return F.when(F.count(x).over(rows(w, n)) >= n, agg)


def sma(x: Column, w: WindowSpec, n: int) -> Column:
    return full(x, w, n, F.avg(x).over(rows(w, n)))


def stdev(x: Column, w: WindowSpec, n: int) -> Column:
    return full(x, w, n, F.stddev_samp(x).over(rows(w, n)))


def true_range(w: WindowSpec, seed: bool = False) -> Column:
    """Range with the close before; a series' first row has high - low, or with `seed` its own close as the one before."""
    p = F.lag("c").over(w)
    if seed:
        p = F.coalesce(p, F.col("c"))
    return F.greatest(F.col("h") - F.col("l"), F.abs(F.col("h") - p), F.abs(F.col("l") - p))


def rsi(diff: Column, w: WindowSpec, n: int, flat: float | None = None) -> Column:
    """Relative strength index of simple averages; without any loss null, or `flat` (also while the look-back fills)."""
    up, dn = (F.avg(F.greatest(s * diff, F.lit(0.0))).over(rows(w, n)) for s in (1, -1))
    ok = F.count(diff).over(rows(w, n)) >= n
    value = F.when(ok & (dn != 0), 100 - 100 / (1 + up / dn))
    return value if flat is None else F.coalesce(value, F.lit(flat))


def ema(x: Column, w: WindowSpec, span: int, reach: int | None = None) -> Column:
    """Exponential mean with weights (1 - alpha)^k over the last rows, normalised; weights under 1e-15 are left out by default."""
    decay = 1 - 2 / (span + 1)
    reach = reach or int(34.5 * (span + 1) / 2) + 1
    return F.aggregate(F.collect_list(x).over(rows(w, reach)), F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("n")), lambda a, v: F.struct((a["s"] * decay + v).alias("s"), (a["n"] * decay + 1).alias("n")), lambda a: a["s"] / a["n"])


def ewm_std(x: Column, w: WindowSpec, span: int, reach: int) -> Column:
    """Bias-corrected exponentially weighted deviation over the last `reach` rows."""
    d = 1 - 2 / (span + 1)
    zero = F.struct(*(F.lit(0.0).alias(k) for k in ("w", "w2", "x", "x2")))
    last = F.collect_list(x).over(rows(w, reach))
    shifted = F.transform(last, lambda v: v - F.get(last, F.lit(0)))  # a deviation does not depend on the level, but the sums of squares would lose their digits on it
    step = lambda a, v: F.struct((a["w"] * d + 1).alias("w"), (a["w2"] * d * d + 1).alias("w2"), (a["x"] * d + v).alias("x"), (a["x2"] * d + v * v).alias("x2"))
    def end(a):
        var = a["x2"] / a["w"] - (a["x"] / a["w"]) * (a["x"] / a["w"])
        fix = a["w"] * a["w"] - a["w2"]
        return F.when(fix > 1e-12, F.sqrt(F.greatest(var, F.lit(0.0)) * a["w"] * a["w"] / fix))
    return F.aggregate(shifted, zero, step, end)


def zscore(x: Column, w: WindowSpec, n: int) -> Column:
    sd = F.stddev_samp(x).over(rows(w, n))
    return full(x, w, n, F.when(sd > 0, (x - F.avg(x).over(rows(w, n))) / sd))


def rolling_median(x: Column, w: WindowSpec, n: int) -> Column:
    return full(x, w, n, F.percentile(x, F.lit(0.5)).over(rows(w, n)))


def cci(x: Column, w: WindowSpec, n: int) -> Column:
    """Commodity channel index by the mean absolute deviation; 0 without deviation or look-back."""
    last = F.collect_list(x).over(rows(w, n))
    mean = F.avg(x).over(rows(w, n))
    dev = F.aggregate(last, F.lit(0.0), lambda a, v: a + F.abs(v - mean)) / n
    return F.when((F.count(x).over(rows(w, n)) >= n) & (dev > 0), (x - mean) / (0.015 * dev)).otherwise(0.0)


def forward(x: Column, w: WindowSpec, n: int, agg) -> Column:
    """`agg` over the next n rows, null where fewer are left."""
    ahead = w.rowsBetween(1, n)
    return F.when(F.count(x).over(ahead) >= n, agg(x).over(ahead))


def run_length(df: DataFrame, keys: list[str], t: str, flag: str, out: str) -> DataFrame:
    """Add `out`: rows in a row, up to this one, for which `flag` holds (0 where it does not); null flags do not hold."""
    w = Window.partitionBy(*keys).orderBy(t).rowsBetween(Window.unboundedPreceding, 0)
    on = F.coalesce(F.col(flag), F.lit(False))
    n = F.count(F.lit(1)).over(w)
    df = df.withColumns({"_n": n, "_on": on})
    return df.withColumn(out, (F.col("_n") - F.coalesce(F.max(F.when(~F.col("_on"), F.col("_n"))).over(w), F.lit(0))).cast("int")).drop("_n", "_on")


#: Rows of a series whose running sums are one window of `with_ema`.
RUN = 128


def _same(keys: list[str], mark: str) -> Column:
    cond = None
    for k in keys:
        eq = F.col(k).eqNullSafe(F.col(f"{mark}{k}"))
        cond = eq if cond is None else cond & eq
    return cond


def with_position(df: DataFrame, keys: list[str], t: str, block_s: int = 30 * 86_400) -> DataFrame:
    """Add `_p`, each row's place in its series by time (from 0), without sorting a series in one task: places within blocks of time, and one row per block for what lies before it."""
    x = df.withColumn("_tb", F.floor(F.unix_timestamp(t) / block_s))
    x = x.withColumn("_p", F.row_number().over(Window.partitionBy(*keys, "_tb").orderBy(t)) - 1)
    n = x.groupBy(*keys, "_tb").agg(F.count(F.lit(1)).alias("_c"))
    before = F.coalesce(F.sum("_c").over(Window.partitionBy(*keys).orderBy("_tb").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    n = n.select(*(F.col(k).alias(f"_n_{k}") for k in keys), F.col("_tb").alias("_n__tb"), before.alias("_off"))
    x = x.join(n, _same([*keys, "_tb"], "_n_")).withColumn("_p", F.col("_p") + F.col("_off"))
    return x.select(*df.columns, "_p")


def _aged(name: str, fade: float):
    """Step of a fold over run ends, oldest first."""
    return lambda a, e: F.struct((a["s"] * fade + e[f"_s_{name}"]).alias("s"), (a["w"] * fade + e[f"_w_{name}"]).alias("w"))


def with_ema(df: DataFrame, keys: list[str], t: str, means: dict[str, tuple[str, int]]) -> DataFrame:
    """Add the exponential means {name: (column, span)} of each series, the same as `ema`, as running sums: no row copies its look-back.

    Needs `_p` (`with_position`). A series falls into runs of RUN rows, each a window of its own; what a run inherits is folded from the ends of those before it within the reach, one row per run. A null value
    has no weight of its own, but those before it age over it.
    """
    x = df.withColumns({"_run": F.floor(F.col("_p") / RUN), "_r": (F.col("_p") % RUN).cast("double")})
    w = Window.partitionBy(*keys, "_run").orderBy("_p").rowsBetween(Window.unboundedPreceding, 0)
    sums, ends, take = {}, [], {}
    for name, (c, span) in means.items():
        d = 1 - 2 / (span + 1)
        up = F.pow(F.lit(1 / d), F.col("_r"))
        back = F.pow(F.lit(d), F.col("_r"))
        sums |= {f"_s_{name}": F.coalesce(F.sum(F.col(c) * up).over(w), F.lit(0.0)) * back, f"_w_{name}": F.coalesce(F.sum(F.when(F.col(c).isNotNull(), up)).over(w), F.lit(0.0)) * back}
    x = x.withColumns(sums)
    last = x.groupBy(*keys, "_run").agg(F.max_by(F.struct(*sums), "_r").alias("_e"))
    for name, (_, span) in means.items():
        d = 1 - 2 / (span + 1)
        m = int(34.5 * (span + 1) / 2) // RUN + 1
        before = F.collect_list("_e").over(Window.partitionBy(*keys).orderBy("_run").rowsBetween(-m, -1))
        zero = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("w"))
        ends.append(F.aggregate(before, zero, _aged(name, d**RUN)).alias(f"_b_{name}"))
        fade = F.pow(F.lit(d), F.col("_r") + 1)
        total = F.col(f"_w_{name}") + fade * F.col(f"_b_{name}.w")
        take[name] = F.when(total > 0, (F.col(f"_s_{name}") + fade * F.col(f"_b_{name}.s")) / total)
    last = last.select(*(F.col(k).alias(f"_l_{k}") for k in keys), F.col("_run").alias("_l__run"), *ends)
    return x.join(last, _same([*keys, "_run"], "_l_")).select(*df.columns, *(c.alias(n) for n, c in take.items()))


def in_blocks(df: DataFrame, keys: list[str], t: str, back: int, ahead: int = 0, size: int = 4096) -> DataFrame:
    """Split series into blocks (`_block`) of `size` rows, each with copies of the `back` rows before and the `ahead` rows after it (`_extra`).

    Windows over (keys, _block) in time order that look back and ahead no further are then the same as over whole series, in many tasks; `own` drops the copies. Rows are counted, not
    time, so holes and sparse series make no difference. Adds `_p` where it is missing.
    """
    x = df if "_p" in df.columns else with_position(df, keys, t)
    at = lambda p: F.floor(p / size)
    x = x.withColumn("_block", F.explode(F.sequence(at(F.greatest(F.col("_p") - ahead, F.lit(0))), at(F.col("_p") + back))))
    return x.withColumn("_extra", F.col("_block") != at(F.col("_p")))


def own(df: DataFrame) -> DataFrame:
    """The rows of `in_blocks` that are no copies."""
    return df.where("NOT _extra").drop("_p", "_block", "_extra")


def block_window(*keys: str, t: str = "t") -> WindowSpec:
    return Window.partitionBy(*keys, "_block").orderBy(t)
