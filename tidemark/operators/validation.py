"""Statistical validation of trade logs: resampling, folds, null tests, deflated Sharpe, calibration."""

from __future__ import annotations

import math
from datetime import date, timedelta
from itertools import combinations
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EULER = 0.5772156649015329
#: A daily series for resampling is handed to the tasks as one list of at most this many days (about 2,700 years).
DAYS = 1_000_000


def daily(log: DataFrame, keys: list[str], ts: str, pnl: str) -> DataFrame:
    return log.groupBy(*keys, F.to_date(ts).alias("day")).agg(F.sum(pnl).alias("pnl"))


def block_length(n: int) -> int:
    """Mean block: n^(1/3), or sqrt(n) under 20 days, within [2, n/4]."""
    raw = math.sqrt(n) if n < 20 else n ** (1 / 3)
    return int(max(2, min(max(2, n // 4), round(raw))))


def bootstrap(days: DataFrame, n: int, seed: int = 42, blocks: bool = True) -> DataFrame:
    """Replicates (replicate, pf, total) of a daily series (day, pnl): stationary blocks of geometric length with wrap-around, or single days.

    Replicates are rows spread over tasks; only the series itself, a value per day and checked against DAYS, goes to each. Each replicate has its own seed, so results do not depend on the partitioning.
    """
    spark = days.sparkSession
    rows = days.orderBy("day").select("pnl").limit(DAYS + 1).collect()
    if len(rows) > DAYS:
        raise ValueError(f"more than {DAYS} days")
    x = [float(r.pnl) for r in rows]
    mean = block_length(len(x)) if blocks else 1

    def run(batches):
        import numpy as np
        import pandas as pd

        v, m = np.array(x), len(x)
        for b in batches:
            out = []
            for i in b["id"]:
                rng = np.random.default_rng([seed, int(i)])
                if mean > 1 and m:
                    start = rng.random(m) < 1 / mean
                    start[0] = True
                    first = rng.integers(0, m, m)
                    at = np.maximum.accumulate(np.where(start, np.arange(m), 0))
                    s = v[(first[at] + np.arange(m) - at) % m]
                else:
                    s = v[rng.integers(0, m, m)] if m else v
                g, l_ = s[s > 0].sum(), -s[s < 0].sum()
                out.append((int(i), float(g / l_) if l_ > 0 else float("inf") if g > 0 else 0.0, float(s.sum())))
            yield pd.DataFrame(out, columns=["replicate", "pf", "total"])

    return spark.range(n).mapInPandas(run, "replicate bigint, pf double, total double")


def bootstrap_summary(reps: DataFrame) -> DataFrame:
    p = lambda c, q: F.percentile(c, F.lit(q))
    return reps.agg(F.avg(F.when(F.col("pf") != float("inf"), F.col("pf"))).alias("mean_pf"), p("pf", 0.5).alias("median_pf"), p("pf", 0.025).alias("lo"), p("pf", 0.975).alias("hi"), F.avg((F.col("pf") <= 1).cast("double")).alias("p_pf"), F.avg((F.col("total") <= 0).cast("double")).alias("p_total"))


def _pf(s) -> float:
    g, l_ = s[s > 0].sum(), -s[s < 0].sum()
    return float(g / l_) if l_ > 0 else float("inf") if g > 0 else 0.0


def sign_null(days: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """(replicate, pf) of a daily series (day, pnl): replicate 0 is the real one, each of the n others draws a sign of its own for every day."""
    rows = days.orderBy("day").select("pnl").limit(DAYS + 1).collect()
    if len(rows) > DAYS:
        raise ValueError(f"more than {DAYS} days")
    x = [float(r.pnl) for r in rows]

    def run(batches):
        import numpy as np
        import pandas as pd

        v = np.array(x)
        for b in batches:
            yield pd.DataFrame([(int(i), _pf(v * (np.random.default_rng([seed, int(i)]).integers(0, 2, len(v)) * 2 - 1) if i else v)) for i in b["id"]], columns=["replicate", "pf"])

    return days.sparkSession.range(n + 1).mapInPandas(run, "replicate bigint, pf double")


def null_summary(reps: DataFrame, gate: float = 5.0) -> DataFrame:
    """One row: the real profit factor (replicate 0) against the distribution of the others: how many reach it, and its ratio to their median (gate: at least 5)."""
    null = lambda q: F.percentile(F.when(F.col("replicate") > 0, F.col("pf")), F.lit(q))
    one = reps.agg(F.max(F.when(F.col("replicate") == 0, F.col("pf"))).alias("real"), null(0.5).alias("median"), null(0.05).alias("p5"), null(0.95).alias("p95"), F.collect_list(F.when(F.col("replicate") > 0, F.col("pf"))).alias("_n"))
    over = F.size(F.filter("_n", lambda x: x >= F.col("real"))) / F.size("_n")
    one = one.select("real", "median", "p5", "p95", over.alias("p_value"), F.when(F.col("median") > 0, F.col("real") / F.col("median")).otherwise(float("inf")).alias("edge_ratio"))
    return one.withColumn("passed", F.col("edge_ratio") >= gate)


def drawdown_replicates(log: DataFrame, order: list[str], pnl: str, n: int, start: float, seed: int = 42, most: int = DAYS) -> DataFrame:
    """(sim, max_dd): drawdowns of the real order of the log's rows (sim 0) and of n random ones.

    Up to `most` rows go to the tasks as one list (8 bytes a row), and orders are drawn side by side. A longer log is ordered by a window over a seeded hash for each sim,
    which shuffles all its rows n times.
    """
    rows = log.where(F.col(pnl).isNotNull()).select(F.struct(*order, pnl).alias("_o"), F.col(pnl).cast("double").alias("_p"))
    if rows.limit(most + 1).count() <= most:
        v = rows.orderBy("_o").select("_p").toArrow()["_p"].to_numpy()

        def run(batches):
            import numpy as np
            import pandas as pd

            for b in batches:
                out = []
                for i in b["id"]:
                    e = start + np.cumsum(np.random.default_rng([seed, int(i)]).permutation(v) if i else v)
                    out.append((int(i), float((np.maximum(np.maximum.accumulate(e), start) - e).max()) if len(v) else 0.0))
                yield pd.DataFrame(out, columns=["sim", "max_dd"])

        return log.sparkSession.range(n + 1).mapInPandas(run, "sim bigint, max_dd double")
    # rows that are alike in all columns are told apart by their number, so that their places are drawn apart
    again = F.row_number().over(Window.partitionBy("_o").orderBy("_p"))
    x = rows.withColumn("_h", F.xxhash64("_o", again, F.lit(seed))).withColumn("sim", F.explode(F.sequence(F.lit(0), F.lit(n)))).withColumn("sim", F.col("sim").cast("bigint"))
    w = Window.partitionBy("sim").orderBy(F.when(F.col("sim") > 0, F.xxhash64("_h", "sim")), "_o").rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumn("_e", start + F.sum("_p").over(w)).withColumn("_m", F.greatest(F.max("_e").over(w), F.lit(start)))
    return x.groupBy("sim").agg(F.max(F.col("_m") - F.col("_e")).alias("max_dd"))


def expected_max_sharpe(trials: int, variance: float = 1.0) -> float:
    """Expected largest Sharpe ratio of `trials` strategies without edge."""
    if trials <= 1:
        return 0.0
    z = NormalDist().inv_cdf
    return math.sqrt(variance) * ((1 - EULER) * z(1 - 1 / trials) + EULER * z(1 - 1 / (trials * math.e)))


def deflated_sharpe(sharpe: float, n: int, skew: float, kurt: float, trials: int, variance: float) -> float:
    """Probability that the Sharpe ratio (per observation) exceeds that expected of the best of `trials`; kurt is the plain fourth moment (3 for a normal)."""
    sd = math.sqrt(max(1e-12, (1 - skew * sharpe + (kurt - 1) / 4 * sharpe * sharpe) / (n - 1)))
    return NormalDist().cdf((sharpe - expected_max_sharpe(trials, variance)) / sd)


def moments(log: DataFrame, keys: list[str], x: Column) -> DataFrame:
    """n, mean, sample deviation, and sample-corrected skewness and excess kurtosis per key."""
    m = log.groupBy(*keys).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd"), F.skewness(x).alias("g"), F.kurtosis(x).alias("k"))
    n = F.col("n").cast("double")
    return m.withColumns({"skew": F.when(n > 2, F.sqrt(n * (n - 1)) / (n - 2) * F.col("g")), "kurt": F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.col("k") + 6))}).drop("g", "k")


def pf_to_sharpe(pf: Column, win_rate: Column) -> Column:
    """Sharpe ratio per trade of two-valued outcomes with this profit factor and win rate."""
    gain = pf * (1 - win_rate) / win_rate
    mean = win_rate * gain - (1 - win_rate)
    return mean / F.sqrt(win_rate * (1 - win_rate) * (gain + 1) * (gain + 1))


def folds(log: DataFrame, ts: str, train: int, test: int, step: int) -> DataFrame:
    """(fold, train_start, train_end, test_end): windows of months moving on by `step`, until a test would end after the day after the last trade."""
    e = log.agg(F.to_date(F.min(ts)).alias("a"), F.date_add(F.to_date(F.max(ts)), 1).alias("z"))
    e = e.withColumn("k", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor(F.months_between("z", "a") / step).cast("int")))))
    m = lambda extra: F.add_months("a", F.col("k") * step + extra)
    return e.select(F.col("k").alias("fold"), m(0).alias("train_start"), m(train).alias("train_end"), m(train + test).alias("test_end"), "z").where("test_end <= z").drop("z")


def fold_trades(log: DataFrame, f: DataFrame, ts: str) -> DataFrame:
    """Each trade with the folds whose test it falls into. The folds are few (months over step) and joined on the month, so that no trade is held against all of them."""
    f = f.withColumn("_m", F.explode(F.sequence(F.trunc("train_end", "month"), F.trunc("test_end", "month"), F.expr("interval 1 month"))))
    x = log.withColumn("_d", F.to_date(ts)).withColumn("_tm", F.trunc("_d", "month"))
    return x.join(f, (F.col("_tm") == F.col("_m")) & (F.col("_d") >= F.col("train_end")) & (F.col("_d") < F.col("test_end"))).drop("_d", "_tm", "_m")


def tier(results: DataFrame, keys: list[str], base: str) -> DataFrame:
    """(keys, tier): ERROR for any error; C for a test instrument with a drawdown over 40 or two that fail; A if base and all tests pass; B for two tests that pass; else C.

    results: keys, symbol, pf, dd_pct, trades, error. A result passes with pf >= 1, dd_pct <= 40 and trades.
    """
    ok = F.coalesce((F.col("pf") >= 1) & (F.col("dd_pct") <= 40) & (F.col("trades") > 0), F.lit(False))
    test = F.col("symbol") != base
    g = results.groupBy(*keys).agg(F.count_if(F.col("error").isNotNull()).alias("errors"), F.count_if(test & (F.col("dd_pct") > 40)).alias("wiped"), F.count_if(test & ~ok).alias("failed"), F.count_if(test & ok).alias("passed"), F.count_if(~test & ok).alias("base_ok"))
    t = F.when(F.col("errors") > 0, "ERROR").when((F.col("wiped") > 0) | (F.col("failed") >= 2), "C").when((F.col("base_ok") > 0) & (F.col("failed") == 0), "A").when(F.col("passed") >= 2, "B").otherwise("C")
    return g.select(*keys, t.alias("tier"))


def spearman(df: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """(keys, rho): Pearson correlation of average ranks."""
    rank = lambda c: F.rank().over(Window.partitionBy(*keys).orderBy(c)) + (F.count(F.lit(1)).over(Window.partitionBy(*keys, c)) - 1) / 2
    return df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).withColumns({"_a": rank(a), "_b": rank(b)}).groupBy(*keys).agg(F.corr("_a", "_b").alias("rho"))


def ks_distance(df: DataFrame, keys: list[str], side: Column, x: str) -> DataFrame:
    """(keys, ks): largest distance between the distribution functions of the two sides (side true or false); null where a side is empty."""
    g = df.where(F.col(x).isNotNull()).groupBy(*keys, x).agg(F.count_if(side).alias("p"), F.count_if(~side).alias("q"))
    w = Window.partitionBy(*keys).orderBy(x).rowsBetween(Window.unboundedPreceding, 0)
    tot = Window.partitionBy(*keys)
    d = F.abs(F.try_divide(F.sum("p").over(w), F.sum("p").over(tot)) - F.try_divide(F.sum("q").over(w), F.sum("q").over(tot)))
    return g.withColumn("_d", d).groupBy(*keys).agg(F.max("_d").alias("ks"))


def auc(df: DataFrame, keys: list[str], score: str, label: str) -> DataFrame:
    """(keys, auc): area under the ROC curve from counts by score, ties counting half. No group is sorted by row, only by distinct score."""
    g = df.groupBy(*keys, score).agg(F.count_if(F.col(label) == 1).alias("_p"), F.count_if(F.col(label) == 0).alias("_n"))
    below = F.coalesce(F.sum("_n").over(Window.partitionBy(*keys).orderBy(score).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    g = g.withColumn("_u", F.col("_p") * (below + F.col("_n") / 2))
    return g.groupBy(*keys).agg((F.sum("_u") / F.nullif(F.sum("_p") * F.sum("_n"), F.lit(0))).alias("auc"))


def time_series_splits(n: Column, rows: int, k: int, test: int, embargo: int) -> list[tuple[int, int, int, int]]:
    """Expanding splits: (fold, train_end, test_start, test_end) by row number, `embargo` rows dropped before each test."""
    return [(i, max(0, rows - (k - i) * test - embargo), rows - (k - i) * test, rows - (k - i - 1) * test) for i in range(k)]


def rolling_folds(first: date, last: date) -> list[tuple[date, date, date]]:
    """(train_start, test_start, test_end), ends excluded, over all days from first to last: 6 calendar months to the next one, moved on by a month, from the first day that begins a month.

    Where that gives no fold, 12 days to the next 4, moved on by 4.
    """
    m = first.month - 1 + (first.day > 1)
    month = lambda k: date(first.year + (m + k) // 12, (m + k) % 12 + 1, 1)
    day = lambda k: first + timedelta(days=k)
    at, train, step = (month, 6, 1) if month(6) <= last else (day, 12, 4)
    out, k = [], train
    while at(k) <= last:
        out.append((at(k - train), at(k), at(k + step)))
        k += step
    return out


def cpcv_paths(groups: int, k: int) -> list[tuple[int, tuple[int, ...]]]:
    """Numbered choices of k test groups out of `groups`."""
    return list(enumerate(combinations(range(groups), k)))


def purged_paths(df: DataFrame, keys: list[str], t: str, groups: int, k: int, purge: int) -> DataFrame:
    """Each row with the paths (`path`, `tests`: the path's k test groups) in which it takes part, as `part` test or train, by combinatorial purged cross-validation.

    A key's rows fall by position into `groups` equal runs; every choice of k of them is a path. Training rows within `purge` positions of a test group are left out, so
    that no label that looks ahead and no feature that looks back reaches over. Which groups lie that near depends on the row alone, so paths are told per row, without a join.
    """
    w = Window.partitionBy(*keys)
    x = df.withColumns({"_pos": F.row_number().over(w.orderBy(t)) - 1, "_n": F.count(F.lit(1)).over(w)})
    grp = lambda p: F.expr(f"({p}) * {groups} div _n")
    x = x.withColumns({"_g": grp("_pos"), "_from": grp(f"greatest(_pos - {purge}, 0)"), "_to": grp(f"least(_pos + {purge}, _n - 1)")})
    paths = F.array(*(F.struct(F.lit(i).alias("path"), F.array(*(F.lit(g).cast("bigint") for g in gs)).alias("tests")) for i, gs in cpcv_paths(groups, k)))
    part = lambda p: F.when(F.array_contains(p["tests"], F.col("_g")), "test").when(~F.exists(p["tests"], lambda g: (g >= F.col("_from")) & (g <= F.col("_to"))), "train")
    x = x.withColumn("_p", F.explode(F.transform(paths, lambda p: F.struct(p["path"].alias("path"), p["tests"].alias("tests"), part(p).alias("part")))))
    return x.select(*df.columns, "_p.*").where("part IS NOT NULL")


def stationary_block_length(x) -> float:
    """Politis-White (2004, corrected 2009) block length for the stationary bootstrap of a series (any sequence of numbers).

    The correlations are taken up to the lag after which k_n in a row are insignificant, by a flat-top window; a series without correlation gives 1. Under 20 values,
    or without variance, the square root of their number.
    """
    import numpy as np

    x = np.asarray(x, float)
    n = len(x)
    if n < 20 or not np.isfinite(x).all() or x.var() == 0:
        return math.sqrt(n)
    x = x - x.mean()
    kn = max(5, math.ceil(math.sqrt(math.log10(n))))
    most = math.ceil(math.sqrt(n)) + kn
    cov = np.array([(x[: n - k] * x[k:]).sum() / n for k in range(min(most, n - 1) + 1)])
    rho = np.abs(cov[1:] / cov[0])
    bound = 2 * math.sqrt(math.log10(n) / n)
    small = rho < bound
    m = next((i for i in range(len(small) - kn + 1) if small[i : i + kn].all()), None)
    if m is None:
        far = np.flatnonzero(~small)
        m = int(far[-1]) + 1 if len(far) else 0
    top = min(2 * max(m, 1), len(cov) - 1)
    k = np.arange(1, top + 1)
    lam = np.where(k / top <= 0.5, 1.0, 2 * (1 - k / top))
    g = 2 * (lam * k * cov[1 : top + 1]).sum()
    d = 2 * (cov[0] + 2 * (lam * cov[1 : top + 1]).sum()) ** 2
    return float(min(max(1.0, (2 * g * g / d) ** (1 / 3) * n ** (1 / 3)), math.ceil(min(3 * math.sqrt(n), n / 3)))) if d > 0 else math.sqrt(n)


def least_pf(trials: int, trades: int, years: float = 7.0, win_rate: float = 0.5, confidence: float = 0.95, skew: float = 0.0, kurt: float = 3.0, variance: float = 1.0) -> float:
    """The least profit factor at which two-valued outcomes of this many trades pass the deflated Sharpe test against `trials`, by bisection in [1, 5] (5: none does).

    variance: of the trials' Sharpe ratios a year.
    """
    per_year = max(trades / years, 1.0)
    q = 1 - win_rate

    def passes(pf: float) -> bool:
        gain = pf * q / win_rate
        sharpe = (win_rate * gain - q) / math.sqrt(win_rate * q * (gain + 1) ** 2)
        return deflated_sharpe(sharpe, trades, skew, kurt, trials, variance / per_year) >= confidence

    low, high = 1.0, 5.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (low, mid) if passes(mid) else (mid, high)
    return high


def walk_forward(log: DataFrame, ts: str, train: int, test: int, step: int, runner) -> DataFrame:
    """Results of `runner(train rows, test rows, fold)` (DataFrames and an int -> DataFrame) for every fold of `folds`, with `fold`, put together.

    The folds are few (months over the step) and met one after the other when the plan is made; their work is Spark's. Without a fold, ValueError.
    """
    found = folds(log, ts, train, test, step).orderBy("fold").collect()
    if not found:
        raise ValueError("the history is too short for a fold")
    day = F.to_date(ts)
    out = None
    for f in found:
        within = lambda a, z: log.where((day >= F.lit(a)) & (day < F.lit(z)))
        x = runner(within(f.train_start, f.train_end), within(f.train_end, f.test_end), f.fold).withColumn("fold", F.lit(f.fold))
        out = x if out is None else out.unionByName(x)
    return out
