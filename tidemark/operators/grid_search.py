"""Many label settings searched in a few passes."""

from __future__ import annotations

from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The settings searched (bars ahead, stop and target in average ranges) and the thresholds tried.
AHEAD, STOPS, TARGETS = [3, 5, 10], [0.5, 0.6, 0.7, 0.8, 0.9, 1.0, 1.2, 1.5], [1.0, 1.2, 1.5, 1.8, 2.0, 2.5, 3.0, 4.0]
SETTINGS = list(product(AHEAD, STOPS, TARGETS))
THRESHOLDS = [round(0.20 + 0.02 * i, 2) for i in range(18)]
BALANCE, LEAST, FOLDS, EMBARGO = (0.02, 0.95), 60, 5, 5


def _labels(pdf, np):
    """Labels (rows x settings) on closes: 1 if the target is reached within the bars ahead and not after the stop; highest and lowest close ahead for each length."""
    c, atr = pdf["c"].to_numpy(float), pdf["atr"].to_numpy(float)
    path = np.array(pdf["ahead"].tolist(), float).reshape(len(pdf), max(AHEAD)) - c[:, None]
    first = lambda hit: np.where(hit.any(1), hit.argmax(1), 99)
    si = {x: first(path <= -x * atr[:, None]) for x in STOPS}
    ti = {x: first(path >= x * atr[:, None]) for x in TARGETS}
    y = np.stack([(ti[b] < n) & (ti[b] <= si[a]) for n, a, b in SETTINGS], 1).astype(float)
    return y, {n: path[:, :n].max(1) for n in AHEAD}, {n: path[:, :n].min(1) for n in AHEAD}, atr


def _design(pdf, features, scale, np):
    x = pdf[features].to_numpy(float)
    if scale is not None:
        x = (x - scale[0]) / scale[1]
    return np.hstack([np.ones((len(pdf), 1)), x])


def search(rows: DataFrame, features: list[str], spread: float) -> DataFrame:
    """(ahead, stop, target, balance, threshold, trades, wins, pf, net): the best threshold of every setting, over its out-of-fold scores.

    rows: symbol, t, pos (from 1), n (rows of the symbol), c, atr, ahead (the next closes, max(AHEAD) of them) and `features` (no nulls). Settings whose labels are all but one-sided (BALANCE) and thresholds with
    fewer than LEAST trades are left out. Score: a linear probability model for each setting and each of FOLDS expanding folds, embargoed by the bars ahead and EMBARGO more. As all settings share the
    features, one pass of sums (a matrix of features, and features by settings) fits all of them, and one more scores and trades them; what comes back is a number per
    setting and threshold. Ambiguous bars count as losses; without either touch the middle of highest and lowest close is the exit.
    """
    import numpy as np

    k = len(features) + 1
    m = rows.agg(*(F.avg(c).alias(f"a{i}") for i, c in enumerate(features)), *(F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(features))).first()
    scale = (np.array([m[f"a{i}"] or 0.0 for i in range(k - 1)]), np.array([m[f"s{i}"] or 1.0 for i in range(k - 1)]))
    size = F.expr("n div 7")
    test = F.col("n") - F.col("pos")  # rows after this one
    rows = rows.withColumn("fold", F.when(test < FOLDS * size, FOLDS - 1 - F.floor(test / size)).otherwise(-1).cast("int"))

    def sums(batches):
        import pandas as pd

        for b in batches:
            x, y = _design(b, features, scale, np), _labels(b, np)[0]
            start = b["n"].to_numpy()[:, None] - (FOLDS - np.arange(FOLDS))[None] * (b["n"].to_numpy() // 7)[:, None]
            out = []
            for f in range(FOLDS):
                for n in AHEAD:
                    use = b["pos"].to_numpy() <= start[:, f] - n - EMBARGO
                    if use.any():
                        cols = [i for i, s in enumerate(SETTINGS) if s[0] == n]
                        out.append((f, n, (x[use].T @ x[use]).ravel().tolist(), (x[use].T @ y[np.ix_(use, cols)]).ravel().tolist()))
            yield pd.DataFrame(out, columns=["fold", "ahead", "xx", "xy"])

    got = rows.mapInPandas(sums, "fold int, ahead int, xx array<double>, xy array<double>")
    add = lambda c: got.select("fold", "ahead", F.posexplode(c).alias("i", "v")).groupBy("fold", "ahead", "i").agg(F.sum("v").alias("v"))
    xx = {(f, n): np.zeros(k * k) for f in range(FOLDS) for n in AHEAD}
    per = len(STOPS) * len(TARGETS)
    xy = {key: np.zeros(k * per) for key in xx}
    for frame, into in ((add("xx"), xx), (add("xy"), xy)):
        for r in frame.collect():  # folds x lengths x features x (features or settings)
            into[r.fold, r.ahead][r.i] = r.v
    beta = np.zeros((FOLDS, k, len(SETTINGS)))
    for (f, n), a in xx.items():
        cols = [i for i, s in enumerate(SETTINGS) if s[0] == n]
        beta[f][:, cols] = np.linalg.pinv(a.reshape(k, k), hermitian=True) @ xy[f, n].reshape(k, per)

    def trade(batches):
        import pandas as pd

        for b in batches:
            y, high, low, atr = _labels(b, np)
            x, f = _design(b, features, scale, np), b["fold"].to_numpy()
            total = np.zeros((len(SETTINGS), len(THRESHOLDS), 5))
            score = np.full(y.shape, -1.0)
            for g in range(FOLDS):
                score[f == g] = x[f == g] @ beta[g]
            for i, (n, a, t) in enumerate(SETTINGS):
                won, lost = high[n] >= t * atr, low[n] <= -a * atr
                gain = np.where(won & ~lost, t * atr, np.where(lost, -a * atr, (high[n] + low[n]) / 2))
                for j, thr in enumerate(THRESHOLDS):
                    s = (score[:, i] > thr) & (f >= 0)
                    total[i, j] += (s.sum(), (s & won & ~lost).sum(), gain[s & won & ~lost].sum(), -gain[s & lost].sum(), gain[s].sum())
            labels = y.sum(0)
            yield pd.DataFrame([(i, j, float(len(b)), float(labels[i]), *map(float, total[i, j])) for i in range(len(SETTINGS)) for j in range(len(THRESHOLDS))], columns=["i", "j", "rows", "ones", "n", "wins", "up", "down", "net"])

    kinds = "i int, j int, rows double, ones double, n double, wins double, up double, down double, net double"
    t = rows.mapInPandas(trade, kinds).groupBy("i", "j").agg(*(F.sum(c).alias(c) for c in ("rows", "ones", "n", "wins", "up", "down", "net")))
    t = t.withColumns({"balance": F.col("ones") / F.col("rows"), "pf": F.col("up") / F.nullif(F.col("down") + spread * F.col("n"), F.lit(0.0))}).where((F.col("balance") >= BALANCE[0]) & (F.col("balance") <= BALANCE[1]) & (F.col("n") >= LEAST))
    best = t.groupBy("i").agg(F.max_by(F.struct("j", "balance", "n", "wins", "pf", "net"), F.struct("pf", -F.col("j"))).alias("b")).select("i", "b.*")
    table = lambda v: F.array(*(F.lit(float(x)) for x in v))
    part = lambda p: F.get(table([s[p] for s in SETTINGS]), F.col("i"))
    return best.select(part(0).cast("int").alias("ahead"), part(1).alias("stop"), part(2).alias("target"), F.round("balance", 6).alias("balance"), F.get(table(THRESHOLDS), F.col("j")).alias("threshold"), F.col("n").cast("bigint").alias("trades"), F.col("wins").cast("bigint").alias("wins"), F.round("pf", 6).alias("pf"), F.round(F.col("net") - spread * F.col("n"), 3).alias("net"))
