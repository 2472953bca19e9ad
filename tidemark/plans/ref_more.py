"""Feature assembly, gates, further joins, folds and designed extras."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..functions import guards
from ..functions import indicators as I
from ..operators import features as FE
from ..operators import joins as J
from ..operators import metrics as M
from ..operators import signals as G
from ..operators import validation as V
from ..session import table, written
from .ref_trades import FEATURES, LEAD, SIGS, T, _fit, _learn, _scored, _wave, pf_sql
from .ref_windows import ATR14, TR, W0, with_atr
from .substrate import HOURS, ORD, TICKS, hours, ticks, trades, w

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def R(c, n=6):
    return F.round(c, n)


MED = "m AS (SELECT symbol AS ms, quantile_cont(h - l, 0.5) AS med FROM hours GROUP BY 1)"


@query("c10_regime_gates", f"WITH {HOURS}, {MED}, g AS (SELECT unnest(['all', 'high_vol', 'low_vol', 'hours', 'no_wednesday', 'high_vol_hours', 'low_vol_hours']) AS gate) SELECT symbol, t, gate FROM hours JOIN m ON symbol = ms, g WHERE CASE gate WHEN 'all' THEN true WHEN 'high_vol' THEN h - l > med WHEN 'low_vol' THEN h - l <= med WHEN 'hours' THEN hour(t) BETWEEN 7 AND 21 WHEN 'no_wednesday' THEN NOT (isodow(t) = 3 AND hour(t) BETWEEN 13 AND 15) WHEN 'high_vol_hours' THEN h - l > med AND hour(t) BETWEEN 7 AND 21 ELSE h - l <= med AND hour(t) BETWEEN 7 AND 21 END")
def c10(s, d):
    h = hours(s, d)
    med = h.groupBy("symbol").agg(F.percentile(F.col("h") - F.col("l"), F.lit(0.5)).alias("med"))
    return FE.gates(h.join(med, "symbol"), F.col("h") - F.col("l"), F.col("med"), "t").select("symbol", "t", "gate")


Z = f"z AS (SELECT symbol, t, round(CASE WHEN count(c) {w(20)} >= 20 AND stddev_samp(c) {w(20)} > 0 THEN (c - avg(c) {w(20)}) / stddev_samp(c) {w(20)} END, 6) AS z FROM hours)"


@query("c11_divergence_state", f"WITH {HOURS}, {Z} SELECT symbol, t, CASE WHEN abs(z) >= 3.5 THEN 'extreme' WHEN abs(z) >= 2.5 THEN 'diverged' WHEN abs(z) >= 2 THEN 'stretched' WHEN abs(z) >= 1 THEN 'normal' ELSE 'coupled' END AS state, CASE WHEN abs(z) >= 2.5 THEN 'VETO' ELSE 'PASS' END AS gate FROM z WHERE z IS NOT NULL")
def c11(s, d):
    z = hours(s, d).withColumn("z", R(I.zscore(F.col("c"), W0(), 20))).where("z IS NOT NULL")
    return z.select("symbol", "t", FE.divergence_state(F.col("z")).alias("state"), F.when(F.abs("z") >= 2.5, "VETO").otherwise("PASS").alias("gate"))


@query("c17_synthetic_cross", "WITH l AS (SELECT feed, symbol, avg(close) AS c FROM quality_audit WHERE close > 0 AND symbol IN ('EURUSD', 'GBPUSD', 'USDJPY', 'USDCHF') GROUP BY 1, 2), p AS (SELECT feed, max(c) FILTER (symbol = 'EURUSD') AS e, max(c) FILTER (symbol = 'GBPUSD') AS g, max(c) FILTER (symbol = 'USDJPY') AS j, max(c) FILTER (symbol = 'USDCHF') AS f FROM l GROUP BY 1) SELECT feed, round(ln(j) + ln(f) - ln(g), 8) AS proxy, round(e / g, 8) AS eurgbp FROM p")
def c17(s, d):
    p = table(s, d, "quality_audit").where("close > 0 AND symbol IN ('EURUSD', 'GBPUSD', 'USDJPY', 'USDCHF')").groupBy("feed").pivot("symbol", ["EURUSD", "GBPUSD", "USDJPY", "USDCHF"]).agg(F.avg("close"))
    return p.select("feed", R(F.ln("USDJPY") + F.ln("USDCHF") - F.ln("GBPUSD"), 8).alias("proxy"), R(F.col("EURUSD") / F.col("GBPUSD"), 8).alias("eurgbp"))


@query("c19_complete_rows", f"WITH {HOURS}, {ATR14} SELECT symbol, t FROM (SELECT symbol, t, atr, lead(c, 5) {ORD} AS ahead, lag(c, 5) {ORD} AS back FROM a) WHERE atr IS NOT NULL AND ahead IS NOT NULL AND back IS NOT NULL")
def c19(s, d):
    x = with_atr(s, d).withColumns({"ahead": F.lead("c", 5).over(W0()), "back": F.lag("c", 5).over(W0())})
    return x.dropna(subset=["atr", "ahead", "back"]).select("symbol", "t")


@query("d09_ticks_in_bucket", f"WITH {HOURS} SELECT h.symbol, h.t, count(k.seq) AS n FROM hours h JOIN ticks k ON k.symbol = h.symbol AND k.ts >= h.t AND k.ts < h.t + INTERVAL 5 MINUTE GROUP BY 1, 2")
def d09(s, d):
    h = hours(s, d).select("symbol", "t")
    k = ticks(s, d).withColumn("t", F.date_trunc("hour", "ts")).where(F.unix_micros("ts") - F.unix_micros("t") < 300_000_000)
    return h.join(k, ["symbol", "t"]).groupBy("symbol", "t").agg(F.count("seq").alias("n"))


@query("d13_night_levels", f"WITH {HOURS}, z AS (SELECT symbol, CAST(t + CASE WHEN hour(t) >= 22 THEN INTERVAL 1 DAY ELSE INTERVAL 0 DAY END AS DATE) AS day, max(h) AS hi, min(l) AS lo FROM hours WHERE hour(t) >= 22 OR hour(t) < 7 GROUP BY 1, 2) SELECT x.symbol, x.t, z.hi, z.lo FROM hours x LEFT JOIN z ON x.symbol = z.symbol AND CAST(x.t AS DATE) = z.day")
def d13(s, d):
    return hours(s, d).withColumn("day", F.to_date("t")).join(G.night_range(hours(s, d)), ["symbol", "day"], "left").select("symbol", "t", "hi", "lo")


@query("d17_rounded_key", f"WITH {LEAD}, a AS (SELECT harvester, round(vt, 2) AS k, min(pf) AS p FROM w WHERE report_id % 2 = 0 AND vt IS NOT NULL GROUP BY 1, 2), b AS (SELECT harvester, round(vt, 2) AS k, max(pf) AS q FROM w WHERE report_id % 2 = 1 AND vt IS NOT NULL GROUP BY 1, 2) SELECT a.harvester, a.k, p, q FROM a JOIN b ON a.harvester = b.harvester AND a.k = b.k")
def d17(s, d):
    v = _wave(s, d).where("vt IS NOT NULL").withColumn("k", F.round("vt", 2))
    a = v.where("report_id % 2 = 0").groupBy("harvester", "k").agg(F.min("pf").alias("p"))
    return a.join(v.where("report_id % 2 = 1").groupBy("harvester", "k").agg(F.max("pf").alias("q")), ["harvester", "k"])


_E25 = f"WITH {HOURS}, o AS (SELECT t, c AS x FROM hours WHERE symbol = 'view'), j AS (SELECT symbol, hours.t, x, ln(c) AS y FROM hours JOIN o ON hours.t = o.t WHERE symbol <> 'view'), b AS (SELECT symbol, covar_samp(x, y) / var_pop(y) AS beta FROM j GROUP BY 1), r AS (SELECT j.symbol, t, beta, x - beta * y AS resid FROM j JOIN b ON j.symbol = b.symbol)"


@query("e25_residual_beta", _E25 + f" SELECT symbol, t, round(beta, 3) AS beta, round(resid - lag(resid, 5) {ORD}, 3) AS ret_5 FROM r")
def e25(s, d):
    """Another series less its linear part in the log price (one factor per symbol), and the residual's change over five bars."""
    h = hours(s, d)
    x = h.where("symbol <> 'view'").select("symbol", "t", F.ln("c").alias("y")).join(h.where("symbol = 'view'").select("t", F.col("c").alias("x")), "t")
    b = x.groupBy("symbol").agg((F.covar_samp("x", "y") / F.nullif(F.var_pop("y"), F.lit(0.0))).alias("beta"))
    r = I.in_blocks(x.join(b, "symbol").withColumn("resid", F.col("x") - F.col("beta") * F.col("y")), ["symbol"], "t", 5)
    return I.own(r.withColumn("ret_5", R(F.col("resid") - F.lag("resid", 5).over(I.block_window("symbol")), 3))).select("symbol", "t", R(F.col("beta"), 3).alias("beta"), "ret_5")


@query("e27_feature_rows")
def e27(s, d):
    """The 23 features in contract order with both targets, complete rows only."""
    other = hours(s, d).where("symbol = 'view'").select("t", F.col("c").alias("other"))
    return FE.assemble(hours(s, d), other)


@query("e28_feature_rows_short")
def e28(s, d):
    return FE.assemble_short(hours(s, d))


@query("h03_bias_correction", T + f", k AS (SELECT strategy, {pf_sql('0.0')} AS pf FROM trades WHERE strategy IS NOT NULL GROUP BY 1) SELECT strategy, round(pf * CASE WHEN strategy LIKE 'ldn%' THEN 0.92 WHEN strategy LIKE 'ny%' THEN 0.95 ELSE 1.0 END, 9) AS pf FROM k")
def h03(s, d):
    k = trades(s, d).where("strategy IS NOT NULL").groupBy("strategy").agg(M.profit_factor(F.col("cents"), "zero").alias("pf"))
    bias = F.when(F.col("strategy").startswith("ldn"), 0.92).when(F.col("strategy").startswith("ny"), 0.95).otherwise(1.0)
    return k.select("strategy", R(F.col("pf") * bias, 9).alias("pf"))


_H10 = f"""WITH {HOURS}, x AS (SELECT symbol, t, lead(c, 12) {ORD} - c AS x, row_number() {ORD} AS pos, count(*) OVER (PARTITION BY symbol) AS n, md5(symbol || '|' || CAST(epoch_us(t) AS VARCHAR) || '|42') AS m FROM hours),
 r AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY m) AS k FROM x WHERE pos > 50 AND pos <= n - 12),
 y AS (SELECT symbol, m, x, unnest(['long', 'short', 'random']) AS side FROM r WHERE k <= 200), z AS (SELECT symbol, side, CASE WHEN side = 'long' THEN x WHEN side = 'short' THEN -x WHEN strpos('02468ace', substr(m, 4, 1)) > 0 THEN x ELSE -x END AS p FROM y)
 SELECT symbol, side, count(*) AS n, CAST(sum(p) AS BIGINT) AS net, round(sum(p) FILTER (p > 0) / -sum(p) FILTER (p <= 0), 6) AS pf FROM z GROUP BY 1, 2"""


@query("h10_hold_check", _H10)
def h10(s, d):
    """Two hundred drawn entries per symbol held for twelve bars without cost, long, short and on a drawn side: about 1 where there is no edge."""
    x = I.in_blocks(hours(s, d).select("symbol", "t", "c"), ["symbol"], "t", 0, 12)
    x = x.withColumn("x", F.lead("c", 12).over(I.block_window("symbol")) - F.col("c")).where("NOT _extra AND _p >= 50 AND x IS NOT NULL")
    m = guards.drawn(42, F.col("symbol"), F.unix_micros("t"))
    x = x.withColumn("m", m).withColumn("k", F.row_number().over(Window.partitionBy("symbol").orderBy("m"))).where("k <= 200")
    flip = F.when(guards.drawn_below(F.col("m"), 2) == 0, F.col("x")).otherwise(-F.col("x"))
    sides = F.array(*(F.struct(F.lit(n).alias("side"), v.alias("p")) for n, v in (("long", F.col("x")), ("short", -F.col("x")), ("random", flip))))
    z = x.select("symbol", F.explode(sides).alias("z")).select("symbol", "z.*")
    p = F.col("p")
    return z.groupBy("symbol", "side").agg(F.count(F.lit(1)).alias("n"), F.sum(p).cast("bigint").alias("net"), R(F.sum(F.when(p > 0, p)) / -F.sum(F.when(p <= 0, p))).alias("pf"))


@query("h10_buy_hold", f"WITH {HOURS} SELECT symbol, arg_min(c, t) AS first, arg_max(c, t) AS last, round((arg_max(c, t) - arg_min(c, t)) / arg_min(c, t) * 100, 6) AS pct FROM hours GROUP BY 1")
def h10b(s, d):
    first, last = F.min_by("c", "t"), F.max_by("c", "t")
    return hours(s, d).groupBy("symbol").agg(first.alias("first"), last.alias("last"), R((last - first) / first * 100).alias("pct"))


@query("j08_legs_by_frame")
def j08(s, d):
    """Signals of the same strategy on hourly and four-hourly bars of all symbols in one job."""
    from ..operators.bars import bars_to_bars

    h = hours(s, d)
    slow = bars_to_bars(h, ["symbol"], F.window("t", "4 hours")["start"])
    legs = [G.generate(G.context(x), "atr_bracket").withColumn("frame", F.lit(n)) for n, x in (("H1", h), ("H4", slow))]
    return legs[0].unionByName(legs[1])


@query("j09_baseline_deltas", T + f", b AS (SELECT bucket, {pf_sql('0.0')} AS pf, count(*) AS n FROM trades WHERE bucket IS NOT NULL GROUP BY 1), a AS (SELECT {pf_sql('0.0')} AS pf FROM trades) SELECT bucket, round(b.pf - a.pf, 9) AS delta, CASE WHEN b.pf > a.pf THEN 'better' ELSE 'not better' END AS verdict FROM b, a")
def j09(s, d):
    """Each bucket against the whole, from sums per bucket."""
    g, b = M.gross(F.col("cents"))
    x = trades(s, d).groupBy("bucket").agg(g.alias("g"), b.alias("b"))
    one = Window.partitionBy(F.lit(0))  # one row per bucket
    pf = lambda p, q: F.when(q > 0, p / q).otherwise(0.0)
    own, all_ = pf(F.col("g"), F.col("b")), pf(F.sum("g").over(one), F.sum("b").over(one))
    return x.withColumns({"own": own, "whole": all_}).where("bucket IS NOT NULL").select("bucket", R(F.col("own") - F.col("whole"), 9).alias("delta"), F.when(F.col("own") > F.col("whole"), "better").otherwise("not better").alias("verdict"))


@query("k02_block_length", T + ", n AS (SELECT book, count(DISTINCT CAST(open_time AS DATE)) AS n FROM trades GROUP BY 1) SELECT book, n, CAST(greatest(2, least(greatest(2, n // 4), round(CASE WHEN n < 20 THEN sqrt(n) ELSE pow(n, 1 / 3) END))) AS INTEGER) AS block FROM n")
def k02(s, d):
    n = trades(s, d).groupBy("book").agg(F.count_distinct(F.to_date("open_time")).alias("n"))
    raw = F.round(F.when(F.col("n") < 20, F.sqrt("n")).otherwise(F.pow("n", F.lit(1 / 3))))
    return n.select("book", "n", F.greatest(F.lit(2), F.least(F.greatest(F.lit(2), F.expr("n div 4")), raw)).cast("int").alias("block"))


@query("k09_fixed_folds", T + f" SELECT strategy, CAST(year(open_time) AS INTEGER) AS fold, count(*) AS n, round({pf_sql('0.0')}, 9) AS pf FROM trades WHERE strategy IS NOT NULL GROUP BY 1, 2")
def k09(s, d):
    """A fold for each calendar year of the log."""
    t = trades(s, d).where("strategy IS NOT NULL").withColumn("fold", F.year("open_time"))
    return t.groupBy("strategy", "fold").agg(F.count(F.lit(1)).alias("n"), R(M.profit_factor(F.col("cents"), "zero"), 9).alias("pf"))


_HEX = " + ".join(f"(strpos('0123456789abcdef', substr(m, {i}, 1)) - 1) * {16 ** (4 - i)}" for i in (1, 2, 3, 4))


@query("k11_hour_shuffle", f"""WITH {HOURS}, x AS (SELECT *, md5(symbol || '|' || CAST(epoch_us(t) AS VARCHAR) || '|42') AS m FROM hours), y AS (SELECT symbol, t + to_minutes(CAST(({_HEX}) % 96 * 15 AS INTEGER)) AS t, o, h, l, c, v FROM x)
 SELECT *, CAST(row_number() OVER (PARTITION BY symbol ORDER BY t, v, c) AS INTEGER) AS pos FROM y""")
def k11(s, d):
    """Bars moved by a seeded number of quarter hours and sorted anew."""
    step = guards.drawn_below(guards.drawn(42, F.col("symbol"), F.unix_micros("t")), 96)
    h = hours(s, d).withColumn("t", F.timestamp_seconds(F.unix_timestamp("t") + step * 900))
    return h.withColumn("pos", F.row_number().over(Window.partitionBy("symbol").orderBy("t", "v", "c")))


@query("k14_random_signals", SIGS + """, cnt AS (SELECT symbol AS s, count(buy) AS nb, count(sell) AS ns FROM g GROUP BY 1), rr AS (SELECT symbol, t, c, atr, row_number() OVER (PARTITION BY symbol ORDER BY md5(symbol || '|' || CAST(epoch_us(t) AS VARCHAR) || '|7')) AS i FROM a WHERE atr > 0)
 SELECT symbol, t, round(CASE WHEN i <= nb THEN c + 0.3 * atr END, 4) AS buy, round(CASE WHEN i > nb THEN c - 0.3 * atr END, 4) AS sell FROM rr JOIN cnt ON rr.symbol = cnt.s WHERE i <= nb + ns""")
def k14(s, d):
    """As many signals per symbol and side as the strategy gave, on seeded random bars."""
    sig = G.generate(G.context(hours(s, d)), "atr_bracket")
    n = sig.groupBy("symbol").agg(F.count("buy").alias("nb"), F.count("sell").alias("ns"))
    x = with_atr(s, d).where("atr > 0").withColumn("r", F.row_number().over(Window.partitionBy("symbol").orderBy(guards.drawn(7, F.col("symbol"), F.unix_micros("t"))))).join(n, "symbol").where("r <= nb + ns")
    return x.select("symbol", "t", R(F.when(F.col("r") <= F.col("nb"), F.col("c") + 0.3 * F.col("atr")), 4).alias("buy"), R(F.when(F.col("r") > F.col("nb"), F.col("c") - 0.3 * F.col("atr")), 4).alias("sell"))


@query("k21_preflight", "SELECT 'quality_audit' AS name, count(*) AS n, count(*) >= 1000 AS ok FROM quality_audit UNION ALL SELECT 'tick_replay', count(*), count(*) >= 100 FROM tick_replay UNION ALL SELECT 'instruments', count(*), count(*) >= 36 FROM instruments")
def k21(s, d):
    out = None
    for name, least in (("quality_audit", 1000), ("tick_replay", 100), ("instruments", 36)):
        x = table(s, d, name).agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n")).withColumn("ok", F.col("n") >= least)
        out = x if out is None else out.unionByName(x)
    return out


@query("l02_date_split", "SELECT CASE WHEN o_orderdate < TIMESTAMP '1997-01-01' THEN 'train' ELSE 'test' END AS part, count(*) AS n FROM orders GROUP BY 1")
def l02(s, d):
    return table(s, d, "orders").groupBy(F.when(F.expr("o_orderdate < timestamp_ntz'1997-01-01'"), "train").otherwise("test").alias("part")).agg(F.count(F.lit(1)).alias("n"))


#: Boosting rounds of the original's folds and of its monthly retraining.
ROUNDS, ROLLING_ROUNDS = 300, 200


def _rows(s, d):
    """e27's complete feature rows with the next bar's direction as label, written once for all folds."""
    x = e27(s, d).select("symbol", "t", *(F.col(c).cast("double").alias(c) for c in FE.FEATURES), F.col("target_next").cast("double").alias("label"))
    return written(x.withColumns({"pos": F.row_number().over(W0()), "n": F.count(F.lit(1)).over(Window.partitionBy("symbol"))}), "learn")


def _fold_scores(folds, rounds: int, fold_type: str):
    """(symbol, t, prob, label, fold) of [(fold, train, test)]: a model per fold, fitted side by side. Folds whose train rows lack a label's side or whose test is empty give no rows."""
    from multiprocessing.pool import ThreadPool

    from pyspark import inheritable_thread_target

    def run(f):
        fold, train, test = f
        if train.select("label").distinct().count() < 2 or test.isEmpty():
            return None
        return _scored(_fit(train, rounds, FE.FEATURES), test).select("symbol", "t", "prob", "label", F.lit(fold).cast(fold_type).alias("fold"))

    spark = folds[0][1].sparkSession
    with ThreadPool(min(6, len(folds))) as pool:
        found = [p for p in pool.map(inheritable_thread_target(spark)(run), folds) if p is not None]
    out = found[0] if found else spark.createDataFrame([], f"symbol string, t timestamp, prob double, label double, fold {fold_type}")
    for p in found[1:]:
        out = out.unionByName(p)
    return out


@query("l04_out_of_fold")
def l04(s, d):
    """Predictions of l03's five expanding folds, each of the last 5/7 of a series' rows once, put together."""
    x = _rows(s, d).withColumn("size", F.expr("n div 7"))
    return _fold_scores([(k, x.where(f"pos <= n - {5 - k} * size - 10"), x.where(f"pos > n - {5 - k} * size AND pos <= n - {4 - k} * size")) for k in range(5)], ROUNDS, "int")


@query("l07_rolling_retrain")
def l07(s, d):
    """A model per window of months (V.rolling_folds), scored on the month after it, over the whole history; fold: the test's first day."""
    x = _rows(s, d).withColumn("day", F.to_date("t"))
    e = x.agg(F.min("day").alias("a"), F.max("day").alias("z")).first()
    folds = V.rolling_folds(e.a, e.z) if e.a else []
    span = lambda a, z: (F.col("day") >= F.lit(a)) & (F.col("day") < F.lit(z))
    return _fold_scores([(b, x.where(span(a, b)), x.where(span(b, c))) for a, b, c in folds] or [(None, x.limit(0), x.limit(0))], ROLLING_ROUNDS, "date")


@query("l08_holdout", f"WITH {HOURS}, x AS (SELECT symbol, t, row_number() {ORD} AS pos, count(*) OVER (PARTITION BY symbol) AS n FROM hours) SELECT symbol, t, CASE WHEN pos > n * 7 // 10 THEN 'test' ELSE 'train' END AS part FROM x WHERE pos > n * 7 // 10 OR pos <= n * 7 // 10 - 10")
def l08(s, d):
    x = hours(s, d).select("symbol", "t", F.row_number().over(W0()).alias("pos"), F.count(F.lit(1)).over(Window.partitionBy("symbol")).alias("n")).withColumn("cut", F.expr("n * 7 div 10"))
    return x.where("pos > cut OR pos <= cut - 10").select("symbol", "t", F.when(F.col("pos") > F.col("cut"), "test").otherwise("train").alias("part"))


@query("l11_feature_sets")
def l11(s, d):
    """Area under the curve with and without the clock feature."""
    x = _learn(s, d)
    train, test = x.where("pos <= n * 0.7 - 10"), x.where("pos > n * 0.7")
    without = train.withColumn("hour", F.lit(0.0)), test.withColumn("hour", F.lit(0.0))
    a = V.auc(_scored(_fit(train, 3), test), [], "prob", "label").select(F.lit("with").alias("features"), "auc")
    return a.unionByName(V.auc(_scored(_fit(without[0], 3), without[1]), [], "prob", "label").select(F.lit("without").alias("features"), "auc"))


@query("l13_by_instrument")
def l13(s, d):
    x = _learn(s, d)
    return V.auc(_scored(_fit(x.where("pos <= n * 0.7 - 10"), 3), x.where("pos > n * 0.7")).select("symbol", "prob", "label"), ["symbol"], "prob", "label")


HTML = "'<tr><td>Profit Factor</td><td><b>' || coalesce(profit_factor, '-') || '</b></td></tr><tr><td>Total Trades</td><td>' || coalesce(total_trades, '-') || '</td></tr>'"


@query("m01_report_metrics", f"WITH h AS (SELECT report_id, {HTML} AS html FROM wave_results) SELECT report_id, regexp_extract(html, 'Profit Factor(<[^>]*>)*([^<]*)', 2) AS pf, regexp_extract(html, 'Total Trades(<[^>]*>)*([^<]*)', 2) AS n FROM h")
def m01(s, d):
    html = F.concat(F.lit("<tr><td>Profit Factor</td><td><b>"), F.coalesce("profit_factor", F.lit("-")), F.lit("</b></td></tr><tr><td>Total Trades</td><td>"), F.coalesce("total_trades", F.lit("-")), F.lit("</td></tr>"))
    after = lambda label: F.regexp_extract("html", label + "(<[^>]*>)*([^<]*)", 2)
    return table(s, d, "wave_results").select("report_id", html.alias("html")).select("report_id", after("Profit Factor").alias("pf"), after("Total Trades").alias("n"))


@query("x01_clock_and_shape", f"WITH {HOURS} SELECT symbol, t, round(sin(2 * pi() * hour(t) / 24), 9) AS sh, round(cos(2 * pi() * hour(t) / 24), 9) AS ch, round(CASE WHEN h > l THEN abs(c - o) / (h - l) ELSE 0 END, 9) AS body, round(CASE WHEN h > l THEN (h - greatest(o, c)) / (h - l) ELSE 0 END, 9) AS wick FROM hours")
def x01(s, d):
    rng = F.col("h") - F.col("l")
    a = 2 * F.pi() * F.hour("t") / 24
    return hours(s, d).select("symbol", "t", R(F.sin(a), 9).alias("sh"), R(F.cos(a), 9).alias("ch"), R(F.when(rng > 0, F.abs(F.col("c") - F.col("o")) / rng).otherwise(0), 9).alias("body"), R(F.when(rng > 0, (F.col("h") - F.greatest("o", "c")) / rng).otherwise(0), 9).alias("wick"))


VW = "OVER (PARTITION BY symbol, CAST(t AS DATE) ORDER BY t ROWS UNBOUNDED PRECEDING)"
_V20 = "OVER (PARTITION BY symbol, CAST(t AS DATE) ORDER BY t ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"


@query("x04_anchored_vwap", f"WITH {HOURS}, a AS (SELECT symbol, t, c, sum((h + l + c) * v) {VW} / (3 * sum(v) {VW}) AS vwap FROM hours), b AS (SELECT symbol, t, vwap, stddev_samp(c - vwap) {_V20} AS sd FROM a) SELECT symbol, t, round(vwap, 4) AS vwap, round(vwap + 2 * sd, 3) AS upper, round(vwap - 2 * sd, 3) AS lower FROM b")
def x04(s, d):
    """Volume-weighted mean price since the day's start, and two deviations (of the last 20 bars of the day) about it."""
    day = Window.partitionBy("symbol", F.to_date("t")).orderBy("t")
    so_far = day.rowsBetween(Window.unboundedPreceding, 0)
    x = hours(s, d).withColumn("vwap", F.sum((F.col("h") + F.col("l") + F.col("c")) * F.col("v")).over(so_far) / (3 * F.sum("v").over(so_far)))
    x = x.withColumn("sd", F.stddev_samp(F.col("c") - F.col("vwap")).over(day.rowsBetween(-19, 0)))
    return x.select("symbol", "t", R(F.col("vwap"), 4).alias("vwap"), R(F.col("vwap") + 2 * F.col("sd"), 3).alias("upper"), R(F.col("vwap") - 2 * F.col("sd"), 3).alias("lower"))


@query("x06_round_numbers", f"WITH {HOURS} SELECT symbol, t, round(c / 500) * 500 AS level FROM (SELECT *, lag(h) {ORD} AS ph FROM hours) WHERE h > round(c / 500) * 500 AND c < round(c / 500) * 500 AND ph <= round(c / 500) * 500")
def x06(s, d):
    level = F.round(F.col("c") / 500) * 500
    return hours(s, d).withColumns({"ph": F.lag("h").over(W0()), "level": level}).where("h > level AND c < level AND ph <= level").select("symbol", "t", "level")


@query("x08_spread_guard", f"WITH {HOURS}, m AS (SELECT *, quantile_cont(h - l, 0.5) OVER (PARTITION BY symbol ORDER BY t ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING) AS med FROM hours) SELECT symbol, t, coalesce(h - l > 2 * med, false) AS skip FROM m")
def x08(s, d):
    med = F.percentile(F.col("h") - F.col("l"), F.lit(0.5)).over(W0().rowsBetween(-12, -1))
    return hours(s, d).withColumn("med", med).select("symbol", "t", F.coalesce(F.col("h") - F.col("l") > 2 * F.col("med"), F.lit(False)).alias("skip"))
