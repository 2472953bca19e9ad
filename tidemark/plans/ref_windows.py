"""Indicators, labels and entry signals over bars."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import indicators as I
from ..functions.calendar import sessions
from ..operators import features as FE
from ..operators import labels as L
from ..operators import signals as G
from .substrate import FIVES, HOURS, ORD, WALK, fives, hours, over, w, walk_fives, walk_hours

QUERIES, SQL = {}, {}
W0 = over


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = f"WITH {HOURS}" + sql
        return f

    return add


def R(c, n=6):
    return F.round(c, n)


def WB():
    return I.block_window("symbol")


def _blocks(s, d):
    """Hourly bars in blocks that hold what a look-back of 96 and a look-ahead of 8 rows needs: one series is many tasks' work."""
    return I.in_blocks(hours(s, d), ["symbol"], "t", 96, 8)


def _whole(x):
    return x.where("NOT _extra").drop("_extra")


TR = f"greatest(h - l, abs(h - lag(c) {ORD}), abs(l - lag(c) {ORD}))"
TRS = f"greatest(h - l, abs(h - coalesce(lag(c) {ORD}, c)), abs(l - coalesce(lag(c) {ORD}, c)))"


@query("e01_returns", f" SELECT symbol, t, c - lag(c) {ORD} AS diff, round(c / lag(c, 3) {ORD} - 1, 9) AS pct, round(ln(c / lag(c, 5) {ORD}), 9) AS lr FROM hours")
def e01(s, d):
    return _whole(_blocks(s, d).select("symbol", "t", "_extra", (F.col("c") - F.lag("c").over(WB())).alias("diff"), R(F.col("c") / F.lag("c", 3).over(WB()) - 1, 9).alias("pct"), R(F.ln(F.col("c") / F.lag("c", 5).over(WB())), 9).alias("lr")))


@query("e02_atr", f", r AS (SELECT symbol, t, {TR} AS tr FROM hours) SELECT symbol, t, round(CASE WHEN count(tr) {w(14)} >= 14 THEN avg(tr) {w(14)} END, 6) AS atr FROM r")
def e02(s, d):
    """In blocks with the fifteen rows before them, so that one series is many tasks' work."""
    b, wb = I.in_blocks(hours(s, d), ["symbol"], "t", 15), I.block_window("symbol")
    b = b.withColumn("tr", I.true_range(wb)).withColumn("atr", R(I.sma(F.col("tr"), wb, 14)))
    return I.own(b).select("symbol", "t", "atr")


@query("e03_atr_seeded", f", r AS (SELECT symbol, t, {TRS} AS tr FROM hours) SELECT symbol, t, round(CASE WHEN count(tr) {w(14)} >= 14 THEN avg(tr) {w(14)} END, 6) AS atr FROM r")
def e03(s, d):
    b = _blocks(s, d).withColumn("tr", I.true_range(WB(), seed=True))
    return _whole(b.select("symbol", "t", "_extra", R(I.sma(F.col("tr"), WB(), 14)).alias("atr")))


@query("e04_range_sma", f" SELECT symbol, t, round(CASE WHEN count(h) {w(14)} >= 14 THEN avg(h - l) {w(14)} END, 6) AS atr FROM hours")
def e04(s, d):
    return _whole(_blocks(s, d).select("symbol", "t", "_extra", R(I.sma(F.col("h") - F.col("l"), WB(), 14)).alias("atr")))


@query("e05_daily_median_atr", f", r AS (SELECT symbol, t, {TRS} AS tr FROM hours), a AS (SELECT symbol, t, round(CASE WHEN count(tr) {w(14)} >= 14 THEN avg(tr) {w(14)} END, 6) AS atr FROM r) SELECT symbol, CAST(t AS DATE) AS day, round(quantile_cont(atr, 0.5) / 10, 6) AS pips FROM a GROUP BY 1, 2")
def e05(s, d):
    return e03(s, d).groupBy("symbol", F.to_date("t").alias("day")).agg(R(F.percentile("atr", F.lit(0.5)) / 10).alias("pips"))


RSI = "up AS (SELECT symbol, t, c - lag(c) " + ORD + " AS x FROM hours), a AS (SELECT symbol, t, count(x) {0} AS n, avg(greatest(x, 0)) {0} AS u, avg(greatest(-x, 0)) {0} AS d FROM up)"


def _rsi(n):
    return RSI.replace("{0}", w(n)).replace("greatest(x, 0)", "CASE WHEN x IS NOT NULL THEN greatest(x, 0) END").replace("greatest(-x, 0)", "CASE WHEN x IS NOT NULL THEN greatest(-x, 0) END")


@query("e06_rsi", f", {_rsi(14)} SELECT symbol, t, round(CASE WHEN n >= 14 AND d <> 0 THEN 100 - 100 / (1 + u / d) END, 6) AS rsi FROM a")
def e06(s, d):
    b = _blocks(s, d).withColumn("x", F.col("c") - F.lag("c").over(WB())).withColumn("g", F.col("x"))
    up = F.when(F.col("x").isNotNull(), F.greatest(F.col("x"), F.lit(0.0)))
    dn = F.when(F.col("x").isNotNull(), F.greatest(-F.col("x"), F.lit(0.0)))
    b = b.withColumns({"n": F.count("x").over(I.rows(WB(), 14)), "u": F.avg(up).over(I.rows(WB(), 14)), "d": F.avg(dn).over(I.rows(WB(), 14))})
    return _whole(b.select("symbol", "t", "_extra", R(F.when((F.col("n") >= 14) & (F.col("d") != 0), 100 - 100 / (1 + F.col("u") / F.col("d")))).alias("rsi")))


X0 = f"x AS (SELECT symbol, t, coalesce(c - lag(c) {ORD}, 0) AS x FROM hours)"


@query("e07_rsi_filled", f", {X0}, a AS (SELECT symbol, t, count(x) {w(14)} AS n, avg(greatest(x, 0)) {w(14)} AS u, avg(greatest(-x, 0)) {w(14)} AS d FROM x) SELECT symbol, t, round(CASE WHEN n >= 14 AND d <> 0 THEN 100 - 100 / (1 + u / d) ELSE 100 END, 6) AS rsi FROM a")
def e07(s, d):
    b = _blocks(s, d).withColumn("x", F.coalesce(F.col("c") - F.lag("c").over(WB()), F.lit(0.0)))
    return _whole(b.select("symbol", "t", "_extra", R(I.rsi(F.col("x"), WB(), 14, 100.0)).alias("rsi")))


EMA = "list_reduce(list_prepend({{'s': 0.0::DOUBLE, 'n': 0.0::DOUBLE}}, list_transform(xs, lambda each: {{'s': each, 'n': 1.0::DOUBLE}})), lambda a, b: {{'s': a.s * {d} + b.s, 'n': a.n * {d} + b.n}})"


def _ema(span):
    reach = int(34.5 * (span + 1) / 2) + 1
    return f"g AS (SELECT symbol, t, c, list(c) {w(reach)} AS xs FROM hours), e AS (SELECT symbol, t, c, {EMA.format(d=1 - 2 / (span + 1))} AS r FROM g)"


@query("e08_ema", f", {_ema(8)} SELECT symbol, t, round(r.s / r.n, 6) AS ema FROM e")
def e08(s, d):
    return _with_mean(s, d, 8).select("symbol", "t", R(F.col("ema")).alias("ema"))


def _with_mean(s, d, span):
    """Hourly bars with `_p` and the exponential mean `ema` of the closes."""
    return I.with_ema(I.with_position(hours(s, d), ["symbol"], "t"), ["symbol"], "t", {"ema": ("c", span)})


STD = "list_reduce(list_transform(xs, lambda v: {{'w': 1.0::DOUBLE, 'w2': 1.0::DOUBLE, 'x': v - xs[1], 'x2': (v - xs[1]) * (v - xs[1])}}), lambda a, b: {{'w': a.w * {d} + 1, 'w2': a.w2 * {d} * {d} + 1, 'x': a.x * {d} + b.x, 'x2': a.x2 * {d} + b.x2}})".format(d=1 - 2 / 21)


@query("e09_ewm_std", f", g AS (SELECT symbol, t, list(c) {w(400)} AS xs FROM hours), r AS (SELECT symbol, t, {STD} AS r FROM g) SELECT symbol, t, round(CASE WHEN r.w * r.w - r.w2 > 1e-12 THEN sqrt(greatest(r.x2 / r.w - (r.x / r.w) * (r.x / r.w), 0) * r.w * r.w / (r.w * r.w - r.w2)) END, 4) AS sd FROM r")
def e09(s, d):
    return hours(s, d).select("symbol", "t", R(I.ewm_std(F.col("c"), W0(), 20, 400), 4).alias("sd"))


@query("e10_ema_distance", f", {_ema(8)}, r AS (SELECT symbol, t, {TRS} AS tr FROM hours), a AS (SELECT symbol, t, CASE WHEN count(tr) {w(14)} >= 14 THEN avg(tr) {w(14)} END AS atr FROM r) SELECT e.symbol, e.t, round((c - round(e.r.s / e.r.n, 6)) / round(atr, 6), 6) AS z FROM e JOIN a ON e.symbol = a.symbol AND e.t = a.t")
def e10(s, d):
    b, wb = I.in_blocks(_with_mean(s, d, 8), ["symbol"], "t", 15), I.block_window("symbol")
    b = b.withColumn("tr", I.true_range(wb, seed=True))
    return I.own(b.withColumn("z", R(F.try_divide(F.col("c") - R(F.col("ema")), R(I.sma(F.col("tr"), wb, 14)))))).select("symbol", "t", "z")


@query("e11_vol_of_vol", f", r AS (SELECT symbol, t, {TRS} AS tr FROM hours), a AS (SELECT symbol, t, CASE WHEN count(tr) {w(14)} >= 14 THEN round(avg(tr) {w(14)}, 6) END AS atr FROM r) SELECT symbol, t, round(CASE WHEN count(atr) {w(20)} >= 20 THEN stddev_samp(atr) {w(20)} / avg(atr) {w(20)} END, 6) AS vov FROM a")
def e11(s, d):
    a = _blocks(s, d).withColumn("tr", I.true_range(WB(), seed=True)).withColumn("atr", R(I.sma(F.col("tr"), WB(), 14)))
    n = F.count("atr").over(I.rows(WB(), 20)) >= 20
    return _whole(a.select("symbol", "t", "_extra", R(F.when(n, F.try_divide(F.stddev_samp("atr").over(I.rows(WB(), 20)), F.avg("atr").over(I.rows(WB(), 20))))).alias("vov")))


@query("e12_range_expansion", f", m AS (SELECT *, CASE WHEN count(h) {w(20)} >= 20 THEN quantile_cont(h - l, 0.5) {w(20)} END AS med FROM hours) SELECT symbol, t, round(CASE WHEN med > 0 THEN (h - l) / med END, 6) AS x FROM m")
def e12(s, d):
    b = _blocks(s, d).withColumn("r", F.col("h") - F.col("l")).withColumn("med", I.rolling_median(F.col("r"), WB(), 20))
    return _whole(b.select("symbol", "t", "_extra", R(F.when(F.col("med") > 0, F.col("r") / F.col("med"))).alias("x")))


@query("e13_volume_z", f" SELECT symbol, t, round(CASE WHEN count(v) {w(50)} >= 50 AND stddev_samp(v) {w(50)} > 0 THEN (v - avg(v) {w(50)}) / stddev_samp(v) {w(50)} END, 6) AS z FROM hours")
def e13(s, d):
    return _whole(_blocks(s, d).select("symbol", "t", "_extra", R(I.zscore(F.col("v"), WB(), 50)).alias("z")))


@query("e14_session_momentum")
def e14(s, d):
    """Close less the first open of its hour and day, over five-minute bars."""
    ws = Window.partitionBy("symbol", F.date_trunc("hour", "t")).orderBy("t")
    return fives(s, d).select("symbol", "t", (F.col("c") - F.first("o").over(ws)).alias("mom"))


SQL["e14_session_momentum"] = f"WITH {FIVES} SELECT symbol, t, c - first_value(o) OVER (PARTITION BY symbol, date_trunc('hour', t) ORDER BY t) AS mom FROM fives"


@query("e15_slope_sign")
def e15(s, d):
    """The hourly mean's slope, carried to the five-minute bars of the hour after."""
    b = fives(s, d).select("symbol", "t", F.date_trunc("hour", "t").alias("hour"))
    return b.join(FE.hour_slope(fives(s, d), ["symbol"]), ["symbol", "hour"], "left").select("symbol", "t", "slope")


SQL["e15_slope_sign"] = f"""WITH {FIVES}, hl AS (SELECT symbol, date_trunc('hour', t) AS t, arg_max(c, t) AS c FROM fives GROUP BY 1, 2), sp AS (SELECT symbol, unnest(generate_series(min(t), max(t), INTERVAL 1 HOUR)) AS t FROM hl GROUP BY 1),
 hours AS (SELECT sp.symbol, sp.t, hl.c FROM sp LEFT JOIN hl ON hl.symbol = sp.symbol AND hl.t = sp.t), g AS (SELECT symbol, t, list(c) {w(int(34.5 * 51 / 2) + 1)} AS xs FROM hours),
 e AS (SELECT symbol, t, list_reduce(list_transform(xs, lambda each: {{'s': coalesce(each, 0.0)::DOUBLE, 'n': CASE WHEN each IS NULL THEN 0.0 ELSE 1.0 END::DOUBLE}}), lambda a, b: {{'s': a.s * {1 - 2 / 51} + b.s, 'n': a.n * {1 - 2 / 51} + b.n}}) AS r FROM g),
 x AS (SELECT symbol, t, round(r.s / r.n, 4) AS e FROM e), y AS (SELECT symbol, t + INTERVAL 1 HOUR AS t, CAST(sign(e - lag(e, 3) {ORD}) AS DOUBLE) AS slope FROM x)
 SELECT f.symbol, f.t, y.slope FROM fives f LEFT JOIN y ON y.symbol = f.symbol AND y.t = date_trunc('hour', f.t)"""


@query("e16_cci", f", g AS (SELECT symbol, t, (h + l + c) AS tp, list(h + l + c) {w(20)} AS xs FROM hours), m AS (SELECT *, list_avg(xs) AS mean FROM g), q AS (SELECT *, list_sum(list_transform(xs, lambda v: abs(v - mean))) / 20 AS dev FROM m) SELECT symbol, t, round(CASE WHEN len(xs) >= 20 AND dev > 0 THEN (tp - mean) / (0.015 * dev) ELSE 0 END, 4) AS cci FROM q")
def e16(s, d):
    b = _blocks(s, d).withColumn("tp", F.col("h") + F.col("l") + F.col("c"))
    return _whole(b.select("symbol", "t", "_extra", R(I.cci(F.col("tp"), WB(), 20), 4).alias("cci")))


@query("e17_bollinger", f", b AS (SELECT symbol, t, CASE WHEN count(c) {w(20)} >= 20 THEN avg(c) {w(20)} END AS m, CASE WHEN count(c) {w(20)} >= 20 THEN stddev_samp(c) {w(20)} END AS sd FROM hours), k AS (SELECT symbol, t, round(m + 2 * sd, 4) AS upper, round(m - 2 * sd, 4) AS lower, round(4 * sd, 4) AS width, 4 * sd AS raw FROM b) SELECT symbol, t, upper, lower, width, round(CASE WHEN count(raw) {w(30)} >= 30 THEN avg(raw) {w(30)} END, 4) AS width_ma FROM k")
def e17(s, d):
    m, sd = I.sma(F.col("c"), WB(), 20), I.stdev(F.col("c"), WB(), 20)
    b = _blocks(s, d).withColumns({"upper": R(m + 2 * sd, 4), "lower": R(m - 2 * sd, 4), "width": R(4 * sd, 4), "raw": 4 * sd})
    return I.own(b.withColumn("width_ma", R(I.sma(F.col("raw"), WB(), 30), 4))).select("symbol", "t", "upper", "lower", "width", "width_ma")


@query("e18_extremes", f" SELECT symbol, t, CASE WHEN count(h) {w(12)} >= 12 THEN max(h) {w(12)} END AS h12, CASE WHEN count(l) {w(24)} >= 24 THEN min(l) {w(24)} END AS l24 FROM hours")
def e18(s, d):
    return _whole(_blocks(s, d).select("symbol", "t", "_extra", I.full(F.col("h"), WB(), 12, F.max("h").over(I.rows(WB(), 12))).alias("h12"), I.full(F.col("l"), WB(), 24, F.min("l").over(I.rows(WB(), 24))).alias("l24")))


@query("e19_volume_ratio", f" SELECT symbol, t, round(coalesce(v / nullif(CASE WHEN count(v) {w(20)} >= 20 THEN avg(v) {w(20)} END, 0), 0), 6) AS ratio FROM hours")
def e19(s, d):
    ma = I.sma(F.col("v"), WB(), 20)
    return _whole(_blocks(s, d).select("symbol", "t", "_extra", R(F.coalesce(F.when(ma != 0, F.col("v") / ma), F.lit(0.0))).alias("ratio")))


ASIA = "z AS (SELECT symbol, CAST(t + CASE WHEN hour(t) >= 22 THEN INTERVAL 1 DAY ELSE INTERVAL 0 DAY END AS DATE) AS day, max(h) AS hi, min(l) AS lo FROM hours WHERE hour(t) >= 22 OR hour(t) < 7 GROUP BY 1, 2)"


@query("e20_asian_range", f", {ASIA} SELECT symbol, day, hi, lo FROM z")
def e20(s, d):
    return G.night_range(hours(s, d))


@query("e21_forward_extremes", f" SELECT symbol, t, CASE WHEN count(h) {ORD[:-1]} ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) >= 5 THEN max(h) {ORD[:-1]} ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) END AS up, CASE WHEN count(h) {ORD[:-1]} ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) >= 5 THEN min(l) {ORD[:-1]} ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) END AS dn FROM hours")
def e21(s, d):
    return _whole(_blocks(s, d).select("symbol", "t", "_extra", I.forward(F.col("h"), WB(), 5, F.max).alias("up"), I.forward(F.col("l"), WB(), 5, F.min).alias("dn")))


@query("e22_rolling_beta", f" , x AS (SELECT symbol, t, c, CAST(v AS DOUBLE) AS v FROM hours), b AS (SELECT symbol, t, c, v, count(c) {w(60)} AS n, covar_samp(c, v) {w(60)} AS cv, var_samp(v) {w(60)} AS vv FROM x) SELECT symbol, t, round(CASE WHEN n >= 60 AND vv > 0 THEN cv / vv END, 7) AS beta FROM b")
def e22(s, d):
    f = I.rows(WB(), 60)
    b = _blocks(s, d).withColumns({"n": F.count("c").over(f), "cv": F.covar_samp("c", "v").over(f), "vv": F.var_samp("v").over(f)})
    return _whole(b.select("symbol", "t", "_extra", R(F.when((F.col("n") >= 60) & (F.col("vv") > 0), F.col("cv") / F.col("vv")), 7).alias("beta")))


@query("e23_drawdown", f", e AS (SELECT symbol, t, sum(c - o) {ORD[:-1]} ROWS UNBOUNDED PRECEDING) AS eq FROM hours) SELECT symbol, t, eq, max(eq) {ORD[:-1]} ROWS UNBOUNDED PRECEDING) - eq AS dd FROM e")
def e23(s, d):
    up = W0().rowsBetween(Window.unboundedPreceding, 0)
    b = hours(s, d).withColumn("eq", F.sum(F.col("c") - F.col("o")).over(up))
    return b.select("symbol", "t", "eq", (F.max("eq").over(up) - F.col("eq")).alias("dd"))


@query("e24_regime_quartile", """, a AS (SELECT symbol, CAST(t AS DATE) AS day, avg(h - l) AS x FROM hours GROUP BY 1, 2), q AS (SELECT symbol, quantile_cont(x, 0.25) AS a, quantile_cont(x, 0.5) AS b, quantile_cont(x, 0.75) AS c FROM a GROUP BY 1)
 SELECT a.symbol, day, CASE WHEN x <= q.a THEN 1 WHEN x <= q.b THEN 2 WHEN x <= q.c THEN 3 ELSE 4 END AS regime FROM a JOIN q ON a.symbol = q.symbol""")
def e24(s, d):
    a = hours(s, d).groupBy("symbol", F.to_date("t").alias("day")).agg(F.avg(F.col("h") - F.col("l")).alias("x"))
    q = a.groupBy("symbol").agg(F.percentile("x", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"))
    x = F.col("x")
    return a.join(q, "symbol").select("symbol", "day", F.when(x <= F.col("q")[0], 1).when(x <= F.col("q")[1], 2).when(x <= F.col("q")[2], 3).otherwise(4).alias("regime"))


@query("e26_inside_inside", f" SELECT symbol, t FROM (SELECT *, lag(h) {ORD} AS h1, lag(l) {ORD} AS l1, lag(h, 2) {ORD} AS h2, lag(l, 2) {ORD} AS l2 FROM hours) WHERE h < h1 AND l > l1 AND h1 < h2 AND l1 > l2")
def e26(s, d):
    return _whole(_blocks(s, d).where("true").withColumn("x", G.inside(WB())).where("x").select("symbol", "t", "_extra"))


# -- labels ------------------------------------------------------------------------------------


@query("f01_next_direction", f" SELECT symbol, t, CAST(coalesce(lead(c) {ORD} > c, false) AS INTEGER) AS y FROM hours")
def f01(s, d):
    return _whole(_blocks(s, d).select("symbol", "t", "_extra", L.next_up(WB()).alias("y")))


ATR14 = f"r AS (SELECT *, {TRS} AS tr FROM hours), a AS (SELECT *, CASE WHEN count(tr) {w(14)} >= 14 THEN round(avg(tr) {w(14)}, 6) END AS atr FROM r)"


def _atr_blocks(s, d, ahead=0):
    """Hourly bars with `atr`, in blocks that reach `ahead` rows on."""
    b, wb = I.in_blocks(hours(s, d), ["symbol"], "t", 15, ahead), I.block_window("symbol")
    return b.withColumn("tr", I.true_range(wb, seed=True)).withColumn("atr", R(I.sma(F.col("tr"), wb, 14)))


def with_atr(s, d):
    return I.own(_atr_blocks(s, d))


def _label(s, d, ahead, name, of):
    return I.own(_atr_blocks(s, d, ahead).withColumn(name, of(I.block_window("symbol")))).select("symbol", "t", name)


@query("f02_excursion", f", {ATR14} SELECT symbol, t, CAST(coalesce(CASE WHEN count(h) {ORD[:-1]} ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) >= 5 THEN max(h) {ORD[:-1]} ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) END - c > atr, false) AS INTEGER) AS y FROM a")
def f02(s, d):
    return _label(s, d, 5, "y", lambda wb: L.excursion(wb, 5))


TOUCH = ", f AS (SELECT symbol, t, c, atr, list({{'h': h, 'l': l, 'c': c}}) {o} ROWS BETWEEN 1 FOLLOWING AND 10 FOLLOWING) AS n FROM a), k AS (SELECT *, coalesce(list_position(list_transform(n, lambda x: {tp}), true), 0) AS ti, coalesce(list_position(list_transform(n, lambda x: {sl}), true), 0) AS si FROM f) SELECT symbol, t, CAST(CASE WHEN atr IS NULL OR len(n) < 10 OR ti = 0 THEN 0 WHEN si = 0 OR ti {cmp} si THEN 1 ELSE 0 END AS INTEGER) AS y FROM k"


@query("f03_barrier_close", f", {ATR14}" + TOUCH.format(o=ORD[:-1], tp="x.c >= c + 2.0 * atr", sl="x.c <= c - atr", cmp="<="))
def f03(s, d):
    return _label(s, d, 10, "y", lambda wb: L.triple_barrier(wb, 10, 2.0, 1.0, high="c", low="c", stop_first=False))


@query("f04_barrier_high_low", f", {ATR14}" + TOUCH.format(o=ORD[:-1], tp="x.h >= c + 2.0 * atr", sl="x.l <= c - atr", cmp="<"))
def f04(s, d):
    return _label(s, d, 10, "y", lambda wb: L.triple_barrier(wb, 10, 2.0, 1.0))


@query("f05_permuted_labels", f""", y AS (SELECT symbol, t, CAST(coalesce(lead(c) {ORD} > c, false) AS INTEGER) AS y FROM hours), a AS (SELECT symbol, t, row_number() {ORD} AS i FROM y),
 b AS (SELECT symbol, y, row_number() OVER (PARTITION BY symbol ORDER BY md5(CAST(epoch_us(t) AS VARCHAR) || '|42'), t) AS i FROM y) SELECT a.symbol, a.t, b.y FROM a JOIN b ON a.symbol = b.symbol AND a.i = b.i""")
def f05(s, d):
    return L.permuted(f01(s, d), ["symbol"], "t", "y", 42)


@query("f06_outcome", f", {ATR14}, o AS (SELECT symbol, t, CASE WHEN count(h) {ORD[:-1]} ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) >= 5 THEN max(h) {ORD[:-1]} ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) END - c >= atr AS win, c - CASE WHEN count(h) {ORD[:-1]} ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) >= 5 THEN min(l) {ORD[:-1]} ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) END >= atr AS loss FROM a) SELECT symbol, t, CASE WHEN win AND loss THEN 'ambiguous' WHEN win THEN 'win' WHEN loss THEN 'loss' WHEN NOT win AND NOT loss THEN 'timeout' END AS outcome FROM o")
def f06(s, d):
    return _label(s, d, 5, "outcome", lambda wb: L.outcome(wb, 5))


# -- signals -----------------------------------------------------------------------------------

def _mean(span: int) -> str:
    """SQL of the exponential mean over its reach, once `span` bars are there."""
    reach = int(34.5 * (span + 1) / 2) + 1
    return f"CASE WHEN count(c) {w(span)} >= {span} THEN list(c) {w(reach)} END"


IND = f"""{ATR14}, x1 AS (SELECT *, c - lag(c, 5) {ORD} AS ret5, CASE WHEN count(v) {w(20)} >= 20 THEN avg(v) {w(20)} END AS vma, CASE WHEN count(h) {w(12)} >= 12 THEN max(h) {w(12)} END AS hi12, CASE WHEN count(l) {w(12)} >= 12 THEN min(l) {w(12)} END AS lo12,
  coalesce(c - lag(c) {ORD}, 0) AS x0, {_mean(8)} AS l8, {_mean(21)} AS l21, list(h + l + c) {w(20)} AS tps, CASE WHEN count(c) {w(20)} >= 20 THEN avg(c) {w(20)} END AS bbm, CASE WHEN count(c) {w(20)} >= 20 THEN stddev_samp(c) {w(20)} END AS bbs,
  lag(h) {ORD} AS h1, lag(l) {ORD} AS l1, lag(h, 2) {ORD} AS h2, lag(l, 2) {ORD} AS l2 FROM a),
 x2 AS (SELECT *, count(x0) {w(14)} AS rn, avg(greatest(x0, 0)) {w(14)} AS ru, avg(greatest(-x0, 0)) {w(14)} AS rd, list_avg(tps) AS tpm, CASE WHEN count(bbs) {w(30)} >= 30 THEN avg(4 * bbs) {w(30)} END AS bbwma,
  CASE WHEN l8 IS NOT NULL THEN {EMA.format(d=1 - 2 / 9).replace("xs", "l8")} END AS r8, CASE WHEN l21 IS NOT NULL THEN {EMA.format(d=1 - 2 / 22).replace("xs", "l21")} END AS r21 FROM x1),
 x3 AS (SELECT *, CASE WHEN rn >= 14 AND rd <> 0 THEN 100 - 100 / (1 + ru / rd) ELSE 100 END AS rsi, list_sum(list_transform(tps, lambda each: abs(each - tpm))) / 20 AS dev, r8.s / r8.n AS e8, r21.s / r21.n AS e21 FROM x2), {ASIA},
 x AS (SELECT x3.*, CASE WHEN len(tps) >= 20 AND dev > 0 THEN (h + l + c - tpm) / (0.015 * dev) ELSE 0 END AS cci, hi AS ahi, lo AS alo FROM x3 LEFT JOIN z ON x3.symbol = z.symbol AND CAST(x3.t AS DATE) = z.day)"""
SIG = """, k AS (SELECT symbol, t, h, l, {buy} AS b, {sell} AS s FROM x WHERE atr > 0 AND hour(t) >= 7 AND hour(t) < 20), u AS (SELECT symbol, t, CASE WHEN h >= b THEN NULL ELSE b END AS b, CASE WHEN l <= s THEN NULL ELSE s END AS s FROM k),
 n AS (SELECT symbol, t, b, s, count(b) OVER (PARTITION BY symbol, CAST(t AS DATE) ORDER BY t) AS nb, count(s) OVER (PARTITION BY symbol, CAST(t AS DATE) ORDER BY t) AS ns FROM u)
 SELECT symbol, t, round(CASE WHEN nb = 1 THEN b END, 4) AS buy, round(CASE WHEN ns = 1 THEN s END, 4) AS sell FROM n WHERE (b IS NOT NULL AND nb = 1) OR (s IS NOT NULL AND ns = 1)"""
UP, DN, NONE = "c + 0.3 * atr", "c - 0.3 * atr", "CAST(NULL AS DOUBLE)"
NIGHT = "ahi - alo > 0 AND ahi - alo <= 10 * atr"


def _if(cond: str, level: str) -> str:
    return f"CASE WHEN {cond} THEN {level} END"


def _unless(cond: str, level: str) -> str:
    return f"CASE WHEN NOT coalesce({cond}, false) THEN {level} END"


# Each strategy's levels in SQL, as the library has them: both sides, or null where it does not fire.
LEVELS = {
    "atr_bracket": (UP, DN), "atr_breakout": (UP, DN), "null_bracket": (UP, DN), "night_range": (_if(NIGHT, "ahi"), _if(NIGHT, "alo")),
    "momentum_long": (_unless("ret5 <= 0", UP), NONE), "momentum_short": (NONE, _unless("ret5 >= 0", DN)), "momentum_bracket": (_unless("ret5 <= 0", UP), _unless("ret5 >= 0", DN)),
    "fade_long": (_if("rsi < 35", UP), NONE), "fade_short": (NONE, _if("rsi > 65", DN)), "rsi_long": (_if("rsi > 55", UP), NONE), "rsi_short": (NONE, _if("rsi < 45", DN)),
    "ema_cross_long": (_unless("e8 <= e21", UP), NONE), "ema_cross_short": (NONE, _unless("e8 >= e21", DN)), "ema_trend_bracket": (_unless("e8 <= e21", UP), _unless("e8 >= e21", DN)),
    "ema_fade_long": (_unless("e8 >= e21", UP), NONE), "ema_fade_short": (NONE, _unless("e8 <= e21", DN)),
    "breakout_range": ("hi12", "lo12"),
    "vol_spike_bracket": (_if("vma > 0 AND v >= 1.2 * vma", UP), _if("vma > 0 AND v >= 1.2 * vma", DN)), "vol_quiet_bracket": (_if("vma > 0 AND v < 0.5 * vma", UP), _if("vma > 0 AND v < 0.5 * vma", DN)),
    "high_vol_long": (_if("vma > 0 AND v >= 1.2 * vma AND NOT coalesce(ret5 <= 0, false)", UP), NONE), "high_vol_short": (NONE, _if("vma > 0 AND v >= 1.2 * vma AND NOT coalesce(ret5 >= 0, false)", DN)),
    "cci_fade_long": (_if("cci <= -200", UP), NONE), "cci_fade_short": (NONE, _if("cci >= 200", DN)),
    "bb_squeeze_long": (_if("4 * bbs < 0.7 * bbwma AND c > bbm + 2 * bbs", UP), NONE), "bb_squeeze_short": (NONE, _if("4 * bbs < 0.7 * bbwma AND c < bbm - 2 * bbs", DN)),
    "inside_inside_long": (_if("h < h1 AND l > l1 AND h1 < h2 AND l1 > l2", "h2"), NONE), "inside_inside_short": (NONE, _if("h < h1 AND l > l1 AND h1 < h2 AND l1 > l2", "l2")),
}


def _signal(name):
    def f(s, d):
        return G.generate(G.context(walk_hours(s, d)), name, vol_mult=1.2)

    return f


for _n in G.STRATEGIES:
    query(f"g_{_n}")(_signal(_n))
    SQL[f"g_{_n}"] = f"WITH {WALK}, {IND}" + SIG.format(buy=LEVELS[_n][0], sell=LEVELS[_n][1])


@query("g28_night_fade")
def g28(s, d):
    """Night fades of five-minute bars of the walk, with their exits."""
    return G.night_fade(walk_fives(s, d), 2.0, 1.0, 1.5, 12, 15.0)


@query("g29_threshold", f", p AS (SELECT symbol, t, round((c - l) / nullif(h - l, 0), 6) AS prob FROM hours) SELECT symbol, t, thr, prob > thr AS strict, prob >= thr AS loose FROM p, (SELECT unnest([0.5, 0.75, 0.9]) AS thr) WHERE prob >= thr")
def g29(s, d):
    p = hours(s, d).select("symbol", "t", R((F.col("c") - F.col("l")) / F.nullif(F.col("h") - F.col("l"), F.lit(0))).alias("prob"))
    p = p.withColumn("thr", F.explode(F.array(F.lit(0.5), F.lit(0.75), F.lit(0.9)))).where("prob >= thr")
    return p.select("symbol", "t", "thr", (F.col("prob") > F.col("thr")).alias("strict"), F.lit(True).alias("loose"))
