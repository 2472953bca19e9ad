"""Simulators, trade metrics, portfolios, validation, learning and report parsing."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import guards
from ..functions import indicators as I
from ..operators import joins as J
from ..operators import metrics as M
from ..operators import replay as P
from ..operators import signals as G
from ..operators import simulate as S
from ..operators import validation as V
from ..session import table
from .ref_windows import ATR14, W0, with_atr
from .substrate import HOURS, ORD, TICKS, TRADES, fives, hours, ticks, trades

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


T = f"WITH {TRADES} "
WIN, LOSS = "coalesce(sum(cents) FILTER (cents > 0), 0)", "coalesce(-sum(cents) FILTER (cents < 0), 0)"


def pf_sql(none: str) -> str:
    return f"CASE WHEN {LOSS} > 0 THEN {WIN} / {LOSS} ELSE {none} END"


# -- simulators --------------------------------------------------------------------------------


def _signals(s, d):
    g = G.generate(G.context(hours(s, d)), "atr_bracket")
    return g.join(with_atr(s, d).select("symbol", "t", "atr"), ["symbol", "t"]).withColumns({"sl_dist": F.col("atr"), "tp_dist": 2 * F.col("atr")})


HOUR_US = 3_600_000_000
RULES = P.Rules(bar_us=HOUR_US, wait=3, hold=24, stops=5.0, freeze=2.0, gap_us=6 * HOUR_US, cost=7.0, slip=1.0, trades_a_day=5, daily_loss=0.05, start=100_000.0)


def _orders(s, d):
    """Signals as orders: break-even at one average range, trailing at one and a half, a spread of 10 points."""
    a = F.col("atr")
    return _signals(s, d).join(hours(s, d).select("symbol", "t", F.col("c").alias("close")), ["symbol", "t"]).select("symbol", F.unix_timestamp("t").alias("id"), F.unix_micros("t").alias("u"), "buy", "sell", "sl_dist", "tp_dist", a.alias("be_dist"), (1.5 * a).alias("trail_dist"), "close", F.lit(10.0).alias("spread"))


def _quotes(s, d):
    """Ticks with a spread of 10 points about them."""
    return ticks(s, d).select("symbol", F.unix_micros("ts").alias("u"), (F.col("pts") - 5.0).alias("bid"), (F.col("pts") + 5.0).alias("ask"))


def _times(x):
    at = lambda c: F.timestamp_micros(c)
    return x.select("symbol", at("u").alias("t"), *(c for c in ("side", "entry", "exit", "sl", "tp", "pnl", "reason", "spread", "state", "balance") if c in x.columns), at("entry_u").alias("entry_time"), at("exit_u").alias("exit_time"))


@query("h01_sequential_sim")
def h01(s, d):
    """One bracket position at a time on hourly signals, followed over five-minute bars."""
    return _times(P.bracket_ea(_orders(s, d), fives(s, d).select("symbol", F.unix_micros("t").alias("u"), "h", "l", "c"), RULES))


@query("h02_sim_result")
def h02(s, d):
    """Reducer of h01: figures per symbol and year, with the exits by reason."""
    x = F.col("pnl")
    t = h01(s, d)
    g = t.groupBy("symbol", F.year("exit_time").alias("year"))
    reasons = {n: F.count_if(F.col("reason") == n).alias(n) for n in ("sl", "tp", "time_stop", "end_of_data")}
    return g.agg(*(R(c).alias(n) for n, c in M.summary(x).items()), R(M.profit_factor(x)).alias("pf"), F.max("balance").alias("top"), *reasons.values())


SIM = f"""WITH {HOURS}, {ATR14}, k AS (SELECT symbol, t, h, l, c + 0.3 * atr AS b, c - 0.3 * atr AS s, atr FROM a WHERE atr > 0 AND hour(t) >= 7 AND hour(t) < 20),
 u AS (SELECT symbol, t, atr, CASE WHEN h >= b THEN NULL ELSE b END AS b, CASE WHEN l <= s THEN NULL ELSE s END AS s FROM k),
 n AS (SELECT *, count(b) OVER (PARTITION BY symbol, CAST(t AS DATE) ORDER BY t) AS nb, count(s) OVER (PARTITION BY symbol, CAST(t AS DATE) ORDER BY t) AS ns FROM u),
 g AS (SELECT symbol, t, atr, 1 AS dir, round(b, 4) AS level FROM n WHERE b IS NOT NULL AND nb = 1 UNION ALL SELECT symbol, t, atr, -1, round(s, 4) FROM n WHERE s IS NOT NULL AND ns = 1),
 f AS (SELECT symbol, t, row_number() {ORD} AS i, h, l, c FROM hours), gi AS (SELECT g.*, f.i FROM g JOIN f ON g.symbol = f.symbol AND g.t = f.t),
 e AS (SELECT gi.symbol, gi.t, gi.i, dir, level, atr, min(f.i) AS ei FROM gi JOIN f ON f.symbol = gi.symbol AND f.i BETWEEN gi.i + 1 AND gi.i + 6 AND CASE WHEN dir > 0 THEN f.h >= level ELSE f.l <= level END GROUP BY ALL),
 x AS (SELECT e.*, min(f.i) FILTER (CASE WHEN dir > 0 THEN f.l <= level - dir * atr ELSE f.h >= level - dir * atr END) AS si, min(f.i) FILTER (CASE WHEN dir > 0 THEN f.h >= level + dir * 2 * atr ELSE f.l <= level + dir * 2 * atr END) AS ti,
   count(f.i) AS m, arg_max(f.c, f.i) AS last FROM e LEFT JOIN f ON f.symbol = e.symbol AND f.i BETWEEN e.ei + 1 AND e.ei + 6 GROUP BY e.symbol, e.t, e.i, e.dir, e.level, e.atr, e.ei),
 y AS (SELECT *, CASE WHEN si IS NOT NULL AND (ti IS NULL OR si <= ti) THEN 'sl' WHEN ti IS NOT NULL THEN 'tp' WHEN m >= 6 THEN 'timeout' ELSE 'eod' END AS why FROM x),
 sim AS (SELECT symbol, t, CASE WHEN dir > 0 THEN 'long' ELSE 'short' END AS side, CAST(ei - i AS INTEGER) AS entry_i, CAST(ei - i + CASE why WHEN 'sl' THEN si - ei WHEN 'tp' THEN ti - ei ELSE m END AS INTEGER) AS exit_i, why AS exit_reason,
   round(dir * (CASE why WHEN 'sl' THEN level - dir * atr WHEN 'tp' THEN level + dir * 2 * atr ELSE coalesce(last, level) END - level) - 15, 3) AS pnl FROM y) """


def _bracket(s, d):
    return S.bracket(_signals(s, d), hours(s, d), 6, 15.0)


@query("h04_bracket_sim", SIM + "SELECT symbol, t, side, entry_i, exit_i, exit_reason, pnl FROM sim")
def h04(s, d):
    return _bracket(s, d).select("symbol", "t", "side", "entry_i", "exit_i", "exit_reason", R(F.col("pnl"), 3).alias("pnl"))


@query("h05_tick_replay")
def h05(s, d):
    """Every signal by itself over the ticks."""
    return _times(P.tick_outcomes(_orders(s, d), _quotes(s, d), RULES))


@query("h06_tick_book")
def h06(s, d):
    """The same with one position at a time and daily limits."""
    return _times(P.tick_book(_orders(s, d), _quotes(s, d), RULES))


TB = f"""WITH {HOURS}, {ATR14}, f AS (SELECT *, row_number() {ORD} AS i FROM a), k AS (SELECT symbol, t, i, atr FROM f WHERE atr > 0 AND c > o),
 e AS (SELECT k.*, x.o AS entry, z.o AS last FROM k JOIN f x ON x.symbol = k.symbol AND x.i = k.i + 1 JOIN f z ON z.symbol = k.symbol AND z.i = k.i + 7),
 m AS (SELECT e.symbol, e.t, e.atr, e.entry, e.last, min(f.i) FILTER (f.l <= entry - e.atr) AS si, min(f.i) FILTER (f.h >= entry + 2.0 * e.atr) AS ti FROM e JOIN f ON f.symbol = e.symbol AND f.i BETWEEN e.i + 1 AND e.i + 7 GROUP BY ALL)
 SELECT symbol, t, CASE WHEN si IS NOT NULL AND (ti IS NULL OR si <= ti) THEN 'sl' WHEN ti IS NOT NULL THEN 'tp' ELSE 'time' END AS exit_reason,
 round(CASE WHEN si IS NOT NULL AND (ti IS NULL OR si <= ti) THEN entry - atr WHEN ti IS NOT NULL THEN entry + 2.0 * atr ELSE last END - entry - 17, 3) AS pnl FROM m"""


@query("h08_threshold_sim", TB)
def h08(s, d):
    c = with_atr(s, d).where("atr > 0 AND c > o").select("symbol", "t", "atr")
    return S.threshold_long(c, hours(s, d), 6, 1.0, 2.0, 17.0).select("symbol", "t", "exit_reason", R(F.col("pnl"), 3).alias("pnl"))


H09 = SIM + """, z AS (SELECT *, dir * (CASE why WHEN 'sl' THEN level - dir * atr WHEN 'tp' THEN level + dir * 2 * atr ELSE coalesce(last, level) END - level) - 15 AS stop, coalesce(si = ti, false) AS tie, 2 * atr - 15 AS goal,
   strpos('02468ace', substr(md5(symbol || '|' || CAST(epoch_us(t) AS VARCHAR) || '|' || CASE WHEN dir > 0 THEN 'long' ELSE 'short' END || '|42'), 4, 1)) > 0 AS coin FROM y),
 m AS (SELECT 'stop_first' AS mode, stop AS p FROM z UNION ALL SELECT 'target_first', CASE WHEN tie THEN goal ELSE stop END FROM z UNION ALL SELECT 'coin', CASE WHEN tie AND coin THEN goal ELSE stop END FROM z)
 SELECT mode, round(coalesce(sum(p) FILTER (p > 0), 0) / -sum(p) FILTER (p < 0), 6) AS pf, count(*) AS trades FROM m GROUP BY 1"""


@query("h09_bias_modes", H09)
def h09(s, d):
    """Outcomes of the same brackets with the stop, the target or a seeded coin deciding bars that touch both."""
    return S.bias_modes(_bracket(s, d)).groupBy("mode").agg(R(M.profit_factor(F.col("pnl"))).alias("pf"), F.count(F.lit(1)).alias("trades"))


@query("h11_greedy_no_overlap", """WITH RECURSIVE x AS (SELECT log_id, book, strategy, open_time AS o, close_time AS c, row_number() OVER (PARTITION BY book, strategy ORDER BY open_time, log_id) AS i FROM eur_dd_postmortem WHERE close_time >= open_time AND book IS NOT NULL AND strategy IS NOT NULL),
 r AS (SELECT book, strategy, i, log_id, c AS busy, true AS kept FROM x WHERE i = 1 UNION ALL SELECT x.book, x.strategy, x.i, x.log_id, CASE WHEN x.o >= r.busy THEN x.c ELSE r.busy END, x.o >= r.busy FROM r JOIN x ON x.book = r.book AND x.strategy = r.strategy AND x.i = r.i + 1)
 SELECT log_id FROM r WHERE kept""")
def h11(s, d):
    log = table(s, d, "eur_dd_postmortem").where("book IS NOT NULL AND strategy IS NOT NULL")
    return M.greedy_no_overlap(log, ["book", "strategy"], "open_time", "close_time", "log_id").select("log_id")


STEP = "CASE WHEN 1 + 0.01 * cents / 10000.0 > 0 THEN ln(1 + 0.01 * cents / 10000.0) ELSE -1e9 END"


@query("h12_compounding", T + f"SELECT log_id, round(exp(sum({STEP}) OVER (PARTITION BY book ORDER BY open_time, log_id ROWS UNBOUNDED PRECEDING)), 6) AS growth FROM trades WHERE book IS NOT NULL")
def h12(s, d):
    """Growth at a hundredth of the equity per trade, as running sums of logarithms in chunks; a loss of all there is leaves 0 for good."""
    step = 1 + 0.01 * F.col("cents") / 10000.0
    t = trades(s, d).where("book IS NOT NULL").withColumn("step", F.when(step > 0, F.ln(step)).otherwise(-1e9))
    return M.equity(t, ["book"], ["open_time", "log_id"], "step").select("log_id", R(F.exp("equity")).alias("growth"))


@query("h13_kill_switch")
def h13(s, d):
    return M.kill_switch(trades(s, d), ["book"], ["open_time", "log_id"], "cents", 100_000.0)


@query("h14_position_size", "SELECT trade_id, CASE WHEN abs(entry_price - sl) > 0 THEN greatest(0.01, least(100.0, floor(round(10000.0 * 1.0 / 100 / (abs(entry_price - sl) * 100000) / 0.01, 6)) * 0.01)) ELSE 0.0 END AS lots FROM tick_replay")
def h14(s, d):
    return table(s, d, "tick_replay").select("trade_id", S.position_size(F.lit(10000.0), F.lit(1.0), F.abs(F.col("entry_price") - F.col("sl")) * 100000).alias("lots"))


@query("h15_cost_models", "SELECT trade_id, m AS model, round(pnl_gross - CASE m WHEN 'flat' THEN 1.5 WHEN 'spread_slip' THEN 1.7 ELSE 1.3 END, 6) AS pnl FROM tick_replay, (SELECT unnest(['flat', 'spread_slip', 'spread']) AS m)")
def h15(s, d):
    models = F.array(*(F.struct(F.lit(n).alias("model"), F.lit(c).alias("cost")) for n, c in (("flat", 1.5), ("spread_slip", 1.7), ("spread", 1.3))))
    return table(s, d, "tick_replay").select("trade_id", "pnl_gross", F.explode(models).alias("m")).select("trade_id", "m.model", R(F.col("pnl_gross") - F.col("m.cost")).alias("pnl"))


# -- metrics -----------------------------------------------------------------------------------


@query("i01_profit_factors", T + f"SELECT book, strategy, round({pf_sql(f'CASE WHEN {WIN} > 0 THEN 999.0 ELSE 0.0 END')}, 9) AS capped, round({pf_sql('0.0')}, 9) AS zero, round({pf_sql('NULL')}, 9) AS nul FROM trades GROUP BY 1, 2")
def i01(s, d):
    x = F.col("cents")
    return trades(s, d).groupBy("book", "strategy").agg(*(R(M.profit_factor(x, v), 9).alias(n) for v, n in (("capped", "capped"), ("zero", "zero"), ("null", "nul"))))


@query("i02_summary", T + "SELECT strategy, count(cents) AS trades, count_if(cents > 0) AS wins, count_if(cents < 0) AS losses, CAST(sum(cents) AS BIGINT) AS net, count_if(cents > 0) / count(cents) AS win_rate, avg(cents) FILTER (cents > 0) AS avg_win, avg(cents) FILTER (cents < 0) AS avg_loss FROM trades GROUP BY 1")
def i02(s, d):
    return trades(s, d).groupBy("strategy").agg(*(c.alias(n) for n, c in M.summary(F.col("cents")).items()))


EQ = "e AS (SELECT *, CAST(sum(cents) OVER (PARTITION BY book ORDER BY open_time, log_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS eq FROM trades), p AS (SELECT *, greatest(max(eq) OVER (PARTITION BY book ORDER BY open_time, log_id ROWS UNBOUNDED PRECEDING), 0) AS pk, max(eq) OVER (PARTITION BY book ORDER BY open_time, log_id ROWS UNBOUNDED PRECEDING) AS pk0 FROM e)"


@query("i03_max_drawdown", f"WITH {TRADES}, {EQ} SELECT book, CAST(max(100000 + pk0 - (100000 + eq)) AS DOUBLE) AS max_dd, round(coalesce(max((pk0 - eq) / (100000 + pk0) * 100) FILTER (100000 + pk0 > 0), 0), 9) AS max_dd_pct FROM p GROUP BY 1")
def i03(s, d):
    eq = M.equity(trades(s, d).where("book IS NOT NULL"), ["book"], ["open_time", "log_id"], "cents", 100_000.0)
    return M.max_drawdown(eq, ["book"]).withColumn("max_dd_pct", R(F.col("max_dd_pct"), 9))


@query("i03_drawdown_seeded", f"WITH {TRADES}, {EQ} SELECT log_id, CAST(eq AS DOUBLE) AS equity, CAST(pk - eq AS DOUBLE) AS dd FROM p")
def i03b(s, d):
    return M.equity(trades(s, d).where("book IS NOT NULL"), ["book"], ["open_time", "log_id"], "cents", 0.0, True).select("log_id", "equity", F.col("dd").cast("double").alias("dd"))


@query("i04_groupings", T + """SELECT year(open_time) AS y, hour(open_time) AS h, isodow(open_time) - 1 AS dow, direction, exit_reason, strategy, bucket, CAST(grouping(year(open_time), hour(open_time), isodow(open_time) - 1, direction, exit_reason, strategy, bucket) AS BIGINT) AS g, count(*) AS n, CAST(sum(cents) AS BIGINT) AS net
 FROM trades GROUP BY GROUPING SETS ((year(open_time)), (hour(open_time)), (isodow(open_time) - 1), (direction), (exit_reason), (strategy), (bucket))""")
def i04(s, d):
    t = trades(s, d).withColumns({"y": F.year("open_time").cast("bigint"), "h": F.hour("open_time").cast("bigint"), "dow": F.weekday("open_time").cast("bigint")})
    t.createOrReplaceTempView("_tm_trades")
    cols = ["y", "h", "dow", "direction", "exit_reason", "strategy", "bucket"]
    return s.sql(f"SELECT {', '.join(cols)}, CAST(grouping_id({', '.join(cols)}) AS BIGINT) AS g, count(*) AS n, sum(cents) AS net FROM _tm_trades GROUP BY GROUPING SETS ({', '.join(f'({c})' for c in cols)})")


@query("i05_exit_histogram", T + "SELECT strategy, coalesce(exit_reason, '?') AS exit_reason, count(*) AS n FROM trades GROUP BY 1, 2")
def i05(s, d):
    return trades(s, d).groupBy("strategy", F.coalesce("exit_reason", F.lit("?")).alias("exit_reason")).agg(F.count(F.lit(1)).alias("n"))


@query("i06_daily_pnl", T + "SELECT book, CAST(open_time AS DATE) AS day, CAST(sum(cents) AS BIGINT) AS pnl FROM trades GROUP BY 1, 2")
def i06(s, d):
    return V.daily(trades(s, d), ["book"], "open_time", "cents")


@query("i07_sharpe", T + ", d AS (SELECT book, CAST(open_time AS DATE) AS day, sum(cents) AS p FROM trades GROUP BY 1, 2), a AS (SELECT book, avg(cents) / stddev_pop(cents) * sqrt(count(*)) AS s FROM trades GROUP BY 1 HAVING stddev_pop(cents) > 0), b AS (SELECT book, avg(p) / stddev_samp(p) * sqrt(252) AS s FROM d GROUP BY 1 HAVING count(*) > 1) SELECT a.book, round(a.s, 6) AS per_trade, round(b.s, 6) AS daily FROM a JOIN b ON a.book = b.book")
def i07(s, d):
    t = trades(s, d).where("book IS NOT NULL")
    x = F.col("cents")
    a = t.groupBy("book").agg(F.avg(x).alias("m"), F.stddev_pop(x).alias("sd"), F.count(x).alias("n")).where("sd > 0").select("book", R(F.col("m") / F.col("sd") * F.sqrt("n")).alias("per_trade"))
    b = V.daily(t, ["book"], "open_time", "cents").groupBy("book").agg(F.avg("pnl").alias("m"), F.stddev_samp("pnl").alias("sd"), F.count("pnl").alias("n")).where("n > 1").select("book", R(F.col("m") / F.col("sd") * F.sqrt(F.lit(252.0))).alias("daily"))
    return a.join(b, "book")


@query("i08_rates", T + "SELECT book, round(count(*) / greatest((epoch(max(open_time)) - epoch(min(open_time))) / 86400 / 30.4375, 1), 6) AS per_month, round(sum(cents) / 1000.0, 6) AS return_pct FROM trades GROUP BY 1")
def i08(s, d):
    us = lambda c: F.unix_micros(c) / 1e6
    return trades(s, d).groupBy("book").agg(R(F.count(F.lit(1)) / F.greatest((us(F.max("open_time")) - us(F.min("open_time"))) / 86400 / 30.4375, F.lit(1))).alias("per_month"), R(F.sum("cents") / 1000.0).alias("return_pct"))


EVENTS = f"""WITH {TRADES}, {EQ}, s AS (SELECT *, pk - eq AS dd, sum(CASE WHEN pk = eq THEN 1 ELSE 0 END) OVER (PARTITION BY book ORDER BY open_time, log_id ROWS UNBOUNDED PRECEDING) AS seg FROM p WHERE book IS NOT NULL),
 g AS (SELECT book, seg, min(open_time) AS peak_time, CAST(max(dd) AS DOUBLE) AS depth, arg_min(open_time, (-dd, open_time, log_id)) AS trough_time FROM s GROUP BY 1, 2), l AS (SELECT *, lead(peak_time) OVER (PARTITION BY book ORDER BY seg) AS recovery_time FROM g),
 ev AS (SELECT book, peak_time, depth, trough_time, recovery_time, CAST(row_number() OVER (PARTITION BY book ORDER BY depth DESC, peak_time, seg) AS INTEGER) AS rank FROM l WHERE depth > 0 QUALIFY rank <= 5),
 bd AS (SELECT t.book, rank, strategy, CAST(sum(cents) AS BIGINT) AS net, count(*) AS n FROM trades t JOIN ev ON t.book = ev.book AND t.open_time > peak_time AND t.open_time <= trough_time GROUP BY ALL),
 wb AS (SELECT *, row_number() OVER (PARTITION BY book, rank ORDER BY net, strategy NULLS FIRST) = 1 AS worst, round(CASE WHEN net < 0 THEN net / sum(net) FILTER (net < 0) OVER (PARTITION BY book, rank) END, 6) AS loss_share FROM bd),
 pt AS (SELECT strategy, count(*) AS events, CAST(sum(net) AS BIGINT) AS net FROM wb WHERE worst GROUP BY 1) """


@query("i09_drawdown_events", EVENTS + "SELECT * FROM ev")
def i09(s, d):
    eq = M.equity(trades(s, d).where("book IS NOT NULL"), ["book"], ["open_time", "log_id"], "cents", 0.0, True)
    return M.drawdown_events(eq, ["book"], ["open_time", "log_id"], 5)


@query("i10_event_breakdown", EVENTS + "SELECT * FROM wb")
def i10(s, d):
    """Losses of each strategy within each drawdown event, from peak to trough, and the worst of them."""
    ev = i09(s, d).select(F.col("book").alias("b"), "rank", "peak_time", "trough_time")
    t = trades(s, d).join(ev, (F.col("book") == F.col("b")) & (F.col("open_time") > F.col("peak_time")) & (F.col("open_time") <= F.col("trough_time")))
    g = t.groupBy("book", "rank", "strategy").agg(F.sum("cents").alias("net"), F.count(F.lit(1)).alias("n"))
    worst = F.row_number().over(Window.partitionBy("book", "rank").orderBy("net", "strategy")) == 1
    share = F.sum(F.when(F.col("net") < 0, F.col("net"))).over(Window.partitionBy("book", "rank"))
    return g.select("book", "rank", "strategy", "net", "n", worst.alias("worst"), R(F.when(F.col("net") < 0, F.col("net") / share)).alias("loss_share"))


@query("i11_worst_pattern", EVENTS + "SELECT * FROM pt")
def i11(s, d):
    return i10(s, d).where("worst").groupBy("strategy").agg(F.count(F.lit(1)).alias("events"), F.sum("net").alias("net"))


@query("i12_mitigations", EVENTS + "SELECT strategy, CASE WHEN events >= 10 THEN 'drop ' || strategy WHEN events >= 3 THEN 'halve ' || strategy ELSE 'watch' END AS advice FROM pt")
def i12(s, d):
    n = F.col("events")
    return i11(s, d).select("strategy", F.when(n >= 10, F.concat_ws(" ", F.lit("drop"), "strategy")).when(n >= 3, F.concat_ws(" ", F.lit("halve"), "strategy")).otherwise("watch").alias("advice"))


@query("i13_top_per_strategy", T + f"""SELECT * FROM (SELECT strategy, bucket, count(*) AS n, round({pf_sql('0.0')}, 9) AS pf, row_number() OVER (PARTITION BY strategy ORDER BY round({pf_sql('0.0')}, 9) DESC, bucket) AS rank FROM trades WHERE bucket IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 20) WHERE rank <= 2""")
def i13(s, d):
    g = trades(s, d).where("bucket IS NOT NULL").groupBy("strategy", "bucket").agg(F.count(F.lit(1)).alias("n"), R(M.profit_factor(F.col("cents"), "zero"), 9).alias("pf")).where("n >= 20")
    return g.withColumn("rank", F.row_number().over(Window.partitionBy("strategy").orderBy(F.desc("pf"), "bucket")).cast("bigint")).where("rank <= 2")


LEAD = "w AS (SELECT harvester, label, vt, try_cast(profit_factor AS DOUBLE) AS pf, try_cast(total_trades AS BIGINT) AS n, report_id FROM wave_results)"


@query("i14_best_threshold", f"WITH {LEAD} SELECT harvester, arg_max(vt, (pf, -report_id)) AS vt, max(pf) AS pf FROM w WHERE n >= 60 AND pf IS NOT NULL AND vt IS NOT NULL GROUP BY 1")
def i14(s, d):
    w = _wave(s, d).where("n >= 60 AND pf IS NOT NULL AND vt IS NOT NULL")
    return w.groupBy("harvester").agg(F.max_by("vt", F.struct("pf", -F.col("report_id"))).alias("vt"), F.max("pf").alias("pf"))


def _wave(s, d):
    return table(s, d, "wave_results").select("harvester", "label", "vt", F.col("profit_factor").try_cast("double").alias("pf"), F.col("total_trades").try_cast("bigint").alias("n"), "report_id")


@query("i15_frontier", f"WITH {LEAD} SELECT harvester, coalesce(arg_max(report_id, (n, -report_id)) FILTER (pf >= 1.3 AND n >= 20), arg_max(report_id, (pf, -report_id))) AS pick FROM w WHERE pf IS NOT NULL AND n IS NOT NULL GROUP BY 1")
def i15(s, d):
    good = (F.col("pf") >= 1.3) & (F.col("n") >= 20)
    w = _wave(s, d).where("pf IS NOT NULL AND n IS NOT NULL")
    best = F.max_by(F.when(good, F.col("report_id")), F.when(good, F.struct("n", -F.col("report_id"))))
    return w.groupBy("harvester").agg(F.coalesce(best, F.max_by("report_id", F.struct("pf", -F.col("report_id")))).alias("pick"))


@query("i16_threshold_sweep", f"""WITH {HOURS}, p AS (SELECT symbol, round((c - l) / nullif(h - l, 0), 6) AS prob, CAST(lead(c) {ORD} - c AS BIGINT) AS pnl FROM hours) SELECT thr, count(*) AS n, CAST(sum(pnl) AS BIGINT) AS net FROM p, (SELECT unnest(range(20, 61)) AS k, k / 100 AS thr) WHERE prob > thr AND pnl IS NOT NULL GROUP BY 1""")
def i16(s, d):
    p = hours(s, d).select(R((F.col("c") - F.col("l")) / F.nullif(F.col("h") - F.col("l"), F.lit(0))).alias("prob"), (F.lead("c").over(W0()) - F.col("c")).cast("bigint").alias("pnl"))
    p = p.where("pnl IS NOT NULL").withColumn("thr", F.explode(F.expr("transform(sequence(20, 60), k -> k / 100)"))).where("prob > thr")
    return p.groupBy("thr").agg(F.count(F.lit(1)).alias("n"), F.sum("pnl").alias("net"))


@query("i17_leaderboard", f"WITH {LEAD} SELECT report_id, label, pf, n FROM w WHERE pf IS NOT NULL AND n >= 100 AND pf <= 20 ORDER BY pf DESC, report_id LIMIT 5")
def i17(s, d):
    return _wave(s, d).where("pf IS NOT NULL AND n >= 100 AND pf <= 20").orderBy(F.desc("pf"), "report_id").limit(5).select("report_id", "label", "pf", "n")


# -- portfolios --------------------------------------------------------------------------------

CONC = "i AS (SELECT t.*, o FROM (SELECT *, open_time AS o FROM trades WHERE close_time > open_time AND book IS NOT NULL) t), n AS (SELECT a.log_id, count(*) AS k FROM i a JOIN i b ON a.book = b.book AND b.open_time <= a.open_time AND b.close_time > a.open_time GROUP BY 1)"


@query("j01_concurrency_haircut", f"WITH {TRADES}, {CONC} SELECT i.log_id, CAST(k AS BIGINT) AS concurrent, CASE WHEN k > 3 THEN cents * 0.5 ELSE cents * 1.0 END AS adjusted FROM i JOIN n ON i.log_id = n.log_id")
def j01(s, d):
    t = trades(s, d).where("close_time > open_time AND book IS NOT NULL")
    k = J.concurrency(t, ["book"], "open_time", "close_time", "log_id").select(F.col("log_id").alias("i"), "concurrent")
    return t.join(k, F.col("log_id") == F.col("i")).select("log_id", "concurrent", F.when(F.col("concurrent") > 3, F.col("cents") * 0.5).otherwise(F.col("cents") * 1.0).alias("adjusted"))


COR = ", x AS (SELECT strategy, CAST(open_time AS DATE) AS day, CAST(sum(cents) AS DOUBLE) AS p FROM trades WHERE strategy IS NOT NULL GROUP BY 1, 2), n AS (SELECT count(DISTINCT day) AS n FROM x), m AS (SELECT strategy, sum(p) AS s, sum(p * p) AS q FROM x GROUP BY 1), ab AS (SELECT a.strategy AS a, b.strategy AS b, sum(a.p * b.p) AS ab, count(*) AS days FROM x a JOIN x b ON a.day = b.day AND a.strategy < b.strategy GROUP BY 1, 2), c AS (SELECT ab.a, ab.b, days, round((n * ab - ma.s * mb.s) / sqrt((n * ma.q - ma.s * ma.s) * (n * mb.q - mb.s * mb.s)), 9) AS rho FROM ab, n, m ma, m mb WHERE ma.strategy = ab.a AND mb.strategy = ab.b)"


def _corr(s, d):
    """Correlations of daily results over the union of days, missing days 0: sums alone, so no day is made up and no wide table is built."""
    x = V.daily(trades(s, d).where("strategy IS NOT NULL"), ["strategy"], "open_time", "cents").select("strategy", "day", F.col("pnl").cast("double").alias("p"))
    n = x.agg(F.count_distinct("day").alias("n"))
    m = x.groupBy("strategy").agg(F.sum("p").alias("s"), F.sum(F.col("p") * F.col("p")).alias("q"))
    y = x.select(F.col("strategy").alias("b"), "day", F.col("p").alias("pb"))
    ab = x.join(y, "day").where("strategy < b").groupBy(F.col("strategy").alias("a"), "b").agg(F.sum(F.col("p") * F.col("pb")).alias("ab"), F.count(F.lit(1)).alias("days"))
    ab = ab.join(m.select(F.col("strategy").alias("a"), F.col("s").alias("sa"), F.col("q").alias("qa")), "a").join(m.select(F.col("strategy").alias("b"), F.col("s").alias("sb"), F.col("q").alias("qb")), "b").join(n.withColumn("_one", F.lit(1)), F.lit(1) == F.col("_one"))
    n = F.col("n")
    return ab.select("a", "b", "days", R((n * F.col("ab") - F.col("sa") * F.col("sb")) / F.sqrt((n * F.col("qa") - F.col("sa") * F.col("sa")) * (n * F.col("qb") - F.col("sb") * F.col("sb"))), 9).alias("rho"))


@query("j02_correlations", T + COR + " SELECT a, b, days, rho FROM c")
def j02(s, d):
    return _corr(s, d)


@query("j03_correlation_gate", T + COR + " SELECT count(*) AS pairs, max(abs(rho)) AS worst, CASE WHEN count(*) = 0 THEN 'INSUFFICIENT' WHEN min(days) < 60 THEN 'INSUFFICIENT' WHEN max(abs(rho)) <= 0.3 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM c")
def j03(s, d):
    worst = F.max(F.abs(F.col("rho")))
    return _corr(s, d).agg(F.count(F.lit(1)).alias("pairs"), worst.alias("worst"), F.when((F.count(F.lit(1)) == 0) | (F.min("days") < 60), "INSUFFICIENT").when(worst <= 0.3, "PASS").otherwise("FAIL").alias("verdict"))


@query("j04_unique_names", "SELECT report_id, CASE WHEN row_number() OVER (PARTITION BY label ORDER BY report_id) = 1 THEN label ELSE label || '_' || row_number() OVER (PARTITION BY label ORDER BY report_id) END AS name FROM wave_results WHERE label IS NOT NULL")
def j04(s, d):
    i = F.row_number().over(Window.partitionBy("label").orderBy("report_id"))
    return table(s, d, "wave_results").where("label IS NOT NULL").select("report_id", F.when(i == 1, F.col("label")).otherwise(F.concat_ws("_", "label", i.cast("string"))).alias("name"))


@query("j05_bucket_cap", T + f"SELECT bucket, strategy, pf FROM (SELECT bucket, strategy, round({pf_sql('0.0')}, 9) AS pf, row_number() OVER (PARTITION BY bucket ORDER BY round({pf_sql('0.0')}, 9) DESC, strategy) AS r FROM trades WHERE bucket IS NOT NULL AND strategy IS NOT NULL GROUP BY 1, 2) WHERE r <= 3")
def j05(s, d):
    g = trades(s, d).where("bucket IS NOT NULL AND strategy IS NOT NULL").groupBy("bucket", "strategy").agg(R(M.profit_factor(F.col("cents"), "zero"), 9).alias("pf"))
    return g.withColumn("r", F.row_number().over(Window.partitionBy("bucket").orderBy(F.desc("pf"), "strategy"))).where("r <= 3").drop("r")


@query("j06_gate_sweep", T + "SELECT g AS gate, count(*) AS n, CAST(sum(cents) AS BIGINT) AS net FROM trades, (SELECT unnest([0, 4, 5, 6, 7, 8]) AS g) WHERE abs(cents) >= g * 100 GROUP BY 1")
def j06(s, d):
    t = trades(s, d).withColumn("gate", F.explode(F.array(*(F.lit(g) for g in (0, 4, 5, 6, 7, 8))))).where("abs(cents) >= gate * 100")
    return t.groupBy("gate").agg(F.count(F.lit(1)).alias("n"), F.sum("cents").alias("net"))


@query("j07_drop_one", T + f", s AS (SELECT strategy, {WIN} AS g, {LOSS} AS b, CAST(sum(cents) AS BIGINT) AS net FROM trades WHERE strategy IS NOT NULL GROUP BY 1), t AS (SELECT sum(g) AS g, sum(b) AS b, sum(net) AS net FROM s) SELECT strategy AS dropped, CAST(t.net - s.net AS BIGINT) AS net, round((t.g - s.g) / nullif(t.b - s.b, 0), 9) AS pf, round((t.g - s.g) / nullif(t.b - s.b, 0) - t.g / nullif(t.b, 0), 9) AS delta FROM s, t")
def j07(s, d):
    """Leave-one-out from sums per strategy: the whole less the one, so the log is read once however many strategies there are."""
    g, b = M.gross(F.col("cents"))
    x = trades(s, d).where("strategy IS NOT NULL").groupBy("strategy").agg(g.alias("g"), b.alias("b"), F.sum("cents").alias("net"))
    w = Window.partitionBy(F.lit(0))  # one row per strategy
    tg, tb, tn = F.sum("g").over(w), F.sum("b").over(w), F.sum("net").over(w)
    pf = (tg - F.col("g")) / F.nullif(tb - F.col("b"), F.lit(0))
    return x.select(F.col("strategy").alias("dropped"), (tn - F.col("net")).alias("net"), R(pf, 9).alias("pf"), R(pf - tg / F.nullif(tb, F.lit(0)), 9).alias("delta"))


@query("j10_first_qualifying", f"WITH {LEAD} SELECT harvester, min(report_id) AS winner FROM w WHERE pf >= 1.1 AND n >= 100 GROUP BY 1")
def j10(s, d):
    return _wave(s, d).where("pf >= 1.1 AND n >= 100").groupBy("harvester").agg(F.min("report_id").alias("winner"))


# -- validation --------------------------------------------------------------------------------


def _days(s, d):
    return V.daily(trades(s, d), [], "open_time", "cents")


@query("k01_block_bootstrap")
def k01(s, d):
    return V.bootstrap_summary(V.bootstrap(_days(s, d), 10_000))


@query("k03_iid_bootstrap")
def k03(s, d):
    return V.bootstrap_summary(V.bootstrap(_days(s, d), 1000, blocks=False))


@query("k04_moments", T + "SELECT book, count(*) AS n, round(avg(cents), 6) AS mean, round(stddev_samp(cents), 4) AS sd, round(skewness(cents), 6) AS skew, round(kurtosis(cents), 5) AS kurt FROM trades GROUP BY 1 HAVING count(*) > 3")
def k04(s, d):
    m = V.moments(trades(s, d), ["book"], F.col("cents").cast("double")).where("n > 3")
    return m.select("book", "n", R(F.col("mean")).alias("mean"), R(F.col("sd"), 4).alias("sd"), R(F.col("skew")).alias("skew"), R(F.col("kurt"), 5).alias("kurt"))


@query("k04_deflated_sharpe")
def k04b(s, d):
    """One row per book (few): moments are aggregated in Spark, the normal quantiles taken on the rows."""
    m = V.moments(trades(s, d), ["book"], F.col("cents").cast("double")).where("n > 3 AND sd > 0")

    def run(batches):
        for b in batches:
            b["dsr"] = [V.deflated_sharpe(r.mean / r.sd, int(r.n), r.skew, r.kurt + 3, 100, 1 / r.n) for r in b.itertuples()]
            yield b[["book", "n", "dsr"]]

    return m.mapInPandas(run, "book string, n bigint, dsr double")


@query("k05_pf_to_sharpe", f"WITH {LEAD} SELECT report_id, round((pf * 0.6 / 0.4 * 0.4 - 0.6) / sqrt(0.24 * (pf * 0.6 / 0.4 + 1) * (pf * 0.6 / 0.4 + 1)), 9) AS sharpe FROM w WHERE pf IS NOT NULL")
def k05(s, d):
    return _wave(s, d).where("pf IS NOT NULL").select("report_id", R(V.pf_to_sharpe(F.col("pf"), F.lit(0.4)), 9).alias("sharpe"))


FOLDS = ", e AS (SELECT CAST(min(open_time) AS DATE) AS a, CAST(max(open_time) AS DATE) + 1 AS z FROM trades), f AS (SELECT CAST(k AS INTEGER) AS fold, CAST(a + to_months(CAST(k * 3 AS INTEGER)) AS DATE) AS train_start, CAST(a + to_months(CAST(k * 3 + 9 AS INTEGER)) AS DATE) AS train_end, CAST(a + to_months(CAST(k * 3 + 12 AS INTEGER)) AS DATE) AS test_end, z FROM e, (SELECT unnest(range(0, 100)) AS k))"


@query("k06_walk_forward", T + FOLDS + f" SELECT fold, train_end, test_end, count(*) AS n, CAST(sum(cents) AS BIGINT) AS net, round({pf_sql('0.0')}, 9) AS pf FROM f JOIN trades ON CAST(open_time AS DATE) >= train_end AND CAST(open_time AS DATE) < test_end WHERE test_end <= z GROUP BY 1, 2, 3 HAVING count(*) >= 30")
def k06(s, d):
    t = trades(s, d)
    x = V.fold_trades(t, V.folds(t, "open_time", 9, 3, 3), "open_time")
    return x.groupBy("fold", "train_end", "test_end").agg(F.count(F.lit(1)).alias("n"), F.sum("cents").alias("net"), R(M.profit_factor(F.col("cents"), "zero"), 9).alias("pf")).where("n >= 30")


@query("k08_walk_forward_verdict", T + FOLDS + f", r AS (SELECT fold, {pf_sql('0.0')} >= 1 AS ok FROM f JOIN trades ON CAST(open_time AS DATE) >= train_end AND CAST(open_time AS DATE) < test_end WHERE test_end <= z GROUP BY 1 HAVING count(*) >= 30) SELECT count(*) AS folds, coalesce(count_if(ok), 0) AS passed, CASE WHEN count(*) = 0 THEN 'INSUFFICIENT' WHEN count_if(ok) * 6 >= count(*) * 5 THEN 'PASS' WHEN count_if(ok) * 2 >= count(*) THEN 'MARGINAL' ELSE 'FAIL' END AS verdict FROM r")
def k08(s, d):
    n, p = F.count(F.lit(1)), F.coalesce(F.count_if(F.col("pf") >= 1), F.lit(0))
    return k06(s, d).agg(n.alias("folds"), p.alias("passed"), F.when(n == 0, "INSUFFICIENT").when(p * 6 >= n * 5, "PASS").when(p * 2 >= n, "MARGINAL").otherwise("FAIL").alias("verdict"))


@query("k10_circular_shift", f"WITH {HOURS}, x AS (SELECT symbol, t, c, row_number() {ORD} - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n FROM hours) SELECT a.symbol, a.t, b.c AS shifted FROM x a JOIN x b ON a.symbol = b.symbol AND b.i = (a.i + 100) % a.n")
def k10(s, d):
    x = hours(s, d).withColumns({"i": F.row_number().over(W0()) - 1, "n": F.count(F.lit(1)).over(Window.partitionBy("symbol"))})
    b = x.select("symbol", F.col("i").alias("j"), F.col("c").alias("shifted"))
    return x.withColumn("j", (F.col("i") + 100) % F.col("n")).join(b, ["symbol", "j"]).select("symbol", "t", "shifted")


@query("k12_direction_flip", "SELECT trade_id, CASE WHEN NOT isnan(pnl_net) THEN round(-pnl_gross - (pnl_gross - pnl_net), 6) END AS flipped FROM tick_replay")
def k12(s, d):
    return table(s, d, "tick_replay").select("trade_id", R(-F.col("pnl_gross") - (F.col("pnl_gross") - guards.number("pnl_net"))).alias("flipped"))


SIGS = f"""WITH {HOURS}, {ATR14}, k AS (SELECT symbol, t, h, l, c, c + 0.3 * atr AS b, c - 0.3 * atr AS s FROM a WHERE atr > 0 AND hour(t) >= 7 AND hour(t) < 20),
 u AS (SELECT symbol, t, c, CASE WHEN h >= b THEN NULL ELSE b END AS b, CASE WHEN l <= s THEN NULL ELSE s END AS s FROM k), n AS (SELECT *, count(b) OVER (PARTITION BY symbol, CAST(t AS DATE) ORDER BY t) AS nb, count(s) OVER (PARTITION BY symbol, CAST(t AS DATE) ORDER BY t) AS ns FROM u),
 g AS (SELECT symbol, t, c, round(CASE WHEN nb = 1 THEN b END, 4) AS buy, round(CASE WHEN ns = 1 THEN s END, 4) AS sell FROM n WHERE (b IS NOT NULL AND nb = 1) OR (s IS NOT NULL AND ns = 1))"""
_DRAW = "md5(symbol || '|' || CAST(epoch_us(t) AS VARCHAR) || '|{}')"


@query("k13_relocated_signals", SIGS + f""", hr AS (SELECT symbol, CAST(t AS DATE) AS day, t, c, row_number() OVER (PARTITION BY symbol, CAST(t AS DATE) ORDER BY {_DRAW.format(42)}) AS i FROM hours),
 gr AS (SELECT *, row_number() OVER (PARTITION BY symbol, CAST(t AS DATE) ORDER BY {_DRAW.format(43)}) AS i FROM g) SELECT gr.symbol, hr.t, round(gr.buy + hr.c - gr.c, 4) AS buy, round(gr.sell + hr.c - gr.c, 4) AS sell FROM gr JOIN hr ON gr.symbol = hr.symbol AND CAST(gr.t AS DATE) = hr.day AND gr.i = hr.i""")
def k13(s, d):
    """Each signal moved to another bar of its symbol and day, its levels by the change of the close: both are put into a drawn order and met by rank, so that no signal is held against all bars."""
    day = Window.partitionBy("symbol", "day")
    rank = lambda seed: F.row_number().over(day.orderBy(guards.drawn(seed, F.col("symbol"), F.unix_micros("t"))))
    h = hours(s, d).select("symbol", F.to_date("t").alias("day"), "t", "c").withColumn("i", rank(42)).select("symbol", "day", "i", F.col("t").alias("rt"), F.col("c").alias("rc"))
    x = _signals(s, d).join(hours(s, d).select("symbol", "t", "c"), ["symbol", "t"]).withColumn("day", F.to_date("t")).withColumn("i", rank(43)).join(h, ["symbol", "day", "i"])
    move = F.col("rc") - F.col("c")
    return x.select("symbol", F.col("rt").alias("t"), R(F.col("buy") + move, 4).alias("buy"), R(F.col("sell") + move, 4).alias("sell"))


@query("k15_null_summary")
def k15(s, d):
    return V.null_summary(V.sign_null(_days(s, d), 500))


@query("k16_drawdown_monte_carlo")
def k16(s, d):
    """The real order's drawdown, and percentiles over 1000 random orders of single trades."""
    r = V.drawdown_replicates(trades(s, d), ["open_time", "log_id"], "cents", 1000, 100_000.0)
    p = lambda q: F.percentile(F.when(F.col("sim") > 0, F.col("max_dd")), F.lit(q))
    return r.agg(F.max(F.when(F.col("sim") == 0, F.col("max_dd"))).alias("real"), p(0.5).alias("p50"), p(0.95).alias("p95"), p(0.99).alias("p99"))


@query("k17_tiers", "WITH w AS (SELECT harvester, symbol, max(try_cast(profit_factor AS DOUBLE)) AS pf, max(try_cast(max_dd_pct AS DOUBLE)) AS dd, max(try_cast(total_trades AS BIGINT)) AS n FROM wave_results WHERE symbol IS NOT NULL GROUP BY 1, 2), k AS (SELECT *, coalesce(pf >= 1 AND dd <= 40 AND n > 0, false) AS ok, symbol <> 'EURUSD' AS test FROM w), g AS (SELECT harvester, count_if(test AND dd > 40) AS wiped, count_if(test AND NOT ok) AS failed, count_if(test AND ok) AS passed, count_if(NOT test AND ok) AS base FROM k GROUP BY 1) SELECT harvester, CASE WHEN wiped > 0 OR failed >= 2 THEN 'C' WHEN base > 0 AND failed = 0 THEN 'A' WHEN passed >= 2 THEN 'B' ELSE 'C' END AS tier FROM g")
def k17(s, d):
    w = table(s, d, "wave_results").where("symbol IS NOT NULL").groupBy("harvester", "symbol").agg(*(F.max(F.col(c).try_cast(t)).alias(n) for c, t, n in (("profit_factor", "double", "pf"), ("max_dd_pct", "double", "dd_pct"), ("total_trades", "bigint", "trades"))))
    return V.tier(w.withColumn("error", F.lit(None).cast("string")), ["harvester"], "EURUSD")


RANK = "rank() OVER (PARTITION BY book ORDER BY {0}) + (count(*) OVER (PARTITION BY book, {0}) - 1) / 2"


@query("k18_spearman", f"{T}, x AS (SELECT book, cents, epoch_ms(close_time) - epoch_ms(open_time) AS held FROM trades WHERE close_time IS NOT NULL), r AS (SELECT book, {RANK.format('cents')} AS a, {RANK.format('held')} AS b FROM x) SELECT book, round(corr(a, b), 9) AS rho FROM r GROUP BY 1 HAVING count(*) > 2")
def k18(s, d):
    x = trades(s, d).where("close_time IS NOT NULL").withColumn("held", F.unix_millis("close_time") - F.unix_millis("open_time"))
    n = x.groupBy("book").agg(F.count(F.lit(1)).alias("n"))
    return V.spearman(x, ["book"], "cents", "held").join(n, "book").where("n > 2").select("book", R(F.col("rho"), 9).alias("rho"))


@query("k18_ks_distance", T + ", g AS (SELECT strategy, cents, count_if(direction = 'long') AS p, count_if(direction <> 'long') AS q FROM trades WHERE direction IS NOT NULL AND strategy IS NOT NULL GROUP BY 1, 2), c AS (SELECT strategy, abs(sum(p) OVER w / nullif(sum(p) OVER (PARTITION BY strategy), 0) - sum(q) OVER w / nullif(sum(q) OVER (PARTITION BY strategy), 0)) AS d FROM g WINDOW w AS (PARTITION BY strategy ORDER BY cents ROWS UNBOUNDED PRECEDING)) SELECT strategy, round(max(d), 9) AS ks FROM c GROUP BY 1")
def k18b(s, d):
    x = trades(s, d).where("direction IS NOT NULL AND strategy IS NOT NULL")
    return V.ks_distance(x, ["strategy"], F.col("direction") == "long", "cents").select("strategy", R(F.col("ks"), 9).alias("ks"))


@query("k19_isotonic")
def k19(s, d):
    """Monotone map from in-sample to recovery figures of the reports."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import IsotonicRegression

    w = table(s, d, "wave_results").select("report_id", F.col("profit_factor").try_cast("double").alias("x"), F.col("recovery_factor").alias("label")).where("x BETWEEN 0 AND 20 AND label IS NOT NULL AND NOT isnan(label)")
    x = VectorAssembler(inputCols=["x"], outputCol="features").transform(w)
    return IsotonicRegression().fit(x).transform(x).select("report_id", "x", "prediction")


@query("k20_reference_check", f"WITH {HOURS}, a AS (SELECT t, c FROM hours WHERE symbol = 'view'), b AS (SELECT t, c FROM hours WHERE symbol = 'click'), x AS (SELECT abs(a.c - b.c) / b.c * 10000 AS bp, a.c AS p, b.c AS q FROM a JOIN b ON a.t = b.t) SELECT round(avg(bp), 6) AS mean, round(quantile_cont(bp, 0.5), 6) AS p50, round(quantile_cont(bp, 0.95), 6) AS p95, round(quantile_cont(bp, 0.99), 6) AS p99, round(max(bp), 6) AS top, round(corr(p, q), 9) AS rho FROM x")
def k20(s, d):
    h = hours(s, d)
    a, b = h.where("symbol = 'view'").select("t", F.col("c").alias("p")), h.where("symbol = 'click'").select("t", F.col("c").alias("q"))
    bp = F.abs(F.col("p") - F.col("q")) / F.col("q") * 10000
    pc = lambda v: R(F.percentile("bp", F.lit(v)))
    return a.join(b, "t").withColumn("bp", bp).agg(R(F.avg("bp")).alias("mean"), pc(0.5).alias("p50"), pc(0.95).alias("p95"), pc(0.99).alias("p99"), R(F.max("bp")).alias("top"), R(F.corr("p", "q"), 9).alias("rho"))


# -- learning ----------------------------------------------------------------------------------


def _learn(s, d):
    h = hours(s, d)
    c = F.col("c")
    x = h.withColumns({"ret1": c - F.lag("c").over(W0()), "ret5": c - F.lag("c", 5).over(W0()), "rng": F.col("h") - F.col("l"), "hour": F.hour("t").cast("double"), "vol": F.col("v").cast("double"), "label": F.coalesce(F.lead("c").over(W0()) > c, F.lit(False)).cast("double"), "pos": F.row_number().over(W0()), "n": F.count(F.lit(1)).over(Window.partitionBy("symbol"))})
    return x.dropna(subset=["ret1", "ret5"])


FEATURES = ["ret1", "ret5", "rng", "hour", "vol"]


def _fit(train, iterations: int = 5, features=FEATURES):
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    return Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="features"), GBTClassifier(maxIter=iterations, maxDepth=3, seed=42)]).fit(train)


def _scored(model, test):
    from pyspark.ml.functions import vector_to_array

    return model.transform(test).withColumn("prob", vector_to_array("probability")[1])


@query("l01_boosted_trees")
def l01(s, d):
    x = _learn(s, d)
    return _scored(_fit(x.where("pos <= n * 0.7 - 10")), x.where("pos > n * 0.7")).select("symbol", "t", "prob", "label")


@query("l03_expanding_folds", f"WITH {HOURS}, x AS (SELECT symbol, t, row_number() {ORD} AS pos, count(*) OVER (PARTITION BY symbol) AS n FROM hours), f AS (SELECT *, unnest(range(5)) AS fold FROM x) SELECT symbol, t, CAST(fold AS INTEGER) AS fold, CASE WHEN pos > n - (5 - fold) * (n // 7) AND pos <= n - (4 - fold) * (n // 7) THEN 'test' ELSE 'train' END AS part FROM f WHERE (pos > n - (5 - fold) * (n // 7) AND pos <= n - (4 - fold) * (n // 7)) OR pos <= n - (5 - fold) * (n // 7) - 10")
def l03(s, d):
    x = hours(s, d).select("symbol", "t", F.row_number().over(W0()).alias("pos"), F.count(F.lit(1)).over(Window.partitionBy("symbol")).alias("n")).withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(4))))
    size = F.expr("n div 7")
    start = F.col("n") - (5 - F.col("fold")) * size
    test = (F.col("pos") > start) & (F.col("pos") <= start + size)
    return x.where(test | (F.col("pos") <= start - 10)).select("symbol", "t", "fold", F.when(test, "test").otherwise("train").alias("part"))


@query("l05_auc", f"WITH {HOURS}, x AS (SELECT symbol, round((c - l) / nullif(h - l, 0), 6) AS p, CAST(coalesce(lead(c) {ORD} > c, false) AS INTEGER) AS y FROM hours), r AS (SELECT *, rank() OVER (PARTITION BY symbol ORDER BY p) + (count(*) OVER (PARTITION BY symbol, p) - 1) / 2 AS k FROM x WHERE p IS NOT NULL) SELECT symbol, round((sum(k) FILTER (y = 1) - count_if(y = 1) * (count_if(y = 1) + 1) / 2) / (count_if(y = 1) * count_if(y = 0)), 9) AS auc FROM r GROUP BY 1")
def l05(s, d):
    x = hours(s, d).select("symbol", R((F.col("c") - F.col("l")) / F.nullif(F.col("h") - F.col("l"), F.lit(0))).alias("p"), F.coalesce(F.lead("c").over(W0()) > F.col("c"), F.lit(False)).cast("int").alias("y"))
    return V.auc(x.where("p IS NOT NULL"), ["symbol"], "p", "y").select("symbol", R(F.col("auc"), 9).alias("auc"))


PURGE = 15
L06 = f"""WITH {HOURS}, x AS (SELECT symbol, t, row_number() {ORD} - 1 AS pos, count(*) OVER (PARTITION BY symbol) AS n FROM hours),
 g AS (SELECT *, pos * 8 // n AS grp FROM x), b AS (SELECT symbol, grp, min(pos) AS lo, max(pos) AS hi FROM g GROUP BY 1, 2),
 p AS (SELECT a.i AS a, b.i AS b FROM (SELECT unnest(range(8)) AS i) a, (SELECT unnest(range(8)) AS i) b WHERE a.i < b.i)
 SELECT g.symbol, p.a, p.b, count_if(grp IN (p.a, p.b)) AS test,
 count_if(grp NOT IN (p.a, p.b) AND NOT EXISTS (SELECT 1 FROM b WHERE b.symbol = g.symbol AND b.grp IN (p.a, p.b) AND g.pos BETWEEN b.lo - {PURGE} AND b.hi + {PURGE})) AS train
 FROM g, p GROUP BY 1, 2, 3"""


@query("l06_purged_paths", L06)
def l06(s, d):
    """Rows of test and of purged training in each of the 28 choices of two of eight groups (horizon 10, five more to each side)."""
    x = hours(s, d).select("symbol", "t")
    parts = V.purged_paths(x, ["symbol"], "t", 8, 2, PURGE)
    return parts.groupBy("symbol", F.col("tests")[0].alias("a"), F.col("tests")[1].alias("b")).agg(F.count_if(F.col("part") == "test").alias("test"), F.count_if(F.col("part") == "train").alias("train"))


@query("l09_importances")
def l09(s, d):
    imp = _fit(_learn(s, d)).stages[-1].featureImportances.toArray()
    return s.createDataFrame([(f, float(v)) for f, v in zip(FEATURES, imp)], "feature string, gain double")


@query("l12_null_edge")
def l12(s, d):
    """Area under the curve with true and with permuted labels, and the ratio of their edges."""
    from ..operators.labels import permuted

    x = _learn(s, d)
    real = V.auc(_scored(_fit(x.where("pos <= n * 0.7 - 10")), x.where("pos > n * 0.7")), [], "prob", "label")
    y = permuted(x.select("symbol", "t", "label", "pos", "n", *FEATURES), ["symbol"], "t", "label", 42)
    null = V.auc(_scored(_fit(y.where("pos <= n * 0.7 - 10")), y.where("pos > n * 0.7")), [], "prob", "label").withColumnRenamed("auc", "null_auc")
    both = real.withColumn("_k", F.lit(1)).join(null.withColumn("_k", F.lit(1)), "_k")
    return both.select("auc", "null_auc", ((F.col("auc") - 0.5) / F.nullif(F.col("null_auc") - 0.5, F.lit(0))).alias("edge_ratio"))


# -- reports -----------------------------------------------------------------------------------


@query("m03_clean_numbers", "SELECT report_id, try_cast(CASE WHEN regexp_full_match(x, '-?[0-9]+,[0-9]+') THEN replace(x, ',', '.') ELSE replace(x, ',', '') END AS DOUBLE) AS dd FROM (SELECT report_id, regexp_replace(max_dd_pct, '[\\s  %]', '', 'g') AS x FROM wave_results)")
def m03(s, d):
    return table(s, d, "wave_results").select("report_id", guards.clean_number(F.col("max_dd_pct")).alias("dd"))


@query("m04_decode_label", "SELECT report_id, try_cast(regexp_extract(label, 'h(\\d\\d)-(\\d\\d)', 1) AS INTEGER) AS h0, try_cast(regexp_extract(label, 'h(\\d\\d)-(\\d\\d)', 2) AS INTEGER) AS h1, try_cast(regexp_extract(label, '\\.v(\\d+)', 1) AS INTEGER) AS vt, try_cast(regexp_extract(label, '\\.l(\\d+)', 1) AS INTEGER) AS sl FROM wave_results WHERE label IS NOT NULL")
def m04(s, d):
    g = lambda p, i=1: F.regexp_extract("label", p, i).try_cast("int")
    return table(s, d, "wave_results").where("label IS NOT NULL").select("report_id", g(r"h(\d\d)-(\d\d)").alias("h0"), g(r"h(\d\d)-(\d\d)", 2).alias("h1"), g(r"\.v(\d+)").alias("vt"), g(r"\.l(\d+)").alias("sl"))


@query("m05_key_values", """WITH p AS (SELECT event_id, unnest(regexp_extract_all(props, '"(\\w+)": ("[^"]*"|[^,}]*)', 1)) AS key, unnest(regexp_extract_all(props, '"(\\w+)": ("[^"]*"|[^,}]*)', 2)) AS value FROM events WHERE props IS NOT NULL) SELECT event_id, key, trim(value, '"') AS value FROM p""")
def m05(s, d):
    """key: value pairs of a block of text as a map, here all the event properties, a row for each."""
    pairs = lambda i: F.regexp_extract_all("props", F.lit(r'"(\w+)": ("[^"]*"|[^,}]*)'), F.lit(i))
    e = table(s, d, "events").where("props IS NOT NULL").select("event_id", F.explode(F.map_from_arrays(pairs(1), pairs(2))))
    return e.select("event_id", "key", F.trim(F.col("value"), F.lit('"')).alias("value"))


@query("m06_strip_tags", "SELECT report_id, trim(regexp_replace(regexp_replace('<td> ' || label || ' </td>  <b>' || symbol || '</b>', '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g')) AS txt FROM wave_results")
def m06(s, d):
    html = F.concat(F.lit("<td> "), "label", F.lit(" </td>  <b>"), "symbol", F.lit("</b>"))
    return table(s, d, "wave_results").select("report_id", F.trim(F.regexp_replace(F.regexp_replace(html, "<[^>]*>", " "), r"\s+", " ")).alias("txt"))


@query("m07_print_number", "SELECT symbol, rtrim(rtrim(printf('%.6f', point), '0'), '.') AS txt, CASE WHEN always_open THEN 'true' ELSE 'false' END AS flag FROM instruments")
def m07(s, d):
    return table(s, d, "instruments").select("symbol", F.regexp_replace(F.regexp_replace(F.format_string("%.6f", "point"), "0+$", ""), r"\.$", "").alias("txt"), F.when(F.col("always_open"), "true").otherwise("false").alias("flag"))


@query("m08_to_json")
def m08(s, d):
    x = i09(s, d)
    return x.groupBy("book").agg(F.to_json(F.array_sort(F.collect_list(F.struct("rank", "depth", "peak_time", "trough_time", "recovery_time")))).alias("events"))


@query("m09_config_name", "SELECT report_id, concat_ws('_', wave, symbol, concat(CAST(CAST(session_start AS INTEGER) AS VARCHAR), '-', CAST(CAST(session_end AS INTEGER) AS VARCHAR))) AS name FROM wave_results WHERE session_start IS NOT NULL AND session_end IS NOT NULL")
def m09(s, d):
    i = lambda c: F.col(c).cast("int").cast("string")
    return table(s, d, "wave_results").where("session_start IS NOT NULL AND session_end IS NOT NULL").select("report_id", F.concat_ws("_", "wave", "symbol", F.concat(i("session_start"), F.lit("-"), i("session_end"))).alias("name"))
