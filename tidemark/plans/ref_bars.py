"""Sources, cleaning, resampling, audits, calendar features and joins of bars."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..functions import guards
from ..functions import indicators as I
from ..operators import bars as B
from ..operators import joins as J
from ..session import table
from .substrate import HOURS, ORD, TICKS, hours, over, ticks, w

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


# -- scans -------------------------------------------------------------------------------------


@query("a01_projected_scan", "SELECT trade_id, entry_price, exit_price, (entry_price + exit_price) * 0.5 AS mid FROM tick_replay")
def a01(s, d):
    return table(s, d, "tick_replay").select("trade_id", "entry_price", "exit_price", ((F.col("entry_price") + F.col("exit_price")) * 0.5).alias("mid"))


@query("a02_sorted_scan", f"WITH {TICKS} SELECT symbol, ts, seq, pts, row_number() OVER (PARTITION BY symbol ORDER BY ts, seq) AS pos FROM ticks")
def a02(s, d):
    return ticks(s, d).withColumn("pos", F.row_number().over(Window.partitionBy("symbol").orderBy("ts", "seq")).cast("bigint"))


# -- cleaning and resampling -------------------------------------------------------------------


@query("b01_keep_first", f"WITH {TICKS} SELECT symbol, date_trunc('minute', ts) AS m, arg_min(seq, (ts, seq)) AS seq FROM ticks GROUP BY 1, 2")
def b01(s, d):
    return B.dedup(ticks(s, d).withColumn("m", F.date_trunc("minute", "ts")), ["symbol", "m"], ["ts", "seq"]).select("symbol", "m", "seq")


@query("b02_keep_last", f"WITH {TICKS} SELECT symbol, date_trunc('minute', ts) AS m, arg_max(seq, (ts, seq)) AS seq FROM ticks GROUP BY 1, 2")
def b02(s, d):
    return B.dedup(ticks(s, d).withColumn("m", F.date_trunc("minute", "ts")), ["symbol", "m"], ["ts", "seq"], "last").select("symbol", "m", "seq")


@query("b03_union_all", "SELECT trade_id AS id, symbol, CASE WHEN NOT isnan(pnl_net) THEN pnl_net END AS pnl, CAST(NULL AS VARCHAR) AS book FROM tick_replay UNION ALL SELECT log_id, NULL, CASE WHEN NOT isnan(pnl) THEN pnl END, book FROM eur_dd_postmortem")
def b03(s, d):
    return B.union_all(table(s, d, "tick_replay").select(F.col("trade_id").alias("id"), "symbol", guards.number("pnl_net").alias("pnl")), table(s, d, "eur_dd_postmortem").select(F.col("log_id").alias("id"), guards.number("pnl").alias("pnl"), "book"))


@query("b04_ticks_to_bars", f"""WITH {TICKS} SELECT symbol, time_bucket(INTERVAL 5 MINUTE, ts) AS t, arg_min(pts, (ts, seq)) AS o, max(pts) AS h, min(pts) AS l,
  arg_max(pts, (ts, seq)) AS c, count(*) AS v FROM ticks GROUP BY 1, 2""")
def b04(s, d):
    return B.ticks_to_bars(ticks(s, d), ["symbol"], "ts", "seq", "pts", F.window("ts", "5 minutes")["start"])


@query("b05_bars_to_bars", f"""WITH {HOURS} SELECT symbol, date_trunc('day', t) AS t, arg_min(o, t) AS o, max(h) AS h, min(l) AS l, arg_max(c, t) AS c, CAST(sum(v) AS BIGINT) AS v FROM hours GROUP BY 1, date_trunc('day', t)""")
def b05(s, d):
    return B.bars_to_bars(hours(s, d), ["symbol"], F.date_trunc("day", "t"))


@query("b06_last_with_gaps", f"""WITH {HOURS}, e AS (SELECT symbol, min(t) AS a, max(t) AS z FROM hours GROUP BY 1),
 g AS (SELECT symbol, unnest(generate_series(a, z, INTERVAL 1 HOUR)) AS t FROM e) SELECT g.symbol, g.t, h.c FROM g LEFT JOIN hours h ON g.symbol = h.symbol AND g.t = h.t""")
def b06(s, d):
    return B.last_with_gaps(hours(s, d), ["symbol"], "hour", "1 hour")


@query("b07_daily_median", f"WITH {HOURS} SELECT symbol, date_trunc('day', t) AS d, quantile_cont(h - l, 0.5) AS med, sum(v) * 1.0 AS vol FROM hours GROUP BY 1, 2")
def b07(s, d):
    return hours(s, d).groupBy("symbol", F.date_trunc("day", "t").alias("d")).agg(F.percentile(F.col("h") - F.col("l"), F.lit(0.5)).alias("med"), F.sum("v").cast("double").alias("vol"))


CLOSED = "(isodow(ts) = 6 OR (isodow(ts) = 5 AND hour(ts) >= 22) OR (isodow(ts) = 7 AND hour(ts) < 22))"


@query("b08_open_market", f"WITH {TICKS} SELECT seq, ts FROM ticks WHERE NOT {CLOSED}")
def b08(s, d):
    return B.open_market(ticks(s, d), "ts").select("seq", "ts")


@query("b09_price_bounds", f"WITH {TICKS} SELECT seq, pts FROM ticks WHERE pts > 110200 AND pts < 111800")
def b09(s, d):
    return ticks(s, d).where("pts > 110200 AND pts < 111800").select("seq", "pts")


VIOLATION = "(high < greatest(open, close, low) OR low > least(open, close, high) OR least(open, high, low, close) <= 0)"


@query("b10_ohlc_identity", f"SELECT bar_id FROM quality_audit WHERE {VIOLATION}")
def b10(s, d):
    return table(s, d, "quality_audit").where(B.ohlc_violation()).select("bar_id")


@query("b11_repeated_bars", "SELECT bar_id FROM (SELECT bar_id, time, count(*) OVER (PARTITION BY feed, symbol, time) AS n FROM quality_audit) WHERE n > 1 AND time IS NOT NULL")
def b11(s, d):
    return B.repeated(table(s, d, "quality_audit").where("time IS NOT NULL"), ["feed", "symbol", "time"]).select("bar_id")


@query("b12_zero_volume", "SELECT bar_id FROM quality_audit WHERE tick_volume = 0")
def b12(s, d):
    return table(s, d, "quality_audit").where("tick_volume = 0").select("bar_id")


@query("b13_saturday_bars", "SELECT bar_id FROM quality_audit WHERE isodow(received_at) = 6")
def b13(s, d):
    return table(s, d, "quality_audit").where(F.weekday("received_at") == 5).select("bar_id")


@query("b14_gap_kinds", f"""WITH {HOURS}, g AS (SELECT symbol, lag(t) {ORD} AS prev, t, (epoch(t) - epoch(lag(t) {ORD})) / 60 AS minutes FROM hours),
 k AS (SELECT *, CASE WHEN minutes = 60 THEN NULL WHEN minutes BETWEEN 2820 AND 3900 THEN NULL WHEN minutes = 55 THEN 'dst_spring_ok' WHEN minutes < 60 THEN 'backward_or_zero_delta' WHEN minutes > 120 THEN 'intraday_gap' END AS kind FROM g)
 SELECT symbol, prev, t, minutes, kind FROM k WHERE kind IS NOT NULL""")
def b14(s, d):
    return B.gaps(hours(s, d), ["symbol"], 60)


@query("b15_completeness", "SELECT feed, symbol, CAST(floor(date_diff('day', CAST(min(received_at) AS DATE), CAST(max(received_at) AS DATE)) * 5 / 7 * 288) AS BIGINT) AS expected, count(*) AS bars FROM quality_audit GROUP BY 1, 2")
def b15(s, d):
    q = table(s, d, "quality_audit").groupBy("feed", "symbol").agg(F.min("received_at").alias("a"), F.max("received_at").alias("z"), F.count(F.lit(1)).alias("bars"))
    return q.select("feed", "symbol", B.expected_bars(F.to_date("a"), F.to_date("z")).alias("expected"), "bars")


@query("b16_audit_summary", f"""SELECT feed, count(*) AS bars, count_if({VIOLATION}) AS ohlc_bad, count_if(tick_volume = 0) AS zero_volume, count_if(isodow(received_at) = 6) AS saturday,
 CASE WHEN count_if({VIOLATION}) = 0 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM quality_audit GROUP BY 1""")
def b16(s, d):
    bad = F.count_if(B.ohlc_violation())
    return table(s, d, "quality_audit").groupBy("feed").agg(F.count(F.lit(1)).alias("bars"), bad.alias("ohlc_bad"), F.count_if(F.col("tick_volume") == 0).alias("zero_volume"), F.count_if(F.weekday("received_at") == 5).alias("saturday"), F.when(bad == 0, "PASS").otherwise("FAIL").alias("verdict"))


@query("b17_tick_days", f"""WITH {TICKS}, g AS (SELECT symbol, ts, pts, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY symbol ORDER BY ts, seq)) AS gap FROM ticks)
 SELECT symbol, CAST(ts AS DATE) AS day, count(*) AS n, count_if(gap > 60000000) AS gaps, quantile_cont(pts, 0.05) AS p5, quantile_cont(pts, 0.5) AS p50, quantile_cont(pts, 0.95) AS p95, round(avg(pts), 6) AS mean FROM g GROUP BY 1, 2""")
def b17(s, d):
    gap = F.unix_micros("ts") - F.unix_micros(F.lag("ts").over(Window.partitionBy("symbol").orderBy("ts", "seq")))
    p = lambda x: F.percentile("pts", F.lit(x))
    return ticks(s, d).withColumn("gap", gap).groupBy("symbol", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("gap") > 60000000).alias("gaps"), p(0.05).alias("p5"), p(0.5).alias("p50"), p(0.95).alias("p95"), F.round(F.avg("pts"), 6).alias("mean"))


@query("b17_largest_gaps", f"""WITH {TICKS}, g AS (SELECT symbol, seq, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY symbol ORDER BY ts, seq)) AS gap FROM ticks) SELECT symbol, seq, gap FROM g WHERE gap IS NOT NULL ORDER BY gap DESC, seq LIMIT 10""")
def b17b(s, d):
    gap = F.unix_micros("ts") - F.unix_micros(F.lag("ts").over(Window.partitionBy("symbol").orderBy("ts", "seq")))
    return ticks(s, d).select("symbol", "seq", gap.alias("gap")).where("gap IS NOT NULL").orderBy(F.desc("gap"), "seq").limit(10)


@query("b18_spread_stats", """WITH m AS (SELECT symbol, quantile_cont(spread, 0.5) AS med FROM quality_audit GROUP BY 1) SELECT q.symbol, min(spread) AS lo, min(med) AS med, quantile_cont(spread, 0.95) AS p95, max(spread) AS hi,
 count(DISTINCT spread) AS kinds, count_if(spread <> med) / count(spread) AS off FROM quality_audit q JOIN m USING (symbol) GROUP BY 1""")
def b18(s, d):
    q = table(s, d, "quality_audit").select("symbol", "spread")
    m = q.groupBy("symbol").agg(F.percentile("spread", F.lit(0.5)).alias("med"))
    return q.join(m, "symbol").groupBy("symbol").agg(F.min("spread").alias("lo"), F.min("med").alias("med"), F.percentile("spread", F.lit(0.95)).alias("p95"), F.max("spread").alias("hi"), F.count_distinct("spread").alias("kinds"), (F.count_if(F.col("spread") != F.col("med")) / F.count("spread")).alias("off"))


@query("b19_half_even", "SELECT log_id, round_even(pnl, 1) AS r FROM eur_dd_postmortem WHERE pnl IS NOT NULL AND NOT isnan(pnl)")
def b19(s, d):
    return table(s, d, "eur_dd_postmortem").where("pnl IS NOT NULL AND NOT isnan(pnl)").select("log_id", F.bround("pnl", 1).alias("r"))


# -- calendar ----------------------------------------------------------------------------------


@query("c01_sessions", f"""WITH {TICKS} SELECT seq, CAST(hour(ts) >= 22 OR hour(ts) < 7 AS INTEGER) AS asia, CAST(hour(ts) >= 7 AND hour(ts) < 12 AS INTEGER) AS london,
 CAST(hour(ts) >= 12 AND hour(ts) < 16 AS INTEGER) AS overlap, CAST(hour(ts) >= 16 AND hour(ts) < 22 AS INTEGER) AS ny FROM ticks""")
def c01(s, d):
    return ticks(s, d).select("seq", *(c.cast("int").alias(n) for n, c in cal.sessions(F.col("ts")).items()))


@query("c02_clock_features", f"""WITH {TICKS} SELECT seq, CAST((hour(ts) - 7 + 24) % 24 * 60 + minute(ts) AS INTEGER) AS since_london, CAST((16 - hour(ts) + 24) % 24 * 60 - minute(ts) AS INTEGER) AS to_fix,
 (hour(ts) * 60 + minute(ts)) BETWEEN 955 AND 965 AS near_fix, CAST(isodow(ts) - 1 AS INTEGER) AS dow FROM ticks""")
def c02(s, d):
    t = F.col("ts")
    return ticks(s, d).select("seq", cal.since_london_open(t).alias("since_london"), cal.to_ny_fix(t).alias("to_fix"), cal.near_ny_fix(t).alias("near_fix"), F.weekday(t).alias("dow"))


@query("c05_session_filter", "SELECT report_id, CASE WHEN session_end <= session_start THEN hour(harvested_at) >= session_start OR hour(harvested_at) < session_end ELSE hour(harvested_at) >= session_start AND hour(harvested_at) < session_end END AS inside FROM wave_results")
def c05(s, d):
    return table(s, d, "wave_results").select("report_id", cal.in_session(F.col("harvested_at"), F.col("session_start"), F.col("session_end")).alias("inside"))


@query("c07_session_bucket", """SELECT report_id, CASE concat(CAST(CAST(session_start AS INTEGER) AS VARCHAR), '-', CAST(CAST(session_end AS INTEGER) AS VARCHAR)) WHEN '7-12' THEN 'London' WHEN '13-17' THEN 'NY' WHEN '13-20' THEN 'NY'
 WHEN '22-7' THEN 'Asian' WHEN '0-24' THEN 'FullDay' WHEN '20-22' THEN 'LateNY' ELSE 'Other' END AS bucket FROM wave_results WHERE session_start IS NOT NULL AND session_end IS NOT NULL""")
def c07(s, d):
    return table(s, d, "wave_results").where("session_start IS NOT NULL AND session_end IS NOT NULL").select("report_id", cal.session_bucket(F.col("session_start").cast("int"), F.col("session_end").cast("int")).alias("bucket"))


M = "(hour(ts) * 60 + minute(ts))"


@query("c08_fix_features", f"""WITH {TICKS} SELECT seq, CAST(greatest(-240, least(240, 960 - {M})) AS INTEGER) AS dist, CAST({M} >= 900 AND {M} < 960 AS INTEGER) AS pre, CAST({M} >= 960 AND {M} < 1020 AS INTEGER) AS post,
 CAST(day(ts) >= 28 AS INTEGER) AS month_end, CAST(day(ts) >= 28 AND month(ts) % 3 = 0 AS INTEGER) AS quarter_end, CAST(day(ts) >= 28 AND month(ts) = 12 AS INTEGER) AS year_end FROM ticks""")
def c08(s, d):
    return ticks(s, d).select("seq", *(c.alias(n) for n, c in cal.fix_features(F.col("ts")).items()))


@query("c09_rule_blackout", f"""WITH {TICKS} SELECT seq FROM ticks WHERE NOT ((isodow(ts) = 5 AND day(ts) <= 7 AND {M} BETWEEN 780 AND 855) OR (isodow(ts) = 4 AND {M} >= 720 AND {M} < 840)
 OR (isodow(ts) = 3 AND day(ts) + 7 > day(last_day(ts)) AND {M} >= 1080 AND {M} < 1200) OR {M} BETWEEN 945 AND 975 OR ({M} >= 1200 AND {M} < 1320))""")
def c09(s, d):
    return ticks(s, d).where(~cal.rule_blackout(F.col("ts"))).select("seq")


@query("c12_payroll_calendar", """SELECT CAST(m AS DATE) AS month, CAST(m + to_days(CAST((4 - (isodow(m) - 1) + 7) % 7 AS INTEGER)) AS DATE) AS payrolls FROM (SELECT unnest(generate_series(
 (SELECT date_trunc('month', min(ts)) FROM events), (SELECT date_trunc('month', max(ts)) FROM events), INTERVAL 1 MONTH)) AS m)""")
def c12(s, d):
    e = table(s, d, "events").agg(F.to_date(F.date_trunc("month", F.min("ts"))).alias("a"), F.to_date(F.date_trunc("month", F.max("ts"))).alias("z"))
    m = e.select(F.explode(F.expr("sequence(a, z, interval 1 month)")).alias("month"))
    return m.select("month", cal.first_friday(F.col("month")).alias("payrolls"))


@query("c14_date_slice", "SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1997-01-01'")
def c14(s, d):
    return table(s, d, "orders").where("o_orderdate >= timestamp_ntz'1996-01-01' AND o_orderdate < timestamp_ntz'1997-01-01'").select("o_orderkey")


@query("c15_pips", "SELECT trade_id, round((exit_price - entry_price) / CASE WHEN digits <= 3 THEN 0.01 ELSE 0.0001 END, 6) AS pips FROM tick_replay JOIN instruments USING (symbol)")
def c15(s, d):
    t = table(s, d, "tick_replay").join(table(s, d, "instruments"), "symbol")
    return t.select("trade_id", F.round(guards.pips(F.col("exit_price") - F.col("entry_price"), F.col("digits")), 6).alias("pips"))


# The dollar index's weights and constant.
DXY = {"EURUSD": -0.576, "USDJPY": 0.136, "GBPUSD": -0.119, "USDCAD": 0.091, "USDSEK": 0.042, "USDCHF": 0.036}
DXY_CONSTANT = 50.14348112


@query("c16_dollar_index", "WITH l AS (SELECT feed, symbol, avg(close) AS c FROM quality_audit WHERE close > 0 GROUP BY 1, 2), p AS (SELECT feed, " + ", ".join(f"max(c) FILTER (symbol = '{k}') AS {k}" for k in DXY) + f" FROM l GROUP BY 1) SELECT feed, round(exp(ln({DXY_CONSTANT})" + "".join(f" + {v} * ln({k})" for k, v in DXY.items()) + "), 6) AS dxy FROM p")
def c16(s, d):
    legs = table(s, d, "quality_audit").where("close > 0").groupBy("feed").pivot("symbol", list(DXY)).agg(F.avg("close"))
    return legs.select("feed", F.round(guards.basket_index(DXY, DXY_CONSTANT), 6).alias("dxy"))


@query("c18_guards", "SELECT trade_id, CASE WHEN abs(pnl_gross) < 1e-12 THEN 0.0 ELSE pnl_net / pnl_gross END AS ratio, round(CASE WHEN entry_price < 1e-12 THEN 0.0 ELSE ln(entry_price) END, 9) AS lg FROM tick_replay")
def c18(s, d):
    return table(s, d, "tick_replay").select("trade_id", guards.safe_div(F.col("pnl_net"), F.col("pnl_gross")).alias("ratio"), F.round(guards.safe_log(F.col("entry_price")), 9).alias("lg"))


_FNV = "CAST(list_reduce(list_prepend(2166136261::HUGEINT, list_transform(string_split(symbol, ''), lambda each: ascii(each)::HUGEINT)), lambda h, x: (xor(h, x) * 16777619::HUGEINT) % 4294967296::HUGEINT) AS BIGINT)"


@query("c20_symbol_hash", f"SELECT symbol, {_FNV} AS hash, 770000 + {_FNV} % 1000 AS magic FROM instruments")
def c20(s, d):
    return table(s, d, "instruments").select("symbol", guards.fnv1a32(F.col("symbol")).alias("hash"), (F.lit(770000) + guards.fnv1a32(F.col("symbol")) % 1000).alias("magic"))


# -- joins -------------------------------------------------------------------------------------

PAIR = "a AS (SELECT t, c FROM hours WHERE symbol = 'view'), b AS (SELECT t, c FROM hours WHERE symbol = 'click')"


def _pair(s, d):
    h = hours(s, d)
    return h.where("symbol = 'view'").select("t", "c"), h.where("symbol = 'click'").select("t", F.col("c").alias("c2"))


@query("d01_same_time", f"WITH {HOURS}, {PAIR} SELECT a.t, a.c AS c, b.c AS c2 FROM a JOIN b ON a.t = b.t")
def d01(s, d):
    a, b = _pair(s, d)
    return a.join(b, "t")


@query("d02_compare", f"WITH {HOURS}, {PAIR} SELECT avg(abs(a.c - b.c)) AS mean, quantile_cont(abs(a.c - b.c), 0.5) AS med, quantile_cont(abs(a.c - b.c), 0.95) AS p95 FROM a JOIN b ON a.t = b.t")
def d02(s, d):
    a, b = _pair(s, d)
    x = F.abs(F.col("c") - F.col("c2"))
    return a.join(b, "t").agg(F.avg(x).alias("mean"), F.percentile(x, F.lit(0.5)).alias("med"), F.percentile(x, F.lit(0.95)).alias("p95"))


@query("d03_shift_search", f"""WITH {HOURS}, {PAIR}, s AS (SELECT unnest(range(-3, 4)) AS shift), m AS (SELECT CAST(shift AS INTEGER) AS shift, quantile_cont(abs(a.c - b.c), 0.5) AS med, count(*) AS n FROM s, a JOIN b ON b.t = a.t + to_hours(shift) GROUP BY 1)
 SELECT shift, med, n, row_number() OVER (ORDER BY med, shift) = 1 AS best FROM m""")
def d03(s, d):
    a, b = _pair(s, d)
    a = a.withColumn("shift", F.explode(F.sequence(F.lit(-3), F.lit(3)))).withColumn("t", F.expr("t + make_dt_interval(0, shift)"))
    m = a.join(b, "t").groupBy("shift").agg(F.percentile(F.abs(F.col("c") - F.col("c2")), F.lit(0.5)).alias("med"), F.count(F.lit(1)).alias("n"))
    return m.withColumn("best", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("med", "shift")) == 1)  # seven rows


@query("d04_asof", f"""WITH {TICKS}, r AS (SELECT symbol, ts, seq, pts FROM ticks WHERE seq % 3 = 0), l AS (SELECT symbol, ts AS lt, seq AS id FROM ticks WHERE seq % 3 <> 0)
 SELECT l.id, r.pts AS seen FROM l ASOF LEFT JOIN r ON l.symbol = r.symbol AND l.lt >= r.ts""")
def d04(s, d):
    t = ticks(s, d)
    left = t.where("seq % 3 <> 0").select("symbol", F.col("ts").alias("lt"), F.col("seq").alias("id"))
    return J.asof_backward(left, t.where("seq % 3 = 0").withColumn("seen", F.col("pts")), ["symbol"], "lt", "ts", ["seen"], "seq").select("id", "seen")


@query("d05_limited_fill", f"""WITH {HOURS}, x AS (SELECT symbol, t, CASE WHEN v % 3 = 0 THEN c END AS c FROM hours), f AS (SELECT symbol, t, c, last_value(c IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY t ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS filled FROM x)
 SELECT symbol, t, filled, c IS NULL AND filled IS NOT NULL AS stale FROM f""")
def d05(s, d):
    h = hours(s, d).withColumn("c", F.when(F.col("v") % 3 == 0, F.col("c")))
    return J.carry_rows(h, ["symbol"], "t", "c", 3).select("symbol", "t", "filled", "stale")


@query("d06_lookup_fallback", "SELECT trade_id, coalesce(spread_at_fill, point * 10) AS spread FROM tick_replay LEFT JOIN instruments USING (symbol)")
def d06(s, d):
    return table(s, d, "tick_replay").join(table(s, d, "instruments"), "symbol", "left").select("trade_id", F.coalesce("spread_at_fill", F.col("point") * 10).alias("spread"))


@query("d07_rows_in_bars", f"""WITH {HOURS}, b AS (SELECT symbol, t AS bar_t, coalesce(lead(t) {ORD}, t + INTERVAL 1 HOUR) AS bar_end FROM hours)
 SELECT k.seq, b.bar_t FROM ticks k JOIN b ON k.symbol = b.symbol AND k.ts >= b.bar_t AND k.ts < b.bar_end""")
def d07(s, d):
    return J.within_bars(hours(s, d), ticks(s, d), ["symbol"], "t", "ts", 3600).select("seq", "bar_t")


@query("d08_positional", f"WITH {HOURS}, p AS (SELECT symbol, t, CAST((row_number() {ORD} - 1) // 5 AS BIGINT) AS parent FROM hours), g AS (SELECT symbol, parent, min(t) AS first, max(t) AS last, count(*) AS n FROM p GROUP BY 1, 2) SELECT p.symbol, p.t, p.parent, g.first, g.last, g.n FROM p JOIN g ON p.symbol = g.symbol AND p.parent = g.parent")
def d08(s, d):
    """Every five rows of a series stand for one coarser bar: each row with its parent's number and reach."""
    p = I.with_position(hours(s, d).select("symbol", "t"), ["symbol"], "t").select("symbol", "t", F.expr("_p div 5").alias("parent"))
    g = p.groupBy("symbol", "parent").agg(F.min("t").alias("first"), F.max("t").alias("last"), F.count(F.lit(1)).alias("n"))
    return p.join(g, ["symbol", "parent"]).select("symbol", "t", "parent", "first", "last", "n")


NEWS = "n AS (SELECT o_orderdate + INTERVAL 28 YEAR AS e FROM orders WHERE o_orderpriority = '1-URGENT')"
BLACK = f"WITH {TICKS}, n AS (SELECT DISTINCT date_trunc('day', ts) + INTERVAL 750 MINUTE AS e FROM ticks) SELECT seq FROM ticks WHERE "


def _news(t):
    return t.select((F.date_trunc("day", "ts") + F.expr("interval 750 minutes")).alias("e")).distinct()


@query("d10_in_blackout", BLACK + "EXISTS (SELECT 1 FROM n WHERE ts BETWEEN e - INTERVAL 15 MINUTE AND e + INTERVAL 30 MINUTE)")
def d10(s, d):
    t = ticks(s, d)
    return J.near_event(t, _news(t), "ts", "e", 900, 1800).select("seq")


@query("d11_outside_blackout", BLACK + "NOT EXISTS (SELECT 1 FROM n WHERE ts BETWEEN e - INTERVAL 15 MINUTE AND e + INTERVAL 30 MINUTE)")
def d11(s, d):
    t = ticks(s, d)
    return J.near_event(t, _news(t), "ts", "e", 900, 1800, keep=False).select("seq")


@query("d12_daily_gate", f"""WITH {HOURS}, g AS (SELECT symbol, CAST(t AS DATE) AS day, quantile_cont(h - l, 0.5) AS med FROM hours GROUP BY 1, 2) SELECT k.seq FROM ticks k LEFT JOIN g ON k.symbol = g.symbol AND CAST(k.ts AS DATE) = g.day WHERE coalesce(med, 0) >= 600""")
def d12(s, d):
    g = hours(s, d).groupBy("symbol", F.to_date("t").alias("day")).agg(F.percentile(F.col("h") - F.col("l"), F.lit(0.5)).alias("med"))
    return ticks(s, d).withColumn("day", F.to_date("ts")).join(g, ["symbol", "day"], "left").where(F.coalesce("med", F.lit(0)) >= 600).select("seq")


@query("d14_entry_exit_clock", f"WITH {HOURS} SELECT e.symbol, CAST(e.t AS DATE) AS day, e.o AS entry, x.o AS exit FROM hours e JOIN hours x ON e.symbol = x.symbol AND CAST(e.t AS DATE) = CAST(x.t AS DATE) WHERE hour(e.t) = 8 AND hour(x.t) = 16")
def d14(s, d):
    at = lambda h, n: hours(s, d).where(F.hour("t") == h).select("symbol", F.to_date("t").alias("day"), F.col("o").alias(n))
    return at(8, "entry").join(at(16, "exit"), ["symbol", "day"])


@query("d15_concurrency", """WITH i AS (SELECT log_id, book, open_time AS o, close_time AS c FROM eur_dd_postmortem WHERE close_time > open_time)
 SELECT a.log_id, CAST(count(*) AS BIGINT) AS concurrent FROM i a JOIN i b ON a.book = b.book AND b.o <= a.o AND b.c > a.o GROUP BY 1""")
def d15(s, d):
    return J.concurrency(table(s, d, "eur_dd_postmortem").where("book IS NOT NULL"), ["book"], "open_time", "close_time", "log_id").select("log_id", "concurrent")


@query("d16_outer_dates", f"""WITH {HOURS}, p AS (SELECT CAST(t AS DATE) AS day, symbol, sum(c - o) AS x FROM hours GROUP BY 1, 2) SELECT day, coalesce(max(x) FILTER (symbol = 'view'), 0) AS a, coalesce(max(x) FILTER (symbol = 'click'), 0) AS b FROM p GROUP BY 1""")
def d16(s, d):
    p = hours(s, d).withColumn("x", F.col("c") - F.col("o")).groupBy(F.to_date("t").alias("day")).pivot("symbol", ["view", "click"]).agg(F.sum("x")).na.fill(0.0)
    return p.select("day", F.col("view").alias("a"), F.col("click").alias("b"))


@query("d18_grid", "SELECT w.report_id, g AS gate, w.total_net_profit > g AS ok FROM wave_results w, (SELECT unnest([0, 100, 200, 400]) AS g)")
def d18(s, d):
    return table(s, d, "wave_results").select("report_id", "total_net_profit", F.explode(F.array(*(F.lit(g) for g in (0, 100, 200, 400)))).alias("gate")).select("report_id", "gate", (F.col("total_net_profit") > F.col("gate")).alias("ok"))


@query("d19_shared_days", """WITH x AS (SELECT DISTINCT strategy, CAST(open_time AS DATE) AS day FROM eur_dd_postmortem WHERE open_time IS NOT NULL AND strategy IS NOT NULL)
 SELECT a.strategy AS a, b.strategy AS b, count(*) AS days FROM x a JOIN x b ON a.day = b.day AND a.strategy < b.strategy GROUP BY 1, 2""")
def d19(s, d):
    x = table(s, d, "eur_dd_postmortem").where("open_time IS NOT NULL AND strategy IS NOT NULL").select("strategy", F.to_date("open_time").alias("day")).distinct()
    y = x.select(F.col("strategy").alias("b"), "day")
    return x.join(y, "day").where("strategy < b").groupBy(F.col("strategy").alias("a"), "b").agg(F.count(F.lit(1)).alias("days"))
