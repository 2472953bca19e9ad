"""Sources and sinks read back, event calendar, walk-forward with a runner, grid search, audits, archetype signals, saved models and live streams."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..functions import indicators as I
from ..operators import audit
from ..operators import features as FE
from ..operators import grid_search as GS
from ..operators import metrics as M
from ..operators import validation as V
from ..session import scratch, table, written
from ..sources import readers, writers
from ..streaming import live
from .ref_more import _rows
from .ref_trades import FEATURES, T, _fit, _learn
from .ref_windows import TRS, W0, with_atr
from .streams import _drain
from .substrate import FIVES, HOURS, TICKS, fives, hours, ticks, trades, w

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


# -- sources and sinks, read back -----------------------------------------------------------------


def _shards(s, d):
    """Ticks with bid and ask in one folder of parquet files per day."""
    at = scratch(s, "shards")
    t = ticks(s, d).select(F.col("ts").alias("time"), (F.col("pts") - 5.0).alias("bid"), (F.col("pts") + 5.0).alias("ask"), F.lit(0.0).alias("last"), F.col("seq").alias("volume"), F.lit(6).alias("flags"), F.date_format("ts", "yyyyMMdd").alias("day"))
    writers.parquet(t, at, by=["day"])
    return at


@query("a03_shards", f"WITH {TICKS} SELECT CAST(ts AS DATE) AS day, count(*) AS n, CAST(sum(pts) AS DOUBLE) AS mids, CAST(count(*) * 10.0 AS DOUBLE) AS spreads FROM ticks GROUP BY 1")
def a03(s, d):
    """All shards by one glob; only the columns that are asked for are read."""
    t = readers.ticks(s, f"{_shards(s, d)}/day=*")
    return t.groupBy(F.to_date("time").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.sum("mid").alias("mids"), F.sum(F.col("spread").cast("double")).alias("spreads"))


def _csv(s, df, **kw):
    at = scratch(s, "csv")
    writers.csv(df, at, **kw)
    return at


@query("a04_csv", f"WITH {HOURS} SELECT t AS time, c, CAST(v AS DOUBLE) AS v FROM hours WHERE symbol = 'view'")
def a04(s, d):
    """A CSV whose time column is found by its name, headers in another case."""
    h = hours(s, d).where("symbol = 'view'").select(F.date_format("t", "yyyy.MM.dd HH:mm").alias("<DateTime>"), F.col("c").alias(" C "), F.col("v").alias("V"))
    return readers.csv(s, _csv(s, h)).select("time", "c", "v")


@query("a05_leg", f"WITH {HOURS} SELECT t AS time, c AS close FROM hours WHERE symbol = 'view'")
def a05(s, d):
    h = hours(s, d).where("symbol = 'view'").select(F.date_format("t", "yyyy-MM-dd HH:mm:ss").alias("time"), F.col("c").alias("close"))
    return readers.leg(s, _csv(s, h.unionByName(h)))


@query("a06_spread_series", f"WITH {HOURS} SELECT CAST(epoch(t) AS BIGINT) AS time, CAST(v AS INTEGER) AS spread_points, CAST(v / 4.0 AS FLOAT) AS spread_price FROM hours WHERE symbol = 'view'")
def a06(s, d):
    """The first file is not there, so the CSV is read."""
    h = hours(s, d).where("symbol = 'view'").select(F.unix_timestamp("t").alias("time"), F.col("v").alias("spread_points"), (F.col("v") / 4).alias("spread_price"))
    at = scratch(s, "spread") + ".csv"
    writers.csv(h, at)
    return readers.spread_series(s, scratch(s, "nothing") + ".parquet", at)


@query("a09_history", f"WITH {HOURS} SELECT symbol, t, c, v FROM hours")
def a09(s, d):
    """Ten-day chunks that overlap by two days, put together."""
    h = hours(s, d).select("symbol", "t", "c", "v")
    e = h.agg(F.to_date(F.min("t")).alias("a"), F.datediff(F.max("t"), F.min("t")).alias("n")).first()
    if e.a is None:
        return h
    day = lambda k: F.date_add(F.lit(e.a), k)
    return readers.history([h.where((F.col("t") >= day(10 * k)) & (F.col("t") < day(10 * k + 12))) for k in range(e.n // 10 + 1)], ["symbol", "t"])


@query("a10_trade_logs", "SELECT open_time, close_time, round(pnl, 5) AS pnl FROM eur_dd_postmortem WHERE open_time IS NOT NULL AND close_time IS NOT NULL AND pnl IS NOT NULL AND NOT isnan(pnl)")
def a10(s, d):
    f = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(c)
    t = table(s, d, "eur_dd_postmortem").where("open_time IS NOT NULL AND close_time IS NOT NULL AND pnl IS NOT NULL AND NOT isnan(pnl)").select(f("open_time"), f("close_time"), "pnl")
    return readers.trade_logs(s, _csv(s, t, compression="gzip")).select("open_time", "close_time", "pnl")


@query("a11_configs", "SELECT strategy AS id, CAST(count(*) AS VARCHAR) AS n FROM eur_dd_postmortem WHERE strategy IS NOT NULL GROUP BY 1")
def a11(s, d):
    """One JSON file per strategy, read as configurations."""
    at = scratch(s, "configs")
    t = table(s, d, "eur_dd_postmortem").where("strategy IS NOT NULL").groupBy("strategy").agg(F.count(F.lit(1)).cast("string").alias("n"))
    t.select(F.to_json(F.struct(F.col("strategy").alias("id"), F.create_map(F.lit("n"), F.col("n")).alias("params"))).alias("value"), "strategy").write.partitionBy("strategy").text(at)
    return readers.configs(s, f"{at}/strategy=*").select("id", F.col("params")["n"].alias("n"))


@query("a12_parquet", "SELECT book, log_id, pnl FROM eur_dd_postmortem WHERE book IS NOT NULL")
def a12(s, d):
    at = scratch(s, "parquet")
    writers.parquet(table(s, d, "eur_dd_postmortem").where("book IS NOT NULL").select("book", "log_id", "pnl"), at, by=["book"])
    return s.read.parquet(at).select("book", "log_id", "pnl")


@query("a13_csv_fixed", f"WITH {HOURS} SELECT symbol, strftime(t, '%Y-%m-%d %H') AS t, printf('%.5f', c / 7) AS x FROM hours")
def a13(s, d):
    h = hours(s, d).select("symbol", F.date_format("t", "yyyy-MM-dd HH").alias("t"), (F.col("c") / 7).alias("x"))
    return s.read.csv(_csv(s, h), header=True)


@query("a14_artifacts", "SELECT 'daily' AS name, count(*) AS n FROM (SELECT DISTINCT book, CAST(open_time AS DATE) FROM eur_dd_postmortem WHERE open_time IS NOT NULL AND pnl IS NOT NULL AND NOT isnan(pnl)) UNION ALL SELECT 'trades', count(*) FROM eur_dd_postmortem WHERE open_time IS NOT NULL AND pnl IS NOT NULL AND NOT isnan(pnl)")
def a14(s, d):
    at = scratch(s, "artifacts")
    t = trades(s, d)
    writers.artifacts({"daily": V.daily(t, ["book"], "open_time", "cents"), "trades": t.select("log_id", "cents")}, at)
    return s.read.csv(f"{at}/daily", header=True).agg(F.lit("daily").alias("name"), F.count(F.lit(1)).alias("n")).unionByName(s.read.csv(f"{at}/trades", header=True).agg(F.lit("trades").alias("name"), F.count(F.lit(1)).alias("n")))


@query("a15_ini", "SELECT symbol AS key, CAST(digits AS VARCHAR) AS value FROM instruments")
def a15(s, d):
    """A settings file (one small file, read by a terminal), written as UTF-16 and read back."""
    at = scratch(s, "ini")
    writers.ini(table(s, d, "instruments").select(F.col("symbol").alias("key"), F.col("digits").cast("string").alias("value")), at)
    text = readers.decode_report(s, f"{at}/*.csv").select(F.explode(F.split("text", r"\r?\n")).alias("x"))
    return text.where("x LIKE '%=%'").select(F.split_part("x", F.lit("="), F.lit(1)).alias("key"), F.split_part("x", F.lit("="), F.lit(2)).alias("value"))


# -- calendar -------------------------------------------------------------------------------------

_Y = "y AS (SELECT DISTINCT year(ts) AS y FROM events UNION SELECT 2026)"
_D = lambda xs, e, c, extra="": " UNION ALL ".join(f"SELECT TIMESTAMP '{x}:00'{extra} AS ts, '{c}' AS currency, '{e}' AS event" for x in xs)


@query("c12_event_calendar", f"""WITH {_Y}, m AS (SELECT make_date(CAST(y AS INTEGER), CAST(k AS INTEGER), 1) AS f, k, CASE WHEN k IN (1, 2, 11, 12) THEN 13 ELSE 12 END AS hh FROM y, (SELECT unnest(range(1, 13)) AS k))
 SELECT CAST(f + CAST((4 - (isodow(f) - 1) + 7) % 7 AS INTEGER) AS TIMESTAMP) + to_minutes(hh * 60 + 30) AS ts, 'USD' AS currency, 'NFP' AS event FROM m
 UNION ALL SELECT CAST(f + 12 AS TIMESTAMP) + to_minutes(hh * 60 + 30), 'USD', 'US_CPI' FROM m UNION ALL SELECT CAST(f + CASE WHEN k = 2 THEN 27 ELSE 29 END AS TIMESTAMP) + INTERVAL 9 HOUR, 'EUR', 'EU_CPI' FROM m
 UNION ALL {_D(cal.FED_2026, 'FOMC', 'USD')} UNION ALL {_D(cal.ECB_2026, 'ECB_RATE', 'EUR')} UNION ALL {_D(cal.ECB_2026, 'ECB_PRESSER', 'EUR', ' + INTERVAL 30 MINUTE')}""")
def c12b(s, d):
    """The generated calendar of the years in the events, and of 2026."""
    years = table(s, d, "events").select(F.year("ts").alias("year")).distinct().unionByName(s.range(1).select(F.lit(2026).alias("year"))).distinct()
    return cal.event_calendar(years)


# -- validation -----------------------------------------------------------------------------------


@query("k02_stationary_length")
def k02b(s, d):
    """Block length of each book's daily results by the correlogram; a book's days (one row each) are one task's work."""
    x = V.daily(trades(s, d).where("book IS NOT NULL"), ["book"], "open_time", "cents")

    def run(key, pdf):
        import pandas as pd

        v = pdf.sort_values("day")["pnl"].to_numpy(float)
        return pd.DataFrame([(key[0], len(v), V.stationary_block_length(v), V.block_length(len(v)))], columns=["book", "days", "length", "fallback"])

    return x.groupBy("book").applyInPandas(run, "book string, days bigint, length double, fallback int")


@query("k05_least_pf")
def k05b(s, d):
    """Each book's profit factor beside the least one that passes the deflated Sharpe test against 1, 10, 100, 1000 and 10000 trials at its trades, years and win rate."""
    t = trades(s, d).where("book IS NOT NULL").groupBy("book").agg(F.count_if(F.col("cents") != 0).alias("n"), F.avg(F.when(F.col("cents") != 0, (F.col("cents") > 0).cast("double"))).alias("win"), M.profit_factor(F.col("cents"), "capped").alias("pf"), ((F.max(F.unix_timestamp("open_time")) - F.min(F.unix_timestamp("open_time"))) / (365.25 * 86400)).alias("years"))
    t = t.where("n >= 30 AND win > 0 AND win < 1 AND years > 0").withColumn("trials", F.explode(F.array(*(F.lit(k) for k in (1, 10, 100, 1000, 10_000)))))

    def run(batches):
        for b in batches:
            b["least"] = [V.least_pf(int(r.trials), int(r.n), float(r.years), float(r.win)) for r in b.itertuples()]
            b["passed"] = b["pf"] >= b["least"]
            yield b[["book", "trials", "n", "pf", "least", "passed"]]

    return t.mapInPandas(run, "book string, trials int, n bigint, pf double, least double, passed boolean")


_F = T + """, e AS (SELECT CAST(min(open_time) AS DATE) AS a, CAST(max(open_time) AS DATE) + 1 AS z FROM trades), f AS (SELECT CAST(k AS INTEGER) AS fold, CAST(a + to_months(CAST(k * 3 AS INTEGER)) AS DATE) AS p, CAST(a + to_months(CAST(k * 3 + 9 AS INTEGER)) AS DATE) AS q, CAST(a + to_months(CAST(k * 3 + 12 AS INTEGER)) AS DATE) AS r, z FROM e, (SELECT unnest(range(0, 100)) AS k)),
 tr AS (SELECT fold, strategy, CAST(sum(cents) AS BIGINT) AS net, row_number() OVER (PARTITION BY fold ORDER BY sum(cents) DESC, strategy) AS k FROM f JOIN trades ON CAST(open_time AS DATE) >= p AND CAST(open_time AS DATE) < q WHERE r <= z AND strategy IS NOT NULL GROUP BY 1, 2)
 SELECT f.fold, t.strategy, count(*) AS n, CAST(sum(cents) AS BIGINT) AS net FROM tr JOIN f ON f.fold = tr.fold JOIN trades t ON t.strategy = tr.strategy AND CAST(open_time AS DATE) >= q AND CAST(open_time AS DATE) < r WHERE tr.k <= 3 GROUP BY 1, 2"""


@query("k07_walk_forward_runner", _F)
def k07(s, d):
    """A runner that picks three strategies by their training result and trades them in the test, over all folds."""
    def runner(train, test, fold):
        best = train.groupBy("strategy").agg(F.sum("cents").alias("net")).orderBy(F.desc("net"), "strategy").limit(3).select("strategy")
        return test.join(best, "strategy").groupBy("strategy").agg(F.count(F.lit(1)).alias("n"), F.sum("cents").alias("net"))

    return V.walk_forward(written(trades(s, d).where("strategy IS NOT NULL"), "log"), "open_time", 9, 3, 3, runner)


# -- learning -------------------------------------------------------------------------------------


@query("l10_grid")
def l10(s, d):
    """All 192 settings of the barrier labels over the 23 features, each with its best threshold."""
    x = _rows(s, d).select("symbol", "t", *FE.FEATURES)
    a = with_atr(s, d).where("atr > 0").withColumn("ahead", F.collect_list("c").over(W0().rowsBetween(1, max(GS.AHEAD)))).where(F.size("ahead") == max(GS.AHEAD)).select("symbol", "t", "c", "atr", "ahead")
    x = x.join(a, ["symbol", "t"]).withColumns({"pos": F.row_number().over(W0()), "n": F.count(F.lit(1)).over(Window.partitionBy("symbol"))})
    return GS.search(written(x, "grid-rows"), FE.FEATURES, 15.0)


@query("l14_streamed_scores")
def l14(s, d):
    """A model fitted on the first 70 per cent, saved, loaded again and run over the rest as a stream."""
    x = _learn(s, d)
    at, rest = scratch(s, "model"), scratch(s, "rest")
    _fit(x.where("pos <= n * 0.7 - 10"), 3).write().save(at)
    x.where("pos > n * 0.7").select("symbol", "t", *FEATURES).write.parquet(rest)
    stream = s.readStream.schema(s.read.parquet(rest).schema).parquet(rest)
    return _drain(live.scored(stream, at).select("symbol", "t", "prob"), "stream-scores")


# -- streams --------------------------------------------------------------------------------------


def _bar_stream(s, d):
    at = scratch(s, "bars")
    hours(s, d).write.parquet(at)
    return s.readStream.schema(s.read.parquet(at).schema).parquet(at)


@query("n02_live_features")
def n02(s, d):
    """Features of each closed bar from a buffer of 800 bars in the state store."""
    return _drain(live.live_features(_bar_stream(s, d)), "stream-features")


@query("n05_time_stops", f"WITH {HOURS}, o AS (SELECT symbol, t, row_number() OVER (PARTITION BY symbol ORDER BY t) AS i FROM hours) SELECT a.symbol, CAST(epoch(a.t) AS BIGINT) AS id, b.t FROM o a JOIN o b ON a.symbol = b.symbol AND b.i = a.i + 12 WHERE a.i % 7 = 0")
def n05(s, d):
    """Every seventh bar opens a position; twelve bars later it is told to close."""
    i = F.row_number().over(W0())
    e = hours(s, d).select("symbol", "t", i.alias("i"))
    ev = e.select("symbol", "t", F.lit("bar").alias("kind"), F.lit(0).cast("bigint").alias("id")).unionByName(e.where("i % 7 = 0").select("symbol", "t", F.lit("open").alias("kind"), F.unix_timestamp("t").alias("id")))
    at = scratch(s, "events")
    ev.write.parquet(at)
    stream = s.readStream.schema(s.read.parquet(at).schema).parquet(at)
    return _drain(live.time_stops(stream, 12), "stream-stops")


# -- audits and archetypes ------------------------------------------------------------------------


@query("x02_look_ahead_audit")
def x02(s, d):
    """How many rows of each feature change if the bars of the last third change: none may, but for the targets."""
    h = written(hours(s, d), "audit-bars")
    cut = h.agg(F.timestamp_seconds((F.min(F.unix_timestamp("t")) + 2 * F.max(F.unix_timestamp("t"))) / 3)).first()[0]
    other = h.where("symbol = 'view'").select("t", F.col("c").alias("other"))
    return audit.look_ahead(lambda x: FE.assemble(x, other), h, ["symbol"], "t", ["o", "h", "l", "c"], F.lit(cut))


@query("x03_permutation_z")
def x03(s, d):
    """The area under the curve against that of 20 permutations of the labels: z of at least 3 is an edge. Labels are dealt anew per symbol by seeded order."""
    p = hours(s, d).withColumns({"p": R((F.col("c") - F.col("l")) / F.nullif(F.col("h") - F.col("l"), F.lit(0))), "y": F.coalesce(F.lead("c").over(W0()) > F.col("c"), F.lit(False)).cast("int")}).where("p IS NOT NULL").select("symbol", "t", "p", "y")
    r = p.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(20))))
    key = Window.partitionBy("symbol", "rep")
    a = r.withColumn("_i", F.row_number().over(key.orderBy("t"))).drop("y")
    b = r.select("symbol", "rep", "y", F.row_number().over(key.orderBy(F.when(F.col("rep") == 0, 0).otherwise(F.xxhash64("t", "rep", F.lit(42))), "t")).alias("_i"))
    auc = V.auc(a.join(b, ["symbol", "rep", "_i"]), ["symbol", "rep"], "p", "y")
    null = F.when(F.col("rep") > 0, F.col("auc"))
    g = auc.groupBy("symbol").agg(F.max(F.when(F.col("rep") == 0, F.col("auc"))).alias("real"), F.avg(null).alias("mean"), F.stddev_samp(null).alias("sd"))
    return g.withColumn("z", (F.col("real") - F.col("mean")) / F.nullif(F.col("sd"), F.lit(0.0))).withColumn("passed", F.coalesce(F.col("z") >= 3, F.lit(False)))


_A20 = f"r AS (SELECT *, {TRS} AS tr FROM fives), a AS (SELECT *, CASE WHEN count(tr) {w(20)} >= 20 THEN round(avg(tr) {w(20)}, 6) END AS atr FROM r)"
_MIN = "hour(t) * 60 + minute(t)"


@query("x05_opening_drift", f"""WITH {FIVES}, {_A20}, d AS (SELECT symbol, CAST(t AS DATE) AS day, arg_min(o, t) FILTER ({_MIN} >= 810 AND {_MIN} < 870) AS o, arg_max(c, t) FILTER ({_MIN} >= 810 AND {_MIN} < 870) AS c, max(h) FILTER ({_MIN} >= 810 AND {_MIN} < 870) AS hi, min(l) FILTER ({_MIN} >= 810 AND {_MIN} < 870) AS lo,
 arg_max(atr, t) FILTER ({_MIN} >= 810 AND {_MIN} < 870) AS atr FROM a GROUP BY 1, 2)
 SELECT d.symbol, d.day, CASE WHEN d.c > d.o THEN 'short' ELSE 'long' END AS side, d.c - d.o AS drift, min(a.t) AS entry FROM d JOIN a ON a.symbol = d.symbol AND CAST(a.t AS DATE) = d.day WHERE abs(d.c - d.o) > 1.5 * d.atr AND {_MIN.replace('(t)', '(a.t)')} >= 900 AND {_MIN.replace('(t)', '(a.t)')} < 1020 AND a.c < d.hi AND a.c > d.lo GROUP BY ALL""")
def x05(s, d):
    """Fade of the opening drift (13:30 to 14:30): armed beyond one and a half average ranges, entered at the first close back inside the range from 15:00 to 17:00."""
    b = fives(s, d).withColumn("tr", I.true_range(W0(), seed=True)).withColumn("atr", R(I.sma(F.col("tr"), W0(), 20))).withColumns({"day": F.to_date("t"), "m": F.hour("t") * 60 + F.minute("t")})
    opening = F.when((F.col("m") >= 810) & (F.col("m") < 870), F.col("t"))
    seen = opening.isNotNull()
    g = b.groupBy("symbol", "day").agg(F.min_by("o", opening).alias("do"), F.max_by("c", opening).alias("dc"), F.max(F.when(seen, F.col("h"))).alias("hi"), F.min(F.when(seen, F.col("l"))).alias("lo"), F.max_by("atr", F.when(F.col("atr").isNotNull(), opening)).alias("da"))
    g = g.where(F.abs(F.col("dc") - F.col("do")) > 1.5 * F.col("da"))
    x = b.where("m >= 900 AND m < 1020").join(g, ["symbol", "day"]).where("c < hi AND c > lo")
    return x.groupBy("symbol", "day", F.when(F.col("dc") > F.col("do"), "short").otherwise("long").alias("side"), (F.col("dc") - F.col("do")).alias("drift")).agg(F.min("t").alias("entry"))


_X = f"""WITH {HOURS}, r AS (SELECT *, {TRS} AS tr FROM hours), a AS (SELECT symbol, t, CASE WHEN count(tr) {w(14)} >= 14 THEN round(avg(tr) {w(14)}, 6) END AS atr FROM r),
 p AS (SELECT symbol, t, atr, list(atr) FILTER (atr IS NOT NULL) {w(100)} AS xs FROM a), q AS (SELECT symbol, t, row_number() OVER (PARTITION BY symbol ORDER BY t) AS i, coalesce(len(xs) >= 100 AND len(list_filter(xs, lambda x: x <= atr)) * 5 < len(xs), false) AS low FROM p),
 g AS (SELECT *, i - coalesce(max(CASE WHEN NOT low THEN i END) OVER (PARTITION BY symbol ORDER BY t ROWS UNBOUNDED PRECEDING), 0) AS n FROM q) SELECT symbol, t, CAST(n AS INTEGER) AS n FROM g WHERE n >= 5"""


@query("x07_compression", _X)
def x07(s, d):
    """Bars at which the average range has been in the lowest fifth of its last 100 for five bars or more."""
    f = I.rows(W0(), 100)
    x = with_atr(s, d).withColumn("xs", F.collect_list("atr").over(f))
    low = (F.size("xs") >= 100) & (F.size(F.filter("xs", lambda v: v <= F.col("atr"))) * 5 < F.size("xs"))
    return I.run_length(x.select("symbol", "t", low.alias("low")), ["symbol"], "t", "low", "n").where("n >= 5").select("symbol", "t", "n")
