"""Ticks, bars and trade logs over the given tables, in both languages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import bars as B
from ..operators.metrics import equity
from ..session import table

SERIES = ["symbol"]


def ticks(spark, sf_dir) -> DataFrame:
    """events as ticks: symbol, ts, seq, pts (integer points)."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"), (110000 + F.round(F.col("value") * 100).cast("bigint") % 2001).alias("pts"))


TICKS = """ticks AS (SELECT event_type AS symbol, CAST(ts AS TIMESTAMP) AS ts, event_id AS seq,
  110000 + CAST(round(value * 100) AS BIGINT) % 2001 AS pts FROM events)"""


def hours(spark, sf_dir) -> DataFrame:
    """Hourly bars of the ticks: symbol, t, o, h, l, c (integer points as double), v."""
    b = B.ticks_to_bars(ticks(spark, sf_dir), SERIES, "ts", "seq", "pts", F.date_trunc("hour", "ts"))
    return b.select("symbol", "t", *(F.col(x).cast("double").alias(x) for x in "ohlc"), "v")


HOURS = (
    TICKS
    + """, hours AS (SELECT symbol, date_trunc('hour', ts) AS t, CAST(arg_min(pts, (ts, seq)) AS DOUBLE) AS o, CAST(max(pts) AS DOUBLE) AS h,
  CAST(min(pts) AS DOUBLE) AS l, CAST(arg_max(pts, (ts, seq)) AS DOUBLE) AS c, CAST(count(*) AS BIGINT) AS v FROM ticks GROUP BY 1, 2)"""
)


def fives(spark, sf_dir) -> DataFrame:
    """Five-minute bars of the ticks: symbol, t, o, h, l, c, v, as `hours`."""
    b = B.ticks_to_bars(ticks(spark, sf_dir), SERIES, "ts", "seq", "pts", F.window("ts", "5 minutes")["start"])
    return b.select("symbol", "t", *(F.col(x).cast("double").alias(x) for x in "ohlc"), "v")


FIVES = (
    TICKS
    + """, fives AS (SELECT symbol, time_bucket(INTERVAL 5 MINUTE, ts) AS t, CAST(arg_min(pts, (ts, seq)) AS DOUBLE) AS o, CAST(max(pts) AS DOUBLE) AS h,
  CAST(min(pts) AS DOUBLE) AS l, CAST(arg_max(pts, (ts, seq)) AS DOUBLE) AS c, CAST(count(*) AS BIGINT) AS v FROM ticks GROUP BY 1, 2)"""
)


def walk_hours(spark, sf_dir) -> DataFrame:
    """Hourly bars of a random walk made of the ticks (each moves the price by up to 100 points), so that prices trend, as in a market: symbol, t, o, h, l, c, v."""
    return _walk(spark, sf_dir, F.date_trunc("hour", "ts"))


def walk_fives(spark, sf_dir) -> DataFrame:
    """Five-minute bars of the same walk."""
    return _walk(spark, sf_dir, F.window("ts", "5 minutes")["start"])


def _walk(spark, sf_dir, bucket) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"), (F.round(F.col("value") * 100).cast("bigint") % 201 - 100).alias("step"))
    k = equity(e.where("symbol IS NOT NULL"), ["symbol"], ["ts", "seq"], "step").select("symbol", "ts", "seq", (110000 + F.col("equity")).alias("pts"))
    b = B.ticks_to_bars(k, SERIES, "ts", "seq", "pts", bucket)
    return b.select("symbol", "t", *(F.col(x).cast("double").alias(x) for x in "ohlc"), "v")


#: The same, as `hours`.
WALK = """ticks AS (SELECT event_type AS symbol, CAST(ts AS TIMESTAMP) AS ts, event_id AS seq,
  110000 + sum(CAST(round(value * 100) AS BIGINT) % 201 - 100) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS pts FROM events WHERE event_type IS NOT NULL),
  hours AS (SELECT symbol, date_trunc('hour', ts) AS t, CAST(arg_min(pts, (ts, seq)) AS DOUBLE) AS o, CAST(max(pts) AS DOUBLE) AS h,
  CAST(min(pts) AS DOUBLE) AS l, CAST(arg_max(pts, (ts, seq)) AS DOUBLE) AS c, CAST(count(*) AS BIGINT) AS v FROM ticks GROUP BY 1, 2)"""


def over(n: int | None = None, ahead: int = 0) -> Window:
    """The series' window in time order: the last n rows, or all before, to `ahead` rows on."""
    w = Window.partitionBy("symbol").orderBy("t")
    return w if n is None else w.rowsBetween(-(n - 1), ahead)


def trades(spark, sf_dir) -> DataFrame:
    """The trade log with pnl in whole cents: rows without open time or pnl are left out."""
    d = table(spark, sf_dir, "eur_dd_postmortem")
    return d.where("open_time IS NOT NULL AND pnl IS NOT NULL AND NOT isnan(pnl)").select("log_id", "book", "strategy", "bucket", "direction", "exit_reason", "open_time", "close_time", F.round(F.col("pnl") * 100).cast("bigint").alias("cents"))


TRADES = """trades AS (SELECT log_id, book, strategy, bucket, direction, exit_reason, open_time, close_time,
  CAST(round(pnl * 100) AS BIGINT) AS cents FROM eur_dd_postmortem WHERE open_time IS NOT NULL AND pnl IS NOT NULL AND NOT isnan(pnl))"""
W = "OVER (PARTITION BY symbol ORDER BY t ROWS BETWEEN {0} PRECEDING AND CURRENT ROW)"
ORD = "OVER (PARTITION BY symbol ORDER BY t)"


def w(n: int) -> str:
    return W.format(n - 1)
