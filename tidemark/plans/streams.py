"""Streaming queries, run to the end of the given tables (trigger available-now)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import configure, scratch, table
from ..streaming import bars as SB
from .substrate import HOURS, TICKS, trades

QUERIES, SQL = {}, {}


def _source(s, d, name: str) -> DataFrame:
    configure(s)
    return s.readStream.schema(table(s, d, name).schema).parquet(f"{d}/{name}.parquet*")


def _drain(stream: DataFrame, what: str) -> DataFrame:
    """Run an append query to its end into a table in the shared folder."""
    out, at = scratch(stream.sparkSession, what), scratch(stream.sparkSession, f"{what}-state")
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", at).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)


def _ticks(s, d):
    e = _source(s, d, "events")
    return e.select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"), (110000 + F.round(F.col("value") * 100).cast("bigint") % 2001).alias("pts"))


def n01_closed_bars(s, d):
    """Bars that are closed: all whose end lies ten minutes or more before the last tick."""
    return _drain(SB.closed_bars(_ticks(s, d)), "stream-bars")


SQL["n01_closed_bars"] = f"""WITH {TICKS}, z AS (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 10 MINUTE AS z FROM ticks) SELECT symbol, time_bucket(INTERVAL 5 MINUTE, ts) AS t, arg_min(pts, (ts, seq)) AS o, max(pts) AS h, min(pts) AS l,
 arg_max(pts, (ts, seq)) AS c, count(*) AS v FROM ticks, z GROUP BY 1, 2, z HAVING time_bucket(INTERVAL 5 MINUTE, ts) + INTERVAL 5 MINUTE <= z"""


def n03_limited_trades(s, d):
    """Daily limits and kill switch with persisted state over the trade log as a stream."""
    t = _source(s, d, "eur_dd_postmortem").where("open_time IS NOT NULL AND pnl IS NOT NULL AND NOT isnan(pnl) AND book IS NOT NULL").select("book", "log_id", "open_time", "pnl")
    return _drain(SB.limited_trades(t, 5, 50.0), "stream-trades")


def n06_static_fallback(s, d):
    """Ticks with the hourly close of another symbol, 0 where there is none."""
    from .substrate import hours

    other = hours(s, d).where("symbol = 'view'").select("t", "c")
    return _drain(SB.with_static_asof(_ticks(s, d), other, "ts").select("seq", "other_c"), "stream-asof")


SQL["n06_static_fallback"] = f"WITH {HOURS} SELECT k.seq, coalesce(h.c, 0) AS other_c FROM ticks k LEFT JOIN hours h ON h.symbol = 'view' AND h.t = date_trunc('hour', k.ts)"
QUERIES |= {f.__name__: f for f in (n01_closed_bars, n03_limited_trades, n06_static_fallback)}
