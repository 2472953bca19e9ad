"""Bars, daily limits and kill switch over tick and trade streams."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def closed_bars(ticks: DataFrame, width: str = "5 minutes", late: str = "10 minutes", repeated: bool = True) -> DataFrame:
    """Bars (symbol, t, o, h, l, c, v) of a tick stream (symbol, ts, seq, pts); in append mode each is given once, when the watermark passes its end.

    With `repeated`, ticks that come again (same symbol, ts, seq) within the lateness are dropped; state is bounded by the watermark.
    """
    t = ticks.withWatermark("ts", late)
    if repeated:
        t = t.dropDuplicatesWithinWatermark(["symbol", "ts", "seq"])
    at = F.struct("ts", "seq")
    b = t.groupBy("symbol", F.window("ts", width).alias("w")).agg(F.min_by("pts", at).alias("o"), F.max("pts").alias("h"), F.min("pts").alias("l"), F.max_by("pts", at).alias("c"), F.count(F.lit(1)).alias("v"))
    return b.select("symbol", F.col("w.start").alias("t"), "o", "h", "l", "c", "v")


def with_static_asof(stream: DataFrame, other: DataFrame, ts: str, bucket: str = "hour") -> DataFrame:
    """Stream rows with `other_c` of a static series (t, c) for their bucket, 0 where it is missing."""
    o = other.select(F.date_trunc(bucket, "t").alias("_ot"), F.col("c").alias("other_c"))
    return stream.withColumn("_st", F.date_trunc(bucket, ts)).join(o, F.col("_st") == F.col("_ot"), "left").withColumn("other_c", F.coalesce("other_c", F.lit(0))).drop("_st", "_ot")


def limited_trades(trades: DataFrame, max_per_day: int, daily_loss: float) -> DataFrame:
    """Trades of a stream (book, log_id, open_time, pnl double) with `admitted`: a book stops for the day after max_per_day trades or a loss of daily_loss; a fall of four daily losses from the peak stops it for good.

    State per book (day, count, loss, equity, peak, latch) is kept in the state store and survives restarts by the query's checkpoint. Within a batch rows go by time.
    """
    out = "book string, log_id bigint, admitted boolean, equity double"
    state = "day bigint, n int, loss double, equity double, peak double, latch boolean"

    def run(key, frames: Iterator, st) -> Iterator:
        import pandas as pd

        pdf = pd.concat(list(frames)).sort_values(["open_time", "log_id"], kind="stable")
        day, n, loss, eq, peak, latch = st.get if st.exists else (-1, 0, 0.0, 0.0, 0.0, False)
        rows = []
        for r in pdf.itertuples():
            d = int(r.open_time.value // 86_400_000_000_000)
            if d != day:
                day, n, loss = d, 0, 0.0
            go = not latch and n < max_per_day and loss < daily_loss
            if go:
                n, eq, loss = n + 1, eq + r.pnl, loss + max(0.0, -r.pnl)
                peak = max(peak, eq)
                latch = peak - eq >= 4 * daily_loss
            rows.append((key[0], int(r.log_id), go, eq))
        st.update((day, n, loss, eq, peak, bool(latch)))
        if rows:
            yield pd.DataFrame(rows, columns=["book", "log_id", "admitted", "equity"])

    return trades.groupBy("book").applyInPandasWithState(run, out, state, "append", "NoTimeout")
