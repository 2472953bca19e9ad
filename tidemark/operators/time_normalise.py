"""Mixed time spellings, units and zones -> one UTC millisecond value per row.

Two ways to the same values:

* `TimeDictionary`: distinct (form, raw, zone, date order) values are parsed once, kept in a table
  that grows by the values not seen before, and joined back to the rows. It pays where values repeat
  (loads that come again, many sources stamped alike).
* `with_utc_ms`: the same expressions inline, for operators that need the time of each row once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.timeparse import ZONED, epoch_ms, fence, parse_stamps, pick_instant, resolve_walls
from ..session import scratch

KEYS = ["form", "raw", "zone", "date_order"]


def _keyed(df: DataFrame, form: str, raw: Column, zone: Column, order: Column) -> DataFrame:
    """Add the dictionary key `_d_*`: zone and order only where the value depends on them, so that zoned text is kept once for all sources."""
    text = raw.cast("string")
    if form == "text":
        bare = ~F.upper(F.trim(text)).rlike(ZONED)
        zone, order = F.when(bare, zone), F.when(bare & F.trim(text).rlike(r"^\d\d/"), order)
    return df.withColumns({
        "_d_form": F.lit(form), "_d_raw": text,
        "_d_zone": F.coalesce(zone, F.lit("")), "_d_date_order": F.coalesce(order, F.lit("")),
    })


def parse_values(values: DataFrame) -> DataFrame:
    """Dictionary keys (form, raw, zone, date_order) -> the same with `early_ms`, `late_ms`."""
    texts = parse_stamps(values.where("form = 'text'"), "raw", "date_order")
    texts = texts.select(*KEYS, F.col("_tp_ms").alias("_ms"), F.col("_tp_wall").alias("_wall"))
    counts = values.where("form = 'epoch'").select(*KEYS, epoch_ms(F.col("raw").try_cast("bigint")).alias("_ms"), (F.col("zone") != "").alias("_wall"))
    both = texts.unionByName(counts).withColumn("_zone", F.nullif(F.col("zone"), F.lit("")))
    done = resolve_walls(both, "_ms", F.col("_wall"), "_zone")
    return done.select(*KEYS, F.col("_tw_early").alias("early_ms"), F.col("_tw_late").alias("late_ms"))


class TimeDictionary:
    """Distinct-value dictionary of time stamps, kept as a parquet table at `path`.

    `path` defaults to a fresh folder in the shared folder; give a lasting one to keep it over loads:
    then `update` parses only values that are not in it yet. An entry depends on nothing but its key, so a value that
    a retried or concurrent load has added twice has equal entries, of which a kept dictionary is read once (`table`).
    """

    def __init__(self, spark, path: str | None = None):
        self.spark, self.path = spark, path or scratch(spark, "time-dictionary")
        self.known, self.fresh = False, path is None
        try:
            self.table()
            self.known = True
        except Exception as e:  # no table there yet
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise

    def table(self) -> DataFrame:
        """(KEYS, early_ms, late_ms), one row per key. A fresh dictionary is written once by one `update` of distinct values; a kept one may hold a key twice."""
        entries = self.spark.read.parquet(self.path)
        return entries if self.fresh else entries.dropDuplicates(KEYS)

    def update(self, *keyed: DataFrame) -> None:
        """Add the values of frames made by `keyed_text` or `keyed_epoch`. Null values have no entry."""
        values = None
        for df in keyed:
            part = df.where("_d_raw IS NOT NULL").select(*(F.col(f"_d_{k}").alias(k) for k in KEYS))
            values = part if values is None else values.unionByName(part)
        values = values.distinct()
        if self.known:
            values = values.join(self.table().select(*KEYS), KEYS, "left_anti")
            self.fresh = False
        parse_values(values).write.mode("append").parquet(self.path)
        self.known = True

    def join(self, keyed: DataFrame) -> DataFrame:
        """Every row of `keyed` with `_early_ms`, `_late_ms` (null where the value is no time). Null values skip the join, lest they gather in one task."""
        entries = self.table().select(*(F.col(k).alias(f"_d_{k}") for k in KEYS), F.col("early_ms").alias("_early_ms"), F.col("late_ms").alias("_late_ms"))
        drop = [f"_d_{k}" for k in KEYS]
        found = keyed.where("_d_raw IS NOT NULL").join(entries, drop, "left")
        none = keyed.where("_d_raw IS NULL").withColumns({"_early_ms": F.lit(None).cast("bigint"), "_late_ms": F.lit(None).cast("bigint")})
        return found.unionByName(none).drop(*drop)


def keyed_text(df: DataFrame, raw: str, zone: str, order: str) -> DataFrame:
    return _keyed(df, "text", F.col(raw), F.col(zone), F.col(order))


def keyed_epoch(df: DataFrame, raw: str, zone: Column) -> DataFrame:
    return _keyed(df, "epoch", F.col(raw), zone, F.lit(None).cast("string"))


def with_utc_ms(df: DataFrame, out: str, *, text: str | None = None, epoch: str | None = None, zone: str, order: str | None = None, wall: Column | None = None, received: Column | None = None) -> DataFrame:
    """Add `out`: the UTC millisecond of column `text` (stamps) or `epoch` (counts; wall time of `zone` where `wall`)."""
    if text is not None:
        df = parse_stamps(df, text, order)
        wall = F.col("_tp_wall")
    else:
        df = df.withColumn("_tp_ms", epoch_ms(F.col(epoch)))
    df = resolve_walls(df, "_tp_ms", F.coalesce(wall, F.lit(False)), zone)
    return df.withColumn(out, fence(pick_instant(F.col("_tw_early"), F.col("_tw_late"), received))).drop("_tp_ms", "_tp_wall", "_tw_early", "_tw_late")


def bars_with_time(bars: DataFrame, feeds: DataFrame, columns: list[str]) -> DataFrame:
    """`columns` of quality_audit and `t_ms`, the UTC millisecond of each bar (null: no time)."""
    feeds = feeds.select(F.col("feed").alias("_f_feed"), F.col("tz_name").alias("_f_zone"), F.col("date_order").alias("_f_order"))
    df = bars.select(*dict.fromkeys([*columns, "feed"]), F.col("time").alias("_f_time"), F.unix_millis("received_at").alias("_f_received"))
    df = df.join(feeds, F.col("feed") == F.col("_f_feed"), "left")
    df = with_utc_ms(df, "t_ms", text="_f_time", zone="_f_zone", order="_f_order", received=F.col("_f_received"))
    return df.select(*columns, "t_ms")


def trades_with_time(trades: DataFrame, feeds: DataFrame, columns: list[str]) -> DataFrame:
    """`columns` of tick_replay and `t_ms`, the UTC millisecond of the entry (null: no time)."""
    feeds = feeds.select(F.col("feed").alias("_f_feed"), F.col("tz_name").alias("_f_zone"))
    df = trades.select(*dict.fromkeys([*columns, "feed"]), F.col("entry_time_ms").alias("_f_time"), (F.col("clock") == "server").alias("_f_wall"))
    df = df.join(feeds, F.col("feed") == F.col("_f_feed"), "left")
    df = with_utc_ms(df, "t_ms", epoch="_f_time", zone="_f_zone", wall=F.col("_f_wall"))
    return df.select(*columns, "t_ms")


CANONICAL = r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}\+00:00$"


def normalise_times(bars: DataFrame, trades: DataFrame, feeds: DataFrame, path: str | None = None) -> DataFrame:
    """(src, row_id, raw, utc_ms) of every bar and trade through one `TimeDictionary`; utc_ms is null for a value that is no time.

    Rows of a feed that `feeds` lacks have no zone: their text without zone is no time. Empty tables give no rows.
    """
    feeds = feeds.select(F.col("feed").alias("_f_feed"), F.col("tz_name").alias("_f_zone"), F.col("date_order").alias("_f_order"))
    b = bars.select(F.lit("bar").alias("src"), F.col("bar_id").alias("row_id"), "feed", F.col("time").alias("raw"), F.unix_millis("received_at").alias("_received"))
    b = keyed_text(b.join(feeds, F.col("feed") == F.col("_f_feed"), "left"), "raw", "_f_zone", "_f_order")
    t = trades.select(F.lit("trade").alias("src"), F.col("trade_id").alias("row_id"), "feed", F.col("entry_time_ms").alias("raw"), "clock")
    t = keyed_epoch(t.join(feeds, F.col("feed") == F.col("_f_feed"), "left"), "raw", F.when(F.col("clock") == "server", F.coalesce("_f_zone", F.lit("?"))))
    t = t.where("_d_zone <> '?'").unionByName(t.where("_d_zone = '?'").withColumn("_d_raw", F.lit(None).cast("string")))
    book = TimeDictionary(bars.sparkSession, path)
    book.update(b, t)
    keep = ["src", "row_id", F.col("raw").cast("string").alias("raw")]
    early, late = F.col("_early_ms"), F.col("_late_ms")
    return book.join(b).select(*keep, pick_instant(early, late, F.col("_received")).alias("utc_ms")).unionByName(book.join(t).select(*keep, late.alias("utc_ms")))


def changed_times(normal: DataFrame) -> DataFrame:
    """Of `normalise_times`, the rows with a time that was not written in the one form: bars as `YYYY-MM-DD HH:MM:SS+00:00`, trades as that millisecond."""
    told = F.when(F.col("src") == "bar", F.col("raw").rlike(CANONICAL)).otherwise(F.col("raw") == F.col("utc_ms").cast("string"))
    return normal.where(F.col("utc_ms").isNotNull() & ~told).select("src", "row_id", "utc_ms")
