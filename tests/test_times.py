"""Time normalisation against plain Python, on written cases and on the smallest tables."""

from datetime import datetime, timezone

from tests import brute
from tidemark.operators import time_normalise as tn
from tidemark.session import table

SF = "/root/testdata/sf0.001"
TEXTS = [
    "2024-03-10 12:00:00+00:00", "2024-10-27 03:30:00", "2024-03-31 03:30:00", "2024.10.27 03:30", "2023-02-30 02:00:00+00:00", "2024-02-29 02:00:00Z", "2023-02-29 02:00:00Z", "2024-13-01T00:00:00Z", "2023-08-27 06:75:00", "2023-08-27 24:00:00",
    "  2024-01-01T00:00:00Z ", "2024-01-01t00:00:00.123z", "20240101T000000Z", "1704067200", "1704067200123", "170406720", "01/02/2024 12:00:00 AM", "02/01/2024 12:59:59 PM", "13/02/2024 01:00:00", "02/13/2024 01:00:00", "13:00", "",
    "n/a", "NaT", "null", "-", None, "2024-01-01 10:00 UTC+05:30", "2024-01-01T10:00:00-0400", "Mon, 01 Jan 2024 10:00:00 GMT", "01 Jan 2024 10:00:00 GMT", "01 Foo 2024 10:00:00 GMT", "2024-01-01 10:00:00.987654", "2024/01/01 10:00:00", "0000-00-00 00:00:00",
]


def test_written_cases(spark):
    feeds = [("a", "Europe/Athens", "dmy"), ("b", "America/New_York", "mdy"), ("c", "Australia/Lord_Howe", "ymd"), ("d", "UTC", "dmy")]
    received = datetime(2024, 10, 27, 0, 50, tzinfo=timezone.utc)
    bars = [(i * 10 + j, f[0], t, received) for i, t in enumerate(TEXTS) for j, f in enumerate(feeds)]
    b = spark.createDataFrame(bars, "bar_id bigint, feed string, time string, received_at timestamp")
    f = spark.createDataFrame([(*x[:1], "v", *x[1:]) for x in feeds], "feed string, venue string, tz_name string, date_order string")
    zone = {x[0]: x for x in feeds}
    want = {i: brute.stamp_ms(t, zone[fd][1], zone[fd][2] if zone[fd][2] != "ymd" or not (t or "").startswith(("01/", "02/", "13/")) else "?", brute._ms(received)) for i, fd, t, _ in bars if not (zone[fd][2] == "ymd" and "/" in (t or "") and t[2] == "/")}
    got = {r.bar_id: r.t_ms for r in tn.bars_with_time(b, f, ["bar_id"]).collect()}
    assert {k: got[k] for k in want} == want
    t = spark.createDataFrame([], "trade_id bigint, feed string, entry_time_ms bigint, clock string")
    through = {r.row_id: r.utc_ms for r in tn.normalise_times(b, t, f).collect()}
    assert through == got


def test_tables(spark):
    t = lambda n: table(spark, SF, n)
    feeds = {r.feed: r for r in t("feeds").collect()}
    want = {("bar", r.bar_id): brute.stamp_ms(r.time, feeds[r.feed].tz_name, feeds[r.feed].date_order, brute._ms(r.received_at.replace(tzinfo=timezone.utc))) for r in t("quality_audit").collect()}
    want |= {("trade", r.trade_id): brute.trade_ms(r.entry_time_ms, r.clock, feeds[r.feed].tz_name) for r in t("tick_replay").collect()}
    got = {(r.src, r.row_id): r.utc_ms for r in tn.normalise_times(t("quality_audit"), t("tick_replay"), t("feeds")).collect()}
    assert got == want


def test_dictionary_grows(spark, tmp_path):
    at = str(tmp_path / "book")
    rows = lambda *x: tn.keyed_text(spark.createDataFrame([(v, "UTC", "dmy") for v in x], "t string, z string, o string"), "t", "z", "o")
    tn.TimeDictionary(spark, at).update(rows("2024-01-01 00:00:00", "2024-01-01 00:00:00", "x", None))
    assert tn.TimeDictionary(spark, at).table().count() == 2
    again = tn.TimeDictionary(spark, at)
    again.update(rows("2024-01-01 00:00:00", "2024-01-02 00:00:00Z"))
    assert again.table().count() == 3
    got = again.join(rows("2024-01-02 00:00:00Z", "x", None)).collect()
    assert sorted((r.t or "", r._late_ms) for r in got) == [("", None), ("2024-01-02 00:00:00Z", 1704153600000), ("x", None)]


def test_empty_and_extra_columns(spark):
    b = spark.createDataFrame([], "bar_id bigint, feed string, time string, received_at timestamp, tz_name string, t_ms bigint")
    f = spark.createDataFrame([("a", "UTC", "dmy", 1)], "feed string, tz_name string, date_order string, time int")
    t = spark.createDataFrame([(1, "a", None, None), (2, "zz", 1704067200000, "server"), (3, "a", 1704067200, "server"), (4, "a", 0, None)], "trade_id bigint, feed string, entry_time_ms bigint, clock string")
    got = {r.row_id: r.utc_ms for r in tn.normalise_times(b, t, f).collect()}
    assert got == {1: None, 2: None, 3: 1704067200000, 4: None}
