"""Clock and calendar expressions over UTC timestamps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def minute_of_day(ts: Column) -> Column:
    return F.hour(ts) * 60 + F.minute(ts)


def market_closed(ts: Column) -> Column:
    """Saturday, Friday from 22:00 and Sunday before 22:00."""
    d, h = F.weekday(ts), F.hour(ts)
    return (d == 5) | ((d == 4) & (h >= 22)) | ((d == 6) & (h < 22))


def sessions(ts: Column) -> dict[str, Column]:
    """One-hot trading sessions; exactly one holds at any hour."""
    h = F.hour(ts)
    return {"asia": (h >= 22) | (h < 7), "london": (h >= 7) & (h < 12), "overlap": (h >= 12) & (h < 16), "ny": (h >= 16) & (h < 22)}


def in_session(ts: Column, start: Column, end: Column) -> Column:
    """Hour within [start, end); a session whose end is not after its start runs over midnight."""
    h = F.hour(ts)
    return F.when(end <= start, (h >= start) | (h < end)).otherwise((h >= start) & (h < end))


def since_london_open(ts: Column) -> Column:
    return F.pmod(F.hour(ts) - 7, F.lit(24)) * 60 + F.minute(ts)


def to_ny_fix(ts: Column) -> Column:
    """Minutes to 16:00 by whole hours ahead less the minutes passed; negative within the hour of the fix."""
    return F.pmod(16 - F.hour(ts), F.lit(24)) * 60 - F.minute(ts)


def near_ny_fix(ts: Column) -> Column:
    m = minute_of_day(ts)
    return (m >= 955) & (m <= 965)


def session_bucket(start: Column, end: Column) -> Column:
    """Name of the session bucket of a strategy's hours."""
    both = F.concat_ws("-", start.cast("string"), end.cast("string"))
    names = {"7-12": "London", "13-17": "NY", "13-20": "NY", "22-7": "Asian", "0-24": "FullDay", "20-22": "LateNY"}  # fixed values
    pick = F.lit("Other")
    for hours, name in names.items():
        pick = F.when(both == hours, name).otherwise(pick)
    return pick


def fix_features(ts: Column) -> dict[str, Column]:
    """Distance to the 16:00 fix (clipped to 240 minutes), the hour before and after it, and period ends (from day 28)."""
    m = minute_of_day(ts)
    end = F.dayofmonth(ts) >= 28
    return {
        "dist": F.greatest(F.lit(-240), F.least(F.lit(240), 960 - m)), "pre": ((m >= 900) & (m < 960)).cast("int"), "post": ((m >= 960) & (m < 1020)).cast("int"),
        "month_end": end.cast("int"), "quarter_end": (end & (F.month(ts) % 3 == 0)).cast("int"), "year_end": (end & (F.month(ts) == 12)).cast("int"),
    }


def rule_blackout(ts: Column) -> Column:
    """Times kept free by rule: payrolls (first Friday 13:00 to 14:15), rate days (Thursday 12:00 to 13:59), the last Wednesday's 18:00 to 19:59, the fix (15:45 to 16:15) and rollover (20:00 to 22:00)."""
    m, d, dom = minute_of_day(ts), F.weekday(ts), F.dayofmonth(ts)
    payrolls = (d == 4) & (dom <= 7) & (m >= 780) & (m <= 855)
    rates = (d == 3) & (m >= 720) & (m < 840)
    wednesday = (d == 2) & (dom + 7 > F.dayofmonth(F.last_day(ts))) & (m >= 1080) & (m < 1200)
    return payrolls | rates | wednesday | ((m >= 945) & (m <= 975)) | ((m >= 1200) & (m < 1320))


def first_friday(month: Column) -> Column:
    """Date of the first Friday of the month that starts at the date `month`."""
    return F.date_add(month, F.pmod(4 - F.weekday(month), F.lit(7)))


# Dates and UTC times of the two central banks' decisions of 2026, in order.
FED_2026 = ["2026-01-28 19:00", "2026-03-18 18:00", "2026-04-29 18:00", "2026-06-17 18:00", "2026-07-29 18:00", "2026-09-16 18:00", "2026-10-28 18:00", "2026-12-09 19:00"]
ECB_2026 = ["2026-02-05 13:15", "2026-03-19 13:15", "2026-04-30 12:15", "2026-06-11 12:15", "2026-07-23 12:15", "2026-09-10 12:15", "2026-10-29 13:15", "2026-12-17 13:15"]


def event_calendar(years: DataFrame) -> DataFrame:
    """(ts, currency, event) of the scheduled events of the given years (column `year`, one row each), for use where no calendar is delivered.

    Every month: payrolls on the first Friday and US prices on the 13th, half past 13 UTC in winter (November to February) and half past 12 else; euro prices on the 30th (28th of
    February) at 9. Rate decisions are known for 2026 only; the bank's press conference follows half an hour after the decision.
    """
    m = years.where("year IS NOT NULL").select(F.explode(F.sequence(F.lit(1), F.lit(12))).alias("_m"), F.make_date("year", F.lit(1), F.lit(1)).alias("_y")).select(F.add_months("_y", F.col("_m") - 1).alias("first"), "_m")
    late = F.when(F.col("_m").isin(1, 2, 11, 12), 13 * 60 + 30).otherwise(12 * 60 + 30)
    rows = [(first_friday(F.col("first")), late, "USD", "NFP"), (F.date_add("first", 12), late, "USD", "US_CPI"), (F.date_add("first", F.when(F.col("_m") == 2, 27).otherwise(29)), F.lit(9 * 60), "EUR", "EU_CPI")]
    at = lambda d, minute: F.timestamp_seconds(F.unix_timestamp(d.cast("timestamp")) + minute * 60)
    monthly = m.select(F.explode(F.array(*(F.struct(at(d, k).alias("ts"), F.lit(c).alias("currency"), F.lit(e).alias("event")) for d, k, c, e in rows))).alias("e")).select("e.*")
    half = F.expr("interval 30 minutes")
    dated = [(F.lit(x).cast("timestamp"), "USD", "FOMC") for x in FED_2026] + [(F.lit(x).cast("timestamp"), "EUR", "ECB_RATE") for x in ECB_2026] + [(F.lit(x).cast("timestamp") + half, "EUR", "ECB_PRESSER") for x in ECB_2026]
    rates = years.where("year = 2026").select(F.explode(F.array(*(F.struct(t.alias("ts"), F.lit(c).alias("currency"), F.lit(e).alias("event")) for t, c, e in dated))).alias("e")).select("e.*")
    return monthly.unionByName(rates)
