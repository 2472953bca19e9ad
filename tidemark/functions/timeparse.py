"""Time stamps in many spellings -> UTC milliseconds, as Catalyst expressions only.

Every step is a projection, so it runs inside whole-stage code generation; regular expressions
decide the spelling once and fixed positions give the fields.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DAY_MS = 86_400_000
BAR_MS = 300_000

# English month abbreviations in calendar order.
MONTHS = "JANFEBMARAPRMAYJUNJULAUGSEPOCTNOVDEC"

# Spellings, tried in this order on upper-cased, trimmed text.
ISO = r"^\d{4}([-./])\d{2}\1\d{2}[T ]\d{2}:\d{2}(:\d{2}([.,]\d{1,9})?)? ?(Z|((UTC|GMT) ?)?([+-]\d{2}(:?\d{2})?)?)$"
COMPACT = r"^\d{8}T\d{6}(Z|[+-]\d{2}:?\d{2})?$"
SLASHED = r"^\d{2}/\d{2}/\d{4} \d{2}:\d{2}(:\d{2})?( [AP]M)?$"
NAMED = r"^([A-Z]{3}, )?\d{2} [A-Z]{3} \d{4} \d{2}:\d{2}:\d{2}( (GMT|UTC|Z|[+-]\d{2}:?\d{2}))?$"
EPOCH = r"^(\d{10}|\d{13})$"
#: Text that names its zone itself (or counts from the epoch): no feed setting takes part.
ZONED = r"(Z|UTC|GMT|(T.*|:\d\d|:\d\d[.,]\d+|UTC|GMT)\s*[+-]\d{2}:?\d{2}|UTC[+-]\d{2}|GMT[+-]\d{2})$|^\d+$"


def fence(c: Column) -> Column:
    """The bigint `c`, computed where it stands.

    A filter on a column is otherwise pushed below the projections that made it, with their
    expressions put in for every mention; for deep expressions that grows without bound and plans never come out.
    """
    return c + (F.spark_partition_id() * 0)


def _int(c: Column) -> Column:
    return c.try_cast("int")


def parse_stamps(df: DataFrame, raw: str, order: str, prefix: str = "_tp") -> DataFrame:
    """Add `<prefix>_ms` (bigint) and `<prefix>_wall` (boolean).

    `<prefix>_ms` is the stamp's epoch millisecond: of the instant if the text names a zone or is an
    epoch count, else of the wall time read as if it were UTC (`<prefix>_wall` true). It is null for
    null, empty or unknown text, impossible dates (30 February, month 13) and clock times (06:75,
    24:00, second 60). `order` is the column holding ymd, dmy or mdy for dates with slashes and the year last; such
    text with any other order is no time.
    """
    p = lambda n: f"{prefix}_{n}"
    c = lambda n: F.col(p(n))
    sub = lambda a, n: _int(F.substring(c("t"), a, n))
    df = df.withColumn(p("t"), F.upper(F.trim(F.col(raw))))
    t = c("t")
    df = df.withColumn(
        p("k"),
        F.when(t.rlike(ISO), 1).when(t.rlike(EPOCH), 5).when(t.rlike(COMPACT), 2).when(t.rlike(SLASHED), 3).when(t.rlike(NAMED), 4),
    )
    # named dates are aligned from the right of an optional "MON, "
    df = df.withColumn(p("t"), F.when((c("k") == 4) & (F.substring(t, 4, 1) == ","), F.substring(t, 6, 64)).otherwise(t))
    k = c("k")
    mdy = F.col(order) == "mdy"
    df = df.withColumns({
        p("y"): F.when(k.isin(1, 2), sub(1, 4)).when(k == 3, sub(7, 4)).when(k == 4, sub(8, 4)),
        p("mo"): F.when(k == 1, sub(6, 2)).when(k == 2, sub(5, 2))
        .when(k == 3, F.when(mdy, sub(1, 2)).when(F.col(order) == "dmy", sub(4, 2)))
        .when(k == 4, _month(F.substring(c("t"), 4, 3))),
        p("d"): F.when(k == 1, sub(9, 2)).when(k == 2, sub(7, 2)).when(k == 3, F.when(mdy, sub(4, 2)).otherwise(sub(1, 2))).when(k == 4, sub(1, 2)),
        p("h"): F.when(k.isin(1, 3), sub(12, 2)).when(k == 2, sub(10, 2)).when(k == 4, sub(13, 2)),
        p("mi"): F.when(k.isin(1, 3), sub(15, 2)).when(k == 2, sub(12, 2)).when(k == 4, sub(16, 2)),
        p("rest"): F.when(k.isin(1, 3), F.substring(c("t"), 17, 40)).when(k == 2, F.concat(F.lit(":"), F.substring(c("t"), 14, 40))).when(k == 4, F.substring(c("t"), 18, 40)),
    })
    rest = c("rest")
    df = df.withColumns({
        p("s"): F.when(F.substring(rest, 1, 1) == ":", _int(F.substring(rest, 2, 2))).when(k.isNotNull(), 0),
        p("f"): F.when(F.substring(rest, 4, 1).isin(".", ","), _int(F.substring(F.rpad(F.regexp_extract(rest, r"^:\d\d[.,](\d+)", 1), 3, "0"), 1, 3))).otherwise(0),
        p("z"): F.when(k.isin(1, 2, 4), F.when(rest.rlike("[+-]"), F.regexp_extract(rest, r"([+-]\d{2}:?(\d{2})?)$", 1)).when(rest.rlike("(Z|UTC|GMT)$"), "+00")),
        p("h"): F.when((k == 3) & rest.endswith("M"), F.when(c("h").between(1, 12), c("h") % 12 + F.when(rest.endswith("PM"), 12).otherwise(0))).otherwise(c("h")),
    })
    y, mo, d, h, mi, s, z = (c(n) for n in ("y", "mo", "d", "h", "mi", "s", "z"))
    leap = ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)
    last = F.when(mo == 2, F.when(leap, 29).otherwise(28)).when(mo.isin(4, 6, 9, 11), 30).otherwise(31)
    off_h, off_m = _int(F.substring(z, 2, 2)), F.coalesce(_int(F.regexp_extract(z, r"^...:?(\d\d)$", 1)), F.lit(0))
    offset = F.when(z.isNull(), 0).when((off_h <= 18) & (off_m < 60), (off_h * 60 + off_m) * F.when(F.substring(z, 1, 1) == "-", -1).otherwise(1))
    valid = (y >= 1) & mo.between(1, 12) & (d >= 1) & (d <= last) & h.between(0, 23) & mi.between(0, 59) & s.between(0, 59)
    days = F.unix_date(F.make_date(y, mo, d)).cast("bigint")
    ms = ((((days * 24 + h) * 60 + mi - offset) * 60) + s) * 1000 + c("f")
    digits = c("t").try_cast("bigint")
    df = df.withColumns({
        p("ms"): fence(F.when(k == 5, F.when(F.length(c("t")) == 10, digits * 1000).otherwise(digits)).when(valid, ms)),
        p("wall"): F.coalesce((k != 5) & z.isNull(), F.lit(False)),
    })
    return df.drop(*(p(n) for n in ("t", "k", "y", "mo", "d", "h", "mi", "rest", "s", "f", "z")))


def _month(name: Column) -> Column:
    return F.coalesce(*[F.when(name == MONTHS[i : i + 3], i // 3 + 1) for i in range(0, 36, 3)])


def epoch_ms(value: Column) -> Column:
    """An epoch count in s, ms, us or ns (told by its magnitude) -> milliseconds, rounded down; null, 0 and negative are no time."""
    v = value
    whole = lambda by: F.call_function("div", v, F.lit(by).cast("bigint"))
    return (
        F.when(v <= 0, F.lit(None).cast("bigint"))
        .when(v < 100_000_000_000, v * 1000)
        .when(v < 100_000_000_000_000, v)
        .when(v < 100_000_000_000_000_000, whole(1000))
        .otherwise(whole(1_000_000))
    )


def _offset(ms: Column, zone: Column) -> Column:
    """Zone offset in ms that holds at the instant."""
    return F.unix_millis(F.from_utc_timestamp(F.timestamp_millis(ms), zone)) - ms


def resolve_walls(df: DataFrame, ms: str, wall: Column, zone: str, prefix: str = "_tw") -> DataFrame:
    """Add `<prefix>_early` and `<prefix>_late`: the first and last instant at which the wall clock of `zone` shows `ms`.

    Both equal `ms` where `wall` is false; both are null where the wall time never occurs (skipped
    by a change of the clocks), or `zone` is null.
    """
    w, z = F.col(ms), F.col(zone)
    a, b = f"{prefix}_a", f"{prefix}_b"
    df = df.withColumns({a: F.when(wall, _offset(w - DAY_MS, z)), b: F.when(wall, _offset(w + DAY_MS, z))})
    oa, ob = F.col(a), F.col(b)
    first = F.when(oa == ob, w - oa).otherwise(F.when(_offset(w - oa, z) == oa, w - oa))
    second = F.when(oa == ob, w - oa).otherwise(F.when(_offset(w - ob, z) == ob, w - ob))
    df = df.withColumns({f"{prefix}_1": F.when(wall, first).otherwise(w), f"{prefix}_2": F.when(wall, second).otherwise(w)})
    one, two = F.col(f"{prefix}_1"), F.col(f"{prefix}_2")
    return df.withColumns({f"{prefix}_early": fence(F.least(one, two)), f"{prefix}_late": fence(F.greatest(one, two))}).drop(a, b, f"{prefix}_1", f"{prefix}_2")


def pick_instant(early: Column, late: Column, received_ms: Column | None = None, lasts_ms: int = BAR_MS) -> Column:
    """The later instant of a wall time that occurs twice, unless the record, lasting `lasts_ms`, would then have been received before its end."""
    if received_ms is None:
        return late
    return F.when((early < late) & (received_ms < late + lasts_ms), early).otherwise(late)
