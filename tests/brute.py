"""Plain Python versions of the time rules, for comparison."""

from __future__ import annotations

import re
from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

MON = {m: i + 1 for i, m in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split())}
EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)


def _ms(dt):
    d = dt - EPOCH
    return d.days * 86_400_000 + d.seconds * 1000 + d.microseconds // 1000


def walls(naive, zone):
    """All instants at which the zone's clock shows `naive`."""
    z, found = ZoneInfo(zone), set()
    for fold in (0, 1):
        at = naive.replace(tzinfo=z, fold=fold).astimezone(timezone.utc)
        if at.astimezone(z).replace(tzinfo=None) == naive:
            found.add(at)
    return sorted(found)


def stamp_ms(text, zone, order, received_ms=None):
    if text is None:
        return None
    t = text.strip()
    if re.fullmatch(r"\d{10}|\d{13}", t):
        return int(t) * (1000 if len(t) == 10 else 1)
    ampm = frac = None
    if m := re.fullmatch(r"(?i)(\d{4})([-./])(\d\d)\2(\d\d)[T ](\d\d):(\d\d)(?::(\d\d)(?:\.(\d+))?)?\s*(Z|UTC|GMT|(?:UTC)?[+-]\d\d:?\d\d)?", t):
        y, _, mo, d, h, mi, s, frac, z = m.groups()
    elif m := re.fullmatch(r"(\d{4})(\d\d)(\d\d)T(\d\d)(\d\d)(\d\d)(Z)", t):
        y, mo, d, h, mi, s, z = m.groups()
    elif m := re.fullmatch(r"(\d\d)/(\d\d)/(\d{4}) (\d\d):(\d\d):(\d\d)(?: ([AP])M)?", t):
        a, b, y, h, mi, s, ampm = m.groups()
        z, (mo, d) = None, (a, b) if order == "mdy" else (b, a)
    elif m := re.fullmatch(r"(?:[A-Z][a-z]{2}, )?(\d\d) ([A-Z][a-z]{2}) (\d{4}) (\d\d):(\d\d):(\d\d) (GMT)", t):
        d, mon, y, h, mi, s, z = m.groups()
        mo = MON.get(mon.lower(), 0)
    else:
        return None
    h = int(h)
    if ampm:
        h = h % 12 + (12 if ampm == "P" else 0)
    try:
        naive = datetime(int(y), int(mo), int(d), h, int(mi), int(s or 0), int(((frac or "") + "000000")[:6]))
    except ValueError:
        return None
    if z is not None:
        off = timedelta()
        if m := re.search(r"([+-])(\d\d):?(\d\d)$", z):
            off = timedelta(hours=int(m[2]), minutes=int(m[3])) * (-1 if m[1] == "-" else 1)
        return _ms(naive.replace(tzinfo=timezone.utc) - off)
    return _choose(walls(naive, zone), received_ms)


def _choose(found, received_ms=None):
    if not found:
        return None
    first, last = _ms(found[0]), _ms(found[-1])
    if first < last and received_ms is not None and received_ms < last + 300_000:
        return first
    return last


def trade_ms(value, clock, zone):
    if value is None or value <= 0:
        return None
    ms = value * 1000 if value < 10**11 else value if value < 10**14 else value // 1000 if value < 10**17 else value // 10**6
    if clock != "server":
        return ms
    found = walls((EPOCH + timedelta(milliseconds=ms)).replace(tzinfo=None), zone)
    return _choose(found)


def clean(text, ms):
    return re.fullmatch(r"\d{4}-\d\d-\d\d \d\d:\d\d:\d\d\+00:00", text) is not None
