"""Small numeric and text expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TINY = 1e-12


def number(c: Column | str) -> Column:
    """A double, NaN as null: a reading that is no number counts as none."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(~F.isnan(c), c)


def safe_div(a: Column, b: Column) -> Column:
    return F.when(F.abs(b) < TINY, 0.0).otherwise(a / b)


def safe_log(a: Column) -> Column:
    return F.when(a < TINY, 0.0).otherwise(F.ln(a))


def basket_index(weights: dict[str, float], constant: float) -> Column:
    """Weighted geometric index in log space: constant * product of price ** weight."""
    total = F.ln(F.lit(constant))
    for name, w in weights.items():
        total = total + w * F.ln(F.col(name))
    return F.exp(total)


def pips(price_change: Column, digits: Column) -> Column:
    """Price difference in pips: the fourth decimal, or the second for instruments with two or three."""
    return price_change / F.when(digits <= 3, 0.01).otherwise(0.0001)


def clean_number(text: Column) -> Column:
    """Printed number -> double: spaces (also unbreakable) between thousands, decimal comma, per cent sign."""
    t = F.regexp_replace(text, "[\\s  %]", "")
    t = F.when(t.rlike(r"^-?\d+,\d+$"), F.replace(t, F.lit(","), F.lit("."))).otherwise(F.replace(t, F.lit(",")))
    return t.try_cast("double")


def fnv1a32(text: Column) -> Column:
    """FNV-1a of the text's characters, 32 bits unsigned, as bigint."""
    codes = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("bigint"))
    mask = F.lit(0xFFFFFFFF)
    # the product is taken in two halves, so that 64 bits suffice
    mul = lambda h: ((h % 65536) * 16777619 + ((F.shiftright(h, 16) * 16777619) % 65536) * 65536).bitwiseAND(mask)
    return F.aggregate(codes, F.lit(2166136261), lambda h, c: mul(h.bitwiseXOR(c)))


def drawn(seed: int, *key: Column) -> Column:
    """A text that depends on the key and the seed alone, by which rows are put into a random order that any engine can repeat."""
    return F.md5(F.concat_ws("|", *(k.cast("string") for k in key), F.lit(str(seed))))


def drawn_below(text: Column, n: int) -> Column:
    """A whole number from 0 to n - 1 from the first four digits of a drawn text (n far below 65536)."""
    return F.conv(F.substring(text, 1, 4), 16, 10).cast("int") % n
