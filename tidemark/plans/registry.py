"""All queries of the core, by name."""

from __future__ import annotations

from . import p_core, ref_bars, ref_extra, ref_more, ref_trades, ref_windows, streams

MODULES = [p_core, ref_bars, ref_windows, ref_trades, ref_more, ref_extra, streams]


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.SQL.items()}
