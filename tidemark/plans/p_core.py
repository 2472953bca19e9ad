"""Queries pN_ of the record-quality operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import grid, implausible, intervals, profile
from ..operators import time_normalise as tn
from ..session import table


def _grid(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    bars = tn.bars_with_time(t("quality_audit"), t("feeds"), ["bar_id", "feed", "symbol", "close", "tick_volume"])
    return grid.bar_grid(bars, t("instruments"))


def p1_found(spark, sf_dir):
    """Open slots without a usable bar, between the first and the last filled slot of each series."""
    return _grid(spark, sf_dir).where("status <> 'filled'").select("feed", "symbol", "slot_s")


def p1_grid(spark, sf_dir):
    """The whole regular series: filled, interpolated (at most three slots in a row) or marked empty."""
    return _grid(spark, sf_dir)


def _normal(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    return tn.normalise_times(t("quality_audit"), t("tick_replay"), t("feeds"))


def p2_found(spark, sf_dir):
    """Bars and trades whose time was not written in the one form, with their UTC millisecond."""
    return tn.changed_times(_normal(spark, sf_dir))


def p2_times(spark, sf_dir):
    """The UTC millisecond of every bar and trade; null for a value that is no time."""
    return _normal(spark, sf_dir).select("src", "row_id", "utc_ms")


def p4_found(spark, sf_dir):
    """Continuous periods with exposure of each book and strategy, and the gaps between them."""
    log = table(spark, sf_dir, "eur_dd_postmortem").select("book", "strategy", F.unix_micros("open_time").alias("o"), F.unix_micros("close_time").alias("c"))
    ms = lambda c: F.call_function("div", F.col(c), F.lit(1000))
    return intervals.periods_and_gaps(log, ["book", "strategy"], "o", "c", intervals.CHUNK_MS * 1000).select("book", "strategy", "kind", ms("from").alias("from_ms"), ms("to").alias("to_ms"))


def p6_found(spark, sf_dir):
    """Findings of each load of each harvester, by itself and against the load before."""
    return profile.findings(table(spark, sf_dir, "wave_results"), table(spark, sf_dir, "column_rules"))


def p6_profile(spark, sf_dir):
    """The profile itself, one row per load and column."""
    return profile.profile_loads(table(spark, sf_dir, "wave_results"), table(spark, sf_dir, "column_rules"))


def p6_stability(spark, sf_dir):
    """Population stability index of each load against the load before."""
    return profile.stability_index(table(spark, sf_dir, "wave_results"), table(spark, sf_dir, "column_rules"))


def _flags(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    bars = tn.bars_with_time(t("quality_audit"), t("feeds"), ["bar_id", "feed", "symbol", "open", "high", "low", "close", "tick_volume"])
    trades = tn.trades_with_time(t("tick_replay"), t("feeds"), ["trade_id", "feed", "symbol", "exit_reason", "spread_at_fill"])
    a, b = implausible.implausible_bars(bars), implausible.implausible_spreads(trades)
    kinds = ["spike", "frozen", "impossible"]
    return a.select(F.lit("bar").alias("src"), F.col("bar_id").alias("row_id"), *kinds).unionByName(b.select(F.lit("trade").alias("src"), F.col("trade_id").alias("row_id"), *kinds))


def p7_found(spark, sf_dir):
    """Bars and fills that are implausible for their own series."""
    return _flags(spark, sf_dir).select("src", "row_id")


def p7_flags(spark, sf_dir):
    """The same with the kinds of fault."""
    return _flags(spark, sf_dir)


QUERIES = {f.__name__: f for f in (p1_found, p1_grid, p2_found, p2_times, p4_found, p6_found, p6_profile, p6_stability, p7_found, p7_flags)}
SQL: dict[str, str] = {
    "p4_found": """WITH i AS (SELECT book, strategy, epoch_us(open_time) AS s, epoch_us(close_time) AS e FROM eur_dd_postmortem WHERE close_time > open_time),
 m AS (SELECT *, max(e) OVER (PARTITION BY book, strategy ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM i),
 f AS (SELECT *, CASE WHEN m IS NULL OR s > m THEN 1 ELSE 0 END AS n FROM m),
 g AS (SELECT *, sum(n) OVER (PARTITION BY book, strategy ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS k FROM f)
 SELECT book, strategy, 'period' AS kind, min(s) // 1000 AS from_ms, max(e) // 1000 AS to_ms FROM g GROUP BY book, strategy, k
 UNION ALL SELECT book, strategy, 'gap', m // 1000, s // 1000 FROM f WHERE n = 1 AND m IS NOT NULL""",
}

_CELLS = " UNION ALL ".join(f"SELECT harvester, load_no, '{c}' AS column_name, {c} AS value FROM wave_results" for c in ("profit_factor", "max_dd_pct", "total_trades"))
_PROFILE = f"""WITH u AS ({_CELLS}), j AS (SELECT u.*, r.min_value AS lo, r.max_value AS hi, coalesce(regexp_full_match(value, value_pattern), false) AS ok FROM u JOIN column_rules r ON r.column_name = u.column_name),
 k AS (SELECT *, CASE WHEN ok THEN try_cast(value AS DOUBLE) END AS num FROM j),
 q AS (SELECT harvester, load_no, column_name, count(*) AS rows, count_if(value IS NULL) AS nulls, count(DISTINCT value) AS distinct_values, count_if(value IS NOT NULL AND NOT ok) AS pattern_violations, count_if(num < lo OR num > hi) AS range_violations,
   min(num) AS min_value, max(num) AS max_value, count(DISTINCT num) AS distinct_numbers, count(num) AS matching, list_sort(list(num) FILTER (num IS NOT NULL)) AS xs FROM k GROUP BY 1, 2, 3),
 p AS (SELECT * EXCLUDE (xs), (xs[(len(xs) + 1) // 2] + xs[len(xs) // 2 + 1]) / 2 AS median FROM q) """
SQL |= {
    "p6_profile": _PROFILE + "SELECT * FROM p",
    "p6_found": _PROFILE + """, b AS (SELECT p.*, q.nulls AS bn, q.rows AS br, q.median AS bm, q.distinct_numbers AS bd FROM p LEFT JOIN p q ON q.harvester IS NOT DISTINCT FROM p.harvester AND q.column_name = p.column_name AND q.load_no = p.load_no - 1)
 SELECT harvester, load_no, column_name, 'pattern' AS finding FROM b WHERE pattern_violations > 0 UNION ALL SELECT harvester, load_no, column_name, 'range' FROM b WHERE range_violations > 0
 UNION ALL SELECT harvester, load_no, column_name, 'nulls' FROM b WHERE nulls / rows - bn / br > 0.10 UNION ALL SELECT harvester, load_no, column_name, 'shift' FROM b WHERE greatest(median, bm) > least(median, bm) * 1.5 AND median IS NOT NULL AND bm IS NOT NULL
 UNION ALL SELECT harvester, load_no, column_name, 'distinct' FROM b WHERE distinct_numbers / rows < 0.5 * (bd / br)""",
}
