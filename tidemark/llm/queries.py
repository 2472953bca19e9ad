"""Queries pN_ of this folder and the SQL they are checked against."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import time_normalise as tn
from ..session import table
from . import nearest as near
from . import percentiles as pct
from .bpe import encode_texts
from .mixing import mix
from .truncation import score_texts, truncation_rates

TWO_MINUTES = 120_000


def p3_found(spark, sf_dir):
    """Each trade with a time and its nearest bar within two minutes."""
    t = lambda n: table(spark, sf_dir, n)
    bars = tn.bars_with_time(t("quality_audit"), t("feeds"), ["bar_id", "feed", "symbol"])
    trades = tn.trades_with_time(t("tick_replay"), t("feeds"), ["trade_id", "feed", "symbol"])
    return near.nearest(trades, bars, ("feed", "symbol"), "t_ms", "t_ms", "trade_id", "bar_id", TWO_MINUTES).select("trade_id", "bar_id")


DIMENSIONS = {"symbol": ["symbol"], "strategy": ["strategy"], "feed": ["feed"]}


def _counts(spark, sf_dir):
    return pct.value_counts(table(spark, sf_dir, "tick_replay"), DIMENSIONS, ["spread_at_fill", "pnl_net"])


def p5_percentiles(spark, sf_dir):
    """Percentiles of spread_at_fill and pnl_net per symbol, per strategy and per feed (the part that is combined)."""
    return pct.percentiles(_counts(spark, sf_dir))


def p5_counts(spark, sf_dir):
    """The combinable form: counts per member and value."""
    return _counts(spark, sf_dir)


def p8_ids(spark, sf_dir):
    """Token ids of every document."""
    return encode_texts(table(spark, sf_dir, "documents"))


def _mix(spark, sf_dir):
    return mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


def p9_mix(spark, sf_dir):
    """Target and actual share of each source."""
    return _mix(spark, sf_dir)[1]


def p9_plan(spark, sf_dir):
    """How often each record of a source with a target is used."""
    return _mix(spark, sf_dir)[0]


def p10_found(spark, sf_dir):
    """Reviews whose text was cut."""
    return score_texts(table(spark, sf_dir, "documents")).where("cut").select("doc_id")


def p10_rates(spark, sf_dir):
    """How often each source truncates."""
    return truncation_rates(score_texts(table(spark, sf_dir, "documents")))


_LONG = """
WITH v AS (SELECT symbol, strategy, feed, 'spread_at_fill' AS metric, spread_at_fill AS value FROM tick_replay
           UNION ALL SELECT symbol, strategy, feed, 'pnl_net', pnl_net FROM tick_replay),
l AS (SELECT 'symbol' AS dimension, symbol AS member, metric, value + 0.0 AS value FROM v WHERE value IS NOT NULL AND NOT isnan(value)
      UNION ALL SELECT 'strategy', strategy, metric, value + 0.0 FROM v WHERE value IS NOT NULL AND NOT isnan(value)
      UNION ALL SELECT 'feed', feed, metric, value + 0.0 FROM v WHERE value IS NOT NULL AND NOT isnan(value)),
c AS (SELECT dimension, member, metric, value, count(*) AS n FROM l GROUP BY ALL)
"""
SQL = {
    "p5_counts": _LONG + "SELECT dimension, member, metric, value, n FROM c",
    "p5_percentiles": _LONG + """,
r AS (SELECT *, sum(n) OVER (PARTITION BY dimension, member, metric) AS total,
             sum(n) OVER (PARTITION BY dimension, member, metric ORDER BY value) AS upto FROM c),
p AS (SELECT unnest([1, 5, 25, 50, 75, 95, 99]) AS percentile)
SELECT dimension, member, metric, CAST(percentile AS INTEGER) AS percentile, value, CAST(total AS BIGINT) AS n, CAST(0 AS INTEGER) AS rank_error
FROM r, p WHERE (percentile * total + 99) // 100 > upto - n AND (percentile * total + 99) // 100 <= upto""",
}
QUERIES = {f.__name__: f for f in (p3_found, p5_percentiles, p5_counts, p8_ids, p9_mix, p9_plan, p10_found, p10_rates)}
