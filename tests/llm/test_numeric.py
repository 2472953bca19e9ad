"""Nearest-time pairing and percentiles against plain Python."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tidemark.llm import nearest as near
from tidemark.llm import percentiles as pct

SCHEMA = "id bigint, f string, s string, t bigint, distance string"


def brute(left, right, tol):
    out = {}
    for i, f, s, t, _ in left:
        if None in (f, s, t):
            continue
        best = min(((abs(rt - t), rt, ri) for ri, rf, rs, rt, _ in right if (rf, rs) == (f, s) and rt is not None), default=None)
        if best and (tol is None or best[0] <= tol):
            out[i] = (best[2], best[0])
    return out


@pytest.mark.parametrize("tol", [None, 6])
@pytest.mark.parametrize("parts", [1, 7])
def test_nearest(spark, tol, parts):
    random.seed(parts)
    pick = lambda n, base: [(base + i, random.choice(["f", "f", "f", "g", None]), random.choice(["x", "x", "y"]), random.choice([random.randrange(300), random.randrange(300), 150, 151, None]), "clash") for i in range(n)]
    left, right = pick(260, 0), pick(200, 1000)
    left += [(5000 + i, "only", "left", i, "c") for i in range(40)]
    lf, rf = spark.createDataFrame(left, SCHEMA), spark.createDataFrame(right, SCHEMA)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "9")
    try:
        got = {r.id: (r.bar, r.distance) for r in near.nearest(lf, rf.withColumnRenamed("id", "bar"), ("f", "s"), "t", "t", "id", "bar", tol, parts).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == brute(left, right, tol)


@pytest.mark.parametrize("tol", [None, 40])
@pytest.mark.parametrize("parts", [40, 600])
def test_nearest_partitions_without_bars(spark, tol, parts, monkeypatch):
    """More partitions than rows, or thousands of trades under one bar: partitions of trades alone, whole scan blocks of them too."""
    monkeypatch.setattr(near, "SCAN_BLOCK", 40)
    left = [(i, "f", "s", 60 * i + 20, "c") for i in range(12)] + [(100 + i, "g", "s", i, "c") for i in range(3000)]
    right = [(5000 + i, "f", "s", 60 * i, "c") for i in range(12)] + [(6000, "g", "s", 10, "c")]
    lf, rf = spark.createDataFrame(left, SCHEMA), spark.createDataFrame(right, SCHEMA)
    got = {r.id: (r.bar, r.distance) for r in near.nearest(lf, rf.withColumnRenamed("id", "bar"), ("f", "s"), "t", "t", "id", "bar", tol, parts).collect()}
    assert got == brute(left, right, tol)


def test_nearest_empty(spark):
    e = spark.createDataFrame([], SCHEMA)
    one = spark.createDataFrame([(1, "f", "s", 5, "")], SCHEMA)
    for a, b in ((e, e), (one, e), (e, one)):
        assert near.nearest(a, b.withColumnRenamed("id", "b"), ("f", "s"), "t", "t", "id", "b").count() == 0


def test_percentiles(spark):
    random.seed(2)
    rows = [(random.choice(["a", "a", "b", None]), random.choice([random.gauss(0, 5), 1.0, -0.0, 0.0, None, float("nan")])) for _ in range(900)] + [("one", 3.0), ("none", None)]
    df = spark.createDataFrame(rows, "k string, x double").withColumn("value", F.lit("clash"))
    parts = [pct.value_counts(d, {"k": ["k"]}, ["x"]) for d in (df.where("x > 0"), df.where("NOT x > 0 OR x IS NULL"))]
    got = {(r.member, r.percentile): (r.value, r.n) for r in pct.percentiles(pct.merge_counts(*parts), partitions=5).collect()}
    want = {}
    for k in ("a", "b", None, "one"):
        v = sorted(x for kk, x in rows if kk == k and x is not None and not math.isnan(x))
        for p in pct.PERCENTILES:
            want[k, p] = (v[-(-p * len(v) // 100) - 1], len(v))
    assert got == want
    assert pct.percentiles(pct.value_counts(df.limit(0), {"k": ["k"]}, ["x"])).count() == 0
