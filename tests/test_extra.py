"""Validation, learning, pipeline, audit, streams and sources added to the survey's list."""

import math
import random
import time
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import calendar as cal
from tidemark.operators import audit, features
from tidemark.operators import grid_search as GS
from tidemark.operators import validation as V
from tidemark.pipeline import GateFailed, run_steps
from tidemark.session import shared_dir
from tidemark.sources import readers, writers
from tidemark.streaming import live


def test_least_profit_factor():
    got = [V.least_pf(n, 2000, 7.0) for n in (1, 10, 100, 1000, 10_000)]
    assert got == sorted(got)
    for x, (lo, hi) in zip(got[1:], ((1.10, 1.40), (1.30, 1.60), (1.45, 1.80), (1.60, 2.00))):
        assert lo <= x <= hi
    assert V.least_pf(1000, 3, 7.0) == 5.0


def test_stationary_block_length():
    rng = np.random.default_rng(1)
    e = rng.normal(size=2000)
    ar = np.zeros(2000)
    for i in range(1, 2000):
        ar[i] = 0.8 * ar[i - 1] + e[i]
    assert V.stationary_block_length(e) < 6 < V.stationary_block_length(ar) < 100
    assert V.stationary_block_length([1.0] * 50) == math.sqrt(50) and V.stationary_block_length([1.0, 2.0]) == math.sqrt(2)


def test_purged_paths(spark):
    start = datetime(2024, 1, 1)
    df = spark.createDataFrame([("a", start + timedelta(hours=i), i) for i in range(80)] + [("b", start, 0)], "k string, t timestamp, i int")
    rows = V.purged_paths(df, ["k"], "t", 8, 2, 3).where("k = 'a'").collect()
    paths = {r.path: r.tests for r in rows}
    assert len(paths) == 28
    for p, tests in paths.items():
        part = {r.i: r.part for r in rows if r.path == p}
        inside = {i for i in range(80) if i // 10 in tests}
        near = {i for i in range(80) if any(abs(i - j) <= 3 for j in inside)} - inside
        assert {i for i, x in part.items() if x == "test"} == inside and {i for i, x in part.items() if x == "train"} == set(range(80)) - inside - near


def test_walk_forward_runner(spark):
    rows = [(datetime(2020, 1, 1) + timedelta(days=i), float(i % 5 - 1)) for i in range(800)]
    log = spark.createDataFrame(rows, "t timestamp, p double")
    got = V.walk_forward(log, "t", 12, 3, 3, lambda train, test, k: train.agg(F.count(F.lit(1)).alias("a"), F.max("t").alias("z")).join(test.agg(F.count(F.lit(1)).alias("b"), F.min("t").alias("y")))).collect()
    assert len(got) >= 4 and all(r.z < r.y and r.a > r.b > 80 for r in got) and len({r.fold for r in got}) == len(got)
    with pytest.raises(ValueError):
        V.walk_forward(log.limit(0), "t", 12, 3, 3, lambda *a: log)


def test_event_calendar(spark):
    rows = cal.event_calendar(spark.createDataFrame([(2026,), (2025,), (None,)], "year int")).collect()
    at = lambda e, y: sorted(r.ts for r in rows if r.event == e and r.ts.year == y)
    assert at("NFP", 2026)[:3] == [datetime(2026, 1, 2, 13, 30), datetime(2026, 2, 6, 13, 30), datetime(2026, 3, 6, 12, 30)]
    assert len(at("FOMC", 2026)) == 8 and not at("FOMC", 2025) and at("ECB_PRESSER", 2026)[0] == datetime(2026, 2, 5, 13, 45)
    assert at("EU_CPI", 2025)[1] == datetime(2025, 2, 28, 9) and all(t.weekday() == 4 and t.day <= 7 for t in at("NFP", 2025))


def bars(spark, n=400, symbols=("a", "b")):
    random.seed(8)
    rows = []
    for s in symbols:
        p = 100.0
        for i in range(n):
            o = p
            p += random.gauss(0, 1)
            rows.append((s, datetime(2024, 1, 1) + timedelta(minutes=20 * i), o, max(o, p) + 0.3, min(o, p) - 0.3, p, random.randrange(1, 50)))
    return spark.createDataFrame(rows, "symbol string, t timestamp, o double, h double, l double, c double, v bigint")


def test_no_feature_looks_ahead(spark):
    b = bars(spark)
    other = b.where("symbol = 'b'").select("t", F.col("c").alias("other"))
    cut = F.lit(datetime(2024, 1, 4))
    x = {r.feature: r for r in audit.look_ahead(lambda d: features.assemble(d, other), b, ["symbol"], "t", ["o", "h", "l", "c"], cut).collect()}
    assert [n for n in (*features.FEATURES, "c") if x[n].changed] == [] and x["atr14"].rows > 100
    ahead = audit.look_ahead(lambda d: d.select("symbol", "t", F.lead("c").over(Window.partitionBy("symbol").orderBy("t")).alias("next")), b, ["symbol"], "t", ["o", "h", "l", "c"], cut).first()
    assert ahead.changed == 2


def test_grid_search(spark):
    random.seed(2)
    rows, n = [], 700
    for i in range(n):
        f = random.gauss(0, 1)
        path, p = [], 100.0
        for _ in range(10):
            p += random.gauss(0.3 * f, 0.5)
            path.append(p)
        rows.append(("a", i + 1, n, 100.0, 1.0, path, f, random.random()))
    df = spark.createDataFrame(rows, "symbol string, pos int, n int, c double, atr double, ahead array<double>, f double, g double")
    got = {(r.ahead, r.stop, r.target): r for r in GS.search(df.repartition(3), ["f", "g"], 0.01).collect()}
    assert len(got) > 100
    # one setting by plain least squares
    a, s, t = 10, 1.0, 2.0
    path = np.array([r[5] for r in rows]) - 100
    first = lambda hit: np.where(hit.any(1), hit.argmax(1), 99)
    ti, si = first(path >= t), first(path <= -s)
    y = ((ti < a) & (ti <= si)).astype(float)
    x = np.array([[1.0, r[6], r[7]] for r in rows])
    score = np.full(n, -1.0)
    for k in range(5):
        b = n - (5 - k) * 100
        beta = np.linalg.lstsq(x[: b - a - 5], y[: b - a - 5], rcond=None)[0]
        score[b : b + 100] = x[b : b + 100] @ beta
    hi, lo = path.max(1), path.min(1)
    won, lost = hi >= t, lo <= -s
    best = None
    for thr in GS.THRESHOLDS:
        m = score > thr
        if m.sum() < 60:
            continue
        up, down = t * (m & won & ~lost).sum(), s * (m & lost).sum()
        pf = up / (down + 0.01 * m.sum())
        if best is None or pf > best[0] + 1e-12:
            best = (pf, thr, m.sum())
    r = got[a, s, t]
    assert r.balance == pytest.approx(y.mean()) and (r.threshold, r.trades) == (best[1], best[2]) and r.pf == pytest.approx(best[0], abs=1e-5)


def test_steps_and_gate(spark):
    ok = lambda v: lambda: spark.createDataFrame([("rows", True), ("dates", v)], "name string, ok boolean")
    seen = []
    done = run_steps([("a", lambda r: seen.append("a")), ("b", lambda r: seen.append(tuple(r)))], ok(True))
    assert list(done) == ["a", "b"] and seen == ["a", ("a",)]
    with pytest.raises(GateFailed, match="dates"):
        run_steps([("a", lambda r: seen.append("never"))], ok(False))
    with pytest.raises(ZeroDivisionError) as e:
        run_steps([("a", lambda r: None), ("b", lambda r: 1 / 0), ("c", lambda r: seen.append("never"))])
    assert "'b'" in e.value.__notes__[0] and "never" not in seen
    assert run_steps([("a", lambda r: seen.append("never"))], ok(True), gate_only=True) == {}


def test_streams(spark, tmp_path):
    b = bars(spark, 120)
    b.write.parquet(str(tmp_path / "bars"))
    stream = spark.readStream.schema(b.schema).parquet(str(tmp_path / "bars"))
    beats = []
    beat = live.Heartbeat(lambda *a: beats.append(a), 0)
    spark.streams.addListener(beat)
    try:
        q = live.live_features(stream, keep=100, least=60).writeStream.format("memory").queryName("lf").outputMode("append").option("checkpointLocation", str(tmp_path / "s")).trigger(availableNow=True).start()
        q.awaitTermination()
        for _ in range(100):  # reports come in a thread of their own
            if beats:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(beat)
    got = {(r.symbol, r.t): r for r in spark.table("lf").collect()}
    assert len(got) == 2 * 61 and beats
    pdf = b.where("symbol = 'a'").toPandas().sort_values("t")
    last = got["a", pdf.t.iloc[-1].to_pydatetime()]
    assert last.ret_1 == pytest.approx(pdf.c.iloc[-1] / pdf.c.iloc[-2] - 1)
    v = pdf.v.iloc[-50:].astype(float)
    assert last.tickvol_z == pytest.approx((v.iloc[-1] - v.mean()) / v.std())


def test_sources(spark, tmp_path):
    df = spark.createDataFrame([(1, 5, 0.5), (2, 6, 0.25)], "time bigint, spread_points int, spread_price double")
    writers.csv(df, str(tmp_path / "s.csv"))
    df.drop("spread_price").write.parquet(str(tmp_path / "lacks.parquet"))
    got = readers.spread_series(spark, str(tmp_path / "none.parquet"), str(tmp_path / "lacks.parquet"), str(tmp_path / "s.csv"))
    assert {tuple(r) for r in got.collect()} == {(1, 5, 0.5), (2, 6, 0.25)} and readers.spread_series(spark, str(tmp_path / "none")) is None
    a, b = df.withColumn("x", F.lit("a")), df.withColumn("x", F.lit("b")).where("time = 2")
    assert {(r.time, r.x) for r in readers.history([a, b], ["time"]).collect()} == {(1, "a"), (2, "b")}


def test_shared_folder_is_needed_on_a_cluster(spark):
    class Conf:
        def __init__(self, master):
            self.master = master

        def get(self, key, default=None):
            return self.master if key == "spark.master" else default

    class Session:
        def __init__(self, master):
            self.conf = Conf(master)

    for master in ("yarn", "spark://x:7077", "local-cluster[2,1,1024]", "k8s://x"):
        with pytest.raises(RuntimeError, match="checkpoint"):
            shared_dir(Session(master))
    assert shared_dir(spark)
