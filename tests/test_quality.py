"""Grid, intervals, medians, profile and implausible readings against plain Python."""

import random
from collections import defaultdict
from statistics import median

from pyspark.sql import functions as F

from tidemark.operators import grid, implausible, intervals, profile
from tidemark.operators.selection import exact_median


def test_open_slots_round_trip(spark):
    df = spark.range(0, 5000).select((F.col("id") * 300 + 1_700_000_100 - 1_700_000_100 % 300).alias("s"))
    for always in (True, False):
        a = F.lit(always)
        got = df.withColumn("i", grid.open_index(F.col("s"), a)).where("i IS NOT NULL").withColumn("b", grid.open_slot(F.col("i"), a)).orderBy("s").collect()
        assert all(r.s == r.b for r in got)
        assert [r.i for r in got] == list(range(got[0].i, got[0].i + len(got)))


def test_grid(spark, monkeypatch):
    monkeypatch.setattr(grid, "BLOCK", 16)
    monkeypatch.setattr(grid, "CHUNK", 4)
    random.seed(3)
    rows = [(k, random.randrange(200) if random.random() < 0.9 else None, float(random.randrange(50)), i) for i in range(120) for k in ("a", "b", None)] + [("one", 5, 1.0, 1)]
    df = spark.createDataFrame(rows, "k string, i bigint, v double, o int").withColumn("status", F.lit("clash"))
    bounds = spark.createDataFrame([("a", -3, 210), ("b", 0, 0), ("zz", 0, 9)], "k string, first_index bigint, last_index bigint")
    got = grid.regular_grid(df, ["k"], "i", {"v": "linear"}, order=["o", "v"], max_interpolated=2, bounds=bounds).collect()
    by = defaultdict(dict)
    for r in got:
        assert r["index"] not in by[r.k]
        by[r.k][r["index"]] = r
    for key in ("a", "b", None, "one"):
        have = {}
        for k, i, v, o in rows:
            if k == key and i is not None and (i not in have or (o, v) > have[i]):
                have[i] = (o, v)
        lo, hi = min(have), max(have)
        want = set(range(lo, hi + 1)) | (set(range(-3, lo)) | set(range(hi + 1, 211)) if key == "a" else set(range(0, lo)) if key == "b" else set())
        assert set(by[key]) == want
        for i, r in by[key].items():
            if i in have:
                assert (r.status, r.v) == ("filled", have[i][1])
            elif lo < i < hi:
                a, z = max(x for x in have if x < i), min(x for x in have if x > i)
                assert r.gap_cells == z - a - 1
                if z - a - 1 <= 2:
                    assert r.status == "interpolated" and abs(r.v - (have[a][1] + (have[z][1] - have[a][1]) * (i - a) / (z - a))) < 1e-9
                else:
                    assert r.status == "empty" and r.v is None
            else:
                assert r.status == ("before" if i < lo else "after")


def test_intervals(spark):
    random.seed(5)
    rows = []
    for k in ("a", "b", None):
        for _ in range(150):
            s = random.randrange(3000)
            rows.append((k, s if random.random() < 0.95 else None, s + random.randrange(-5, 40) if random.random() < 0.95 else None))
    df = spark.createDataFrame(rows + rows[:30], "k string, s bigint, e bigint")
    got = sorted(map(tuple, intervals.periods_and_gaps(df, ["k"], "s", "e", chunk=100).collect()), key=repr)
    want = []
    for k in ("a", "b", None):
        cur = None
        for s, e in sorted({(s, e) for kk, s, e in rows if kk == k and s is not None and e is not None and e > s}):
            if cur and s <= cur[1]:
                cur[1] = max(cur[1], e)
                continue
            if cur:
                want += [(k, "period", *cur), (k, "gap", cur[1], s)]
            cur = [s, e]
        want.append((k, "period", *cur))
    assert got == sorted(want, key=repr)
    assert intervals.periods_and_gaps(df.limit(0), ["k"], "s", "e").count() == 0


def test_exact_median(spark):
    random.seed(7)
    rows = [(k, random.choice([random.gauss(0, 1), 0.0, -2.5, 1e-9, None, float("nan")])) for k in ("a", "b", None) for _ in range(301)] + [("c", 4.0), ("d", None)]
    got = {r.k: (r.median, r.n) for r in exact_median(spark.createDataFrame(rows, "k string, v double"), ["k"], "v").collect()}
    want = {}
    for k in ("a", "b", None, "c"):
        v = [x for kk, x in rows if kk == k and x is not None and x == x]
        want[k] = (median(v), len(v))
    assert got == want


def test_profile(spark):
    rules = spark.createDataFrame([("x", r"^[0-9]+(\.[0-9]+)?$", 0.0, 10.0)], "column_name string, value_pattern string, min_value double, max_value double")
    rows = [("h", 1, v) for v in ("1", "2.0", "3", "4")] + [("h", 2, v) for v in ("2", "2.00", "n/a", None)] + [("h", 3, v) for v in ("20", "5", "5", "6")] + [("g", 2, None), (None, 1, "3"), (None, 1, "4")]
    df = spark.createDataFrame(rows, "harvester string, load_no int, x string").withColumn("column_name", F.lit(1))
    got = {(r.harvester, r.load_no, r.finding) for r in profile.findings(df, rules).collect()}
    assert got == {("h", 2, "pattern"), ("h", 2, "nulls"), ("h", 2, "distinct"), ("h", 3, "range"), ("h", 3, "shift")}
    p = {(r.harvester, r.load_no): r for r in profile.profile_loads(df, rules).collect()}
    assert (p["h", 2].distinct_values, p["h", 2].distinct_numbers, p["h", 2].median, p["h", 2].nulls) == (3, 1, 2.0, 1)
    assert p[None, 1].median == 3.5
    assert p["g", 2].median is None and p["g", 2].distinct_numbers == 0
    assert profile.stability_index(df, rules).count() == 2
    assert profile.findings(df.limit(0), rules).count() == 0


def test_implausible(spark):
    random.seed(11)
    day = implausible.CHUNK_MS
    rows, want = [], set()
    for s in ("a", "b"):
        for i in range(400):
            rows.append([len(rows), "f", s, i * day // 40, random.choice([1.0, 1.1, 1.2, 0.9])])
        base = len(rows) - 400
        for i in range(30, 52):  # a run over a chunk's edge
            rows[base + i][4] = 7.0
            want.add(base + i)
        for i in range(100, 107):  # seven: not enough
            rows[base + i][4] = 1.3
        for i, v in ((200, 50.0), (210, 0.0), (220, -1.0)):
            rows[base + i][4] = v
            want.add(base + i)
        for i in (300, 301):  # no time: only by value
            rows[base + i][3] = None
        rows[base + 300][4] = 99.0
        want.add(base + 300)
    rows.append([len(rows), "f", "none", 0, None])
    df = spark.createDataFrame([(*r, None) for r in rows], "trade_id bigint, feed string, symbol string, t_ms bigint, spread_at_fill double, exit_reason string")
    assert {r.trade_id for r in implausible.implausible_spreads(df).collect()} == want
    assert implausible.implausible_spreads(df.limit(0)).count() == 0


def test_phase_space_over_chunk_edges(spark):
    """Differences are those of the whole series, whatever the chunks; nulls and chunks of a single row included."""
    random.seed(5)
    day = implausible.CHUNK_MS
    rows = [(i, "f", s, t, random.choice([1.0, 2.5, None, 4.0])) for s in ("a", "b") for i, t in enumerate(sorted(random.randrange(12 * day) for _ in range(60)), 100 * (s == "b"))]
    df = spark.createDataFrame([(*r, True) for r in rows], "id bigint, feed string, symbol string, t bigint, x double, ok boolean")
    keys = ["feed", "symbol"]
    got = {r.id: (r._d1, r._d2) for r in implausible.with_heads(implausible.phase_space(df, keys, "id", "t", "x", ["x"], "ok", []), keys, "x").collect()}
    for s in ("a", "b"):
        v = [r for r in rows if r[2] == s]
        for i, r in enumerate(v):
            x, x1, x2 = r[4], v[i - 1][4] if i else None, v[i - 2][4] if i > 1 else None
            d1 = None if x is None or x1 is None else x - x1
            d2 = None if d1 is None or x2 is None else x - 2 * x1 + x2
            assert got[r[0]] == (d1, d2), (s, i)


def test_ellipsoid_decides(spark, monkeypatch):
    """Candidates are few and hold every case; a reading the phase-space stage does not name is no spike."""
    random.seed(6)
    rows = [(i, "f", "a", i * 300_000, 1 + random.random() / 4 + (20 if i % 97 == 5 else 0), None) for i in range(3000)]
    df = spark.createDataFrame(rows, "trade_id bigint, feed string, symbol string, t_ms bigint, spread_at_fill double, exit_reason string")
    made = implausible.candidates
    seen = []
    monkeypatch.setattr(implausible, "candidates", lambda *a: seen.append(made(*a)) or seen[-1])
    spikes = {r.trade_id for r in implausible.implausible_spreads(df).where("spike").collect()}
    assert spikes == {i for i in range(3000) if i % 97 == 5}
    near = {r.trade_id for r in seen[0].collect()}
    assert spikes <= near and len(near) < 300
    monkeypatch.setattr(implausible, "candidates", lambda *a: made(*a).where("trade_id < 1000"))
    assert {r.trade_id for r in implausible.implausible_spreads(df).where("spike").collect()} == {i for i in spikes if i < 1000}
