"""Readers and writers, round trip."""

import lzma
import struct

import pytest
from pyspark.sql import functions as F

from tidemark.sources import readers, writers


def test_csv_and_leg(spark, tmp_path):
    (tmp_path / "a.csv").write_text(" <DateTime> ,Close\n2024.01.01 10:00,1.5\n2024-01-01 10:00:00,1.6\n1704103500,1.7\n")
    got = readers.leg(spark, str(tmp_path / "a.csv")).orderBy("time").collect()
    assert [r.close for r in got] == [1.6, 1.7]
    (tmp_path / "b.csv").write_text("time,close\nnever,1\n")
    with pytest.raises(ValueError):
        readers.leg(spark, str(tmp_path / "b.csv"))
    (tmp_path / "c.csv").write_text("x,y\n1,2\n")
    with pytest.raises(ValueError):
        readers.csv(spark, str(tmp_path / "c.csv"))


def test_bi5(spark, tmp_path):
    at = tmp_path / "2024" / "00" / "02"
    at.mkdir(parents=True)
    (at / "13h_ticks.bi5").write_bytes(lzma.compress(struct.pack(">IIIff", 1500, 110002, 110000, 1.0, 2.0) + struct.pack(">IIIff", 2500, 0, 0, 1.0, 2.0)))
    (at / "14h_ticks.bi5").write_bytes(b"")
    r = readers.bi5(spark, str(at)).collect()
    assert len(r) == 1 and r[0].bid == 1.1 and str(r[0].time) == "2024-01-02 13:00:01.500000"


def test_calendar_logs_configs(spark, tmp_path):
    (tmp_path / "cal.csv").write_text("timestamp_utc,currency,event,impact\n2026-01-02T13:30:00Z,usd,NFP,high\n2026-01-01T10:00:00Z,EUR,CPI,HIGH\nbad,EUR,x,HIGH\n2026-01-01T10:00:00Z,JPY,x,HIGH\n2026-01-01T10:00:00Z,EUR,x,MEDIUM\n")
    assert [r.event for r in readers.calendar(spark, str(tmp_path / "cal.csv")).collect()] == ["CPI", "NFP"]
    (tmp_path / "log1.csv").write_text("open_time,pnl\n2024-01-01 10:00:00,1.5\n")
    r = readers.trade_logs(spark, str(tmp_path / "log1.csv")).first()
    assert r.tag == "log1" and (r.close_time - r.open_time).seconds == 3600
    (tmp_path / "c.json").write_text('{"id": "x", "params": {"vt": 0.5}}')
    assert readers.configs(spark, str(tmp_path / "c.json")).first().params == {"vt": "0.5"}


def test_reports_and_sinks(spark, tmp_path):
    (tmp_path / "r.htm").write_bytes("﻿Profit 1".encode("utf-16-le"))
    (tmp_path / "l.htm").write_bytes("né".encode("latin-1"))
    got = {r.path[-5]: r.text for r in readers.decode_report(spark, str(tmp_path / "*.htm")).collect()}
    assert got == {"r": "Profit 1", "l": "né"}
    df = spark.range(3).select("id", (F.col("id") / 3).alias("x"))
    writers.csv(df, str(tmp_path / "out"), compression="gzip")
    assert sorted(r.x for r in spark.read.csv(str(tmp_path / "out"), header=True).collect()) == ["0.00000", "0.33333", "0.66667"]
    writers.parquet(df, str(tmp_path / "pq"), by=["id"])
    assert spark.read.parquet(str(tmp_path / "pq")).count() == 3
    writers.artifacts({"a": df}, str(tmp_path / "art"))
    writers.ini(spark.createDataFrame([("b", "2"), ("a", "1")], "key string, value string"), str(tmp_path / "ini"))
    text = next((tmp_path / "ini").glob("part-*")).read_bytes().decode("utf-16-le")
    assert "[Tester]" in text and text.index("a=1") < text.index("b=2")
