"""Readers: every source becomes a lazy DataFrame with declared types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.bars import dedup

TICK = T.StructType([T.StructField("time", T.TimestampType()), T.StructField("bid", T.DoubleType()), T.StructField("ask", T.DoubleType()), T.StructField("last", T.DoubleType()), T.StructField("volume", T.LongType()), T.StructField("flags", T.IntegerType())])
# Names under which a time column is looked for, in this order.
TIME_NAMES = ["time", "datetime", "timestamp", "date"]
# Spellings tried for a printed time.
TIME_FORMATS = ["yyyy-MM-dd HH:mm:ss[.SSSSSS]", "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]", "yyyy.MM.dd HH:mm:ss", "yyyy.MM.dd HH:mm", "yyyy-MM-dd HH:mm", "yyyy-MM-dd"]


def ticks(spark: SparkSession, *paths: str) -> DataFrame:
    """Tick shards (files, folders or globs) with mid and spread; columns not asked for later are not read."""
    t = spark.read.schema(TICK).parquet(*paths)
    return t.withColumns({"mid": (F.col("bid") + F.col("ask")) * 0.5, "spread": (F.col("ask") - F.col("bid")).cast("float")})


def parse_time(c: Column) -> Column:
    """Printed time, or epoch seconds, -> timestamp; null if no spelling fits."""
    return F.coalesce(*(F.try_to_timestamp(c, F.lit(f)) for f in TIME_FORMATS), F.timestamp_seconds(c.try_cast("bigint")))


def csv(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """CSV with names trimmed and lower-cased, the time column found by name and parsed as `time`, all else double where it is a number in every row's schema sense (nulls where not).

    Rows whose time fits no spelling have a null time. Without a time column ValueError is raised.
    """
    raw = spark.read.csv(path, header=True, sep=sep, inferSchema=False)
    df = raw.toDF(*(c.strip().strip("<>").lower() for c in raw.columns))
    found = next((n for n in TIME_NAMES if n in df.columns), None) or next((c for c in df.columns if "date" in c or "time" in c), None)
    if found is None:
        raise ValueError(f"no time column among {df.columns}")
    return df.select(parse_time(F.col(found)).alias("time"), *(F.col(c).try_cast("double").alias(c) for c in df.columns if c != found))


def leg(spark: SparkSession, path: str) -> DataFrame:
    """Close series of one leg, the last row of a time kept. ValueError without a close column, for times that cannot be read and for closes not above 0."""
    df = csv(spark, path)
    if "close" not in df.columns:
        raise ValueError("no close column")
    df = df.withColumn("_n", F.monotonically_increasing_id())
    bad = df.agg(F.count_if(F.col("time").isNull()).alias("t"), F.count_if(~F.coalesce(F.col("close") > 0, F.lit(False))).alias("c")).first()
    if bad.t or bad.c:
        raise ValueError(f"{bad.t} times cannot be read, {bad.c} closes are not above 0")
    return dedup(df, ["time"], ["_n"], "last").select("time", "close")


def trade_logs(spark: SparkSession, *paths: str) -> DataFrame:
    """Trade-log CSVs, tagged with the file they came from; close_time missing is an hour after open_time."""
    df = spark.read.csv(list(paths), header=True, inferSchema=False).withColumn("tag", F.regexp_extract(F.input_file_name(), r"([^/]+?)(\.csv)?$", 1))
    for need in ("open_time", "pnl"):
        if need not in df.columns:
            raise ValueError(f"no column {need}")
    opened = parse_time(F.col("open_time"))
    closed = parse_time(F.col("close_time")) if "close_time" in df.columns else F.lit(None).cast("timestamp")
    return df.withColumns({"open_time": opened, "close_time": F.coalesce(closed, opened + F.expr("interval 1 hour")), "pnl": F.col("pnl").try_cast("double")})


def calendar(spark: SparkSession, path: str, impacts: tuple = ("HIGH",), currencies: tuple = ("EUR", "USD")) -> DataFrame:
    """Events (ts, currency, event) of a CSV calendar (timestamp_utc, currency, event, impact): high impact, given currencies, readable times, in order of time."""
    df = spark.read.csv(path, header=True)
    df = df.where(F.upper(F.trim("impact")).isin(*impacts) & F.upper(F.trim("currency")).isin(*currencies))
    return df.select(parse_time(F.regexp_replace("timestamp_utc", "Z$", "")).alias("ts"), F.upper(F.trim("currency")).alias("currency"), "event").where("ts IS NOT NULL").orderBy("ts")


def configs(spark: SparkSession, path: str) -> DataFrame:
    """Strategy configurations {id, params} of JSON files, params as a map of text."""
    return spark.read.text(path, wholetext=True).select(F.from_json("value", "id string, params map<string,string>").alias("c")).select("c.*")


def bi5(spark: SparkSession, path: str, divisor: float = 1e5, low: float = 0.0, high: float = float("inf")) -> DataFrame:
    """Ticks of LZMA-packed hour files: big-endian records (ms, ask, bid, ask volume, bid volume). The hour is read from the path (.../yyyy/mm/dd/hhh_ticks.bi5, months from 00).

    Prices outside (low, high) are dropped; empty files have no ticks. One file is one hour, so a task decodes whole files.
    """

    def decode(batches):
        import lzma

        import numpy as np
        import pandas as pd

        kind = np.dtype([("ms", ">u4"), ("ask", ">u4"), ("bid", ">u4"), ("av", ">f4"), ("bv", ">f4")])
        for b in batches:
            for p, content in zip(b["path"], b["content"]):
                if content:
                    r = np.frombuffer(lzma.decompress(content), dtype=kind)
                    yield pd.DataFrame({"path": p, "ms": r["ms"].astype("int64"), "bid": r["bid"] / divisor, "ask": r["ask"] / divisor, "volume": (r["av"] + r["bv"]).astype("float64")})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    rows = files.mapInPandas(decode, "path string, ms bigint, bid double, ask double, volume double")
    part = lambda i: F.regexp_extract("path", r"(\d{4})/(\d\d)/(\d\d)/(\d\d)h", i).cast("int")
    start = F.make_timestamp(part(1), part(2) + 1, part(3), part(4), F.lit(0), F.lit(0))
    return rows.where((F.col("bid") > low) & (F.col("bid") < high)).select(F.timestamp_millis(F.unix_millis(start) + F.col("ms")).alias("time"), "bid", "ask", "volume")


def decode_report(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of report files in UTF-16 (by its mark, or little-endian without one, told by a first letter of two bytes), UTF-8 or Latin-1."""
    f = spark.read.format("binaryFile").load(path)
    head = F.hex(F.substring("content", 1, 2))
    wide = F.decode("content", "UTF-16")
    narrow = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string")).otherwise(F.decode("content", "ISO-8859-1"))
    return f.select("path", F.regexp_replace(F.when(head.isin("FFFE", "FEFF"), wide).when(head.endswith("00") & (F.octet_length("content") % 2 == 0), F.decode("content", "UTF-16LE")).otherwise(narrow), "^\\x{FEFF}", "").alias("text"))


def _there(spark: SparkSession, path: str) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


def spread_series(spark: SparkSession, *paths: str) -> DataFrame | None:
    """(time, spread_points, spread_price) of the first of `paths` that is there and can be read: parquet, or CSV by its ending; None if none is. Types are declared, so a file that lacks a column fails over, too."""
    kinds = "time bigint, spread_points int, spread_price float"
    need = ["time", "spread_points", "spread_price"]
    for p in paths:
        if not _there(spark, p):
            continue
        df = spark.read.csv(p, header=True, inferSchema=False) if p.lower().endswith((".csv", ".csv.gz")) else spark.read.parquet(p)
        if set(need) <= set(df.columns):
            return df.select(*(F.col(n).cast(t).alias(n) for n, t in (x.split() for x in kinds.split(", "))))
    return None


def history(chunks: list[DataFrame], key: list[str]) -> DataFrame:
    """Chunks of a history that overlap at their ends, put together: one row per key, that of the later chunk. Null keys form one key; chunks may lack columns."""
    out = None
    for i, c in enumerate(chunks):
        c = c.withColumn("_chunk", F.lit(i)).withColumn("_row", F.xxhash64(*c.columns))
        out = c if out is None else out.unionByName(c, allowMissingColumns=True)
    return dedup(out, key, ["_chunk", "_row"], "last").drop("_chunk", "_row")
