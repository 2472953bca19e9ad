"""Sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def parquet(df: DataFrame, path: str, row_group_bytes: int = 128 << 20, by: list[str] | None = None) -> None:
    """Snappy parquet with the given row groups, partitioned by `by` (rows of a partition together first)."""
    w = (df.repartition(*by) if by else df).write.mode("overwrite").option("compression", "snappy").option("parquet.block.size", row_group_bytes)
    (w.partitionBy(*by) if by else w).parquet(path)


def csv(df: DataFrame, path: str, digits: int = 5, compression: str = "none") -> None:
    """CSV with doubles in a fixed number of decimals."""
    fixed = {n: F.format_string(f"%.{digits}f", n) for n, t in df.dtypes if t in ("double", "float")}
    df.withColumns(fixed).write.mode("overwrite").option("header", True).option("compression", compression).csv(path)


def artifacts(parts: dict[str, DataFrame], folder: str) -> None:
    """Each named table as CSV under the folder."""
    for name, df in parts.items():
        csv(df, f"{folder}/{name}")


def ini(df: DataFrame, path: str, section: str = "Tester") -> None:
    """Settings (key, value), in order of key, as one section of a UTF-16 text file: one small file for a terminal, so a single task writes its lines."""
    lines = df.select(F.concat_ws("=", "key", "value").alias("value"), "key").unionByName(df.sparkSession.range(1).select(F.lit(f"[{section}]").alias("value"), F.lit(None).cast("string").alias("key")))
    lines.coalesce(1).sortWithinPartitions(F.col("key").asc_nulls_first()).select("value").write.mode("overwrite").option("encoding", "UTF-16LE").option("lineSep", "\n").csv(path, quote="", escapeQuotes=False)
