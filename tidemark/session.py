"""Session helpers: table access and the shared folder for written intermediates."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def configure(spark: SparkSession) -> None:
    """Session settings the engine relies on.

    The JVM never compiles a method of over 8000 bytes; a generated stage above that runs interpreted, many
    times slower. With this limit Spark splits such stages into smaller methods instead.
    """
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table `name` under `sf_dir`; columns and filters are pushed down by Catalyst."""
    configure(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: `spark.checkpoint.dir` of the session.

    Only where that is unset and everything runs in one process (tests, a laptop) a local folder is made and set for the session; it is removed when Python ends. On a
    cluster a local folder would be another one on each machine: RuntimeError.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        master = spark.conf.get("spark.master", "")
        if not re.fullmatch(r"local(\[[\d*, ]+\])?", master):
            raise RuntimeError(f"spark.checkpoint.dir must name a folder all executors share (master {master!r})")
        folder = tempfile.mkdtemp(prefix="tidemark-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        at = f"file://{folder}"
        spark.conf.set("spark.checkpoint.dir", at)
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


_MADE: list[tuple[SparkSession, str]] = []


def scratch(spark: SparkSession, what: str) -> str:
    """A fresh path in the shared folder, for one written intermediate. It lasts until `release`, at the latest to the end of this Python process."""
    path = f"{shared_dir(spark)}/tidemark-{what}-{uuid.uuid4().hex}"
    if not _MADE:
        atexit.register(release)  # registered after the session's own, so it runs before the session ends
    _MADE.append((spark, path))
    return path


def release() -> None:
    """Delete the intermediates written so far. Results that are not collected or written by then are lost, for they read them."""
    while _MADE:
        spark, path = _MADE.pop()
        try:
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # the session is gone: what lies in it cannot be reached any more
            if path.startswith(("file://", "/")):
                shutil.rmtree(path.removeprefix("file://"), ignore_errors=True)


def written(df: DataFrame, what: str, path: str | None = None) -> DataFrame:
    """Write `df` once and read it back: lineage ends there, and a lost executor costs only a re-read."""
    spark = df.sparkSession
    path = path or scratch(spark, what)
    df.write.mode("append").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
