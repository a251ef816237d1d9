"""Session defaults."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    # the JVM never compiles methods above 8000 bytes; let Spark split them
    "spark.sql.codegen.hugeMethodLimit": "8000",
}
# Settings of DEFAULTS that a running session accepts.
_RUNTIME = ["spark.sql.codegen.hugeMethodLimit",
            "spark.sql.adaptive.forceOptimizeSkewedJoin"]


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime defaults to a session built elsewhere, where left unset."""
    chosen = {k for k, _ in spark.sparkContext.getConf().getAll()}
    for key in _RUNTIME:
        if key not in chosen:
            spark.conf.set(key, DEFAULTS[key])
    return spark


def spread(df: DataFrame) -> DataFrame:
    """The rows dealt out to all cores, before rules that cost much per row.

    Spark splits files by bytes and never inside a row group, so a compact table is
    read in a task or two however much work each of its rows gives.
    """
    return df.repartition(_shares(df))


def deal(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of equal keys brought together, in as many partitions as a shuffle has."""
    return df.repartition(_shares(df), *keys)


def _shares(df: DataFrame) -> int:
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")),
               spark.sparkContext.defaultParallelism)


def shared_folder(spark: SparkSession) -> str:
    """A new folder name below the one that driver and executors share.

    That is ``spark.checkpoint.dir`` or, where it is unset, the warehouse.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) \
        or spark.sparkContext.getConf().get("spark.checkpoint.dir") \
        or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_work"
    return f"{base}/{uuid.uuid4().hex}"


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder of this library's own making, on whatever store it lies."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)


def build_session(app: str = "rankloom", master: str | None = None,
                  **overrides: str) -> SparkSession:
    """A session with the library defaults; ``overrides`` use ``_`` for ``.``."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    for key, value in overrides.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()
