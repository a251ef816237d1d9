"""Intermediate tables in the shared folder, Arrow map jobs and checked broadcasts."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.session import tune

# Rows and bytes per Arrow batch: long texts must not pile up in a Python worker.
ROWS_PER_BATCH = "512"
BYTES_PER_BATCH = "4m"


def prepare(spark: SparkSession) -> SparkSession:
    """Session settings that the operators rely on."""
    tune(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ROWS_PER_BATCH)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BYTES_PER_BATCH)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; set here only where it is unset.

    Unset, the warehouse folder is used: Spark shares it between driver and
    executors, unlike a temporary folder.
    """
    conf = spark.conf.get("spark.checkpoint.dir", None) \
        or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not conf:
        conf = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_work"
        spark.conf.set("spark.checkpoint.dir", conf)
    return conf


def stored(df: DataFrame, *by: str) -> DataFrame:
    """Write ``df`` to a new folder of the shared directory and read it back.

    Cuts the lineage with a copy that outlives any executor. ``by`` names
    partition columns, so that several outputs of one pass are read apart.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    writer = df.write.mode("error")
    (writer.partitionBy(*by) if by else writer).parquet(path)
    # stated schema: nothing is inferred, and a table without rows keeps its columns
    return spark.read.schema(df.schema).parquet(path)


def crc_slot(key: str | Column, modulus: int) -> Column:
    """crc32 of a value's text, modulo ``modulus``."""
    column = F.col(key) if isinstance(key, str) else key
    return F.crc32(column.cast("string").cast("binary")) % modulus


def texts_of(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null is the empty text."""
    return [b if b is not None else b"" for b in column.cast(pa.binary()).to_pylist()]


def map_batches(df: DataFrame, schema: str,
                function: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]) -> DataFrame:
    """``function`` over every Arrow batch of ``df``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from function(batch)
    return df.mapInArrow(run, schema)
