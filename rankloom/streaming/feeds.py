"""Incremental forms: snapshot files and fetch logs as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from rankloom.operators.conform import normalize
from rankloom.operators.streaks import ROWS_PER_BLOCK, host_streaks, latch
from rankloom.schema import CANON
from rankloom.session import remove_folder
from rankloom.sources.files import path_exists


def snapshot_stream(spark: SparkSession, path: str, columns: str,
                    files_per_trigger: int = 100, distinct_within: str | None = None) -> DataFrame:
    """New snapshot files of a folder as canonical rows.

    ``distinct_within`` ("7 days") drops a row that an earlier file already brought, if
    the files' times lie no further apart; the state that remembers rows is let go
    behind that horizon. A file older than the horizon is late and left out.
    """
    raw = spark.readStream.schema(columns).option("header", True) \
        .option("maxFilesPerTrigger", files_per_trigger).csv(path)
    if distinct_within is None:
        return normalize(raw)
    arrived = raw.withColumn("_arrived", F.col("_metadata.file_modification_time"))
    return normalize(arrived, ("_arrived",)).withWatermark("_arrived", distinct_within) \
        .dropDuplicatesWithinWatermark(CANON.names).drop("_arrived")


def append_stream(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append a stream of canonical rows to a dataset.

    The Parquet sink's log makes a replayed micro-batch write once. ``checkpoint``
    is a folder that outlives the job and belongs to this stream: a restart
    goes on from it, a new folder would start again at the first batch.
    """
    return rows.select(*CANON.names).writeStream.format("parquet").outputMode("append") \
        .option("checkpointLocation", checkpoint) \
        .option("path", path).trigger(availableNow=True).start()


_HOSTS = "host string, failures int"


def _hosts(spark: SparkSession, path: str, batch: int) -> DataFrame | None:
    """The streaks that the batch before ``batch`` left; none before the first."""
    before = f"{path}/hosts/batch={batch - 1}"
    return spark.read.schema(_HOSTS).parquet(before) if batch and path_exists(spark, before) \
        else None


def latch_stream(log: DataFrame, path: str, checkpoint: str,
                 rows_per_block: int = ROWS_PER_BLOCK) -> StreamingQuery:
    """The failure latch over a stream of fetches (host, position, outcome).

    Rows with ``circuit_open`` go to ``path/rows``, the hosts' streaks after each
    micro-batch to ``path/hosts``. A micro-batch is latched like a whole log, in blocks, so
    a host may own most of it; the streaks are all that crosses to the next one.
    Positions order a micro-batch, which come in the order of arrival. A batch that is
    replayed after a failure starts from the streaks of the batch before it and
    writes its own folders anew: nothing counts twice. ``checkpoint`` as in
    ``append_stream``.
    """
    def one(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        carried = _hosts(spark, path, number)
        rows = f"{path}/rows/batch={number}"
        latch(batch.select("host", "position", "outcome"), "host", "position", "outcome",
              rows_per_block, carried).write.mode("overwrite").parquet(rows)
        latched = spark.read.schema("host string, position long, outcome string, "
                                    "circuit_open boolean").parquet(rows)
        host_streaks(latched, "host", "position", "outcome", carried) \
            .write.mode("overwrite").parquet(f"{path}/hosts/batch={number}")
        if number > 1:      # a replay needs the streaks of one batch before
            remove_folder(spark, f"{path}/hosts/batch={number - 2}")
    return log.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint) \
        .trigger(availableNow=True).start()
