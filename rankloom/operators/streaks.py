"""Failure streaks per host with a latch (a circuit that stays open).

A host opens at its third failure in a row; a success clears the count, an empty
answer leaves it. Everything after the opening row is not tried. One host may
own a third of the log, so the log is cut into blocks of positions: the sweep
runs inside blocks, and one summary row per block crosses the borders.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LIMIT = 3
ROWS_PER_BLOCK = 1 << 16


def _hits(log: DataFrame, host: str, position: str, status: str,
          carried: DataFrame | None) -> DataFrame:
    """``_host, _pos, _err`` of answers and failures; carried failures stand before all."""
    hits = log.filter(F.col(status).isin("ok", "error")).select(
        F.col(host).alias("_host"), F.col(position).cast("long").alias("_pos"),
        (F.col(status) == "error").cast("int").alias("_err"))
    if carried is None:
        return hits
    # at most LIMIT rows per host
    before = carried.filter(F.col("failures") > 0).select(
        F.col(host).alias("_host"), F.explode(F.sequence(
            -F.least(F.col("failures"), F.lit(LIMIT)).cast("long"), F.lit(-1).cast("long")))
        .alias("_pos"), F.lit(1).alias("_err"))
    return hits.unionByName(before)


def opening_positions(log: DataFrame, host: str, position: str, status: str,
                      rows_per_block: int = ROWS_PER_BLOCK,
                      carried: DataFrame | None = None) -> DataFrame:
    """(host, opened_at): the position of the failure that opens the host.

    Positions count from 0. ``carried`` (host, failures) is what an earlier log left
    behind, see ``host_streaks``; a host that was open then opens before position 0.
    """
    hits = _hits(log, host, position, status, carried).withColumn(
        "_block", F.expr(f"_pos div {int(rows_per_block)}"))

    so_far = Window.partitionBy("_host", "_block").orderBy("_pos")
    running = hits.withColumn(
        "_oks", F.sum(1 - F.col("_err")).over(so_far.rowsBetween(Window.unboundedPreceding, 0)))
    island = Window.partitionBy("_host", "_block", "_oks").orderBy("_pos")
    streaks = running.withColumn(
        "_streak", F.sum("_err").over(island.rowsBetween(Window.unboundedPreceding, 0)))

    # per block: where it opens by itself, its leading failures, its trailing streak
    lead = (F.col("_oks") == 0) & (F.col("_err") == 1)
    blocks = streaks.groupBy("_host", "_block").agg(
        F.min(F.when(F.col("_streak") >= LIMIT, F.col("_pos"))).alias("_inner"),
        *[F.min(F.when(lead & (F.col("_streak") == k), F.col("_pos"))).alias(f"_lead{k}")
          for k in range(1, LIMIT)],
        F.max("_oks").alias("_any_ok"),
        F.max_by("_streak", "_pos").alias("_tail"))

    # streak carried into each block: trailing streak of the last block with a
    # success plus all failures of the failure-only blocks since
    before = Window.partitionBy("_host").orderBy("_block")
    runs = blocks.withColumn("_run", F.sum((F.col("_any_ok") > 0).cast("int")).over(
        before.rowsBetween(Window.unboundedPreceding, 0)))
    within = Window.partitionBy("_host", "_run").orderBy("_block") \
        .rowsBetween(Window.unboundedPreceding, 0)
    carried = runs.withColumn("_after", F.sum("_tail").over(within)) \
        .withColumn("_before", F.coalesce(F.lag("_after").over(before), F.lit(0)))
    entered = F.coalesce(*[
        F.when(F.col("_before") >= LIMIT - k, F.col(f"_lead{k}"))
        for k in range(1, LIMIT)])
    return carried.select("_host", F.least(entered, F.col("_inner")).alias("_open")) \
        .groupBy("_host").agg(F.min("_open").alias("opened_at")) \
        .filter(F.col("opened_at").isNotNull()) \
        .select(F.col("_host").alias(host), "opened_at")


def latch(log: DataFrame, host: str, position: str, status: str,
          rows_per_block: int = ROWS_PER_BLOCK, carried: DataFrame | None = None) -> DataFrame:
    """``log`` with ``circuit_open``: true for rows past their host's opening."""
    opened = opening_positions(log, host, position, status, rows_per_block, carried)
    return log.join(opened, host, "left") \
        .withColumn("circuit_open", F.coalesce(F.col(position) > F.col("opened_at"),
                                               F.lit(False))) \
        .drop("opened_at")


def host_streaks(latched: DataFrame, host: str, position: str, status: str,
                 carried: DataFrame | None = None) -> DataFrame:
    """(host, failures): failures in a row at the end of a latched log, LIMIT where open.

    Hosts without failures are left out; those of ``carried`` that the log does not
    mention stay. A host's last LIMIT answers decide: they are numbered from the end,
    so every map task sends at most LIMIT rows per host.
    """
    tried = latched.filter(~F.col("circuit_open"))
    latest = Window.partitionBy("_host").orderBy(F.desc("_pos"))
    last = _hits(tried, host, position, status, carried) \
        .withColumn("_back", F.row_number().over(latest)).filter(F.col("_back") <= LIMIT)
    return last.groupBy(F.col("_host").alias(host)).agg(F.coalesce(
        F.min(F.when(F.col("_err") == 0, F.col("_back"))) - 1, F.count(F.lit(1)))
        .cast("int").alias("failures")).filter(F.col("failures") > 0)
