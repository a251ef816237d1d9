"""Ranks and running sums inside groups of any size.

A window over a group that holds a third of all rows is one task. Here a group
is cut by the leading digits of its order key: every slice is numbered on its
own, and a small table of slice totals gives the offset.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLICE_DIGITS = 3


def md5_order(key: str) -> Column:
    """A reproducible shuffled order; the leading digits cut a group evenly."""
    return F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary"))


def rank_in_groups(df: DataFrame, groups: list[str], order: str, ties: list[str],
                   weight: str | None = None, digits: int = SLICE_DIGITS) -> DataFrame:
    """Add ``group_rank`` (from 0) and, with ``weight``, ``weight_before``.

    ``order`` names a column of hex text (see ``md5_order``), ``ties`` settle
    equal ones. ``weight_before`` sums the weight of all earlier rows of the
    group. Null groups form a group of their own. The slice table has at most
    16**digits rows per group, whatever the number of rows.
    """
    total = F.sum(weight) if weight else F.lit(None).cast("long")
    keys = [f"_k{i}" for i in range(len(groups))]
    cut = df.withColumn("_slice", F.substring(order, 1, digits))
    for key, g in zip(keys, groups):    # a null group is a group, so "=" marks the others
        cut = cut.withColumn(key, F.coalesce(F.concat(F.lit("="), F.col(g).cast("string")),
                                             F.lit("")))
    sizes = cut.groupBy(*keys, "_slice").agg(F.count(F.lit(1)).alias("_n"), total.alias("_w"))
    before = Window.partitionBy(*keys).orderBy("_slice") \
        .rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        *keys, "_slice",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_rank0"),
        F.coalesce(F.sum("_w").over(before), F.lit(0)).alias("_weight0"))
    inner = Window.partitionBy(*keys, "_slice").orderBy(order, *ties)
    numbered = cut.withColumn("_r", F.row_number().over(inner) - 1)
    if weight:
        numbered = numbered.withColumn("_wb", F.coalesce(
            F.sum(weight).over(inner.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    out = numbered.join(offsets, [*keys, "_slice"]) \
        .withColumn("group_rank", F.col("_r") + F.col("_rank0"))
    if weight:
        out = out.withColumn("weight_before", F.col("_wb") + F.col("_weight0"))
    return out.drop(*keys, "_slice", "_r", "_wb", "_rank0", "_weight0")
