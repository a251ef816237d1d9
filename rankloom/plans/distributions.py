"""Value distributions of several columns in one pass."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def value_distributions(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``column, value, n``: how often each value of each column occurs, nulls too.

    Rows are unfolded to (column, value) and counted by one grouped aggregate, which
    folds a hot value before the shuffle; the table is read once for all columns.
    """
    cells = [x for c in columns for x in (F.lit(c), F.col(c).cast("string"))]
    return df.select(F.stack(F.lit(len(columns)), *cells).alias("column", "value")) \
        .groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


def column_summary(distribution: DataFrame) -> DataFrame:
    """``column, total, distinct_values, non_blank`` from the distribution, not from the table.

    A null is no value; a blank text is a value, but not a non-blank one.
    """
    blank = F.trim(F.coalesce("value", F.lit(""))) == ""
    return distribution.groupBy("column").agg(
        F.sum("n").alias("total"), F.count("value").alias("distinct_values"),
        F.coalesce(F.sum(F.when(~blank, F.col("n"))), F.lit(0)).alias("non_blank"))


def most_common(distribution: DataFrame, column: str, n: int) -> DataFrame:
    """``value, n``: the ``n`` most common values of one column (a report), ties by value."""
    return distribution.filter((F.col("column") == column) & F.col("value").isNotNull()) \
        .select("value", "n").orderBy(F.desc("n"), "value").limit(n)
