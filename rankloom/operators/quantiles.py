"""Exact quantiles without holding a group's rows in one task.

Rows are first folded to (group, value, count) with map-side combining. Ranks
are whole numbers no larger than the candidate pool, so what reaches the final
aggregate is at most one entry per distinct rank, however many rows a group has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def value_counts(df: DataFrame, groups: list[str], value: str) -> DataFrame:
    """(groups..., value, n) for the non-null values."""
    return df.filter(F.col(value).isNotNull()).groupBy(*groups, value) \
        .agg(F.count(F.lit(1)).alias("n"))


def weighted_percentile(value: str, p: float, weight: str = "n") -> Column:
    """Linear-interpolated percentile over value counts."""
    return F.percentile(F.col(value), F.lit(p), F.col(weight))
