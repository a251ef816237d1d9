"""De-duplication with an explicit order.

``dropDuplicates(subset)`` may keep any row, so first and last are chosen by a
``row_number`` over a stated order. A filter on ``row_number = 1`` lets Spark
put a group limit below the shuffle: every map task sends at most one row per
key, so a key that holds a third of the table costs one row per task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The key of each source kind; columns a frame lacks are ignored.
FLAT_KEY = ["Institute", "Branch", "Category", "Quota", "Gender", "Year",
            "OpeningRank", "ClosingRank"]
LAST_RANK_KEY = ["Institute", "Branch", "Category", "Gender", "Year", "ClosingRank"]
HEADED_KEY = ["Institute", "Branch", "Category", "Quota", "Year", "ClosingRank"]
STAGED_KEY = ["Institute", "Branch", "Category", "Round", "Year", "ClosingRank"]
ALLOTMENT_KEY = ["Institute", "Branch", "Category", "Year", "Round", "OpeningRank",
                 "ClosingRank"]
REPORT_KEY = ["Institute", "Branch", "Program", "Category", "Quota", "Gender", "Year",
              "Round", "OpeningRank", "ClosingRank"]
DISTIL_KEY = ["Exam", "Institute", "Branch", "Category", "Year", "OpeningRank",
              "ClosingRank"]


def _numbered(df: DataFrame, keys: Sequence, order: Sequence[Column]) -> DataFrame:
    present = [k for k in keys if not isinstance(k, str) or k in df.columns]
    window = Window.partitionBy(*present).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(window)) \
        .filter(F.col("_rn") == 1).drop("_rn")


# Column that readers add: where a row stands in its source.
POSITION = "_seq"


def position(df: DataFrame) -> list[str]:
    """The position column, where a frame has one: what a look-up side is to carry along."""
    return [POSITION] if POSITION in df.columns else []


def unique_by(df: DataFrame, keys: Sequence[str], keep: str = "last") -> DataFrame:
    """A look-up side with one row per key: equal keys cannot multiply the rows they meet.

    The ``last`` or ``first`` row by ``_seq`` stays; without that column a frame has no
    order, and the greatest or smallest row stays, so the choice is repeatable. A
    grouped aggregate folds every map task's rows of a key before the shuffle.
    """
    order = position(df)
    rest = [c for c in df.columns if c not in keys and c not in order]
    if not rest:
        return df.select(*keys).distinct()
    pick = {"first": F.min, "last": F.max}[keep]
    return df.groupBy(*keys).agg(pick(F.struct(*order, *rest)).alias("_rest")) \
        .select(*keys, *[F.col("_rest")[c].alias(c) for c in rest])


def keep_first(df: DataFrame, keys: Sequence, order: Sequence) -> DataFrame:
    """One row per key: the first in ``order``. Null keys are equal to each other."""
    return _numbered(df, keys, [F.col(o) if isinstance(o, str) else o for o in order])


def keep_last(df: DataFrame, keys: Sequence, order: Sequence[str]) -> DataFrame:
    """One row per key: the last in ``order``, as a later entry overwrites."""
    return _numbered(df, keys, [F.col(o).desc() for o in order])


def keep_best(df: DataFrame, keys: Sequence[str], order: Sequence[Column],
              n: int) -> DataFrame:
    """The ``n`` best rows per key, numbered from 1 in ``position``."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("position", F.row_number().over(window)) \
        .filter(F.col("position") <= n)


def with_file_order(df: DataFrame) -> DataFrame:
    """File name and row position of a file scan, for order across files."""
    return df.withColumns({"_file": F.col("_metadata.file_path"),
                           "_row": F.col("_metadata.row_index")})
