"""Left look-ups of one row per key, for keys that are often blank."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.operators.dedup import unique_by


def look_up(df: DataFrame, key: Column, side: DataFrame, side_key: str,
            keep: str = "last") -> DataFrame:
    """``df`` with the columns of ``side`` (but its key) where ``side_key`` equals ``key``.

    Rows are neither lost nor multiplied: of several rows for a key the last (or
    first) by ``_seq`` is taken, see ``unique_by``. A blank or null key finds nothing; those rows are spread over the
    shuffle by their content, for they may be most of the table.
    """
    spread = F.concat(F.lit("\0"), F.xxhash64(*df.columns).cast("string"))
    at = F.when(F.coalesce(key, F.lit("")) != "", key).otherwise(spread)
    one = unique_by(side.filter(F.coalesce(F.col(side_key), F.lit("")) != ""), [side_key], keep) \
        .withColumnRenamed(side_key, "_side_key")
    return df.withColumn("_key", at).join(one, F.col("_key") == F.col("_side_key"), "left") \
        .drop("_key", "_side_key")
