"""First needle of a table that occurs in a text, for tables of any size.

Every needle stands under one of its own grams, the one that fewest needles share; a
text meets only the needles that stand under its grams, and then the whole needle is
looked for. No text meets every needle, and nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.operators.lookup import look_up

GRAM = 4


def _grams(text: Column, size: Column) -> Column:
    """Distinct stretches of ``size`` characters; none where the text is shorter."""
    return F.when(F.length(text) >= size, F.array_distinct(F.transform(
        F.sequence(F.lit(1), F.length(text) - size + 1), lambda i: F.substring(text, i, size))))


def first_needle(df: DataFrame, text: Column, needles: DataFrame, needle: str, priority: str,
                 gram: int = GRAM) -> DataFrame:
    """``df`` with the other columns of ``needles`` for the first needle in lower(``text``).

    First by ``priority``; of equal ones the smallest needle. Needles are taken in
    lower case; blank ones are left out, and a blank or null text finds none: its
    columns are null. Rows are neither lost nor multiplied. Equal texts are looked
    through once.
    """
    payload = [c for c in needles.columns if c not in (needle, priority)]
    known = needles.select(
        F.lower(needle).alias("_needle"), F.col(priority).alias("_priority"), *payload) \
        .filter(F.trim("_needle") != "")
    best = known.groupBy("_needle").agg(F.min(F.struct("_priority", *payload)).alias("_entry"))
    size = F.least(F.lit(gram), F.length("_needle"))
    shared = best.select("_needle", "_entry", size.alias("_size"),
                         F.explode(_grams(F.col("_needle"), size)).alias("_gram"))
    # how many needles hold a gram: a grouped count, met again by the gram
    common = shared.groupBy("_gram").agg(F.count(F.lit(1)).alias("_common"))
    rarest = Window.partitionBy("_needle").orderBy("_common", "_gram")
    anchors = shared.join(common, "_gram").withColumn("_at", F.row_number().over(rarest)) \
        .filter("_at = 1").drop("_at", "_common")

    # at most ``gram`` lengths; a text is cut only to those that needles have
    texts = df.select(F.lower(text).alias("_text")).filter(F.col("_text") != "").distinct()
    sizes = F.array(*[F.lit(n) for n in range(1, gram + 1)])
    cut = texts.select("_text", F.explode(sizes).alias("_size")) \
        .join(F.broadcast(anchors.select("_size").distinct()), "_size") \
        .select("_text", F.explode(_grams(F.col("_text"), F.col("_size"))).alias("_gram"))
    hits = cut.join(anchors.select("_needle", "_entry", "_gram"), "_gram") \
        .filter(F.contains("_text", "_needle"))
    found = hits.groupBy("_text").agg(F.min(F.struct(
        F.col("_entry")["_priority"].alias("_priority"), "_needle", "_entry")).alias("_first")) \
        .select("_text", *[F.col("_first._entry")[c].alias(c) for c in payload])
    return look_up(df, F.lower(text), found, "_text")
