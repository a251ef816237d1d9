"""Connected components of an edge table, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm.tables import stored


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node hands its larger neighbours to the smallest one it knows."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")) \
        .select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").where("b != m") \
        .select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node joins its smaller neighbours, and itself, to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").where("b != m") \
        .select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def _print(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
    return row[0], row[1]


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for every end of an edge ``(a, b)`` of 64-bit ids.

    ``component`` is the smallest id that links reach. Rounds go on until the
    edges stay the same; each is written to the shared folder. A node with very
    many neighbours is met by aggregates that combine before the shuffle and by
    joins that Spark may split; no neighbour list is gathered. Edges with a null
    or equal ends are left out; no edges give no rows.
    """
    last = None
    edges = edges.select("a", "b").where("a != b")
    while True:
        edges = stored(_small_star(_large_star(edges)))
        now = _print(edges)
        if now == last or not now[0]:
            break
        last = now
    pairs = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return pairs.union(roots)
