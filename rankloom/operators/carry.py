"""Carry-forward over documents ("the last header seen applies to this row").

A plain ``last(ignoreNulls)`` window over a document puts the whole document in
one task, and one document may hold a third of the data. Here a document is cut
into blocks of pages. A block is small by construction (a page is one physical
page), so the window runs per block; what must cross block borders is one row
per block, and only that summary is windowed per document.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.session import deal

PAGES_PER_BLOCK = 256


def _block(page: str, pages_per_block: int) -> Column:
    return F.expr(f"`{page}` div {int(pages_per_block)}")


def in_blocks(df: DataFrame, doc: str, page: str,
              pages_per_block: int = PAGES_PER_BLOCK) -> DataFrame:
    """``df`` with its ``_block``, a block's rows in one partition.

    What is windowed by page and then carried forward is shuffled once.
    """
    return deal(df.withColumn("_block", _block(page, pages_per_block)), [doc, "_block"])


def carry_forward(df: DataFrame, doc: str, page: str, order: Sequence[str],
                  values: dict[str, Column],
                  pages_per_block: int = PAGES_PER_BLOCK) -> DataFrame:
    """Add one column per entry of ``values``: its last non-null value so far.

    Reading order is (``page``, *``order``) inside ``doc``, the row itself
    included. A column ``_block`` that ``df`` brings along (``in_blocks``) is used as it is.
    """
    blocks = df if "_block" in df.columns else df.withColumn("_block", _block(page, pages_per_block))
    marked = blocks.withColumns({f"_new_{name}": value for name, value in values.items()})
    position = [page, *order]
    inside = Window.partitionBy(doc, "_block").orderBy(*position) \
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = marked.withColumns({
        f"_local_{name}": F.last(f"_new_{name}", ignorenulls=True).over(inside)
        for name in values})

    at = F.struct(*position)
    ends = marked.groupBy(doc, "_block").agg(*[
        F.max_by(f"_new_{name}", F.when(F.col(f"_new_{name}").isNotNull(), at))
        .alias(f"_end_{name}") for name in values])
    before = Window.partitionBy(doc).orderBy("_block") \
        .rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(doc, "_block", *[
        F.last(f"_end_{name}", ignorenulls=True).over(before).alias(f"_in_{name}")
        for name in values])

    # null documents and pages are groups like any other
    joined = local.join(carried.withColumnsRenamed({doc: "_doc", "_block": "_at_block"}),
                        F.col(doc).eqNullSafe(F.col("_doc"))
                        & F.col("_block").eqNullSafe(F.col("_at_block")))
    out = joined.withColumns({
        name: F.coalesce(F.col(f"_local_{name}"), F.col(f"_in_{name}"))
        for name in values})
    return out.select(*df.columns, *values)


def heading_above(tables: DataFrame, headings: DataFrame, values: Sequence[str],
                  slack: float = 2.0) -> DataFrame:
    """Attach to each table the nearest heading above it on its own page.

    ``tables``: doc_id, page, table_idx, top. ``headings``: doc_id, page,
    line_idx, top and the ``values`` columns. A table without a heading of its
    own takes the heading of the table before it; headings move only at tables,
    so one low on a page whose table is on the next page is not picked up. Each
    value column is resolved by itself (a null value is not a heading for it).

    Both sides are laid on one vertical axis and swept, so no pairs are made.
    """
    marks = headings.select(
        "doc_id", "page", F.col("top").alias("_at"), F.lit(0).alias("_kind"),
        (-F.col("line_idx")).alias("_tie"), F.lit(None).cast("bigint").alias("table_idx"),
        F.lit(None).cast("double").alias("top"), *values)
    spots = tables.select(
        "doc_id", "page", (F.col("top") + slack).alias("_at"), F.lit(1).alias("_kind"),
        F.lit(0).alias("_tie"), F.col("table_idx").cast("bigint").alias("table_idx"),
        F.col("top").cast("double").alias("top"),
        *[F.lit(None).cast(headings.schema[v].dataType).alias(v) for v in values])
    # a page lies in one block: its rows already stand in one partition
    on_page = Window.partitionBy("doc_id", "_block", "page").orderBy("_at", "_kind", "_tie") \
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = in_blocks(marks.unionByName(spots), "doc_id", "page").withColumns({
        f"_own_{v}": F.last(v, ignorenulls=True).over(on_page) for v in values}) \
        .filter(F.col("_kind") == 1) \
        .select("doc_id", "page", "_block", "table_idx", "top", *[f"_own_{v}" for v in values])
    out = carry_forward(local, "doc_id", "page", ["table_idx"],
                        {v: F.col(f"_own_{v}") for v in values})
    return out.select("doc_id", "page", "table_idx", "top", *values)
