"""Round trips through files: what a sink writes, its reader gives back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.catalogue.bridge import (
    CANON_LIST, canonical, canonical_for_distinct, table, with_star,
)
from rankloom.catalogue.exams import SEGMENT_SQL, exam_sheets
from rankloom.catalogue.registry import query
from rankloom.operators.conform import deliverable
from rankloom.operators.dedup import keep_first
from rankloom.plans import ingest, segmentation
from rankloom.schema import CANON, RAW, SNAPSHOT_COLUMNS, deliverable_columns
from rankloom.session import shared_folder
from rankloom.sources.files import (
    read_canonical, read_raw_tables, read_segmentation, read_snapshot, read_text_csv,
)
from rankloom.sources.registry import SourceMeta, SourceRegistry, SourceSpec


@query("canonical_store", with_star(f"SELECT {CANON_LIST} FROM star"))
def canonical_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written by year, appended to, and read back."""
    path = shared_folder(spark)
    rows = canonical(spark, sf_dir)
    ingest.write_canonical(rows.filter("Year < 1996"), path, by_year=True)
    ingest.append(rows.filter("Year >= 1996"), path, by_year=True)
    return read_canonical(spark, path)


@query("deliverable_store", with_star("SELECT DISTINCT " + ", ".join(
    f'CAST("{c}" AS VARCHAR) AS "{label}"' for c, label in deliverable_columns(True)) + " FROM star"))
def deliverable_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The client's table as text files."""
    path = shared_folder(spark)
    ingest.write_csv(deliverable(canonical_for_distinct(spark, sf_dir), True), path)
    return read_text_csv(spark, path, [label for _, label in deliverable_columns(True)],
                         multi_line=False)


@query("snapshot_store", with_star("SELECT " + ", ".join(
    f'CAST("{c}" AS VARCHAR) AS "{c}"' for c in SNAPSHOT_COLUMNS) + " FROM star"))
def snapshot_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compressed snapshot files, missing values as their token."""
    path = shared_folder(spark)
    rows = canonical(spark, sf_dir).select(*[
        F.coalesce(F.col(c).cast("string"), F.lit("NA")).alias(c) for c in SNAPSHOT_COLUMNS])
    rows.write.option("header", True).option("escape", '"').option("compression", "gzip").csv(path)
    return read_snapshot(spark, path)


@query("segmentation_store", f"""
  WITH {SEGMENT_SQL} SELECT exam, category, status AS cutoff_status, homepage, shiksha,
    CASE WHEN shiksha <> '' THEN 1 ELSE 0 END AS n_competitor_links,
    c_custkey % 5 = 1 AS prose_cutoff_url, folded AS jee_remapped FROM seg""")
def segmentation_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The partition written as text and typed back."""
    path = shared_folder(spark)
    ingest.write_csv(segmentation.segment(*exam_sheets(spark, sf_dir), jee_remap=True), path)
    return read_segmentation(spark, path).select(
        "exam", "category", "cutoff_status", "homepage", "shiksha", "n_competitor_links",
        "prose_cutoff_url", "jee_remapped")


@query("raw_store", """
  SELECT p_name AS exam, min(CASE WHEN p_partkey % 2 = 0 THEN p_partkey ELSE 10000000 + p_partkey END)
    % 10000000 AS closing_rank FROM part GROUP BY 1""")
def raw_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw tables in two folders: the first row in file order stays."""
    path = shared_folder(spark)
    part = table(spark, sf_dir, "part")
    for name, kept in (("a", "p_partkey % 2 = 0"), ("b", "p_partkey % 2 = 1")):
        given = {"exam": F.col("p_name"), "closing_rank": F.col("p_partkey")}
        part.filter(kept).repartition(1).sortWithinPartitions("p_partkey").select(*[
            given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in RAW.fields]) \
            .write.parquet(f"{path}/{name}")
    rows = read_raw_tables(spark, f"{path}/*")
    return keep_first(rows, ["exam"], ["_file", "_row"]).select("exam", "closing_rank")


_SNAPSHOT, _FRESH = "Year < 1995", "Year >= 1995"
# the columns that no enrichment fills
_GIVEN = [c for c in CANON.names if c not in ("City", "Program", "CategoryGroup")]


@query("refresh_fallback", with_star("SELECT DISTINCT " + ", ".join(f'"{c}"' for c in _GIVEN)
                                     + """ FROM star
  WHERE CASE WHEN "Body" IN ('ASIA', 'EUROPE') THEN "Year" >= 1995 ELSE "Year" < 1995 END"""))
def refresh_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source per region; refreshes that are empty or break midway leave the snapshot.

    Two regions refresh, one has nothing new, one breaks on a row of its last
    partition when all others are written, and one breaks before it reads.
    """
    rows = canonical(spark, sf_dir)
    registry = SourceRegistry()

    def latest(body: str, fresh: DataFrame):
        if body == "AFRICA":
            return fresh.limit(0)
        if body == "AMERICA":
            broken = F.when(F.col("Year") == 1997, F.raise_error(F.lit("torn page")))
            return fresh.repartitionByRange(4, "Year").withColumn("Branch", F.coalesce(
                broken.cast("string"), "Branch"))
        return fresh.select("no such column") if body == "MIDDLE EAST" else fresh

    for body in ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"):
        mine = rows.filter(F.col("Body") == body)
        registry.register(SourceSpec(
            SourceMeta(body, body, "UG"), lambda _, m=mine: m.filter(_SNAPSHOT),
            lambda _, b=body, m=mine: latest(b, m.filter(_FRESH))))
    loaded = ingest.load_all(spark, registry.all(), "latest", shared_folder(spark))
    return ingest.union_rows(spark, loaded).select(*_GIVEN)
