"""The exam catalog: classification plus five overlays, as one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.functions.classify import (
    exam_category, exam_level, exam_reference, exam_state, probe_status,
)
from rankloom.functions.embedded import unescape
from rankloom.functions.text import catalog_text, strip
from rankloom.operators.dedup import position
from rankloom.operators.lookup import look_up
from rankloom.operators.needles import first_needle
from rankloom.schema import CATALOG_COLUMNS, LINK_COLUMNS
from rankloom.session import spread


def build_catalog(universe: DataFrame, probe: DataFrame | None = None,
                  extras: DataFrame | None = None, enrichment: DataFrame | None = None,
                  overlay: DataFrame | None = None, reference: DataFrame | None = None,
                  ) -> DataFrame:
    """Catalog of the universe (Exam, Homepage, CutoffURL).

    ``reference`` (needle, priority, body, metric, applicants, seats) replaces the
    built-in reference list by a table of any size.

    Of several rows for a key the first of ``probe`` (url, bucket) is taken and the last
    of ``enrichment`` and ``overlay``, by the position ``_seq`` that readers add; see
    the ``apply_*`` steps for what each may change.
    """
    columns = ["Exam", "Homepage", "CutoffURL"]
    base = spread(universe.select(*columns)).select(
        *[catalog_text(F.col(c)).alias(c) for c in columns])
    ref = base.select("*", exam_category(F.col("Exam")).alias("Category"),
                      exam_level(F.col("Exam")).alias("Level"),
                      exam_state(F.col("Exam")).alias("State"))
    ref = ref.withColumn("_ref", exam_reference(F.col("Exam"))) if reference is None \
        else apply_reference(ref, reference)
    out = apply_probe(ref, probe) if probe is not None else ref.withColumns(
        {"DataFormat": F.lit("unknown"), "Scrapeable": F.lit("unknown")})
    out = out.withColumns({
        "Body": F.col("_ref.body"), "Metric": F.col("_ref.metric"),
        "Applicants": F.col("_ref.applicants"), "Seats": F.col("_ref.seats"),
        "Notes": F.lit(""), "Acronym": F.lit("")}).drop("_ref")
    out = apply_extras(out, extras)
    if enrichment is not None:
        out = apply_enrichment(out, enrichment)
    if overlay is not None:
        out = apply_overlay(out, overlay)
    return out.select(*CATALOG_COLUMNS).orderBy("Category", "Exam")


def apply_reference(df: DataFrame, reference: DataFrame) -> DataFrame:
    """``_ref`` (body, metric, applicants, seats) of the first needle in the exam's name."""
    side = reference.select("needle", "priority", *[
        F.col(c).cast(t).alias(f"_{c}") for c, t in (("body", "string"), ("metric", "string"),
                                                     ("applicants", "long"), ("seats", "long"))])
    found = first_needle(df, F.col("Exam"), side, "needle", "priority")
    return found.withColumn("_ref", F.struct(
        F.coalesce("_body", F.lit("")).alias("body"),
        F.coalesce("_metric", F.lit("")).alias("metric"),
        F.col("_applicants").alias("applicants"), F.col("_seats").alias("seats"))) \
        .drop("_body", "_metric", "_applicants", "_seats")


def apply_probe(df: DataFrame, probe: DataFrame) -> DataFrame:
    """Format and scrapeability by cutoff URL; a URL never probed is unknown.

    Of several probes of a URL the first counts.
    """
    side = probe.select(F.col("url").alias("_url"), F.col("bucket").alias("_bucket"),
                        *position(probe))
    status = probe_status(F.coalesce("_bucket", F.lit("")))
    return look_up(df, F.col("CutoffURL"), side, "_url", "first").withColumn("_s", status) \
        .withColumns({"DataFormat": F.col("_s.format"), "Scrapeable": F.col("_s.status")}) \
        .drop("_bucket", "_s")


def apply_extras(df: DataFrame, extras: DataFrame | None) -> DataFrame:
    """Cutoff status and third-party links by exam; missing is ""."""
    new = ["CutoffStatus", *LINK_COLUMNS]
    if extras is None:
        return df.withColumns({c: F.lit("") for c in new})
    side = extras.select(F.trim("Exam").alias("_exam"), *new, *position(extras))
    return look_up(df, F.trim("Exam"), side, "_exam") \
        .withColumns({c: F.coalesce(c, F.lit("")) for c in new})


def _blank(c: Column) -> Column:
    return strip(F.coalesce(c, F.lit(""))) == ""


def apply_enrichment(df: DataFrame, records: DataFrame) -> DataFrame:
    """Body is filled only if missing; level, metric and notes prefer the record.

    ``records``: exam, body, level, metric, scope - entities decoded here. The last
    record of an exam counts.
    """
    side = records.select(
        F.trim("exam").alias("_exam"),
        *[F.trim(unescape(F.coalesce(c, F.lit("")))).alias(f"_{c}")
          for c in ("body", "level", "metric", "scope")], *position(records))
    out = look_up(df, F.trim("Exam"), side, "_exam")

    def prefer(new: str, old: str) -> Column:
        return F.when(~_blank(F.col(new)), F.col(new)).otherwise(F.col(old))

    return out.withColumns({
        "Body": F.when(_blank(F.col("Body")), F.coalesce("_body", F.lit("")))
        .otherwise(F.col("Body")),
        "Level": prefer("_level", "Level"), "Metric": prefer("_metric", "Metric"),
        "Notes": prefer("_scope", "Notes")}) \
        .drop("_body", "_level", "_metric", "_scope")


def apply_overlay(df: DataFrame, links: DataFrame) -> DataFrame:
    """Validated links and acronym: a listed exam is overwritten, even with "".

    The last row of an exam counts.
    """
    side = links.select(
        F.trim("exam").alias("_exam"),
        *[strip(F.coalesce(c, F.lit(""))).alias(f"_{c}")
          for c in ("homepage", "cutoff", "acronym")], *position(links))
    listed = F.coalesce("_listed", F.lit(False))
    out = look_up(df, F.trim("Exam"), side.withColumn("_listed", F.lit(True)), "_exam")
    return out.withColumns({
        target: F.when(listed, F.col(f"_{source}")).otherwise(F.col(target))
        for target, source in (("Homepage", "homepage"), ("CutoffURL", "cutoff"),
                               ("Acronym", "acronym"))}) \
        .drop("_listed", "_homepage", "_cutoff", "_acronym")


def load_catalog(spark, path: str, build) -> DataFrame:
    """The stored catalog; built and written first if it is missing."""
    from rankloom.sources.files import path_exists

    if not path_exists(spark, path):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def explorer(catalog: DataFrame, category: str = "All", level: str = "All", state: str = "All",
             status: str = "All", search: str | None = None) -> DataFrame:
    """Equality on four dimensions ("All" is off) and a literal name search."""
    out = catalog
    for column, value in (("Category", category), ("Level", level), ("State", state),
                          ("CutoffStatus", status)):
        if value != "All":
            out = out.filter(F.col(column) == value)
    if search:
        out = out.filter(F.lower("Exam").contains(search.lower()))
    return out


def explorer_metrics(catalog: DataFrame) -> DataFrame:
    """Headline numbers over the catalog."""
    return catalog.agg(
        F.count(F.lit(1)).alias("exams"), F.count_distinct("Category").alias("categories"),
        F.count_distinct("State").alias("states"),
        F.count_if(F.col("CutoffStatus").isin("Official Cutoff", "Official Merit List"))
        .alias("official"),
        F.count_if(~_blank(F.col("Homepage"))).alias("homepages"),
        F.count_if(~_blank(F.col("CutoffURL"))).alias("cutoff_pages"))


def scrapeable(catalog: DataFrame) -> DataFrame:
    """HTML sources with a cutoff URL, by exam."""
    return catalog.filter((F.col("DataFormat") == "html") & ~_blank(F.col("CutoffURL"))) \
        .orderBy("Exam")
