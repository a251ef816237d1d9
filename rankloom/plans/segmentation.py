"""Partition of the exam universe by the kind of link each exam has."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.functions.rules import ladder
from rankloom.functions.text import strip
from rankloom.functions.urls import is_aggregator, is_url
from rankloom.schema import LINK_COLUMNS

# Statuses that mean an official link, with and without merit lists.
OFFICIAL = ["Official Cutoff", "Official Merit List"]
OFFICIAL_STRICT = ["Official Cutoff"]
# Exams the links sheet folds into one row.
FOLDED_EXAM = "Joint Entrance Examination"
FOLDED = [
    "Joint Entrance Examination JoSAA Joint Seat Allocation (JEE Main and Advanced)",
    "Joint Entrance Examination Advanced IIT Joint Admission (JEE Advanced)",
    "Joint Entrance Examination CSAB Special Rounds (JEE Main)",
    "Joint Entrance Examination CSAB NEUT North Eastern States and Union Territories (JEE Main)",
    "Joint Entrance Examination JAC Delhi Joint Admission Counselling (JEE Main)",
]


def _sheet(c: str) -> Column:
    return strip(F.coalesce(F.col(c), F.lit("")))


def segment(universe: DataFrame, links: DataFrame, *, merit_list: bool = True,
            jee_remap: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per universe row: cat1 (official), cat2 (third-party), cat3 (none).

    ``links`` has one row per exam. The order of the tests is the rule: an exam
    with an official status is cat1 whatever else it has.
    """
    fields = ["CutoffStatus", *LINK_COLUMNS]
    sheet = links.select(_sheet("Exam").alias("_exam"),
                         F.struct(*[_sheet(c).alias(c) for c in fields]).alias("_link"))
    rows = universe.select(_sheet("Exam").alias("exam"), _sheet("Homepage").alias("homepage"),
                           _sheet("CutoffURL").alias("official_cutoff_url"), *keep) \
        .filter(F.col("exam") != "")
    joined = rows.join(sheet, F.col("exam") == F.col("_exam"), "left")
    remapped = F.lit(False)
    link = F.col("_link")
    if jee_remap:
        # the folded row is a single one: a scalar, not a second join
        folded = sheet.filter(F.col("_exam") == FOLDED_EXAM).select("_link").scalar()
        use = F.col("_link").isNull() & F.col("exam").isin(FOLDED)
        joined = joined.withColumn("_folded", F.when(use, folded))
        link = F.coalesce("_link", "_folded")
        remapped = F.col("_folded").isNotNull()
    found = joined.select("exam", "homepage", "official_cutoff_url", link.alias("_l"),
                          remapped.alias("jee_remapped"), *keep)
    status = F.coalesce("_l.CutoffStatus", F.lit(""))
    competitor = {c: F.coalesce(F.col(f"_l.{c}"), F.lit("")) for c in LINK_COLUMNS}
    n_links = sum((F.col(c.lower()) != "").cast("int") for c in LINK_COLUMNS)
    official = OFFICIAL if merit_list else OFFICIAL_STRICT
    out = found.select("*", status.alias("cutoff_status"),
                       *[v.alias(c.lower()) for c, v in competitor.items()]) \
        .withColumn("n_competitor_links", n_links) \
        .withColumn("category", ladder([
            (F.col("cutoff_status").isin(official), "cat1"),
            (F.col("n_competitor_links") > 0, "cat2")], "cat3"))
    cutoff, home = F.col("official_cutoff_url"), F.col("homepage")
    return out.select(
        "exam", "category", "cutoff_status", "official_cutoff_url", "homepage",
        *[c.lower() for c in LINK_COLUMNS], "n_competitor_links",
        ((F.col("category") == "cat1") & is_aggregator(cutoff)).alias("aggregator_as_official"),
        ((cutoff != "") & ~is_url(cutoff)).alias("prose_cutoff_url"),
        ((home != "") & ~is_url(home)).alias("prose_homepage"), "jee_remapped", *keep)


def counts(segments: DataFrame) -> DataFrame:
    """cat1, cat2, cat3 and total in one row."""
    return segments.agg(*[F.count_if(F.col("category") == c).alias(c)
                          for c in ("cat1", "cat2", "cat3")],
                        F.count(F.lit(1)).alias("total"))


def flag_summary(segments: DataFrame) -> DataFrame:
    flags = ("aggregator_as_official", "prose_cutoff_url", "prose_homepage", "jee_remapped")
    return segments.agg(*[F.count_if(c).alias(c) for c in flags])


def website_map(segments: DataFrame, override: DataFrame | None = None,
                order: str | None = None) -> DataFrame:
    """(exam, website): override, else a real cutoff URL, else a real homepage.

    Of an exam listed twice, the last row with a link in ``order`` (a column of
    both tables) counts; without an order, the greatest link.
    """
    site = ladder([
        ((F.col("official_cutoff_url") != "") & ~F.col("prose_cutoff_url"),
         F.col("official_cutoff_url")),
        ((F.col("homepage") != "") & ~F.col("prose_homepage"), F.col("homepage"))])
    more = [order] if order else []
    out = _last(segments.select("exam", site.alias("website"), *more), "website", order)
    if override is None:
        return out
    better = override.select(_sheet("exam").alias("exam"),
                             _sheet("official_cutoff_url").alias("_better"), *more)
    return out.join(_last(better, "_better", order), "exam", "full_outer") \
        .select("exam", F.coalesce("_better", "website").alias("website"))


def _last(df: DataFrame, value: str, order: str | None) -> DataFrame:
    return df.filter((F.col("exam") != "") & (F.col(value) != "")) \
        .groupBy("exam").agg(F.max_by(value, order or value).alias(value))
