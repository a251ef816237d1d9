"""The counselling bodies: who they are, their snapshot, and how to read a fresh one.

A fresh document is not fetched here. It comes as extracted tables (grid, lines,
words, HTML pages) under ``documents_dir``; without one a source falls back to
its snapshot.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.operators import dedup, grids
from rankloom.operators.conform import dedouble_rows, normalize
from rankloom.operators.htmltables import html_tables
from rankloom.operators.mapping import map_tables, national_grid, portal_report
from rankloom.plans.bulk import official_pass, routed_parse
from rankloom.plans.query import round_ends
from rankloom.schema import CANON, GRID, LINES, TABLES, WORDS, empty_canonical
from rankloom.session import shared_folder
from rankloom.sources.files import path_exists, read_canonical, read_ordered, read_snapshot
from rankloom.sources.registry import SourceMeta, SourceRegistry, SourceSpec


@dataclass(frozen=True)
class Body:
    """One body: identity, snapshot file, grid reader, keep-first key, fixed fields."""

    meta: SourceMeta
    snapshot: str
    reader: str | None = None
    key: tuple[str, ...] | None = None
    year: int | None = None
    round_label: str = ""


def _meta(name: str, exam: str, level: str, state: str, kind: str, body: str, site: str,
          url: str) -> SourceMeta:
    return SourceMeta(name, exam, level, (state,) if state else (), kind, body, site, url)


# The nineteen bodies.
BODIES = [
    Body(_meta("josaa", "JEE Advanced / JEE Main", "UG", "", "html", "JoSAA",
               "https://josaa.nic.in/",
               "https://josaa.admissions.nic.in/applicant/seatallotmentresult/"),
         "josaa_cached.csv.gz", "national"),
    Body(_meta("mhtcet", "MHT-CET", "UG", "Maharashtra", "pdf", "MHT-CET",
               "https://cetcell.mahacet.org/",
               "https://fe2024.mahacet.org/StaticPages/HTML_FrmInstituteCutOff.aspx"),
         "mhtcet_official.csv.gz", "staged", tuple(dedup.STAGED_KEY), 2024, "CAP1"),
    Body(_meta("kcet", "KCET", "UG", "Karnataka", "pdf", "KCET",
               "https://cetonline.karnataka.gov.in/kea/",
               "https://cetonline.karnataka.gov.in/kea/"),
         "kcet_official.csv.gz", "headed", tuple(dedup.HEADED_KEY), 2024, "1"),
    Body(_meta("comedk", "COMEDK", "UG", "Karnataka", "pdf", "COMEDK",
               "https://www.comedk.org/", "https://www.comedk.org/"),
         "comedk_official.csv.gz", "branches", tuple(dedup.STAGED_KEY), 2024, "Round 1"),
    Body(_meta("keam", "Kerala Engineering Architecture Medical Entrance Examination", "UG",
               "Kerala", "pdf", "CEE Kerala", "https://cee.kerala.gov.in/",
               "https://cee.kerala.gov.in/keam2025/list/lastrank/eng-trial.pdf"),
         "keam_cached.csv", "sections", None, 2025, "Trial"),
    Body(_meta("tnea", "TNEA", "UG", "Tamil Nadu", "pdf", "TNEA",
               "https://www.tneaonline.org/", "https://cutoff.tneaonline.org/"),
         "tnea_official.csv.gz", "communities", tuple(dedup.STAGED_KEY), 2024, "Vocational"),
    Body(_meta("tseamcet", "TS EAMCET", "UG", "Telangana", "pdf", "TS EAMCET",
               "https://tgeapcet.nic.in/", "https://tgeapcetd.nic.in/"),
         "tseamcet_official.csv.gz", "last_ranks", tuple(dedup.LAST_RANK_KEY), 2025,
         "Final Phase"),
    Body(_meta("apeapcet", "AP EAPCET", "UG", "Andhra Pradesh", "pdf", "AP EAPCET",
               "https://cets.apsche.ap.gov.in/", "https://apsche.ap.gov.in/"),
         "apeapcet_official.csv.gz", "last_ranks", tuple(dedup.LAST_RANK_KEY), 2022, "Final"),
    Body(_meta("gujacpc", "Gujarat ACPC", "UG", "Gujarat", "pdf", "Gujarat ACPC",
               "https://acpc.gujarat.gov.in/", "https://acpc.gujarat.gov.in/"),
         "gujacpc_official.csv.gz", "flat_western", tuple(dedup.FLAT_KEY), 2024, "Mock Round"),
    Body(_meta("ipu", "IPU CET", "UG", "Delhi", "pdf", "IPU", "https://www.ipu.ac.in/",
               "https://www.ipu.ac.in/"),
         "ipu_official.csv.gz", "flat_capital", tuple(dedup.FLAT_KEY), 2024, "Round 1"),
    Body(_meta("ojee", "OJEE", "UG", "Odisha", "pdf", "OJEE", "https://ojee.nic.in/",
               "https://ojee.nic.in/"),
         "ojee_official.csv.gz", "words", tuple(dedup.FLAT_KEY), 2024, "Final"),
    Body(_meta("jceceb", "JCECE", "UG", "Jharkhand", "pdf", "JCECE",
               "https://jceceb.jharkhand.gov.in/", "https://jceceb.jharkhand.gov.in/"),
         "jceceb_official.csv.gz", "allotments", tuple(dedup.ALLOTMENT_KEY), 2024, "2nd Round"),
    Body(_meta("uptac", "UPTAC", "UG", "Uttar Pradesh", "html", "UPTAC",
               "https://uptac.admissions.nic.in/", "https://uptac.admissions.nic.in/or-cr/"),
         "uptac_official.csv.gz", "report", tuple(dedup.REPORT_KEY), 2025),
    Body(_meta("wbjee", "WBJEE", "UG", "West Bengal", "html", "WBJEE", "https://wbjeeb.nic.in/",
               "https://wbjeeb.nic.in/"), "wbjee_cached.csv"),
    Body(_meta("biharpoly", "Bihar Polytechnic Common Entrance Competitive Examination",
               "Diploma", "Bihar", "pdf", "BCECE", "https://bceceboard.bihar.gov.in/",
               "https://bceceboard.bihar.gov.in/pdf_Web/DC_PE25_FOCFF.pdf"),
         "biharpoly_cached.csv", "mapper"),
    Body(_meta("rajpoly", "Rajasthan Polytechnic Entrance Examination", "Diploma", "Rajasthan",
               "pdf", "Rajasthan DTE", "https://dte.rajasthan.gov.in/",
               "https://dte.rajasthan.gov.in/assets/docs/Admission/FirstYearEngg/"
               "Final%20Merit%20List-%20first%20Allotment%20%202024-25.pdf"),
         "rajpoly_cached.csv", "mapper"),
    Body(_meta("keralavet", "Kerala Veterinary Entrance Examination", "UG", "Kerala", "pdf",
               "CEE Kerala", "https://cee.kerala.gov.in/",
               "https://cee.kerala.gov.in/keam2025/list/allot/allied_p1_final.pdf"),
         "keralavet_cached.csv", "mapper"),
    Body(_meta("icar", "Indian Council of Agricultural Research All India Entrance "
               "Examination for Admission Undergraduate", "UG", "", "pdf", "ICAR / NTA",
               "https://icar.org.in/",
               "https://icarcounseling.com/Images/ICAR-UG-Counseling-CUT-OFF-2024.pdf"),
         "icar_cached.csv", "mapper"),
    Body(_meta("bihareng", "Bihar Engineering Entrance Examination", "UG", "Bihar", "pdf",
               "BCECE (UGEAC)", "https://bceceboard.bihar.gov.in/",
               "https://bceceboard.bihar.gov.in/pdf_Web/UGEAC2024_FOCRANK.pdf"),
         "bihareng_cached.csv", "mapper"),
]

# Bodies whose merit lists have no category split: the gap is named, and the
# body label is set so that both modes agree.
_LABELLED = ("rajpoly", "keralavet", "icar", "bihareng")
_ORDER = [*grids.ORDER, "slot"]


def snapshot_rows(body: Body, raw: DataFrame) -> DataFrame:
    """A body's snapshot as canonical rows, its repairs and keep-first applied.

    ``raw`` as read from one file, or with its own ``_seq`` column: the order
    that keep-first follows.
    """
    if "_seq" not in raw.columns:
        raw = raw.withColumn("_seq", F.monotonically_increasing_id())
    if body.meta.name == "rajpoly":
        raw = dedouble_rows(raw, ("Institute", "Branch", "Category", "Gender"))
    rows = normalize(raw, ("_seq",))
    if body.meta.name in _LABELLED or body.meta.name == "biharpoly":
        rows = rows.withColumn("Body", F.lit(body.meta.body_label))
    if body.meta.name in _LABELLED:
        rows = rows.withColumn("Category", F.coalesce("Category", F.lit("Unspecified")))
    if body.meta.name == "biharpoly":
        rows = rows.withColumn("Year", F.coalesce("Year", F.lit(2025)))
    if body.key:
        rows = dedup.keep_first(rows, body.key, ["_seq"])
    return rows.drop("_seq")


def _doc(spark: SparkSession, base: str, name: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(f"{base}/{name}")


def _read_grid(body: Body, spark: SparkSession, base: str) -> DataFrame:
    """Rows of a body's extracted documents, before the fixed fields."""
    grid = None if body.reader == "words" else _doc(spark, base, "grid", GRID)
    if body.reader in ("headed", "staged"):
        lines, tables = _doc(spark, base, "lines", LINES), _doc(spark, base, "tables", TABLES)
        return grids.headed_matrix(grid, lines, tables) if body.reader == "headed" \
            else grids.staged_matrix(grid, lines, tables, body.round_label)
    if body.reader == "words":
        return grids.borderless_rows(_doc(spark, base, "words", WORDS))
    readers: dict[str, Callable[[DataFrame], DataFrame]] = {
        "branches": grids.branch_melt, "sections": grids.sectioned_matrix,
        "communities": grids.community_melt, "last_ranks": grids.last_rank_melt,
        "flat_western": lambda g: grids.flat_records(g, grids.WESTERN_COLUMNS),
        "flat_capital": lambda g: grids.flat_records(g, grids.CAPITAL_COLUMNS),
        "allotments": lambda g: grids.allotment_cutoffs(grids.allotment_rows(g))}
    return readers[body.reader](grid)


def document_rows(body: Body, spark: SparkSession, base: str) -> DataFrame:
    """Canonical rows of a body's freshly extracted documents."""
    m = body.meta
    state = m.states[0] if m.states else "All India"
    if body.reader in ("report", "national"):
        pages = _doc(spark, base, "pages", "page_id string, url string, html string, "
                                           "year string, round string")
        if body.reader == "report":
            tables = html_tables(pages)
            order = ("page_id", "row_idx")
            rows = portal_report(tables, body.year, keep=order)
            return dedup.keep_first(rows, body.key, list(order)).drop(*order)
        tables = html_tables(pages, keep=("year", "round"))
        return round_ends(national_grid(tables, F.col("year"), F.col("round")))
    if body.reader == "mapper":
        tables = grids.grid_tables(_doc(spark, base, "grid", GRID))
        return map_tables(tables, {
            "Exam": F.lit(m.exam), "Body": F.lit(m.body_label), "Level": F.lit(m.level),
            "State": F.lit(state)})
    found = _read_grid(body, spark, base)
    order = [c for c in _ORDER if c in found.columns]
    fixed: dict[str, Column] = {
        "Body": F.lit(m.body_label), "Exam": F.lit(m.exam), "Level": F.lit(m.level),
        "State": F.lit(state), "Year": F.lit(body.year),
        "SourceURL": F.lit(m.source_url)}
    if body.reader != "staged":
        fixed["Round"] = F.lit(body.round_label)
    if body.reader == "sections":
        fixed.update({"Quota": F.lit("State"), "Gender": F.lit("Gender-Neutral")})
    if body.reader == "headed":
        fixed["Quota"] = F.lit("General")
    rows = normalize(found.withColumns(fixed), order)
    if body.key and order:
        rows = dedup.keep_first(rows, body.key, order)
    return rows.drop(*order)


def register_bodies(registry: SourceRegistry, snapshot_dir: str,
                    documents_dir: str | None = None,
                    bulk_path: str | None = None, bulk_pages: str | None = None,
                    bulk_probe: str | None = None, bulk_links: str | None = None,
                    bulk_log: str | None = None) -> SourceRegistry:
    """Register every body, and the bulk official-link source as opt-in.

    The bulk source's refresh reads stored responses (``bulk_pages``: Parquet as
    ``parse_stored`` takes it) by the reader that the probe's bucket asks for
    (``bulk_probe``: Parquet of url, bucket). With the links and the fetch log
    (``bulk_links``, ``bulk_log``, see ``official_pass``) it is the whole walk: links
    that are prose, dead, failed or past their host's third failure give no rows.
    """
    def bulk_latest(spark: SparkSession) -> DataFrame:
        probe = read_ordered(spark, bulk_probe)
        if not (bulk_links and bulk_log):
            return routed_parse(spark.read.parquet(bulk_pages), probe).select(*CANON.names)
        walk = official_pass(spark.read.parquet(bulk_links), probe, read_ordered(spark, bulk_log),
                             read_ordered(spark, bulk_pages), shared_folder(spark))
        return walk.rows.select(*CANON.names)

    for body in BODIES:
        registry.register(SourceSpec(
            body.meta, _cached(body, snapshot_dir),
            _latest(body, documents_dir) if body.reader and documents_dir else None))
    registry.register(SourceSpec(
        SourceMeta("bulk_official", "(various official links)", "UG", data_format="mixed",
                   optin=True),
        lambda spark: read_canonical(spark, bulk_path) if bulk_path
        else empty_canonical(spark),
        bulk_latest if bulk_pages and bulk_probe else None))
    return registry


def _cached(body: Body, snapshot_dir: str) -> Callable[[SparkSession], DataFrame]:
    def load(spark: SparkSession) -> DataFrame:
        for name in (body.snapshot, body.snapshot.removesuffix(".gz")):
            if path_exists(spark, f"{snapshot_dir}/{name}"):
                return snapshot_rows(body, read_snapshot(spark, f"{snapshot_dir}/{name}",
                                                         ordered=True))
        return empty_canonical(spark)
    return load


def _latest(body: Body, documents_dir: str) -> Callable[[SparkSession], DataFrame]:
    def load(spark: SparkSession) -> DataFrame:
        base = f"{documents_dir}/{body.meta.name}"
        if not path_exists(spark, base):
            return empty_canonical(spark)
        return document_rows(body, spark, base)
    return load
