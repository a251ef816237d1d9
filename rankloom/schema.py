"""Table contracts: column names, order and types of every table the library moves."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import (
    BooleanType, IntegerType, LongType, StringType, StructField, StructType,
)

# The canonical contract, in order.
CANON_COLUMNS = [
    "Body", "Exam", "Website", "Level", "State", "City", "Institute", "Program",
    "Branch", "Category", "CategoryGroup", "Quota", "Gender", "Year", "Round",
    "OpeningRank", "ClosingRank", "SourceURL",
]
CANON_INTS = ("Year", "OpeningRank", "ClosingRank")

# Columns offered as equality filters.
FILTERABLE = [
    "Body", "Exam", "Level", "State", "City", "Year", "Round", "Institute",
    "Program", "Branch", "Category", "CategoryGroup", "Quota", "Gender",
]

# Snapshot files carry these, all as text.
SNAPSHOT_COLUMNS = [
    "Body", "Exam", "Level", "State", "Year", "Round", "Institute", "Branch",
    "Category", "Quota", "Gender", "OpeningRank", "ClosingRank",
]

# The raw table of a third-party site, one row per table cell or row.
RAW_COLUMNS = [
    "source_competitor", "exam", "exam_slug", "page_url", "page_type",
    "table_index", "table_caption", "institute_name", "branch_or_course", "program",
    "category", "quota", "gender", "counselling_round", "year", "opening_rank",
    "closing_rank", "cutoff_percentile", "cutoff_score_or_marks", "rank_range_raw",
    "raw_header_label", "raw_cell_value", "raw_cells", "pdf_url", "notes",
]
_RAW_TYPES = {"table_index": IntegerType(), "opening_rank": LongType(),
              "closing_rank": LongType()}

# Catalog of exams.
LINK_COLUMNS = ["CollegeDunia", "Shiksha", "Careers360", "CollegeDekho"]
CATALOG_COLUMNS = [
    "Exam", "Acronym", "Category", "Level", "State", "Body", "Metric", "Homepage",
    "CutoffURL", "CutoffStatus", "DataFormat", "Scrapeable", "Applicants", "Seats",
    "Notes", *LINK_COLUMNS,
]

# Partition of the exam universe.
SEGMENT_COLUMNS = [
    "exam", "category", "cutoff_status", "official_cutoff_url", "homepage",
    "collegedunia", "shiksha", "careers360", "collegedekho", "n_competitor_links",
    "aggregator_as_official", "prose_cutoff_url", "prose_homepage", "jee_remapped",
]
_SEGMENT_TYPES = {"n_competitor_links": IntegerType(),
                  **{c: BooleanType() for c in SEGMENT_COLUMNS[-4:]}}

# Canonical column -> client label, in the client's order.
DELIVERABLE = [
    ("Exam", "Exam Name"), ("Website", "Link of website"),
    ("Institute", "College Name"), ("City", "City"), ("State", "State"),
    ("Program", "Program"), ("Branch", "Branch"), ("Year", "Year - cutoff"),
    ("Round", "Round #"), ("Gender", "Gender"), ("Quota", "Quota"),
    ("OpeningRank", "Opening Rank"), ("ClosingRank", "Closing Rank"),
    ("SourceURL", "Link - Data Taken from"),
]

# The web-research side table.
WEB_COLUMNS = [
    "Exam Name", "Link of website", "College Name", "City", "State", "Program",
    "Branch", "Year - cutoff", "Round #", "Gender", "Quota", "Category",
    "Opening Rank", "Closing Rank", "Cutoff Percentile/Score",
    "Link - Data Taken from", "Fidelity",
]

# The labelled union of every layer.
UNION_COLUMNS = ["Source", "Fidelity", "Provenance Note",
                 *[c for c in WEB_COLUMNS if c != "Fidelity"]]


def _struct(columns: list[str], types: dict) -> StructType:
    return StructType([StructField(c, types.get(c, StringType())) for c in columns])


CANON = _struct(CANON_COLUMNS, {c: LongType() for c in CANON_INTS})
SNAPSHOT = _struct(SNAPSHOT_COLUMNS, {})
RAW = _struct(RAW_COLUMNS, _RAW_TYPES)
CATALOG = _struct(CATALOG_COLUMNS, {"Applicants": LongType(), "Seats": LongType()})
SEGMENT = _struct(SEGMENT_COLUMNS, _SEGMENT_TYPES)

# Extracted documents, before any rank logic. ``page`` and the ``*_idx`` columns
# give the reading order that sequential rules rely on.
GRID = (
    "doc_id string, page bigint, table_idx bigint, row_idx bigint, cells array<string>")
LINES = (
    "doc_id string, page bigint, line_idx bigint, top double, text string")
TABLES = "doc_id string, page bigint, table_idx bigint, top double"
WORDS = (
    "doc_id string, page bigint, word_idx bigint, top double, x0 double, text string")
HTML_TABLE_COLUMNS = ["page_id", "url", "table_idx", "caption", "header", "rows"]
HTML_TABLE = (
    "page_id string, url string, table_idx int, caption string, "
    "header array<string>, rows array<array<string>>")


def empty_canonical(spark: SparkSession) -> DataFrame:
    """The canonical table with no rows."""
    return spark.createDataFrame([], CANON)


def deliverable_columns(include_category: bool = False) -> list[tuple[str, str]]:
    """(canonical column, client label) pairs; Category slots in after Quota."""
    if not include_category:
        return list(DELIVERABLE)
    at = [c for c, _ in DELIVERABLE].index("Quota") + 1
    return [*DELIVERABLE[:at], ("Category", "Category"), *DELIVERABLE[at:]]


