"""Exam universe: partition, official websites, catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.catalogue.bridge import table
from rankloom.catalogue.conformance import EXAM_WORDINGS
from rankloom.catalogue.registry import query
from rankloom.plans import catalog as cat
from rankloom.plans import segmentation as seg
from rankloom.sources.files import probe_buckets, tidy_extras

# --- partition ---------------------------------------------------------------------
# Customers are the exams. One market segment is missing from the links sheet and
# bears the names the sheet folds into one row; customer 0 is that row.
_STATUS = """CASE c_nationkey % 3 WHEN 0 THEN 'Official Cutoff' WHEN 1 THEN 'Official Merit List'
  ELSE 'No Cutoff Exists' END"""
_SHIKSHA = """CASE WHEN c_custkey % 4 <> 0 THEN 'https://www.shiksha.com/e' || c_custkey
  ELSE '' END"""
_CUTOFF = """CASE c_custkey % 5 WHEN 0 THEN '' WHEN 1 THEN 'ask the office'
  WHEN 2 THEN 'https://law.careers360.com/' || c_custkey ELSE 'https://b.gov/' || c_custkey END"""
_HOME = "CASE c_custkey % 3 WHEN 0 THEN 'no site' ELSE 'http://h.org/' || c_custkey END"
_EXAM = "CASE WHEN c_mktsegment = 'MACHINERY' THEN [{}][c_custkey % 5 + 1] ELSE c_name END".format(
    ", ".join(f"'{x}'" for x in seg.FOLDED))
SEGMENT_SQL = f"""
  u AS (SELECT c_custkey, {_EXAM} AS exam, c_mktsegment = 'MACHINERY' AS folded,
      {_HOME} AS homepage, {_CUTOFF} AS cutoff_url, {_STATUS} AS st, {_SHIKSHA} AS sh FROM customer),
  z AS (SELECT st AS zst, sh AS zsh FROM u WHERE c_custkey = 0),
  l AS (SELECT u.*, CASE WHEN folded THEN zst WHEN c_custkey = 0 THEN '' ELSE st END AS status,
      CASE WHEN folded THEN zsh WHEN c_custkey = 0 THEN '' ELSE sh END AS shiksha FROM u, z),
  seg AS (SELECT *, CASE WHEN status IN ('Official Cutoff', 'Official Merit List') THEN 'cat1'
      WHEN shiksha <> '' THEN 'cat2' ELSE 'cat3' END AS category FROM l)"""


def exam_sheets(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    c = table(spark, sf_dir, "customer")
    key = "cast(c_custkey as string)"
    folded = ", ".join(f"'{x}'" for x in seg.FOLDED)
    universe = c.selectExpr(
        f"if(c_mktsegment = 'MACHINERY', element_at(array({folded}), cast(c_custkey % 5 + 1 as int)), "
        "concat(' ', c_name, ' ')) as Exam",
        f"if(c_custkey % 3 = 0, 'no site', concat('http://h.org/', {key})) as Homepage",
        f"case c_custkey % 5 when 0 then null when 1 then 'ask the office' when 2 then "
        f"concat('https://law.careers360.com/', {key}) else concat('https://b.gov/', {key}) end "
        "as CutoffURL", "c_custkey")
    links = c.filter("c_mktsegment <> 'MACHINERY' or c_custkey = 0").selectExpr(
        f"if(c_custkey = 0, '{seg.FOLDED_EXAM}', c_name) as Exam",
        "case c_nationkey % 3 when 0 then 'Official Cutoff' when 1 then 'Official Merit List' "
        "else 'No Cutoff Exists' end as CutoffStatus", "null as CollegeDunia",
        f"if(c_custkey % 4 <> 0, concat('https://www.shiksha.com/e', {key}), '') as Shiksha",
        "'' as Careers360", "'' as CollegeDekho")
    return universe, links


@query("segment", f"""
  WITH {SEGMENT_SQL}
  SELECT c_custkey, exam, category, status AS cutoff_status, cutoff_url AS official_cutoff_url,
    homepage, '' AS collegedunia, shiksha, '' AS careers360, '' AS collegedekho,
    CASE WHEN shiksha <> '' THEN 1 ELSE 0 END AS n_competitor_links,
    category = 'cat1' AND c_custkey % 5 = 2 AS aggregator_as_official,
    c_custkey % 5 = 1 AS prose_cutoff_url, c_custkey % 3 = 0 AS prose_homepage,
    folded AS jee_remapped FROM seg""")
def segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seg.segment(*exam_sheets(spark, sf_dir), jee_remap=True, keep=("c_custkey",))


@query("segment_counts", f"""
  WITH {SEGMENT_SQL} SELECT count_if(category = 'cat1') AS cat1, count_if(category = 'cat2') AS cat2,
    count_if(category = 'cat3') AS cat3, count(*) AS total FROM seg""")
def segment_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seg.counts(seg.segment(*exam_sheets(spark, sf_dir), jee_remap=True))


@query("segment_flags", f"""
  WITH {SEGMENT_SQL} SELECT count_if(category = 'cat1' AND c_custkey % 5 = 2
      AND status = 'Official Cutoff' AND NOT folded) AS aggregator_as_official,
    count_if(c_custkey % 5 = 1) AS prose_cutoff_url, count_if(c_custkey % 3 = 0) AS prose_homepage,
    0 AS jee_remapped FROM seg""")
def segment_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strict statuses, no folding."""
    rows = seg.segment(*exam_sheets(spark, sf_dir), merit_list=False)
    return seg.flag_summary(rows)


@query("official_websites", f"""
  WITH {SEGMENT_SQL}, s AS (SELECT exam, c_custkey,
      CASE WHEN c_custkey % 5 IN (2, 3, 4) THEN cutoff_url
        WHEN c_custkey % 3 <> 0 THEN homepage END AS site FROM seg),
  b AS (SELECT exam, arg_max(site, c_custkey) FILTER (site IS NOT NULL) AS site FROM s GROUP BY 1),
  o AS (SELECT c_name AS exam, 'https://fix.gov/' || c_custkey AS better FROM customer
    WHERE c_nationkey < 5)
  SELECT coalesce(b.exam, o.exam) AS exam, coalesce(better, site) AS website
  FROM (SELECT * FROM b WHERE site IS NOT NULL) b FULL JOIN o ON b.exam = o.exam""")
def official_websites(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = seg.segment(*exam_sheets(spark, sf_dir), jee_remap=True, keep=("c_custkey",))
    override = table(spark, sf_dir, "customer").filter("c_nationkey < 5").selectExpr(
        "c_name as exam", "concat('https://fix.gov/', cast(c_custkey as string)) "
        "as official_cutoff_url", "c_custkey")
    return seg.website_map(rows, override, order="c_custkey")


# --- catalog -----------------------------------------------------------------------
_N = len(EXAM_WORDINGS)
_REFERENCED = {2: ("NIFT", "Rank", 60000, 6000), 9: ("ICAI", "Pass/Fail", 200000, None),
               10: ("ICSI", "Pass/Fail", 60000, None),
               12: ("NTA / JoSAA", "Rank", 1300000, 57000)}


def _by_wording(values: dict[int, object], default: str) -> str:
    def lit(v: object) -> str:
        return "NULL" if v is None else f"'{v}'" if isinstance(v, str) else f"CAST({v} AS BIGINT)"

    cases = " ".join(f"WHEN {i} THEN {lit(v)}" for i, v in values.items())
    return f"CASE p_partkey % {_N} {cases} ELSE {default} END"


CATALOG_SQL = f"""
  c AS (SELECT p_partkey, {_by_wording({i: w[0] for i, w in enumerate(EXAM_WORDINGS)}, "''")}
      || ' - ' || p_partkey AS "Exam",
    CASE WHEN p_type in ('LARGE', 'ECONOMY') THEN 'A&B' || p_size ELSE '' END AS "Acronym",
    {_by_wording({i: w[1] for i, w in enumerate(EXAM_WORDINGS)}, "''")} AS "Category",
    CASE WHEN p_type = 'SMALL' THEN 'PG' ELSE
      {_by_wording({i: w[2] for i, w in enumerate(EXAM_WORDINGS)}, "''")} END AS "Level",
    {_by_wording({i: w[3] for i, w in enumerate(EXAM_WORDINGS)}, "''")} AS "State",
    coalesce(nullif({_by_wording({i: r[0] for i, r in _REFERENCED.items()}, "''")}, ''),
      CASE WHEN p_type = 'SMALL' THEN 'Board & Council' ELSE '' END) AS "Body",
    CASE WHEN p_type = 'SMALL' THEN 'Score' ELSE
      {_by_wording({i: r[1] for i, r in _REFERENCED.items()}, "''")} END AS "Metric",
    CASE WHEN p_type in ('LARGE', 'ECONOMY') THEN '' ELSE 'http://h.org/' || p_partkey END AS "Homepage",
    CASE WHEN p_type in ('LARGE', 'ECONOMY') THEN 'https://over.org/' || p_partkey
      ELSE 'https://c.org/' || p_size END AS "CutoffURL",
    CASE WHEN p_type = 'PROMO' THEN 'Official Cutoff' ELSE '' END AS "CutoffStatus",
    CASE WHEN p_size % 5 = 0 THEN 'pdf' WHEN p_size % 5 = 1 THEN 'dead'
      WHEN p_size % 5 = 2 THEN 'html' ELSE 'unknown' END AS "DataFormat",
    CASE WHEN p_size % 5 = 0 THEN 'pdf' WHEN p_size % 5 = 1 THEN 'blocked/dead (403)'
      WHEN p_size % 5 = 2 THEN 'scrapeable' ELSE 'unknown' END AS "Scrapeable",
    {_by_wording({i: r[2] for i, r in _REFERENCED.items()}, "NULL")} AS "Applicants",
    {_by_wording({i: r[3] for i, r in _REFERENCED.items()}, "NULL")} AS "Seats",
    CASE WHEN p_type = 'SMALL' THEN 'scope' ELSE '' END AS "Notes",
    CASE WHEN p_type = 'PROMO' THEN 'https://cd/' || p_partkey ELSE '' END AS "CollegeDunia",
    '' AS "Shiksha", '' AS "Careers360", '' AS "CollegeDekho" FROM part)"""


def exam_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    wordings = ", ".join(f"'{w[0]}'" for w in EXAM_WORDINGS)
    part = table(spark, sf_dir, "part").withColumns({
        "name": F.expr(f"concat(element_at(array({wordings}), cast(p_partkey % {_N} + 1 as int)), "
                       "'–', cast(p_partkey as string))"),
        "shown": F.expr(f"concat(element_at(array({wordings}), cast(p_partkey % {_N} + 1 as int)), "
                        "' - ', cast(p_partkey as string))"),
        "k": F.expr("cast(p_partkey as string)")})
    universe = part.selectExpr("name as Exam", "concat('http://h.org/', k) as Homepage",
                               "concat(' https://c.org/', cast(p_size as string)) as CutoffURL")
    probe = probe_buckets(part.selectExpr(
        "concat('https://c.org/', cast(p_size as string)) as url",
        "case p_size % 5 when 0 then 'pdf' when 1 then 'http_403' when 2 then 'html_table_rank' "
        "else '' end as bucket", "p_partkey as seq"), ["seq"])
    extras = tidy_extras(part.filter("p_type = 'PROMO'").selectExpr(
        "shown as `Exam Name`", "'Official Cutoff' as `Status of cutoff`",
        "concat('https://cd/', k) as `Collge duniya`", "'' as Shiksha", "p_partkey as seq"), ["seq"])
    enrichment = part.filter("p_type = 'SMALL'").selectExpr(
        "shown as exam", "'Board &amp; Council' as body", "'PG' as level", "'Score' as metric",
        "' scope ' as scope")
    overlay = part.filter("p_type in ('LARGE', 'ECONOMY')").selectExpr(
        "shown as exam", "null as homepage", "concat('https://over.org/', k) as cutoff",
        "concat('A&B', cast(p_size as string)) as acronym")
    return cat.build_catalog(universe, probe, extras, enrichment, overlay)


_REPEATED_SQL = """
  p AS (SELECT 'https://c.org/' || o_custkey % 40 AS url, arg_min(o_orderkey % 4, o_orderkey) AS b
    FROM orders GROUP BY 1),
  e AS (SELECT c_custkey % 150 AS k, arg_max(c_mktsegment, 7 * c_custkey % 1009 * 100000 + c_custkey) AS m,
      arg_max(c_name, 7 * c_custkey % 1009 * 100000 + c_custkey) AS n FROM customer GROUP BY 1),
  l AS (SELECT l_suppkey * 2 AS k, arg_max(l_partkey, (l_quantity, l_orderkey, l_linenumber)) AS part
    FROM lineitem GROUP BY 1)"""


@query("catalog_repeats", f"""WITH {_REPEATED_SQL}
  SELECT 'Test ' || s_suppkey AS "Exam",
    CASE WHEN l.part IS NULL THEN 'https://c.org/' || s_suppkey % 50
      WHEN l.part % 3 = 0 THEN '' ELSE 'https://over.org/' || l.part END AS "CutoffURL",
    CASE p.b WHEN 0 THEN 'pdf' WHEN 1 THEN 'dead' WHEN 2 THEN 'html' ELSE 'unknown' END
      AS "DataFormat",
    coalesce(e.m, '') AS "Metric", CASE WHEN e.m = 'BUILDING' THEN '' ELSE coalesce(e.n, '') END
      AS "Notes"
  FROM supplier LEFT JOIN p ON p.url = 'https://c.org/' || s_suppkey % 50
    LEFT JOIN e ON e.k = s_suppkey LEFT JOIN l ON l.k = s_suppkey""")
def catalog_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sides that repeat their keys: the first probe, the last record and link row count."""
    universe = table(spark, sf_dir, "supplier").selectExpr(
        "concat('Test ', s_suppkey) as Exam", "'' as Homepage",
        "concat('https://c.org/', s_suppkey % 50) as CutoffURL")
    probe = table(spark, sf_dir, "orders").selectExpr(
        "concat('https://c.org/', o_custkey % 40) as url",
        "case o_orderkey % 4 when 0 then 'pdf' when 1 then 'http_403' when 2 then "
        "'html_table_rank' else '' end as bucket", "o_orderkey as _seq")
    records = table(spark, sf_dir, "customer").selectExpr(
        "concat(' Test ', c_custkey % 150, ' ') as exam", "null as body", "'' as level",
        "c_mktsegment as metric", "case when c_mktsegment = 'BUILDING' then ' ' else c_name end "
        "as scope", "7 * c_custkey % 1009 * 100000 + c_custkey as _seq")
    overlay = table(spark, sf_dir, "lineitem").selectExpr(
        "concat('Test ', l_suppkey * 2) as exam", "'' as homepage",
        "case when l_partkey % 3 = 0 then null else concat('https://over.org/', l_partkey) end "
        "as cutoff", "null as acronym",
        "struct(l_quantity, l_orderkey, l_linenumber) as _seq")
    return cat.build_catalog(universe, probe, None, records, overlay).select(
        "Exam", "CutoffURL", "DataFormat", "Metric", "Notes")


@query("catalog_build", f"""WITH {CATALOG_SQL} SELECT * EXCLUDE (p_partkey) FROM c""")
def catalog_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exam_catalog(spark, sf_dir)


@query("catalog_explorer", f"""WITH {CATALOG_SQL} SELECT "Exam", "State", "CutoffURL" FROM c
  WHERE "Level" = 'UG' AND "CutoffStatus" = 'Official Cutoff' AND "Exam" ILIKE '%ENTRANCE%'""")
def catalog_explorer(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cat.explorer(exam_catalog(spark, sf_dir), level="UG", status="Official Cutoff",
                         search="ENTRANCE")
    return found.select("Exam", "State", "CutoffURL")


@query("explorer_kpis", f"""WITH {CATALOG_SQL} SELECT count(*) AS exams,
  count(DISTINCT "Category") AS categories, count(DISTINCT "State") AS states,
  count_if("CutoffStatus" = 'Official Cutoff') AS official, count_if("Homepage" <> '') AS homepages,
  count_if("CutoffURL" <> '') AS cutoff_pages FROM c""")
def explorer_kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cat.explorer_metrics(exam_catalog(spark, sf_dir))


@query("scrapeable_exams", f"""WITH {CATALOG_SQL} SELECT "Exam", "CutoffURL" FROM c
  WHERE "DataFormat" = 'html' AND "CutoffURL" <> '' """)
def scrapeable_exams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cat.scrapeable(exam_catalog(spark, sf_dir)).select("Exam", "CutoffURL")


@query("catalog_value_counts", f"""WITH {CATALOG_SQL} SELECT "Category", "Level", count(*) AS n
  FROM c GROUP BY 1, 2""")
def catalog_value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exam_catalog(spark, sf_dir).groupBy("Category", "Level").agg(F.count(F.lit(1)).alias("n"))


