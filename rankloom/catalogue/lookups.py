"""Look-ups in tables, distributions, conformance of foreign tables, scans by path."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.catalogue.bridge import canonical, table, with_star
from rankloom.catalogue.exams import CATALOG_SQL, exam_catalog
from rankloom.catalogue.registry import query
from rankloom.operators.conform import conform_to, conformance_report
from rankloom.operators.needles import first_needle
from rankloom.plans import distributions, ingest, links
from rankloom.plans.query import RankQuery
from rankloom.schema import RAW
from rankloom.session import shared_folder

# --- needles -----------------------------------------------------------------------
_NEEDLES = """
  n AS (SELECT lower(substr(p_name, CAST(1 + p_partkey % 3 AS INT), CAST(2 + p_partkey % 7 AS INT)))
      AS needle, (p_partkey * 7919) % 1000003 AS priority, p_brand AS body, p_partkey AS seats
    FROM part)"""


@query("reference_lookup", f"""WITH {_NEEDLES},
  t AS (SELECT p_partkey, upper(p_type) || ' ' || p_name AS exam FROM part
    UNION ALL SELECT -1 - item_id, text FROM benchmark),
  h AS (SELECT p_partkey, arg_min(body, priority) AS body, arg_min(seats, priority) AS seats
    FROM t JOIN n ON contains(lower(exam), needle) AND trim(needle) <> '' GROUP BY 1)
  SELECT t.p_partkey, body, seats FROM t LEFT JOIN h USING (p_partkey)""")
def reference_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts are the reference table: one needle each, short ones and equal ones among them."""
    part = table(spark, sf_dir, "part")
    needles = part.selectExpr(
        "substring(p_name, cast(1 + p_partkey % 3 as int), cast(2 + p_partkey % 7 as int)) "
        "as needle", "(p_partkey * 7919) % 1000003 as priority", "p_brand as body",
        "p_partkey as seats")
    exams = part.selectExpr("p_partkey", "concat(upper(p_type), ' ', p_name) as exam").union(
        table(spark, sf_dir, "benchmark").selectExpr("-1 - item_id", "text"))
    return first_needle(exams, F.col("exam"), needles, "needle", "priority") \
        .select("p_partkey", "body", "seats")


# --- distributions -----------------------------------------------------------------
_SHOWN = ["Category", "Level", "State", "Scrapeable", "CutoffStatus", "Acronym"]


def _stack_sql(source: str, columns: list[str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", CAST(\"{c}\" AS VARCHAR) AS value FROM {source}"
        for c in columns)


@query("catalog_distributions", f"""WITH {CATALOG_SQL}, s AS ({_stack_sql("c", _SHOWN)})
  SELECT "column", value, count(*) AS n FROM s GROUP BY ALL""")
def catalog_distributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distributions.value_distributions(exam_catalog(spark, sf_dir), _SHOWN)


@query("catalog_summary", f"""WITH {CATALOG_SQL}, s AS ({_stack_sql("c", _SHOWN)})
  SELECT "column", count(*) AS total, count(DISTINCT value) AS distinct_values,
    count_if(trim(coalesce(value, '')) <> '') AS non_blank FROM s GROUP BY 1""")
def catalog_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distributions.column_summary(
        distributions.value_distributions(exam_catalog(spark, sf_dir), _SHOWN))


_BUCKETS = {0: "pdf", 1: "html_table_rank", 2: "http_403", 3: ""}
_BUCKET_SQL = "CASE " + " ".join(f"WHEN o_orderkey % 5 = {k} THEN '{v}'"
                                 for k, v in _BUCKETS.items()) + " END"


@query("probe_distributions", f"""WITH p AS (
    SELECT {_BUCKET_SQL} AS bucket, 'h' || o_custkey % 30 || '.in' AS host FROM orders),
  s AS ({_stack_sql("p", ["bucket"])}),
  g AS (SELECT host AS value, count(*) AS n FROM p WHERE bucket = 'html_table_rank' GROUP BY 1
    ORDER BY n DESC, value LIMIT 25)
  SELECT "column", value, count(*) AS n FROM s GROUP BY ALL
  UNION ALL SELECT 'host of html_table_rank', value, n FROM g""")
def probe_distributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders are probes: counts per bucket, and the 25 hosts with most readable tables."""
    probe = table(spark, sf_dir, "orders").selectExpr(
        _BUCKET_SQL + " as bucket", "concat('h', o_custkey % 30, '.in') as host")
    good = distributions.value_distributions(
        probe.filter(F.col("bucket") == "html_table_rank"), ["host"])
    top = distributions.most_common(good, "host", 25)
    return distributions.value_distributions(probe, ["bucket"]).union(
        top.select(F.lit("host of html_table_rank"), "value", "n"))


_KINDS = ["home_kind", "home_show", "cutoff_kind", "cutoff_show"]


@query("link_distributions", f"""WITH k AS (
    SELECT CASE WHEN c_custkey % 4 = 0 THEN 'none' WHEN c_custkey % 4 = 1 THEN 'aggregator'
      WHEN c_custkey % 3 = 0 THEN 'official' ELSE 'dead' END AS home_kind,
      CASE WHEN c_custkey % 5 = 0 THEN 'none' WHEN c_custkey % 3 = 0 THEN 'official' ELSE 'dead' END
      AS cutoff_kind FROM customer),
  f AS (SELECT *, home_kind = 'official' AS home_show, cutoff_kind = 'official' AS cutoff_show FROM k),
  s AS ({_stack_sql("f", _KINDS)})
  SELECT "column", value, count(*) AS n FROM s GROUP BY ALL""")
def link_distributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = table(spark, sf_dir, "customer")
    home, cutoff = ("concat('https://h.org/', c_custkey)", "concat('https://c.org/', c_custkey)")
    exams = customer.selectExpr(
        "c_name as Exam", "'' as Body",
        f"case c_custkey % 4 when 0 then 'ask' when 1 then "
        f"concat('https://www.shiksha.com/', c_custkey) else {home} end as Homepage",
        f"case c_custkey % 5 when 0 then '' else {cutoff} end as CutoffURL")
    status = customer.selectExpr(f"inline(array(struct({home} as url, c_custkey % 3 = 0 as ok), "
                                 f"struct({cutoff} as url, c_custkey % 3 = 0 as ok)))")
    return distributions.value_distributions(links.probe_links(exams, status), _KINDS)


# --- foreign raw tables --------------------------------------------------------------
def _foreign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as raw rows of another's making: columns extra, missing and mistyped."""
    return table(spark, sf_dir, "lineitem").selectExpr(
        "l_partkey as exam", "l_shipdate as scraped_at",
        "case when l_linenumber = 3 then 'n/a' when l_linenumber = 4 then '12.5' "
        "else cast(l_orderkey as string) end as closing_rank",
        "l_extendedprice * 100 / 50 as opening_rank", "cast(l_linenumber as bigint) as table_index",
        "l_returnflag as category", "array(l_returnflag, l_linestatus) as raw_cells", "l_tax")


@query("raw_conformance", """SELECT CAST(l_partkey AS VARCHAR) AS exam, l_linenumber AS table_index,
    l_returnflag AS category, CASE WHEN floor(l_extendedprice * 100 / 50) = l_extendedprice * 100 / 50
      THEN CAST(l_extendedprice * 100 / 50 AS BIGINT) END AS opening_rank,
    CASE WHEN l_linenumber NOT IN (3, 4) THEN l_orderkey END AS closing_rank,
    '["' || l_returnflag || '","' || l_linestatus || '"]' AS raw_cells,
    CAST(NULL AS VARCHAR) AS institute_name FROM lineitem""")
def raw_conformance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conform_to(_foreign(spark, sf_dir), RAW).select(
        "exam", "table_index", "category", "opening_rank", "closing_rank", "raw_cells",
        "institute_name")


_MISSING = [c for c in RAW.names if c not in (
    "exam", "table_index", "category", "opening_rank", "closing_rank", "raw_cells")]


@query("raw_conformance_report", """WITH r AS (
    SELECT count(*) AS n, count_if(l_linenumber IN (3, 4)) AS bad, count_if(
      floor(l_extendedprice * 100 / 50) <> l_extendedprice * 100 / 50) AS part FROM lineitem)
  SELECT 'exam' AS "column", 'cast' AS action, 'bigint' AS found_type, n AS filled, 0 AS unreadable FROM r
  UNION ALL SELECT 'table_index', 'cast', 'bigint', n, 0 FROM r
  UNION ALL SELECT 'category', 'kept', 'string', n, 0 FROM r
  UNION ALL SELECT 'raw_cells', 'cast', 'array<string>', n, 0 FROM r
  UNION ALL SELECT 'closing_rank', 'cast', 'string', n, bad FROM r
  UNION ALL SELECT 'opening_rank', 'cast', 'double', n, part FROM r
  UNION ALL SELECT 'scraped_at', 'dropped', 'timestamp_ntz', n, 0 FROM r
  UNION ALL SELECT 'l_tax', 'dropped', 'double', n, 0 FROM r UNION ALL """ + " UNION ALL ".join(
    f"SELECT '{c}', 'missing', NULL, 0, 0" for c in _MISSING))
def raw_conformance_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conformance_report(_foreign(spark, sf_dir), RAW).drop("wanted_type")


# --- scans by path ---------------------------------------------------------------------
@query("store_scan", with_star("""SELECT "Body", "Year", "Institute", "ClosingRank" FROM star
  WHERE "ClosingRank" >= 50000 AND "Year" IN (SELECT CAST(year(o_orderdate) AS BIGINT) FROM orders
    WHERE o_orderpriority = '1-URGENT' GROUP BY 1 HAVING sum(o_totalprice) > 0
      AND CAST(year(o_orderdate) AS BIGINT) % 3 = 0)"""))
def store_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dataset laid out by year, asked by its path for the years that orders name."""
    path = shared_folder(spark)
    ingest.write_canonical(canonical(spark, sf_dir), path, by_year=True)
    years = table(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'").selectExpr(
        "cast(year(o_orderdate) as bigint) as Year").filter("Year % 3 = 0").distinct()
    found = RankQuery(path, spark).where_matching(years).where_between("ClosingRank", 50000)
    return found.rows().select("Body", "Year", "Institute", "ClosingRank")
