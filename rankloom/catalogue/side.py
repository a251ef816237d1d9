"""Side tables: distilled third-party rows, articles, web research, searches, unions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.catalogue.bridge import canonical, star, table, with_star
from rankloom.catalogue.registry import query
from rankloom.operators.conform import project_deliverable
from rankloom.plans import side
from rankloom.schema import UNION_COLUMNS
from rankloom.sources.files import exam_payloads, unwrap_records

_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
_KEYS = ", ".join(_KEY)

# --- raw third-party rows ----------------------------------------------------------
# The line number decides how a row publishes its rank: in columns (1), inverted
# (2), in the original cells only (3, 4), as a percentile (5), a calendar (6), or as
# an opening rank next to marks (7).
_RAW_COLUMNS = [
    "'site' as source_competitor",
    "if(l_linenumber % 2 = 0, p_type, concat(' ', p_type)) as exam",
    "concat('https://s.org/', l_orderkey) as page_url",
    "if(l_tax = 0, 'AILET 2021 Round 1', 'Ranks') as table_caption",
    "case l_returnflag when 'A' then 'Law Cut-Off 2022' when 'N' then s_name else 'None' end "
    "as institute_name",
    "if(l_linestatus = 'O', p_name, null) as branch_or_course", "p_brand as program",
    "if(l_linenumber in (1, 2), 'OBC', null) as category", "'nan' as quota",
    "cast(null as string) as gender", "concat('R', l_linenumber) as counselling_round",
    "if(l_quantity < 25, '2019', 'Year 12') as year",
    "case l_linenumber when 1 then lo when 2 then hi when 7 then lo end as opening_rank",
    "case l_linenumber when 1 then hi when 2 then lo end as closing_rank",
    "if(l_linenumber = 5, concat(l_linenumber, '8.7'), null) as cutoff_percentile",
    "case l_linenumber when 7 then '49' when 5 then '12' end as cutoff_score_or_marks",
    """case l_linenumber when 3 then concat('{"Opening Rank":"', lo, ' (Gen)",',
      '"Closing Rank":"', hi, '","Caste":"SC"}')
    when 4 then concat('{"Category":"12","Community":"ST","Opening":"--","Cut off":', hi, '}')
    when 6 then '{"Event":"Result","Date":"will be notified","Rank":"to be 5"}'
    else 'not json' end as raw_cells"""]


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = star(spark, sf_dir, heavy=True).withColumns({
        "hi": F.expr("cast(floor(l_extendedprice) as bigint)"),
        "lo": F.expr("cast(floor(l_extendedprice / 10) as bigint)")})
    return items.selectExpr(*_RAW_COLUMNS, *_KEY)


_SIGNAL_SQL = """
  w AS (SELECT *, CAST(floor(l_extendedprice) AS BIGINT) AS hi,
      CAST(floor(l_extendedprice / 10) AS BIGINT) AS lo FROM star WHERE l_linenumber <> 6),
  g AS (SELECT *, p_type AS e, CASE WHEN l_returnflag = 'N' THEN s_name ELSE '' END AS inst,
      CASE WHEN l_linestatus = 'O' THEN p_name ELSE p_brand END AS br,
      CASE WHEN l_linenumber IN (1, 2) THEN 'OBC' WHEN l_linenumber = 3 THEN 'SC'
        WHEN l_linenumber = 4 THEN 'ST' END AS cat,
      CASE WHEN l_quantity < 25 THEN 2019 WHEN l_tax = 0 THEN 2021
        WHEN l_returnflag = 'A' THEN 2022 END AS yr,
      CASE WHEN l_linenumber IN (1, 2, 3, 7) THEN lo END AS o,
      CASE WHEN l_linenumber IN (1, 2, 3, 4) THEN hi WHEN l_linenumber = 5 THEN 58 END AS c FROM w)"""


@query("raw_signal", with_star(f"""
  SELECT {_KEYS}, e AS "Exam", inst AS "Institute", br AS "Branch", p_brand AS "Program",
    cat AS "Category", CAST(NULL AS VARCHAR) AS "Quota", CAST(yr AS BIGINT) AS "Year",
    'R' || l_linenumber AS "Round", o AS "OpeningRank", c AS "ClosingRank",
    'https://s.org/' || l_orderkey AS "SourceURL" FROM g""", _SIGNAL_SQL))
def raw_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = side.row_signal(_raw(spark, sf_dir), tuple(_KEY))
    return rows.select(*_KEY, "Exam", "Institute", "Branch", "Program", "Category", "Quota", "Year",
                       "Round", "OpeningRank", "ClosingRank", "SourceURL")


def _websites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").filter("p_type <> 'PROMO'") \
        .select(F.col("p_type").alias("exam")).distinct() \
        .withColumn("website", F.concat(F.lit("https://gov/"), F.lower("exam")))


_DISTIL_SQL = """d AS (SELECT * FROM g QUALIFY row_number() OVER (
  PARTITION BY e, inst, br, cat, yr, o, c ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) = 1)"""


@query("distil", with_star("""
  SELECT e AS "Exam Name", CASE WHEN e <> 'PROMO' THEN 'https://gov/' || lower(e) END
      AS "Link of website", inst AS "College Name", CAST(NULL AS VARCHAR) AS "City",
    CAST(NULL AS VARCHAR) AS "State", p_brand AS "Program", br AS "Branch",
    CAST(yr AS BIGINT) AS "Year - cutoff", 'R' || l_linenumber AS "Round #",
    CAST(NULL AS VARCHAR) AS "Gender", CAST(NULL AS VARCHAR) AS "Quota", cat AS "Category",
    o AS "Opening Rank", c AS "Closing Rank", 'https://s.org/' || l_orderkey AS "Link - Data Taken from"
  FROM d""", _SIGNAL_SQL, _DISTIL_SQL))
def distil(spark: SparkSession, sf_dir: str) -> DataFrame:
    return side.distil(_raw(spark, sf_dir), _websites(spark, sf_dir), _KEY)


@query("side_metrics", with_star("""
  SELECT e AS "Exam Name", count(*) AS rows, count(c) AS with_closing,
    CAST(min(yr) AS BIGINT) AS first_year, CAST(max(yr) AS BIGINT) AS last_year
  FROM d GROUP BY 1""", _SIGNAL_SQL, _DISTIL_SQL))
def side_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = side.distil(_raw(spark, sf_dir), _websites(spark, sf_dir), _KEY)
    return side.side_metrics(rows, ["Exam Name"])


@query("article_table", with_star("""
  SELECT 'MP DTE' AS "Exam Name", 'Madhya Pradesh' AS "State", s_name AS "College Name",
    p_name AS "Branch", CAST(2024 AS BIGINT) AS "Year - cutoff", c AS "Closing Rank",
    'https://s.org/' || l_orderkey AS "Link - Data Taken from"
  FROM a QUALIFY row_number() OVER (PARTITION BY s_name, p_name, cat, c
    ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) = 1""",
    """a AS (SELECT *, CASE WHEN l_returnflag = 'A' THEN 'SC' END AS cat,
      CAST(floor(l_extendedprice) AS BIGINT) AS c FROM star
      WHERE l_linestatus = 'O' AND l_discount <> 0 AND l_tax <> 0)"""))
def article_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = star(spark, sf_dir).selectExpr(
        "if(l_tax = 0, '  ', concat(s_name, ' ')) as institute_name",
        "if(l_linestatus = 'O', p_name, '') as branch_or_course",
        "if(l_returnflag = 'A', 'SC', null) as category", "cast(null as bigint) as opening_rank",
        "if(l_discount = 0, null, cast(floor(l_extendedprice) as bigint)) as closing_rank",
        "concat('https://s.org/', l_orderkey) as page_url", *_KEY)
    return side.article_table(raw, _KEY).select(
        "Exam Name", "State", "College Name", "Branch", "Year - cutoff", "Closing Rank",
        "Link - Data Taken from")


@query("quality_gate", with_star("""
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
    CASE WHEN l_returnflag = 'A' THEN 'Great College' ELSE s_name END AS "Institute",
    p_name AS "Branch", CASE WHEN l_returnflag = 'A' THEN 'OBC-NCL' ELSE 'SC' END AS "Category",
    CAST(CASE WHEN l_returnflag = 'A' THEN 2023 END AS BIGINT) AS "Year",
    CASE WHEN l_returnflag = 'A' THEN 'Round 2' END AS "Round",
    CASE WHEN l_discount <> 0 THEN CAST(floor(l_extendedprice * 10) AS BIGINT) END AS "ClosingRank",
    CASE WHEN l_tax <> 0 THEN '99.5' END AS "CutoffPercentile"
  FROM star WHERE l_returnflag <> 'R' AND l_linestatus = 'O' AND (l_discount <> 0 OR l_tax <> 0)"""))
def quality_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which raw rows are cutoffs, and what their caption adds."""
    raw = star(spark, sf_dir).selectExpr(
        "p_type as exam", "case l_returnflag when 'A' then 'Great College - Cut Off 2023 OBC-NCL "
        "Round 2' when 'N' then 'Closing Ranks' else 'Admission Dates' end as table_caption",
        "if(l_returnflag = 'A', '', s_name) as institute_name",
        "if(l_linestatus = 'O', p_name, if(l_returnflag = 'A', ' ', s_name)) as branch_or_course",
        "if(l_returnflag = 'A', null, 'SC') as category", "'' as year",
        "cast(null as string) as counselling_round", "cast(null as string) as gender",
        "cast(null as string) as quota", "cast(null as bigint) as opening_rank",
        "if(l_discount = 0, null, cast(floor(l_extendedprice * 10) as bigint)) as closing_rank",
        "if(l_tax = 0, '', '99.5') as cutoff_percentile", *_KEY)
    return side.quality_gate(raw, tuple(_KEY)).select(
        *_KEY, "Institute", "Branch", "Category", "Year", "Round", "ClosingRank",
        "CutoffPercentile")


# --- web research ----------------------------------------------------------------------
def _research(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Orders are batch files with one exam object each; customers are the exams."""
    files = table(spark, sf_dir, "orders").selectExpr(
        "if(o_orderstatus = 'F', 0, 1) as dir_order", "o_orderkey as file", """concat(
        '{"E', o_custkey, '": {', if(o_orderstatus = 'F', '"status": "ok", "note": "n',
          '"data_status": "some", "official_note": "o'), o_orderkey, '", "source_url": "https://w/',
        o_custkey, '", "rows": [{"College Name": "C', o_orderkey, '", "Opening Rank": "1,',
        lpad(o_orderkey % 1000, 3, '0'), '", "Closing Rank": null, "Year - cutoff": 2024}, ',
        '{"College Name": "P", "Closing Rank": "abc", "Cutoff Percentile/Score": ',
        if(o_orderpriority = '1-URGENT', '98.5', '"null"'),
        ', "Link - Data Taken from": "https://own/"}]}, "skipped": 3}') as text""")
    batches = exam_payloads(files, "text", ["dir_order", "file"])
    customer = table(spark, sf_dir, "customer")
    verdicts = customer.selectExpr("concat('E', c_custkey) as exam", "c_mktsegment as fidelity",
                                   "c_mktsegment = 'MACHINERY' as drop")
    websites = customer.filter("c_nationkey < 12").selectExpr(
        "concat('E', c_custkey) as exam", "concat('https://gov/', c_custkey) as website")
    return batches, verdicts, websites


_RESEARCH_SQL = """
  b AS (SELECT *, 'E' || o_custkey AS e FROM orders JOIN customer ON o_custkey = c_custkey
    WHERE c_mktsegment <> 'MACHINERY'),
  site AS (SELECT *, CASE WHEN c_nationkey < 12 THEN 'https://gov/' || o_custkey
    ELSE 'https://w/' || o_custkey END AS website FROM b)"""


@query("web_fold", f"""
  WITH {_RESEARCH_SQL}
  SELECT DISTINCT e AS "Exam Name", website AS "Link of website", 'C' || o_orderkey AS "College Name",
    '2024' AS "Year - cutoff", 1000 + o_orderkey % 1000 AS "Opening Rank",
    CAST(NULL AS BIGINT) AS "Closing Rank", CAST(NULL AS VARCHAR) AS "Cutoff Percentile/Score",
    'https://w/' || o_custkey AS "Link - Data Taken from", c_mktsegment AS "Fidelity" FROM site
  UNION ALL SELECT DISTINCT e, website, 'P', NULL, NULL, NULL, '98.5', 'https://own/', c_mktsegment
  FROM site WHERE o_orderpriority = '1-URGENT' """)
def web_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return side.web_rows(*_research(spark, sf_dir)).select(
        "Exam Name", "Link of website", "College Name", "Year - cutoff", "Opening Rank",
        "Closing Rank", "Cutoff Percentile/Score", "Link - Data Taken from", "Fidelity")


@query("web_status", f"""
  WITH {_RESEARCH_SQL}
  SELECT e AS exam, arg_max(CASE WHEN o_orderstatus = 'F' THEN 'ok' ELSE 'some' END, k) AS status,
    arg_max(CASE WHEN o_orderstatus = 'F' THEN 'n' ELSE 'o' END || o_orderkey, k) AS note,
    CAST(sum(CASE WHEN o_orderpriority = '1-URGENT' THEN 2 ELSE 1 END) AS BIGINT) AS rows_kept
  FROM (SELECT *, CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END * 1000000000000 + o_orderkey AS k
    FROM b) GROUP BY 1""")
def web_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    batches, verdicts, _ = _research(spark, sf_dir)
    return side.web_status(batches, verdicts, ["dir_order", "file", "pos"])


# --- exams without a link -----------------------------------------------------------------
_CANDIDATE = "concat('https://collegedekho.com/customer-', lower(c_mktsegment), '-', c_custkey)"


def _search(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    c = table(spark, sf_dir, "customer", heavy=True)
    exam = "concat('Customer ', c_mktsegment, ' Institute ', c_custkey) as exam"
    exams = c.selectExpr(exam)
    candidates = c.filter("c_nationkey >= 5").selectExpr(
        exam, "inline(array(named_struct('position', 0, 'url', 'https://youtube.com/x'), "
        "named_struct('position', 1, 'url', concat('https://other.org/', c_custkey)), "
        f"named_struct('position', 2, 'url', {_CANDIDATE})))")
    pages = c.filter("c_mktsegment <> 'HOUSEHOLD'").selectExpr(
        f"{_CANDIDATE} as url", """concat('<title>x</title><h2>', c_name, ' Cut Off 2024</h2>',
        if(c_custkey % 2 = 0, concat('<table><tr><th>Course</th><th>SC</th><th>ST</th></tr>',
          '<tr><td>Civil</td><td>', c_custkey + 1, '</td><td>-</td></tr>',
          '<tr><td>Civil</td><td>', c_custkey + 1, '</td><td>7</td></tr></table>'), '')) as html""")
    return exams, candidates, pages


@query("provenance", """
  SELECT 'Customer ' || c_mktsegment || ' Institute ' || c_custkey AS exam,
    CASE WHEN c_nationkey < 5 THEN '' ELSE 'https://collegedekho.com/customer-'
      || lower(c_mktsegment) || '-' || c_custkey END AS candidate_url,
    c_nationkey >= 5 AND c_mktsegment <> 'HOUSEHOLD' AS http_ok,
    CASE WHEN c_nationkey >= 5 AND c_mktsegment <> 'HOUSEHOLD' AND c_custkey % 2 = 0 THEN 1 ELSE 0 END
      AS n_tables, c_nationkey >= 5 AND c_mktsegment <> 'HOUSEHOLD' AND c_custkey % 2 = 0 AS found,
    CASE WHEN c_nationkey < 5 THEN 'no search result' WHEN c_mktsegment = 'HOUSEHOLD'
      THEN 'fetch failed/blocked' WHEN c_custkey % 2 = 0 THEN 'cutoff-like table found'
      ELSE 'page fetched, no cutoff table' END AS note,
    CASE WHEN c_nationkey >= 5 AND c_mktsegment <> 'HOUSEHOLD' AND c_custkey % 2 = 0 THEN 2 ELSE 0 END
      AS rows_extracted FROM customer""")
def provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    exams, candidates, pages = _search(spark, sf_dir)
    audit = side.provenance(exams, side.rank_candidates(candidates), pages)
    return side.fill_missing(audit, pages)[1].drop("query", "generated_at")


@query("cat3_fill", """
  SELECT 'Customer ' || c_mktsegment || ' Institute ' || c_custkey AS "Exam Name",
    c_name AS "College Name", 'Civil' AS "Branch", CAST(2024 AS BIGINT) AS "Year - cutoff",
    CASE k WHEN 'SC' THEN c_custkey + 1 ELSE 7 END AS "Closing Rank",
    'https://collegedekho.com/customer-' || lower(c_mktsegment) || '-' || c_custkey
      AS "Link - Data Taken from"
  FROM customer, (VALUES ('SC'), ('ST')) t(k)
  WHERE c_nationkey >= 5 AND c_mktsegment <> 'HOUSEHOLD' AND c_custkey % 2 = 0""")
def cat3_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    exams, candidates, pages = _search(spark, sf_dir)
    audit = side.provenance(exams, side.rank_candidates(candidates), pages)
    rows, _ = side.fill_missing(audit, pages)
    return rows.select("Exam Name", "College Name", "Branch", "Year - cutoff", "Closing Rank",
                       "Link - Data Taken from")


# --- unions ----------------------------------------------------------------------------------
_UNION_LIST = ", ".join(f'"{c}"' for c in UNION_COLUMNS)


def _layers(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    rows = canonical(spark, sf_dir)
    web = project_deliverable(rows.filter("Body = 'EUROPE'"), True).withColumns({
        "Fidelity": F.lit("portal"), "Cutoff Percentile/Score": F.lit("98.5"),
        "Year - cutoff": F.col("Year - cutoff").cast("double")})
    return {"official": project_deliverable(rows.filter("Body in ('AFRICA', 'ASIA')"), True),
            "aggregator": project_deliverable(rows.filter("Body = 'AMERICA'"), True),
            "articles": project_deliverable(rows.filter("Body = 'MIDDLE EAST'")), "web": web}


@query("union_export", with_star("""
  SELECT CASE "Body" WHEN 'AMERICA' THEN 'competitor-aggregator' WHEN 'MIDDLE EAST' THEN
      'mp-aggregator' WHEN 'EUROPE' THEN 'cat3-web-research' ELSE 'official-adapter' END AS "Source",
    CASE "Body" WHEN 'AMERICA' THEN 'aggregator' WHEN 'MIDDLE EAST' THEN 'aggregator'
      WHEN 'EUROPE' THEN 'web-research' ELSE 'official' END AS "Fidelity",
    CASE "Body" WHEN 'EUROPE' THEN 'portal' END AS "Provenance Note", "Exam" AS "Exam Name",
    "Website" AS "Link of website", "Institute" AS "College Name", "City", "State", "Program",
    "Branch", CAST("Year" AS VARCHAR) AS "Year - cutoff", "Round" AS "Round #", "Gender", "Quota",
    CASE WHEN "Body" <> 'MIDDLE EAST' THEN "Category" END AS "Category",
    CAST("OpeningRank" AS VARCHAR) AS "Opening Rank", CAST("ClosingRank" AS VARCHAR) AS "Closing Rank",
    CASE "Body" WHEN 'EUROPE' THEN '98.5' END AS "Cutoff Percentile/Score",
    "SourceURL" AS "Link - Data Taken from" FROM star"""))
def union_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return side.union_export(_layers(spark, sf_dir))


@query("exam_coverage", with_star("""
  SELECT exam, CASE min(t) WHEN 1 THEN 'official' WHEN 2 THEN 'aggregator' ELSE 'web-research' END
      AS layer
  FROM (SELECT "Exam" || ' ' || "State" AS exam, CASE WHEN "Year" < 1996 THEN 1 WHEN "Year" < 1999
      AND "Level" = 'UG' THEN 2 ELSE 3 END AS t FROM star) GROUP BY 1"""))
def exam_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exams by the most trusted layer that has them."""
    rows = canonical(spark, sf_dir).withColumn("Exam", F.concat("Exam", F.lit(" "), "State"))
    official = F.col("Year") < 1996
    second = ~official & (F.col("Year") < 1999) & (F.col("Level") == "UG")
    return side.exam_coverage(
        rows.filter(official),
        rows.filter(second).withColumnRenamed("Exam", "Exam Name"),
        rows.filter(~official & ~second).withColumnRenamed("Exam", "Exam Name"))



@query("audit_statistics", """
  SELECT count(*) AS exams, count_if(f) AS found_pages, count_if(f) AS exams_with_rows,
    2 * count_if(f) AS cutoff_rows
  FROM (SELECT c_nationkey >= 5 AND c_mktsegment <> 'HOUSEHOLD' AND c_custkey % 2 = 0 AS f
    FROM customer)""")
def audit_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    exams, candidates, pages = _search(spark, sf_dir)
    audit = side.provenance(exams, side.rank_candidates(candidates), pages)
    return side.audit_statistics(side.fill_missing(audit, pages)[1])


@query("record_envelopes", """
  SELECT o_orderkey, 'E' || o_orderkey AS exam, o_orderpriority AS body FROM orders
  WHERE o_orderstatus IN ('F', 'O', 'P')""")
def record_envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bare list, {records} and {result: {records}}, by order status."""
    record = """concat('[{"exam": "E', o_orderkey, '", "body": "', o_orderpriority, '"}]')"""
    files = table(spark, sf_dir, "orders").selectExpr("o_orderkey", f"""case o_orderstatus
        when 'F' then {record} when 'O' then concat('{{"records": ', {record}, '}}')
        else concat('{{"result": {{"records": ', {record}, '}}}}') end as text""")
    return unwrap_records(files, "text", "exam string, body string", ("o_orderkey",))
