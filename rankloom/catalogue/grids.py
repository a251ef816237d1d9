"""Grid queries: header carry, melts, headings, allotments, positioned words.

The documents are laid out from line items: a supplier is a document, orders
give its pages. Nothing is grouped to build them, so the layout scales with the
table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.catalogue.bridge import table
from rankloom.catalogue.registry import query
from rankloom.operators import grids
from rankloom.operators.carry import heading_above
from rankloom.operators.headers import detect_roles
from rankloom.operators.mapping import map_tables, national_grid, portal_report
from rankloom.operators.rawrows import raw_rows

_DOC = "concat('S', cast(l_suppkey as string)) as doc_id"
_PAGE = "l_orderkey as page"
# one table per line item; unique inside its page
_TABLE = "l_partkey * 10 + l_linenumber as table_idx"


def line_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem", heavy=True).withColumns({
        "inst": F.expr("concat('College ', cast(l_suppkey as string), ' of Arts')"),
        "branch": F.expr("concat('Branch ', cast(l_partkey as string))"),
        "hi": F.expr("cast(cast(floor(l_extendedprice) as bigint) as string)"),
        "lo": F.expr("cast(cast(floor(l_extendedprice / 10) as bigint) as string)")})


ITEM_SQL = """i AS (SELECT *, 'College ' || l_suppkey || ' of Arts' AS inst,
  'Branch ' || l_partkey AS branch, CAST(floor(l_extendedprice) AS BIGINT) AS hi,
  CAST(floor(l_extendedprice / 10) AS BIGINT) AS lo FROM lineitem)"""


def laid_out(df: DataFrame, *rows: str, table_idx: str = _TABLE) -> DataFrame:
    """One table per line item, its rows given as SQL arrays of cells."""
    lines = ", ".join(f"named_struct('row_idx', {i}, 'cells', {r})" for i, r in enumerate(rows))
    return df.selectExpr(_DOC, _PAGE, table_idx, f"inline(array({lines}))")


# --- header carry -------------------------------------------------------------
@query("flat_header_carry", f"""
  WITH {ITEM_SQL}, c AS (SELECT *, last_value(CASE WHEN l_linenumber = 1
      THEN l_returnflag = 'A' END IGNORE NULLS) OVER (PARTITION BY l_suppkey
      ORDER BY l_orderkey, l_linenumber, l_partkey ROWS UNBOUNDED PRECEDING) AS open_first
    FROM i)
  SELECT 'S' || l_suppkey AS doc_id, l_orderkey AS page, inst AS "Institute",
    branch AS "Branch", l_returnflag AS "Quota",
    CASE WHEN NOT open_first THEN hi WHEN l_discount <> 0 THEN lo END AS "OpeningRank",
    CASE WHEN open_first THEN hi ELSE lo END AS "ClosingRank"
  FROM c WHERE open_first IS NOT NULL AND (open_first OR l_discount <> 0)""")
def flat_header_carry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two header orders; the latest one applies across pages of a document."""
    items = line_items(spark, sf_dir)
    low = "if(l_discount = 0, '--', concat(lo, ' *'))"
    cells = f"array(concat(' ', inst), branch, l_returnflag, {low}, " \
            "format_number(cast(hi as bigint), 0))"
    data = items.selectExpr(_DOC, _PAGE, "l_linenumber as table_idx",
                            "l_partkey * 2 + 1 as row_idx", f"{cells} as cells")
    labels = "array('Institute Name', 'Program', 'Quota', {}, {})"
    heads = items.filter("l_linenumber = 1").selectExpr(
        _DOC, _PAGE, "l_linenumber as table_idx", "l_partkey * 2 as row_idx",
        "if(l_returnflag = 'A', {}, {}) as cells".format(
            labels.format("'Opening\\nRank'", "'Closing Rank'"),
            labels.format("'Closing Rank'", "'Opening Rank'")))
    out = grids.flat_records(data.unionByName(heads), grids.CAPITAL_COLUMNS)
    return out.select("doc_id", F.col("page").cast("bigint").alias("page"), "Institute",
                      "Branch", "Quota", "OpeningRank", "ClosingRank")


@query("allotment_cutoffs", f"""
  WITH {ITEM_SQL} SELECT inst AS "Institute", l_returnflag AS "Category",
    CASE WHEN l_linestatus = 'O' THEN 'Open' END AS "Branch",
    min(hi) AS "OpeningRank", max(hi) AS "ClosingRank" FROM i
  WHERE l_discount <> 0 GROUP BY 1, 2, 3""")
def allotment_cutoffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate allotments to opening and closing ranks per seat group."""
    head = "array('Sl. No.', 'CML Rank', 'Alloted Institute', 'Alloted Branch', " \
           "'Seat Alloted Category')"
    row = "array('1', if(l_discount = 0, 'NA', hi), inst, " \
          "if(l_linestatus = 'O', 'Open', ''), l_returnflag)"
    grid = laid_out(line_items(spark, sf_dir), head, row)
    return grids.allotment_cutoffs(grids.allotment_rows(grid))


# --- melts ---------------------------------------------------------------------
@query("last_rank_melt", f"""
  WITH {ITEM_SQL} SELECT inst AS "Institute", branch AS "Branch", 'Town' AS "City",
    c AS "Category", g AS "Gender", CASE WHEN c = 'OC' THEN hi ELSE lo END AS "ClosingRank"
  FROM i, (VALUES ('OC', 'Male'), ('BCA', 'Female')) t(c, g)
  WHERE c = 'OC' OR l_discount <> 0""")
def last_rank_melt(spark: SparkSession, sf_dir: str) -> DataFrame:
    head = "array('Sl', 'Institute\\nName', 'Branch Name', 'Place', 'OC_BO\\nYS', 'OC_GIRLS', " \
           "'BC_A_GIRLS')"
    row = "array('1', inst, branch, 'Town', hi, '', if(l_discount = 0, '--', lo))"
    out = grids.last_rank_melt(laid_out(line_items(spark, sf_dir), head, row))
    return out.select("Institute", "Branch", "City", "Category", "Gender", "ClosingRank")


@query("community_melt", f"""
  WITH {ITEM_SQL} SELECT inst AS "Institute", branch AS "Branch", c AS "Category",
    CASE WHEN c = 'OC' THEN hi ELSE lo END AS "ClosingRank"
  FROM i, (VALUES ('OC'), ('MBC')) t(c) WHERE c = 'OC' OR l_discount <> 0""")
def community_melt(spark: SparkSession, sf_dir: str) -> DataFrame:
    head = "array('College Code', 'College Name', 'Branch Code', 'Branch Name', 'OC', 'XX', 'mbc')"
    row = "array('7', inst, '9', branch, hi, '5', if(l_discount = 0, '1.5', lo))"
    out = grids.community_melt(laid_out(line_items(spark, sf_dir), head, row))
    return out.select("Institute", "Branch", "Category", "ClosingRank")


@query("branch_melt", f"""
  WITH {ITEM_SQL} SELECT inst AS "Institute", b AS "Branch", l_returnflag AS "Category",
    CASE WHEN b = 'Design' THEN hi ELSE lo END AS "ClosingRank"
  FROM i, (VALUES ('Design'), ('Computer Science')) t(b) WHERE b = 'Design' OR l_discount <> 0""")
def branch_melt(spark: SparkSession, sf_dir: str) -> DataFrame:
    head = "array('College Code', 'College Name', 'Seat Type', 'AD-Design', '', " \
           "'CS- Computer Science')"
    row = "array('7', inst, l_returnflag, hi, '12', if(l_discount = 0, '-', lo))"
    out = grids.branch_melt(laid_out(line_items(spark, sf_dir), head, row))
    return out.select("Institute", "Branch", "Category", "ClosingRank")


@query("sectioned_matrix", f"""
  WITH {ITEM_SQL}, c AS (SELECT *, last_value(CASE WHEN l_linenumber = 1 THEN branch END
      IGNORE NULLS) OVER w AS section, last_value(CASE WHEN l_linenumber = 2 THEN l_linestatus
      END IGNORE NULLS) OVER w AS layout FROM i
    WINDOW w AS (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey
      ROWS UNBOUNDED PRECEDING))
  SELECT inst AS "Institute", coalesce(section, '') AS "Branch",
    CASE WHEN k = 1 THEN 'SM' WHEN layout = 'O' THEN 'EZ' ELSE 'SC' END AS "Category",
    CASE k WHEN 1 THEN hi ELSE lo END AS "ClosingRank"
  FROM c, (VALUES (1), (2)) t(k)
  WHERE layout IS NOT NULL AND (k = 1 OR l_discount <> 0)""")
def sectioned_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Branch rows and category headers carried over pages, independently."""
    items = line_items(spark, sf_dir)

    def at(offset: int, cells: str, condition: str) -> DataFrame:
        return items.filter(condition).selectExpr(
            _DOC, _PAGE, "l_linenumber as table_idx",
            f"l_partkey * 3 + {offset} as row_idx", f"{cells} as cells")

    section = at(0, "array('', branch, '', '')", "l_linenumber = 1")
    head = at(1, "array('No', 'Name of College', 'SM', if(l_linestatus = 'O', 'ez', 'SC'))",
              "l_linenumber = 2")
    rows = at(2, "array('G', inst, format_number(cast(hi as bigint), 0), "
                 "if(l_discount = 0, '-', lo))", "true")
    out = grids.sectioned_matrix(section.unionByName(head).unionByName(rows))
    return out.select("Institute", "Branch", "Category", "ClosingRank")


# --- headings --------------------------------------------------------------------
_SPOT = "cast(l_orderkey % 250 * 40 + l_linenumber * 5 + l_partkey % 5 as double)"
_SPOT_PAGE = "l_orderkey div 250 as page"
_SPOT_TABLE = "(l_orderkey % 250 * 10 + l_linenumber) * 100000000 + l_partkey as table_idx"
# a heading stands just above its table, or below it
_HEAD_TOP = f"{_SPOT} + if(l_linestatus = 'O', -1.0D, 3.0D) as top"


def spots(items: DataFrame, *rows: str) -> tuple[DataFrame, DataFrame]:
    tables = items.selectExpr(_DOC, _SPOT_PAGE, _SPOT_TABLE, f"{_SPOT} as top")
    lines = ", ".join(f"named_struct('row_idx', {i}, 'cells', {r})" for i, r in enumerate(rows))
    grid = items.selectExpr(_DOC, _SPOT_PAGE, _SPOT_TABLE, f"inline(array({lines}))") \
        if rows else None
    return tables, grid


def _heading_sql(flag: str, text: str, name: str) -> str:
    """Nearest heading above by aggregate, then carried over tables."""
    return f"""
  {name}_h AS (SELECT l_suppkey AS s, l_orderkey // 250 AS p,
      CAST(l_orderkey % 250 * 40 + l_linenumber * 5 + l_partkey % 5 AS DOUBLE)
        + CASE l_linestatus WHEN 'O' THEN -1 ELSE 3 END AS htop, l_partkey AS k, {text} AS txt
    FROM i WHERE {flag}),
  {name}_l AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
      arg_max(txt, htop * 1e9 - k) AS own FROM i LEFT JOIN {name}_h
      ON s = l_suppkey AND p = l_orderkey // 250
      AND htop <= l_orderkey % 250 * 40 + l_linenumber * 5 + l_partkey % 5 + 2 GROUP BY ALL),
  {name} AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
      last_value(own IGNORE NULLS) OVER (PARTITION BY l_suppkey
        ORDER BY l_orderkey, l_linenumber, l_partkey ROWS UNBOUNDED PRECEDING) AS {name}_txt
    FROM {name}_l)"""


_COLLEGE_SQL = _heading_sql("l_returnflag = 'A'", "'College ' || l_partkey", "college")
_COURSE_SQL = _heading_sql("l_returnflag = 'N'", "'Course ' || l_partkey", "course")
_JOIN = "USING (l_orderkey, l_linenumber, l_partkey, l_suppkey)"


@query("heading_above", f"""
  WITH {ITEM_SQL}, {_COLLEGE_SQL}
  SELECT 'S' || l_suppkey AS doc_id, l_orderkey // 250 AS page,
    (l_orderkey % 250 * 10 + l_linenumber) * 100000000 + l_partkey AS table_idx,
    college_txt AS "Institute" FROM college""")
def nearest_heading(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = line_items(spark, sf_dir)
    lines = items.filter("l_returnflag = 'A'").selectExpr(
        _DOC, _SPOT_PAGE, "l_partkey as line_idx", _HEAD_TOP,
        "concat('12 E123 College ', cast(l_partkey as string)) as text")
    tables, _ = spots(items)
    out = heading_above(tables, grids.college_headings(lines), ["Institute"])
    return out.select("doc_id", F.col("page").cast("bigint").alias("page"), "table_idx",
                      "Institute")


@query("headed_matrix", f"""
  WITH {ITEM_SQL}, {_COLLEGE_SQL}
  SELECT college_txt AS "Institute", branch AS "Branch", c AS "Category",
    CASE c WHEN 'GM' THEN hi ELSE lo END AS "ClosingRank"
  FROM i JOIN college {_JOIN}, (VALUES ('GM'), ('SCH')) t(c)
  WHERE college_txt IS NOT NULL AND (c = 'GM' OR l_discount <> 0)""")
def headed_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = line_items(spark, sf_dir)
    lines = items.filter("l_returnflag = 'A'").selectExpr(
        _DOC, _SPOT_PAGE, "l_partkey as line_idx", _HEAD_TOP,
        "concat('12 E123 College ', cast(l_partkey as string)) as text")
    tables, grid = spots(items, "array('Course', 'GM', '2AG', 'SCH')",
                          "array(branch, hi, '--', if(l_discount = 0, '', lo))")
    out = grids.headed_matrix(grid, lines, tables)
    return out.select("Institute", "Branch", "Category", "ClosingRank")


@query("staged_matrix", f"""
  WITH {ITEM_SQL}, {_COLLEGE_SQL}, {_COURSE_SQL}
  SELECT college_txt AS "Institute", course_txt AS "Branch", c AS "Category",
    'CAP1 Stage I' AS "Round", CASE c WHEN 'GOPENS' THEN hi ELSE lo END AS "ClosingRank"
  FROM i JOIN college {_JOIN} JOIN course {_JOIN}, (VALUES ('GOPENS'), ('EWS')) t(c)
  WHERE college_txt IS NOT NULL AND course_txt IS NOT NULL
    AND (c = 'GOPENS' OR l_discount <> 0)""")
def staged_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two headings carried independently; cells are "rank (percentile)"."""
    items = line_items(spark, sf_dir)
    lines = items.filter("l_returnflag in ('A', 'N')").selectExpr(
        _DOC, _SPOT_PAGE, "l_partkey as line_idx", _HEAD_TOP,
        "if(l_returnflag = 'A', concat('01002 - College ', cast(l_partkey as string)), "
        "concat('0100219110 - Course ', cast(l_partkey as string))) as text")
    tables, grid = spots(items, "array('Stage', 'GOPENS', 'EW\\nS', '')",
                          "array('I', concat(hi, '\\n(98.2)'), "
                          "if(l_discount = 0, '', concat(lo, ' (1.0)')), '9')")
    out = grids.staged_matrix(grid, lines, tables, "CAP1")
    return out.select("Institute", "Branch", "Category", "Round", "ClosingRank")


# --- positioned words --------------------------------------------------------------
def words(items: DataFrame) -> DataFrame:
    """A page of positioned words per line item."""
    heads = [("INSTITUTE", 0), ("NAME", 40), ("STREAM", 100), ("QUOTA", 200), ("CATEGORY", 250),
             ("SEAT", 300), ("TYPE", 330), ("OPENING", 360), ("RANK", 390), ("CLOSING", 420)]
    body = [("'NIT'", 0), ("cast(l_suppkey as string)", 30), ("'Civil'", 100), ("'Engg'", 140),
            ("if(l_linestatus = 'O', '(Self)', '')", 201), ("'HS'", 230),
            ("if(l_returnflag = 'A', 'OBC-NCL', 'General')", 260), ("'Female'", 305),
            ("'Only'", 330), ("if(l_discount = 0, '-', lo)", 365), ("hi", 425)]
    placed = [(f"'{w}'", x, 50) for w, x in heads] + [(w, x, 80) for w, x in body]
    words = ", ".join(
        f"named_struct('word_idx', {i}, 'top', cast({top} as double) + {i} * 0.01D, "
        f"'x0', cast({x} as double), 'text', {w})" for i, (w, x, top) in enumerate(placed))
    # the page's name is made once, not for each word
    pages = items.selectExpr(
        "*", "concat('S', cast(l_suppkey as string), '-', cast(l_partkey as string)) as doc_id",
        "l_orderkey * 10 + l_linenumber as page")
    return pages.selectExpr("doc_id", "page", f"inline(array({words}))").filter("text <> ''")


@query("borderless_rows", f"""
  WITH {ITEM_SQL} SELECT 'NIT ' || l_suppkey AS "Institute",
    'Civil Engg' || CASE WHEN l_linestatus = 'O' THEN ' (Self)' ELSE '' END AS "Branch",
    'HS' AS "Quota", CASE WHEN l_returnflag = 'A' THEN 'OBC-NCL' ELSE 'General' END AS "Category",
    'Female-only' AS "Gender", CASE WHEN l_discount <> 0 THEN lo END AS "OpeningRank",
    hi AS "ClosingRank" FROM i""")
def borderless_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words with coordinates, one page per line item."""
    out = grids.borderless_rows(words(line_items(spark, sf_dir)))
    return out.select("Institute", "Branch", "Quota", "Category", "Gender", "OpeningRank",
                      "ClosingRank")


# --- table records -------------------------------------------------------------------
def _records(spark: SparkSession, sf_dir: str, header: str, *rows: str) -> DataFrame:
    """One table record per line item, as the HTML step gives them."""
    return line_items(spark, sf_dir).selectExpr(
        "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) as page_id",
        "concat('https://x.org/', cast(l_orderkey as string)) as url", "0 as table_idx",
        "concat(inst, ' Cut Off 2024') as caption", f"{header} as header",
        f"array({', '.join(rows)}) as rows", "hi", "lo", "l_discount", "l_returnflag")


@query("detect_roles", """
  SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS page_id,
    CASE l_returnflag WHEN 'A' THEN 2 ELSE 1 END AS closing_at,
    CASE l_returnflag WHEN 'A' THEN 1 ELSE 2 END AS opening_at,
    3 AS year_at, CASE l_returnflag WHEN 'A' THEN 0 END AS institute_at,
    CASE l_returnflag WHEN 'A' THEN NULL ELSE 0 END AS branch_at FROM lineitem""")
def roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = _records(spark, sf_dir, "if(l_returnflag = 'A', array('College', 'Opening Rank', "
                      "'Closing Rank', '2024'), array('Branch 2024', 'Last Rank', "
                      "'First Rank', 'Year'))", "array('')")
    found = detect_roles("header")
    return tables.select("page_id", *[
        F.try_element_at(found, F.lit(role)).cast("int").alias(name) for role, name in [
            ("closing_rank", "closing_at"), ("opening_rank", "opening_at"), ("year", "year_at"),
            ("institute_name", "institute_at"), ("branch_or_course", "branch_at")]])


def _raw(spark: SparkSession, sf_dir: str, header: str, *rows: str) -> DataFrame:
    tables = _records(spark, sf_dir, header, *rows).selectExpr(
        "*", "'site' as source_competitor", "'Exam' as exam", "'exam' as exam_slug",
        "url as page_url", "'exam_cutoff' as page_type", "cast(null as string) as year",
        "cast(null as string) as pdf_url")
    return raw_rows(tables)


@query("wide_melt", f"""
  WITH {ITEM_SQL} SELECT 'https://x.org/' || l_orderkey AS page_url, inst AS institute_name,
    branch AS branch_or_course, c AS category,
    CASE c WHEN 'Open' THEN hi WHEN 'SC' THEN CASE WHEN l_discount <> 0 THEN lo END END
      AS closing_rank, CASE c WHEN 'OBC' THEN '99.87' END AS cutoff_percentile,
    CASE c WHEN 'Open' THEN CAST(hi AS VARCHAR) WHEN 'OBC' THEN '99.87'
      WHEN 'SC' THEN CASE WHEN l_discount <> 0 THEN lo || ' *' ELSE '-' END END AS raw_cell_value
  FROM i, (VALUES ('Open'), ('OBC'), ('SC')) t(c)""")
def wide_melt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Category columns to rows; a decimal below 100 is a percentile."""
    rows = _raw(spark, sf_dir, "array('College', 'Branch', 'Open', 'OBC', 'SC')",
                "array(inst, branch, hi, '99.87', if(l_discount = 0, '-', concat(lo, ' *')))")
    return rows.select("page_url", "institute_name", "branch_or_course", "category",
                       "closing_rank", "cutoff_percentile", "raw_cell_value")


@query("narrow_rows", f"""
  WITH {ITEM_SQL} SELECT 'https://x.org/' || l_orderkey AS page_url,
    inst || ' Cut Off 2024' AS institute_name, '' AS branch_or_course,
    CASE WHEN l_discount <> 0 THEN lo END AS opening_rank,
    hi AS closing_rank,
    CASE WHEN l_discount <> 0 THEN lo || ' - ' || hi END AS rank_range_raw,
    CASE WHEN l_discount <> 0 THEN '{{"Rank":"' || lo || ' - ' || hi || '","Rank.1":"x","Open":null}}'
      ELSE '{{"Rank":"x","Rank.1":"x","Open":null}}' END AS raw_cells
  FROM i WHERE l_discount <> 0
  UNION ALL SELECT 'https://x.org/' || l_orderkey, inst || ' Cut Off 2024', '', NULL, hi, NULL,
    '{{"Rank":"' || hi || '","Rank.1":"x","Open":null}}' FROM i WHERE l_discount = 0""".replace(
        '"Rank"', '"Closing Rank"').replace('"Rank.1"', '"Closing Rank.1"'))
def narrow_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A lone category-like header is the opening column; a range fills both ranks."""
    rows = _raw(spark, sf_dir, "array('Closing Rank', 'Closing Rank', 'Open')",
                "array(if(l_discount = 0, hi, concat(lo, ' - ', hi)), 'x', '')")
    return rows.select("page_url", "institute_name", "branch_or_course", "opening_rank",
                       "closing_rank", "rank_range_raw", "raw_cells")


@query("map_tables", f"""
  WITH {ITEM_SQL} SELECT "Body", 'Exam X' AS "Exam", 'UG' AS "Level", inst AS "Institute",
    branch AS "Branch", CAST(2024 AS BIGINT) AS "Year",
    CASE WHEN "Body" = 'two' AND l_discount <> 0 THEN lo END AS "OpeningRank",
    CASE WHEN "Body" = 'two' OR l_discount <> 0 THEN hi END AS "ClosingRank"
  FROM i, (VALUES ('one'), ('two')) t("Body")
  WHERE "Body" = 'two' OR l_discount <> 0""")
def heuristic_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A lone rank column is the closing one; "Opening Cutoff" never is."""
    one = _records(spark, sf_dir, "array('Name of College', 'Course', 'Merit')",
                   "array(inst, branch, if(l_discount = 0, 'NA', hi))")
    two = _records(spark, sf_dir, "array('Institute', 'Stream', 'Opening Cutoff', "
                   "'Closing  Cutoff', 'Closing Cutoff')",
                   "array(inst, branch, if(l_discount = 0, '', lo), hi, '1')")
    noise = _records(spark, sf_dir, "array('Notice', 'Date')", "array('x', '1')")
    tables = one.withColumn("body", F.lit("one")) \
        .unionByName(two.withColumn("body", F.lit("two"))) \
        .unionByName(noise.withColumn("body", F.lit("none")))
    out = map_tables(tables, {"Exam": F.lit("Exam X"), "Body": F.col("body"),
                              "Level": F.lit("UG"), "Year": F.lit(2024)})
    return out.select("Body", "Exam", "Level", "Institute", "Branch", "Year", "OpeningRank",
                      "ClosingRank")


@query("grid_to_canonical", f"""
  WITH {ITEM_SQL} SELECT inst AS "Institute", branch AS "Branch", hi AS "ClosingRank" FROM i""")
def grid_to_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extracted tables through the general-purpose mapper; ragged ones skipped."""
    items = line_items(spark, sf_dir)
    good = laid_out(items, "array('College ', 'Branch', 'Closing Rank')",
                     "array(inst, branch, hi)")
    ragged = laid_out(items, "array('College', 'Closing Rank')", "array(inst, hi, 'x')",
                       table_idx="-l_partkey * 10 - l_linenumber as table_idx")
    out = map_tables(grids.grid_tables(good.unionByName(ragged)), {"Exam": F.lit("Exam X")})
    return out.select("Institute", "Branch", "ClosingRank")


@query("portal_report", f"""
  WITH {ITEM_SQL} SELECT inst AS "Institute", branch AS "Branch", 'Female' AS "Gender",
    CAST(2025 AS BIGINT) AS "Year", lo AS "OpeningRank", hi AS "ClosingRank",
    'https://x.org/' || l_orderkey AS "SourceURL" FROM i""")
def largest_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest table of a page, by exact labels."""
    big = _records(spark, sf_dir, "array('INSTITUTE', 'Stream', 'Seat Gender', 'Opening Rank', "
                   "'Closing Rank')", "array(inst, branch, 'Female Seats', lo, hi)",
                   "array('', '', '', '', '')")
    small = _records(spark, sf_dir, "array('Institute', 'Closing Rank')", "array(inst, '1')") \
        .withColumn("table_idx", F.lit(1))
    out = portal_report(big.unionByName(small), 2025)
    return out.filter(F.col("Institute").isNotNull()).select(
        "Institute", "Branch", "Gender", "Year", "OpeningRank", "ClosingRank", "SourceURL")


@query("national_grid", f"""
  WITH {ITEM_SQL} SELECT 'JoSAA' AS "Body", inst AS "Institute", branch AS "Branch",
    l_returnflag AS "Category", CAST(2024 AS BIGINT) AS "Year", '6' AS "Round",
    lo AS "OpeningRank", hi AS "ClosingRank" FROM i""")
def first_rank_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first table with both rank headers, by fixed labels."""
    other = _records(spark, sf_dir, "array('Institute', 'Closing Rank')", "array(inst, '1')")
    grid = _records(spark, sf_dir, "array('Institute', 'Academic Program Name', 'Seat Type', "
                    "'Opening Rank', 'Closing Rank ')",
                    "array(inst, branch, l_returnflag, lo, hi)") \
        .withColumn("table_idx", F.lit(3))
    later = grid.withColumn("table_idx", F.lit(7))
    out = national_grid(other.unionByName(grid).unionByName(later), F.lit(2024), F.lit(6))
    return out.select("Body", "Institute", "Branch", "Category", "Year", "Round", "OpeningRank",
                      "ClosingRank")
