"""The star-schema tables seen as published ranks.

``canonical`` maps one line item to one rank row: supplier and nation are the
institute, part the exam and branch, price the closing rank.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.schema import CANON_COLUMNS
from rankloom.session import deal

CODES = ["OPEN", "OBC-NCL", "SC", "ST", "EWS-PH", "2AG", "GOPENS", "BH"]


# Stated schemas: no job reads footers to infer them.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, "
                "c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, "
            "p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, "
              "o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
                "l_quantity double, l_extendedprice double, l_discount double, "
                "l_tax double, l_returnflag string, l_linestatus string, "
                "l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, "
              "value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "benchmark": "item_id bigint, text string",
    "pages": "page_id bigint, url string, html string",
}


# A setting for stores whose files are single row groups: read into so many tasks.
READ_PARTITIONS = "rankloom.read.partitions"


def table(spark: SparkSession, sf_dir: str, name: str, heavy: bool = True) -> DataFrame:
    """One of the tables, read plainly: Spark splits it by bytes.

    Only where the user sets READ_PARTITIONS is a table that is read for
    ``heavy`` work per row dealt out first; nothing looks at the data for it.
    """
    df = spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")
    asked = spark.conf.get(READ_PARTITIONS, None)
    return df.repartition(int(asked)) if heavy and asked else df


# The dimensions of a line item, in the order they are joined.
DIMENSIONS = [("part", "l_partkey", "p_partkey"), ("supplier", "l_suppkey", "s_suppkey"),
              ("nation", "s_nationkey", "n_nationkey"), ("region", "n_regionkey", "r_regionkey")]


def _joined(rows: DataFrame, sf_dir: str, dimensions: list[tuple[str, str, str]]) -> DataFrame:
    for side, left, right in dimensions:
        rows = rows.join(table(rows.sparkSession, sf_dir, side, False),
                         F.col(left) == F.col(right))
    return rows


def star(spark: SparkSession, sf_dir: str, heavy: bool = True) -> DataFrame:
    """lineitem with its part, supplier, nation and region.

    Joined one after the other and without hints, so Spark knows every side by
    its own size: nation and region are tiny in any data set and are broadcast;
    part and supplier grow with the data, and are broadcast below the threshold
    and shuffled beyond it.
    """
    return _joined(table(spark, sf_dir, "lineitem", heavy), sf_dir, DIMENSIONS)


_COLUMNS = {
    "Body": "r_name", "Exam": "p_type",
    "Website": "concat('https://', lower(replace(r_name, ' ', '-')), '.example.org/')",
    "Level": "case l_returnflag when 'A' then 'UG' when 'N' then 'PG' else 'Diploma' end",
    "State": "n_name", "City": "cast(null as string)",
    "Institute": "concat(s_name, ', ', n_name)", "Program": "cast(null as string)",
    "Branch": "p_name", "CategoryGroup": "cast(null as string)",
    "Category": "element_at(array({}), p_size % 8 + 1)".format(
        ", ".join(f"'{c}'" for c in CODES)),
    "Quota": "if(l_linestatus = 'O', 'HS', 'AI')",
    "Gender": "element_at(array('Gender-Neutral', 'Female-only', 'Male'), "
              "l_linenumber % 3 + 1)",
    "Year": "cast(year(l_shipdate) as bigint)", "Round": "cast(l_linenumber as string)",
    "OpeningRank": "if(l_discount <> 0, cast(floor(l_extendedprice / 10) as bigint), null)",
    "ClosingRank": "cast(floor(l_extendedprice) as bigint)",
    "SourceURL": "concat('https://src/', cast(l_orderkey as string))",
}


def canonical_of(rows: DataFrame, *keep: str) -> DataFrame:
    """The rank rows of a star; a canonical column it has already stays as it is."""
    return rows.selectExpr(*[c if c in rows.columns else f"{_COLUMNS[c]} as {c}"
                             for c in CANON_COLUMNS], *keep)


def canonical(spark: SparkSession, sf_dir: str, *keep: str, heavy: bool = True) -> DataFrame:
    return canonical_of(star(spark, sf_dir, heavy), *keep)


# Canonical columns of a line item alone; equal rank rows are equal in them.
DEALT_BY = ["Year", "OpeningRank", "ClosingRank", "SourceURL"]


def canonical_for_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``canonical``, dealt out so that equal rows stand in one partition.

    A distinct over rows that keep DEALT_BY needs no shuffle of its own. The rows are
    dealt once all tables that may be joined by a shuffle are, and before the longer texts
    are made, and they are folded in partitions of a share's size: folded where lineitem
    is read, the full rows of a split would outgrow a task's memory and spill.
    """
    rows = _joined(table(spark, sf_dir, "lineitem"), sf_dir, DIMENSIONS[:2]) \
        .withColumns({c: F.expr(_COLUMNS[c]) for c in DEALT_BY})
    return canonical_of(_joined(deal(rows, DEALT_BY), sf_dir, DIMENSIONS[2:]))


_CODE_CASES = " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(CODES))

# The same mapping as SQL text, written for the checking engine. ``star`` keeps
# the base columns next to the canonical ones.
STAR_SQL = f"""
star AS (
  SELECT l.*, p.*, s.*, n.*, r.*,
    r_name AS "Body", p_type AS "Exam",
    'https://' || lower(replace(r_name, ' ', '-')) || '.example.org/' AS "Website",
    CASE l_returnflag WHEN 'A' THEN 'UG' WHEN 'N' THEN 'PG' ELSE 'Diploma' END AS "Level",
    n_name AS "State", CAST(NULL AS VARCHAR) AS "City",
    s_name || ', ' || n_name AS "Institute", CAST(NULL AS VARCHAR) AS "Program",
    p_name AS "Branch",
    CASE p_size % 8 {_CODE_CASES} END AS "Category",
    CAST(NULL AS VARCHAR) AS "CategoryGroup",
    CASE l_linestatus WHEN 'O' THEN 'HS' ELSE 'AI' END AS "Quota",
    CASE l_linenumber % 3 WHEN 0 THEN 'Gender-Neutral' WHEN 1 THEN 'Female-only'
      ELSE 'Male' END AS "Gender",
    CAST(year(l_shipdate) AS BIGINT) AS "Year",
    CAST(l_linenumber AS VARCHAR) AS "Round",
    CASE WHEN l_discount <> 0 THEN CAST(floor(l_extendedprice / 10) AS BIGINT) END
      AS "OpeningRank",
    CAST(floor(l_extendedprice) AS BIGINT) AS "ClosingRank",
    'https://src/' || CAST(l_orderkey AS VARCHAR) AS "SourceURL"
  FROM lineitem l JOIN part p ON l_partkey = p_partkey
  JOIN supplier s ON l_suppkey = s_suppkey
  JOIN nation n ON s_nationkey = n_nationkey
  JOIN region r ON n_regionkey = r_regionkey)"""

CANON_LIST = ", ".join(f'"{c}"' for c in CANON_COLUMNS)

# Reservation group of the eight codes the mapping uses.
GROUP_CASE = """CASE "Category" WHEN 'OPEN' THEN 'General' WHEN 'OBC-NCL' THEN 'OBC'
  WHEN 'SC' THEN 'SC' WHEN 'ST' THEN 'ST' WHEN 'EWS-PH' THEN 'EWS' WHEN '2AG' THEN 'OBC'
  WHEN 'GOPENS' THEN 'General' WHEN 'BH' THEN 'Other' ELSE 'Unspecified' END"""


def with_star(sql: str, *more: str) -> str:
    """A check query with the mapped star (and further CTEs) in front."""
    return "WITH " + ",\n".join([STAR_SQL.strip(), *more]) + "\n" + sql
