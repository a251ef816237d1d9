"""Explorer, predictor and analysis queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.catalogue.bridge import CANON_LIST, GROUP_CASE, canonical, with_star
from rankloom.catalogue.registry import query
from rankloom.operators.conform import enrich
from rankloom.plans import query as q

_ORDER = """"ClosingRank" ASC NULLS LAST, "Institute", "Branch", "Category", "Year",
  "Round", "Quota", "Gender", "Exam", "Body", "OpeningRank" NULLS LAST, "SourceURL" """


@query("rank_predictor", with_star(f"""
  SELECT {CANON_LIST} FROM star
  WHERE "Category" IN ('OPEN', 'GOPENS') AND "ClosingRank" >= 25000 AND "Level" = 'UG'"""))
def rank_predictor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q.RankQuery(canonical(spark, sf_dir)) \
        .where_in("Category", ["OPEN", "GOPENS", "", None]) \
        .where("Level", "UG").where("Body", "").max_closing_rank(25000).to_df()


@query("rank_predictor_topk", with_star(f"""
  SELECT {CANON_LIST} FROM star WHERE "ClosingRank" >= 25000
  ORDER BY {_ORDER} LIMIT 100"""))
def rank_predictor_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q.RankQuery(canonical(spark, sf_dir)).max_closing_rank(25000).limit(100).to_df()


@query("filter_explorer", with_star(f"""
  SELECT "Institute", "Branch", "Category", "Year", "ClosingRank" FROM star
  WHERE "Branch" ILIKE '%RED%' AND "Year" IN (1996, 1997) AND "State" = 'NATION_7'
    AND "ClosingRank" BETWEEN 10000 AND 90000
    AND "Institute" ILIKE '%nation\\_7%' ESCAPE '\\'"""))
def filter_explorer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q.RankQuery(canonical(spark, sf_dir)) \
        .where_contains("Branch", "RED").where_contains("Institute", "nation_7") \
        .where_in("Year", [1996, 1997]).where("State", "NATION_7") \
        .where_between("ClosingRank", 10000, 90000) \
        .to_df(["Institute", "Branch", "Category", "Year", "ClosingRank"])


_STATS = """count(*) AS "Seats", count(DISTINCT "Institute") AS "Colleges",
  count(DISTINCT "Branch") AS "Branches", min("OpeningRank") AS "BestOpening",
  min("ClosingRank") AS "BestClosing",
  CAST(round(median("ClosingRank")) AS BIGINT) AS "MedianClosing",
  CAST(round(avg("ClosingRank")) AS BIGINT) AS "AvgClosing",
  max("ClosingRank") AS "WorstClosing" """


@query("group_stats", with_star(f"""
  SELECT "Body", {_STATS} FROM star GROUP BY 1"""))
def group_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q.RankQuery(canonical(spark, sf_dir)).group_stats(["Body", "NoSuchColumn"])


@query("group_stats_wide", with_star(f"""
  SELECT "Exam", "State", "Year", {_STATS} FROM star WHERE "Level" IN ('UG', 'PG')
  GROUP BY 1, 2, 3"""))
def group_stats_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q.RankQuery(canonical(spark, sf_dir)).where_in("Level", ["UG", "PG"]) \
        .group_stats(["Exam", "State", "Year"])


@query("group_stats_top25", with_star(f"""
  SELECT "Institute", {_STATS} FROM star GROUP BY 1
  ORDER BY "Seats" DESC, "Institute" LIMIT 25"""))
def group_stats_top25(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q.RankQuery(canonical(spark, sf_dir)).group_stats(["Institute"]).limit(25)


_COLLEGES = f"""
  SELECT "Institute" AS "College", min("City") AS "City", min("State") AS "State",
    string_agg(DISTINCT CASE WHEN "Level" = 'Diploma' THEN 'Diploma'
      WHEN "Level" = 'PG' THEN 'M.Tech' ELSE 'B.E./B.Tech' END, ', '
      ORDER BY CASE WHEN "Level" = 'Diploma' THEN 'Diploma'
      WHEN "Level" = 'PG' THEN 'M.Tech' ELSE 'B.E./B.Tech' END) AS "Programs",
    count(DISTINCT "Branch") AS "Branches", min("Year") AS "FirstYear",
    max("Year") AS "LastYear", min("OpeningRank") AS "BestOpening",
    min("ClosingRank") AS "BestClosing", max("ClosingRank") AS "WorstClosing",
    count(*) AS "Records", min("Website") AS "Website", min("SourceURL") AS "SourceURL"
  FROM star WHERE "Exam" = 'PROMO' GROUP BY "Institute" """


@query("colleges_for_exam", with_star(_COLLEGES.replace(
    'min("City") AS "City"', "'Nation_' AS \"City\"")))
def colleges_for_exam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q.colleges_for_exam(enrich(canonical(spark, sf_dir)), "PROMO")


@query("college_metrics", with_star("""
  SELECT count(*) AS "Colleges", count(DISTINCT "State") AS "States",
    min("FirstYear") AS "FirstYear", max("LastYear") AS "LastYear",
    CAST(sum("Records") AS BIGINT) AS "Records",
    CASE WHEN min("FirstYear") = max("LastYear") THEN CAST(min("FirstYear") AS VARCHAR)
      ELSE CAST(min("FirstYear") AS VARCHAR) || '–' || CAST(max("LastYear") AS VARCHAR)
      END AS "Years"
  FROM c""", f"c AS ({_COLLEGES})"))
def college_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    colleges = q.college_summary(
        canonical(spark, sf_dir).filter(F.col("Exam") == "PROMO"), ["Institute"])
    return q.college_metrics(colleges).withColumn(
        "Years", q.years_label(F.col("FirstYear"), F.col("LastYear")))


@query("college_rows", with_star(f"""
  SELECT {CANON_LIST} FROM star
  WHERE "Exam" = 'PROMO' AND "Institute" LIKE 'Supplier#000000007, %'"""))
def college_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drill-down: one college's rows for one exam."""
    return q.RankQuery(canonical(spark, sf_dir)).where("Exam", "PROMO") \
        .where_contains("Institute", "supplier#000000007, ").to_df()


@query("distinct_values", with_star("""
  SELECT DISTINCT "Branch" AS value FROM star WHERE "Branch" IS NOT NULL"""))
def distinct_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q.distinct_values(canonical(spark, sf_dir), "Branch")


@query("count_filtered", with_star("""
  SELECT count(*) AS n FROM star WHERE "Quota" = 'HS' AND "ClosingRank" <= 50000"""))
def count_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q.RankQuery(canonical(spark, sf_dir)).where("Quota", "HS") \
        .where_between("ClosingRank", None, 50000).rows().agg(F.count(F.lit(1)).alias("n"))


@query("latest_year", with_star(f"""
  SELECT {CANON_LIST} FROM star WHERE "Year" = (SELECT max("Year") FROM star)"""))
def latest_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q.latest_year(canonical(spark, sf_dir))


_SHARES = ", ".join(
    f'CAST(round(100.0 * count("{c}") / count(*), 0) AS BIGINT) AS "{c} %"'
    for c in q.COVERAGE_COLUMNS)


@query("coverage", with_star(f"""
  SELECT "Body", count(*) AS "Rows", {_SHARES} FROM star GROUP BY "Body" """))
def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q.coverage(canonical(spark, sf_dir))


@query("distribution", with_star("""
  SELECT count("ClosingRank") AS seats,
    CAST(floor(median("ClosingRank")) AS BIGINT) AS median,
    CAST(floor(quantile_cont("ClosingRank", 0.9)) AS BIGINT) AS p90,
    max("ClosingRank") AS max
  FROM star WHERE "Exam" = 'ECONOMY' """))
def distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q.distribution(q.RankQuery(canonical(spark, sf_dir)).where("Exam", "ECONOMY").rows())


@query("histogram", with_star("""
  SELECT b.bin, CAST(floor(lo + b.bin * (hi - lo) / 30) AS BIGINT) AS rank_from,
    count(k.bin) AS seats
  FROM (SELECT CAST(unnest(range(30)) AS BIGINT) AS bin) b CROSS JOIN lim
  LEFT JOIN (SELECT CAST(least(floor(("ClosingRank" - lo) * 30 / (hi - lo)), 29) AS BIGINT)
               AS bin FROM star, lim) k ON k.bin = b.bin
  GROUP BY b.bin, lo, hi""", """lim AS (
  SELECT CAST(min("ClosingRank") AS DOUBLE) AS lo, CAST(max("ClosingRank") AS DOUBLE) AS hi
  FROM star)"""))
def histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q.histogram(canonical(spark, sf_dir))


@query("yoy_trend", with_star("""
  SELECT * FROM y WHERE ("Institute", "Branch", "Category") IN (
    SELECT ("Institute", "Branch", "Category") FROM y GROUP BY ALL HAVING count(*) >= 2)""",
    """y AS (SELECT "Institute", "Branch", "Category", "Year",
      min("OpeningRank") AS "OpeningRank", min("ClosingRank") AS "ClosingRank"
    FROM star GROUP BY 1, 2, 3, 4)"""))
def yoy_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q.yoy_trend(canonical(spark, sf_dir))


@query("round_ends", with_star(f"""
  SELECT {CANON_LIST} FROM star JOIN (
    SELECT "Body" AS b, "Year" AS y, min(CAST("Round" AS INT)) AS lo,
      max(CAST("Round" AS INT)) AS hi FROM star GROUP BY 1, 2) e
  ON "Body" = b AND "Year" = y AND CAST("Round" AS INT) IN (lo, hi)"""))
def round_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q.round_ends(canonical(spark, sf_dir))


@query("analyst_sql", with_star(f"""
  SELECT "Body", {GROUP_CASE} AS "CategoryGroup", count(*) AS seats,
    median("ClosingRank") AS median_close FROM star GROUP BY 1, 2"""))
def analyst_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q.run_sql(spark, """
        SELECT Body, CategoryGroup, count(*) AS seats, median(ClosingRank) AS median_close
        FROM cutoffs GROUP BY 1, 2 ORDER BY seats DESC""", enrich(canonical(spark, sf_dir)))
