"""Plans that do costly steps once per row, and on all cores."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from rankloom.catalogue.bridge import SCHEMAS, canonical, canonical_for_distinct
from rankloom.catalogue.registry import load_all
from rankloom.functions.text import _SPACE_CHARACTERS, _NAMED, squeeze, strip
from rankloom.operators import grids, headers, rawrows
from rankloom.plans import bulk, catalog, query, side, sites
from rankloom.schema import CANON


def _plan(df, kind="optimizedPlan"):
    return getattr(df._jdf.queryExecution(), kind)().toString()


def test_catalog_rules_run_on_all_cores(spark):
    """a sheet that is read in one task."""
    sheet = spark.createDataFrame([("NEET UG", "h", "c")], "Exam string, Homepage string, "
                                  "CutoffURL string").coalesce(1)
    out = catalog.build_catalog(sheet)
    assert "RoundRobinPartitioning" in _plan(out, "executedPlan")
    assert out.first()["Category"] == "Medical"


def test_slug_rules_run_on_all_cores(spark):
    """links that are read in one task."""
    links = spark.createDataFrame([("x", "https://www.collegedekho.com/exam/x")],
                                  "exam string, site_url string").coalesce(1)
    out = sites.with_cutoff_urls(links, "collegedekho", [2025])
    assert "RoundRobinPartitioning" in _plan(out, "executedPlan")
    assert len(out.first()["urls"]) == 2


def _raw(spark):
    rows = [("1", "2", "x"), (None, None, '[{"Closing":"5"}]'), (None, None, "not json"),
            (None, None, '\t {"Closing Rank":"7"}'), (None, None, '{"Date":"tba"}')]
    return spark.createDataFrame(
        [(i, *r) for i, r in enumerate(rows)],
        "seq int, opening_rank string, closing_rank string, raw_cells string").selectExpr(
        "*", *[f"cast(null as string) as {c}" for c in (
            "cutoff_percentile", "cutoff_score_or_marks", "institute_name", "branch_or_course",
            "program", "category", "quota", "gender", "year", "table_caption",
            "counselling_round", "page_url")], "'E' as exam")


def test_signal_filter_does_not_parse_again(spark):
    """the filter stays above the steps that read the cells."""
    out = side.row_signal(_raw(spark.newSession()), ("seq",))
    assert [(r["seq"], r["OpeningRank"], r["ClosingRank"]) for r in out.orderBy("seq").collect()] \
        == [(0, 1, 2), (3, None, 7)]
    plan = _plan(out)
    assert plan.count("from_json") + plan.count("JsonToStructs") <= 1, plan


def test_edges_and_runs_of_every_space(spark):
    """the fast forms of the whitespace rules equal the plain ones."""
    spaces = [chr(i) for i in range(0x3100) if re.match(_NAMED, chr(i), re.A)]
    assert sorted(spaces) == sorted(_SPACE_CHARACTERS)
    texts = [f"{a}{b}x{a} {b}y {b}{a}" for a in spaces for b in spaces] + ["", " ", "a  b", "\n"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(
        strip(F.col("t")), squeeze(F.col("t")),
        F.regexp_replace("t", f"^{_NAMED}+|{_NAMED}+$", ""),
        F.trim(F.regexp_replace("t", f"{_NAMED}+", " "))).collect()
    assert all((r[0], r[1]) == (r[2], r[3]) for r in got)


def test_words_of_a_page_meet_its_headers_once(spark):
    """one join of all words; header words that name no page are left out of the window."""
    heads = [(h, 50.0 * i) for i, h in enumerate(grids.LINE_HEADERS)]
    row = ["NIT", "Civil GC", "HS", "OBC-NCL", "Female Only", "7", "12"]
    page = [(i, 10.0, x, h) for i, (h, x) in enumerate(heads)] \
        + [(10 + i, 30.0, x, t) for i, ((_, x), t) in enumerate(zip(heads, row))]
    words = spark.createDataFrame(
        [(d, p, *w) for d, p in (("a", 1), ("a", 2), (None, 1), ("b", None)) for w in page],
        "doc_id string, page int, word_idx int, top double, x0 double, text string")
    out = grids.borderless_rows(words)
    assert _plan(out).count("Join") == 1
    assert [tuple(r) for r in out.orderBy("page").collect()] == [
        ("a", p, 0, 30, "NIT", "Civil GC", "HS", "OBC-NCL", "Female-only", 7, 12) for p in (1, 2)]


def test_official_pages_are_parsed_on_all_cores(spark, tmp_path):
    """links and pages that are read in one task."""
    ids = spark.range(0, 64, 1, 1).withColumn("url", F.expr("concat('https://h.in/', id)"))
    links = ids.selectExpr("id as position", "'E' as exam", "url", "false as prose",
                           "'https://home.in' as website", "cast(null as string) as body",
                           "'UG' as level", "cast(null as string) as state")
    page = "<table><tr><th>Institute</th><th>Closing Rank</th></tr><tr><td>C</td><td>7</td></tr>"
    out = bulk.official_pass(
        links, ids.selectExpr("url", "'html_table' as bucket"),
        ids.selectExpr("url", "cast(null as string) as error"),
        ids.select("url", F.lit(page + "</table>").alias("html")), str(tmp_path))
    assert out.rows.count() == 64 and out.report.filter("status = 'ok'").count() == 64
    assert len(spark.read.parquet(f"{tmp_path}/rows").inputFiles()) > 1


def test_ranges_are_read_once_per_row(spark):
    """below the step that makes a row per category column."""
    tables = spark.createDataFrame(
        [(["College", "Open", "SC"], [["C", "1 - 2", "99.5%"]], "Cap", 0),
         (["College", "Closing Rank"], [["D", " 3 to 4 "]], "Cap", 1)],
        "header array<string>, rows array<array<string>>, caption string, table_idx int") \
        .selectExpr("*", *[f"cast(null as string) as {c}" for c in (
            "source_competitor", "exam", "exam_slug", "page_url", "page_type", "year", "pdf_url")])
    out = rawrows.raw_rows(tables)
    plan = _plan(out)
    assert plan.index("posexplode(_slots") < plan.index("(?:-|–|—|to)")
    assert [(r.category, r.opening_rank, r.closing_rank, r.cutoff_percentile, r.rank_range_raw)
            for r in out.orderBy("table_index", "slot_index").collect()] == [
        ("Open", None, 1, None, None), ("SC", None, None, "99.5%", None),
        (None, 3, 4, None, "3 to 4")]


def test_words_of_a_role_stand_in_all_that_match_it():
    """the plain search before a pattern loses no header."""
    labels = ["CLOS", "x cr", "Last  Rank", "cutoffrank", "OPEN", "for", "First Rank", "Start",
              "Percentile", "Score", "Marks", "Round", "a year b", " 2024 ", "Categor", "caste",
              "Quota Type", "QUOTA", "Region", "domicile", "Home\tState", "Gender", "Female",
              "male", "Branch", "Course", "Programme", "specialisation", "Stream", "Degree",
              "College", "Institute", "University", "NIT", "iit", "NLU"]
    for role, pattern in headers.ROLES:
        hits = [t for t in labels if re.search(pattern, t, re.I | re.A)]
        assert hits and all(any(w in t.lower() for w in headers.ROLE_WORDS[role]) for t in hits)


def test_a_group_column_is_not_folded(spark):
    """its distinct values need no rows of their own."""
    rows = [("A", "x", 1, 5), ("A", "y", None, 7), (None, "x", 2, 9)]
    given = spark.createDataFrame(
        rows, "Institute string, Branch string, OpeningRank bigint, ClosingRank bigint")
    df = given.select(*[F.col(f.name) if f.name in given.columns
                        else F.lit(None).cast(f.dataType).alias(f.name) for f in CANON.fields])
    out = query.RankQuery(df).group_stats(["Institute"])
    assert "_view, i," not in _plan(out) and "percentile" not in _plan(out)
    assert [tuple(r)[:4] for r in out.collect()] == [("A", 2, 1, 2), (None, 1, 0, 1)]


def _star_tables(spark, path):
    """Two parts and two suppliers that look the same, and line items given twice."""
    given = {
        "region": [(0, "FAR EAST")], "nation": [(0, "N", 0)],
        "supplier": [(1, "S", 0, 1.0), (2, "S", 0, 2.0), (3, None, 0, 3.0)],
        "part": [(1, "ring", "b", "T", 1, 1.0), (2, "ring", "c", "T", 1, 2.0),
                 (3, "ring", "b", "T", 2, 1.0)],
        "lineitem": [(7, part, supplier, 1, 1.0, 99.5, discount, 0.0, "A", "O", None)
                     for part in (1, 2, 3, 4) for supplier in (1, 2, 3)
                     for discount in (0.0, 0.1, 0.2, None)] * 2}
    for name, rows in given.items():
        spark.createDataFrame(rows, SCHEMAS[name]).write.parquet(f"{path}/{name}.parquet")


def test_a_distinct_of_rank_rows_has_no_shuffle_of_its_own(spark, tmp_path):
    """equal rows are brought together while they are narrow, then folded in place."""
    _star_tables(spark, str(tmp_path))
    plain, dealt = canonical(spark, str(tmp_path)), canonical_for_distinct(spark, str(tmp_path))
    assert dealt.schema == plain.schema and dealt.count() == plain.count() == 72
    assert plain.exceptAll(dealt).count() == 0
    for name, rows in (("deliverable", 4), ("deliverable_category", 8)):
        out = load_all()[name].run(spark, str(tmp_path))
        plan = _plan(out, "executedPlan")
        assert plan.count(" Exchange ") == 1 and "REPARTITION_BY_NUM" in plan, plan
        assert "College Name" not in plan[plan.index(" Exchange "):]
        assert out.count() == out.distinct().count() == rows
        assert {(r["College Name"], r["Opening Rank"], r["Year - cutoff"])
                for r in out.collect()} == {(c, o, None) for c in ("S, N", None)
                                            for o in (None, 9)}
