"""Needles, distributions, conformance and pruned scans."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from rankloom.functions.classify import EXAM_REFERENCE
from rankloom.operators.conform import conform_to, conformance_report
from rankloom.operators.needles import first_needle
from rankloom.plans import catalog, ingest
from rankloom.plans.distributions import column_summary, most_common, value_distributions
from rankloom.plans.query import RankQuery
from rankloom.schema import RAW
from rankloom.sources.files import read_raw_tables


def test_first_needle_equals_brute_force(spark):
    rng = random.Random(3)

    def word(low, high):
        return "".join(rng.choice("abAé %") for _ in range(rng.randint(low, high)))
    needles = [(word(0, 6), rng.randint(0, 50), f"p{i}") for i in range(150)]
    texts = [(i, word(0, 14) if i % 9 else None) for i in range(300)]
    got = first_needle(spark.createDataFrame(texts, "i int, t string"), F.col("t"),
                       spark.createDataFrame(needles, "n string, at int, body string"), "n", "at")
    assert got.columns == ["i", "t", "body"]
    # of equal needles the first by (priority, payload), of equal priorities the smallest needle
    best = {}
    for n, at, body in needles:
        if n.strip(" "):
            best[n.lower()] = min(best.get(n.lower(), (at, body)), (at, body))
    want = {}
    for i, t in texts:
        hits = [(at, n, body) for n, (at, body) in best.items() if t and n in t.lower()]
        want[i] = min(hits)[2] if hits else None
    assert {r.i: r.body for r in got.collect()} == want and any(want.values())


def test_needles_meet_only_texts_with_their_gram(spark):
    """No text meets every needle: the plan has no nested loop and no product."""
    needles = spark.range(2000).selectExpr("concat('needle ', id) as n", "id as at", "id as body")
    texts = spark.range(500).selectExpr("id as i", "concat('a NEEDLE ', id * 7, ' x') as t")
    got = first_needle(texts, F.col("t"), needles, "n", "at")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan
    # 'needle 35' lies in 'needle 35', and 'needle 3' before it
    assert {r.i: r.body for r in got.filter("i in (0, 5, 400)").collect()} == {0: 0, 5: 3, 400: 2}


def test_catalog_takes_its_reference_from_a_table(spark):
    rows = [(n, at, *rest) for at, (n, *rest) in enumerate(EXAM_REFERENCE)]
    table = spark.createDataFrame(rows, "needle string, priority int, body string, metric string, "
                                        "applicants long, seats long")
    names = [f"The {n.title()} of {at}" for n, at, *_ in rows] + [
        "West Bengal Joint Entrance Examination", "nothing known", ""]
    universe = spark.createDataFrame([(n, "", "") for n in names],
                                     "Exam string, Homepage string, CutoffURL string")
    built_in = catalog.build_catalog(universe)
    from_table = catalog.build_catalog(universe, reference=table)
    assert sorted(map(tuple, from_table.collect()), key=repr) \
        == sorted(map(tuple, built_in.collect()), key=repr)
    assert built_in.filter("Body <> ''").count() > 20


def test_distributions(spark):
    df = spark.createDataFrame([("x", True, 1), ("x", None, 2), (" ", False, 1), (None, True, 1)],
                               "a string, b boolean, c int")
    dist = value_distributions(df, ["a", "b", "c"])
    assert {(r.column, r.value): r.n for r in dist.collect()} == {
        ("a", "x"): 2, ("a", " "): 1, ("a", None): 1, ("b", "true"): 2, ("b", "false"): 1,
        ("b", None): 1, ("c", "1"): 3, ("c", "2"): 1}
    assert {r.column: tuple(r)[1:] for r in column_summary(dist).collect()} == {
        "a": (4, 2, 2), "b": (4, 2, 3), "c": (4, 2, 4)}
    assert [tuple(r) for r in most_common(dist, "c", 1).collect()] == [("1", 3)]
    plan = dist._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") == 1        # one read for all columns
    assert value_distributions(df.limit(0), ["a"]).count() == 0


def test_conformance(spark, tmp_path):
    df = spark.createDataFrame([("12", 3.0, "e", [1]), ("no", 3.5, None, None)],
                               "closing_rank string, opening_rank double, exam string, "
                               "`other.one` array<int>")
    out = conform_to(df, RAW)
    assert out.schema == RAW
    assert [(r.closing_rank, r.opening_rank, r.exam) for r in out.collect()] == [
        (12, 3, "e"), (None, None, None)]
    report = {r.column: r for r in conformance_report(df, RAW).collect()}
    assert len(report) == len(RAW.names) + 1
    assert (report["closing_rank"].action, report["closing_rank"].unreadable) == ("cast", 1)
    assert (report["opening_rank"].filled, report["opening_rank"].unreadable) == (2, 1)
    assert (report["exam"].action, report["exam"].filled) == ("kept", 1)
    assert (report["other.one"].action, report["other.one"].filled) == ("dropped", 1)
    assert report["notes"].action == "missing"
    # a folder of another's making, its files of different columns
    df.select("closing_rank", "exam").coalesce(1).write.parquet(f"{tmp_path}/raw/a")
    spark.createDataFrame([("x", 7)], "exam string, opening_rank int") \
        .coalesce(1).write.parquet(f"{tmp_path}/raw/b")
    rows = read_raw_tables(spark, f"{tmp_path}/raw/*", foreign=True)
    assert [f for f in rows.columns if f not in RAW.names] == ["_file", "_row"]
    assert sorted((r.exam or "", r.closing_rank, r.opening_rank) for r in rows.collect()) == [
        ("", None, None), ("e", 12, None), ("x", None, 7)]


def test_scan_by_path_reads_only_the_chosen_years(spark, tmp_path):
    path = str(tmp_path / "store")
    rows = spark.range(4000).selectExpr("concat('I', id) as Institute", "2000 + id % 20 as Year",
                                        "id as ClosingRank")
    ingest.write_canonical(rows, path, by_year=True)
    years = spark.createDataFrame([(2003, "wanted"), (2011, "wanted"), (2012, "not")],
                                  "Year long, mark string")
    years.write.parquet(str(tmp_path / "years"))
    chosen = spark.read.parquet(str(tmp_path / "years")).filter("mark = 'wanted'").select("Year")
    found = RankQuery(path, spark).where_matching(chosen).rows()
    assert found.count() == 400
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan and "LeftSemi" in plan
    found.collect()
    scans = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(Year" in scans
    files = [s for s in _scans(found._jdf.queryExecution().executedPlan()) if "Year" in s[0]]
    assert min(n for _, n in files) < 20    # folders, one file or more each
    with pytest.raises(KeyError):
        RankQuery(path, spark).where_matching(years)


def _scans(plan):
    """(description, files read) of every file scan that a run plan holds."""
    name = plan.getClass().getSimpleName()
    if name == "AdaptiveSparkPlanExec":
        return _scans(plan.executedPlan())
    if name.endswith("QueryStageExec"):
        return _scans(plan.plan())
    out = []
    if name == "FileSourceScanExec":
        out.append((plan.simpleString(500), plan.metrics().apply("numFiles").value()))
    children = plan.children()
    for at in range(children.size()):
        out += _scans(children.apply(at))
    return out
