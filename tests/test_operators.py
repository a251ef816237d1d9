"""Sequential and table operators against brute force and literal tables."""

from __future__ import annotations

import json
import random

from pyspark.sql import functions as F

from rankloom.operators import grids
from rankloom.operators.carry import carry_forward, heading_above
from rankloom.operators.conform import dedouble_rows, normalize
from rankloom.operators.dedup import keep_first, keep_last, unique_by
from rankloom.operators.lookup import look_up
from rankloom.operators.htmltables import html_tables, page_tables
from rankloom.operators.mapping import map_tables
from rankloom.operators.rawrows import raw_rows
from rankloom.operators.streaks import latch
from rankloom.schema import CANON_COLUMNS, GRID


def test_carry_forward_matches_a_sweep(spark):
    rnd = random.Random(7)
    rows = []
    for doc in ("hot", "a", "b"):
        for page in range(400 if doc == "hot" else 20):
            for row in range(rnd.randint(0, 4)):
                rows.append((doc, page, row, rnd.choice([None, None, None, f"{doc}{page}{row}"])))
    want, last = {}, {}
    for doc, page, row, new in sorted(rows, key=lambda r: r[:3]):
        last[doc] = new if new is not None else last.get(doc)
        want[doc, page, row] = last[doc]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "doc string, page int, row int, new string")
    for size in (1, 7, 1000):
        got = carry_forward(df.repartition(5), "doc", "page", ["row"], {"cur": F.col("new")}, size)
        assert {(r["doc"], r["page"], r["row"]): r["cur"] for r in got.collect()} == want


def test_headings_move_only_at_tables(spark):
    heads = spark.createDataFrame(
        [("d", 1, 0, 10.0, "A"), ("d", 1, 1, 90.0, "B"), ("d", 2, 0, 40.0, "C")],
        "doc_id string, page int, line_idx int, top double, Institute string")
    tables = spark.createDataFrame(
        [("d", 1, 0, 20.0), ("d", 1, 1, 50.0), ("d", 2, 0, 5.0), ("d", 2, 1, 41.0)],
        "doc_id string, page int, table_idx int, top double")
    out = heading_above(tables, heads, ["Institute"]).orderBy("page", "table_idx").collect()
    assert [r["Institute"] for r in out] == ["A", "A", "A", "C"]


def test_latch_matches_a_sweep(spark):
    rnd = random.Random(3)
    rows = [(i, rnd.choice(["hot"] * 3 + ["x", "y"]), rnd.choice(["ok", "ok", "error", "empty"]))
            for i in range(3000)] + [(3000 + i, "late", "error") for i in range(5)]
    streak, is_open, want = {}, set(), {}
    for pos, host, outcome in rows:
        want[pos] = host in is_open
        if host in is_open:
            continue
        if outcome == "ok":
            streak[host] = 0
        elif outcome == "error":
            streak[host] = streak.get(host, 0) + 1
        if streak.get(host, 0) >= 3:
            is_open.add(host)
    df = spark.createDataFrame(rows, "pos long, host string, outcome string")
    for size in (1, 2, 5, 64, 100000):
        got = latch(df.repartition(4), "host", "pos", "outcome", size).collect()
        assert {r["pos"]: r["circuit_open"] for r in got} == want


def test_keep_first_is_stable_and_limited_before_the_shuffle(spark):
    rows = [(i, i % 3 if i % 2 else None, i * 7 % 5) for i in range(200)]
    df = spark.createDataFrame(rows, "seq int, k int, v int")
    for parts in (1, 3, 9):
        first = keep_first(df.repartition(parts), ["k", "absent"], ["seq"])
        assert sorted(r["seq"] for r in first.collect()) == [0, 1, 3, 5]
        last = keep_last(df.repartition(parts), ["k"], ["seq"])
        assert sorted(r["seq"] for r in last.collect()) == [195, 197, 198, 199]
    plan = keep_first(df, ["k"], ["seq"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_normalize_tolerates(spark):
    df = spark.createDataFrame([("1,340", "x", " a ", "z")], "ClosingRank string, extra string, "
                               "Body string, b2 string").toDF("ClosingRank", "extra", "Body", "Body")
    out = normalize(df)
    row = out.first()
    assert out.columns == CANON_COLUMNS
    assert (row["Body"], row["ClosingRank"], row["City"]) == ("a", 1340, None)
    again = normalize(out).first()
    assert again == row


def test_dedouble_rows_keeps_clean_digits(spark):
    df = spark.createDataFrame(
        [("Clean College, Pune", "OBC", "1122"),
         ("CCoolllleeggee,, BBiikkaanneerr", "OOBBCC", "55558844")],
        "Institute string, Category string, ClosingRank string")
    rows = dedouble_rows(df, ["Institute", "Missing"]).collect()
    assert rows[0]["ClosingRank"] == "1122"
    assert tuple(rows[1]) == ("College, Bikaner", "OBC", "5584")


PAGE = """<h2>Heading A</h2><table><caption>Real Caption</caption>
<tr><th>Institute</th><th>Branch</th><th>Category</th><th>Opening Rank</th><th>Closing Rank</th></tr>
<tr><td>IIT Example</td><td>CSE</td><td>OPEN</td><td>1</td><td>120</td></tr>
<tr><td>NIT Example</td><td>ECE</td><td>OBC</td><td>500</td><td>1,340</td></tr></table>
<table><tr><th>Notice</th><th>Date</th></tr><tr><td>x</td><td>y</td></tr></table>"""


def _pages(spark, *htmls):
    return spark.createDataFrame([(str(i), f"u{i}", h) for i, h in enumerate(htmls)],
                                 "page_id string, url string, html string")


def test_html_to_canonical(spark):
    tables = html_tables(_pages(spark, PAGE, "", None, "<table><tr>", "not html"))
    captions = [r["caption"] for r in tables.orderBy("table_idx").collect() if r["page_id"] == "0"]
    assert captions == ["Real Caption", "Heading A"]
    rows = map_tables(tables, {"Exam": F.lit("X")}).orderBy("ClosingRank").collect()
    assert [(r["Body"], r["Institute"], r["OpeningRank"], r["ClosingRank"]) for r in rows] \
        == [("X", "IIT Example", 1, 120), ("X", "NIT Example", 500, 1340)]


def test_html_spans_and_nesting():
    nested = page_tables("<table><tr><td rowspan=2>a<td>b<tr><td>c<table><tr><td>in</table>"
                         "</table>")
    assert nested[0].expanded()[1][:2] == [["a", "b"], ["a", "c"]]
    assert nested[1].expanded() == (["0"], [["in"]])
    two = page_tables("<table><thead><tr><th colspan=2>Rank</th></tr><tr><th>Open</th>"
                      "<th>Close</th></tr></thead><tbody><tr><td>1<td>2</tbody></table>")
    assert two[0].expanded() == (["Rank Open", "Rank Close"], [["1", "2"]])


def _table(spark, header, *rows):
    df = spark.createDataFrame([("0", "u", 0, "Cap", list(header), [list(r) for r in rows])],
                               "page_id string, url string, table_idx int, caption string, "
                               "header array<string>, rows array<array<string>>")
    none = F.lit(None).cast("string")
    return df.withColumns({"source_competitor": F.lit("s"), "exam": F.lit("e"),
                           "exam_slug": F.lit(""), "page_url": F.lit("u"), "page_type": F.lit("t"),
                           "year": none, "pdf_url": none})


def test_mapper_rules(spark):
    out = map_tables(_table(spark, ["College", "Cutoff Rank"], ["A", "900"]), {"Exam": F.lit("X")})
    assert out.first()["ClosingRank"] == 900
    both = map_tables(_table(spark, ["Institute", "Opening Cutoff", "Closing Cutoff"],
                             ["A", "50", "500"], ["B", "80", "800"]), {"Exam": F.lit("X")})
    assert sorted((r["OpeningRank"], r["ClosingRank"]) for r in both.collect()) \
        == [(50, 500), (80, 800)]
    twice = map_tables(_table(spark, ["Institute", "Closing Rank", "Closing Rank"],
                              ["A", "100", "150"]), {"Exam": F.lit("X")})
    assert twice.first()["ClosingRank"] == 100


def test_raw_rows(spark):
    wide = raw_rows(_table(spark, ["Institute", "Open", "OBC", "SC"],
                           ["NIT Trichy", "1200", "3400", "9000"])).orderBy("slot_index").collect()
    assert [(r["category"], r["closing_rank"]) for r in wide] \
        == [("Open", 1200), ("OBC", 3400), ("SC", 9000)]
    lone = raw_rows(_table(spark, ["Institute", "Open", "Close"], ["IIT Delhi", "50", "1200"])).collect()
    assert [(r["opening_rank"], r["closing_rank"], r["category"]) for r in lone] == [(50, 1200, None)]
    pct = raw_rows(_table(spark, ["Institute", "General", "OBC"], ["A", "99.87", "12"])) \
        .orderBy("slot_index").collect()
    assert (pct[0]["cutoff_percentile"], pct[0]["closing_rank"]) == ("99.87", None)
    dup = raw_rows(_table(spark, ["Rank", "Rank"], ["1", "2"])).first()
    assert json.loads(dup["raw_cells"]) == {"Rank": "1", "Rank.1": "2"}
    rng = raw_rows(_table(spark, ["College", "Closing Rank"], ["A", "200-500"])).first()
    assert (rng["opening_rank"], rng["closing_rank"], rng["rank_range_raw"]) == (200, 500, "200-500")
    assert raw_rows(_table(spark, ["College", "Rank"], ["", "5"])).first()["institute_name"] == "Cap"


def _grid(spark, *rows, doc="d"):
    return spark.createDataFrame([(doc, p, t, i, list(c)) for p, t, i, c in rows], GRID)


def test_flat_records_carry_the_header(spark):
    rows = grids.flat_records(_grid(
        spark, (0, 0, 0, ["A title"]),
        (0, 0, 1, ["INSTITUTE NAME", "PROGRAM", "OPENING RANK", "CLOSING RANK"]),
        (0, 0, 2, ["IIT Foo", "CSE", "10", "500"]), (300, 0, 0, ["NIT", "ME", "-", "1,200 *"]),
        (300, 0, 1, ["short"]), (300, 0, 2, ["", "x", "1", "2"])), grids.CAPITAL_COLUMNS)
    assert sorted((r["Institute"], r["OpeningRank"], r["ClosingRank"]) for r in rows.collect()) \
        == [("IIT Foo", 10, 500), ("NIT", None, 1200)]


def test_allotments(spark):
    rows = grids.allotment_rows(_grid(
        spark, (0, 0, 0, ["Sl. No.", "CML Rank", "Alloted Institute", "Alloted Branch",
                          "Seat Alloted Category"]),
        (0, 0, 1, ["1", "40", "BIT", "CSE", "OPEN"]), (1, 0, 0, ["2", "12", "BIT", "CSE", "OPEN"]),
        (1, 0, 1, ["3", "x", "BIT", "CSE", "OPEN"])))
    out = grids.allotment_cutoffs(rows).first()
    assert (out["OpeningRank"], out["ClosingRank"]) == (12, 40)


def test_borderless_words(spark):
    heads = [(50.0, x, w) for w, x in zip(grids.LINE_HEADERS, (0, 100, 200, 250, 300, 350, 400))]
    body = [(80.2, 0.0, "NIT"), (79.9, 30.0, "Foo"), (80.0, 100.0, "Civil"), (80.0, 210.0, "HS"),
            (80.0, 255.0, "OBC-NCL"), (80.0, 301.0, "Male"), (80.0, 320.0, "Only"),
            (80.0, 352.0, "10"), (80.0, 405.0, "99")]
    words = spark.createDataFrame([("d", 0, i, t, float(x), w) for i, (t, x, w)
                                   in enumerate(heads + body)], "doc_id string, page int, "
                                  "word_idx int, top double, x0 double, text string")
    row = grids.borderless_rows(words).first()
    assert (row["Institute"], row["Branch"], row["Quota"], row["Category"], row["Gender"],
            row["OpeningRank"], row["ClosingRank"]) \
        == ("NIT Foo", "Civil", "HS", "OBC-NCL", "Male", 10, 99)


def test_rough_html(spark):
    """Headings in cells, open headings and captions, odd spans, hidden elements."""
    cases = {
        "heading": "<table><tr><th>Name</th></tr><tr><td><h3>NIT</h3></td></tr></table>",
        "open heading": "<h2>Round 1<table><tr><th>Name</th></tr><tr><td>NIT</td></tr></table>",
        "open caption": "<table><caption>Round 1<tr><th>Name</th></tr><tr><td>NIT</td></tr></table>",
        "odd span": "<table><tr><th colspan='\u00b2'>Name</th></tr><tr><td rowspan='-1'>NIT</td>"
                    "</tr></table>",
        "hidden": "<table><tr><th>Name</th></tr><tr><td style='display: none'>x</td><td>NIT</td>"
                  "</tr><tr style='DISPLAY:NONE'><td>y</td></tr></table>"
                  "<div style='display:none'><table><tr><td>z</td></tr></table></div>",
        "hidden, not closed": "<table><tr><th>Name<tr><td style='display:none'>x<td>NIT</table>",
    }
    pages = spark.createDataFrame([(k, "u", v) for k, v in cases.items()],
                                  "page_id string, url string, html string")
    found = {r.page_id: (r.caption, r.header, r.rows) for r in html_tables(pages).collect()}
    assert len(found) == len(cases)
    for name, (caption, header, rows) in found.items():
        assert (header, rows) == (["Name"], [["NIT"]]), name
        assert caption == ("Round 1" if name.startswith("open") else ""), name


def test_carry_keeps_null_pages(spark):
    df = spark.createDataFrame([("d", None, 1, "a"), ("d", None, 2, None), (None, 3, 1, "b"),
                                ("d", 1, 1, "c"), ("d", 1, 2, None)],
                               "doc string, page int, line int, v string")
    rows = carry_forward(df, "doc", "page", ["line"], {"got": F.col("v")}).collect()
    assert sorted((r.doc or "", r.page or 0, r.line, r.got) for r in rows) == [
        ("", 3, 1, "b"), ("d", 0, 1, "a"), ("d", 0, 2, "a"), ("d", 1, 1, "c"), ("d", 1, 2, "c")]


def test_look_up_takes_first_or_last_by_position(spark):
    rows = [("a", "z first", 1), ("a", "m middle", 5), ("a", "b last", 9), ("b", None, 2),
            ("b", "x", 1), ("", "never", 1), (None, "never", 2)]
    side = spark.createDataFrame(rows, "k string, v string, _seq int").repartition(3)
    df = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3), ("", 4), (None, 5)],
                               "key string, n int")

    def found(keep, frame):
        return {r.n: r.v for r in look_up(df, F.col("key"), frame, "k", keep).collect()}
    assert found("last", side) == {1: "b last", 2: None, 3: None, 4: None, 5: None}
    assert found("first", side) == {1: "z first", 2: "x", 3: None, 4: None, 5: None}
    assert found("last", side.drop("_seq"))[1] == "z first"     # no order: the greatest
    assert unique_by(side, ["k"]).columns == ["k", "v"]


def test_a_hot_key_of_a_look_up_folds_before_the_shuffle(spark):
    side = spark.range(0, 100000, 1, 4).selectExpr(
        "'hot' as k", "cast(id as string) as v", "id as _seq")
    plan = unique_by(side, ["k"])._jdf.queryExecution().executedPlan().toString()
    assert "partial_max" in plan
    assert unique_by(side, ["k"]).first().v == "99999"


def test_headers_are_made_tidy_once_per_table(spark):
    """which tables count is no filter, which would bring in the header's steps again."""
    tables = spark.createDataFrame([
        (["College", "Closing  Rank", "Closing Rank"], [["a", "1", "2"], ["b", "", "3"]]),
        (["College", "cut  off"], [["c", "4"]]), (["College", "shortcut"], [["d", "5"]]),
        (["Institute", "Rank"], []), ([], [["6"]])],
        "header array<string>, rows array<array<string>>")
    out = map_tables(tables, {"Exam": F.lit("X")}).select("Institute", "ClosingRank")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array_insert") == 1
    assert sorted(map(tuple, out.collect())) == [("a", 1), ("c", 4)]


def test_melts_clean_their_cells_once(spark):
    """Conditions on a row are no filters, which would bring in its steps again."""
    def grid(*rows):
        return spark.createDataFrame([("d", 1, t, i, cells) for t, i, cells in rows], GRID)

    data = {
        grids.community_melt: (grid(
            (0, 0, ["College  Name", "Branch Name", "oc", "MBC"]), (0, 1, [" A ", "b", "1", "2"]),
            (0, 2, ["", "b", "3", "4"]), (0, 3, ["C", "b", "5"]), (0, 4, ["D", None, "6", "x"]),
            (1, 0, ["Name", "OC"]), (1, 1, ["E", "7"])), [("A", "OC", 1), ("A", "MBC", 2),
                                                         ("D", "OC", 6)]),
        grids.last_rank_melt: (grid(
            (0, 0, ["Institute\nName", "OC_BO\nYS", "Place"]), (0, 1, ["A", "1", "p"]),
            (0, 2, ["B", "2"]), (0, 3, [" ", "3", "p"]), (1, 0, ["X"]), (1, 1, ["4"])),
            [("A", "OC", 1)]),
        grids.branch_melt: (grid(
            (0, 0, ["College Code", "N", "Seat", "CS-Computers", "", "Law"]),
            (0, 1, ["1", "A", "GM", "7", "8", "9"]), (0, 2, ["1", "", "GM", "7"]),
            (0, 3, ["1", "B"]), (1, 0, ["Code", "N", "S", "Law"]), (1, 1, ["1", "C", "GM", "5"])),
            [("A", "GM", 7), ("A", "GM", 9)])}
    for melt, (rows, wanted) in data.items():
        out = melt(rows).select("Institute", "Category", "ClosingRank")
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("u2028") == 1, melt.__name__
        assert sorted(map(tuple, out.collect())) == sorted(wanted), melt.__name__
