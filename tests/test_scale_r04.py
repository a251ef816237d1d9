"""Plans that keep memory, disk and time in proportion to the input."""

from __future__ import annotations

import random

from rankloom.operators import grids, htmltables
from rankloom.plans import sites


def _plan(df, kind="optimizedPlan"):
    return getattr(df._jdf.queryExecution(), kind)().toString()


def test_stored_pages_are_not_broadcast(spark):
    """pages meet their addresses by a shuffle, however small Spark takes them for."""
    exams = spark.createDataFrame([("A", "https://www.careers360.com/exams/a"),
                                   ("B", "https://www.careers360.com/exams/b")],
                                  "exam string, site_url string")
    html = "<table><tr><th>College</th><th>Closing Rank</th></tr><tr><td>X</td><td>5</td></tr></table>"
    pages = spark.createDataFrame(
        [("https://www.careers360.com/articles/a-cut-off", html),
         ("https://www.careers360.com/articles/b-cutoff", None)], "url string, html string")
    out = sites.site_rows("careers360", exams, pages)
    assert [(r["exam"], r["institute_name"], r["closing_rank"]) for r in out.collect()] \
        == [("A", "X", 5)]
    for kind in ("executedPlan", "optimizedPlan"):
        assert "Broadcast" not in _plan(out, kind)
    assert "SortMergeJoin" in _plan(out, "executedPlan")


def test_words_are_shuffled_once_and_not_sorted(spark):
    """the words of a page serve its header and its lines from one shuffle."""
    heads = [(h, 50.0 * i) for i, h in enumerate(grids.LINE_HEADERS)]
    row = ["NIT", "Civil", "HS", "General", "Female Only", "7", "12"]
    page = [(i, 10.0, x, h) for i, (h, x) in enumerate(heads)] \
        + [(10 + i, 30.0, x, t) for i, ((_, x), t) in enumerate(zip(heads, row))] \
        + [(20 + i, 40.0, x, h) for i, (h, x) in enumerate(heads)]
    words = spark.createDataFrame(
        [(d, p, *w) for d, p in (("a", 1), ("b", 2), (None, 1), ("b", None)) for w in page],
        "doc_id string, page int, word_idx int, top double, x0 double, text string")
    out = grids.borderless_rows(words)
    # header words below the header are words of a line like any other
    assert sorted(tuple(r) for r in out.collect()) == [
        (d, p, 0, 30, "NIT", "Civil", "HS", "General", "Female-only", 7, 12)
        for d, p in (("a", 1), ("b", 2))]
    plan = _plan(out, "executedPlan").split("Initial Plan")[0]
    assert plan.count("ReusedExchange") == 1, plan
    assert "SortMergeJoin" not in plan and "Broadcast" not in plan


def test_headings_and_their_carry_share_one_shuffle(spark):
    """tables and headings are shuffled once, by block; a table of no document has no rows."""
    lines = spark.createDataFrame(
        [(d, p, i, float(top), t) for d in ("a", "b", None) for p, i, top, t in (
            (1, 0, 1, "01002 - College A"), (1, 1, 2, "0100219110 - Course B"),
            (300, 0, 90, "0100219110 - Course C"))],
        "doc_id string, page int, line_idx int, top double, text string")
    tables = spark.createDataFrame(
        [(d, p, 0, 50.0) for d in ("a", "b", None) for p in (1, 2, 300, 301)],
        "doc_id string, page int, table_idx int, top double")
    grid = spark.createDataFrame(
        [(d, p, 0, i, r) for d in ("a", "b", None) for p in (1, 2, 300, 301)
         for i, r in enumerate((["Stage", "GM"], ["I", "7 (9)"]))],
        "doc_id string, page int, table_idx int, row_idx int, cells array<string>")
    out = grids.staged_matrix(grid, lines, tables, "R")
    got = sorted((r["doc_id"], r["page"], r["Institute"], r["Branch"], r["ClosingRank"])
                 for r in out.collect())
    assert got == [(d, p, "College A", "Course B", 7) for d in "ab" for p in (1, 2, 300, 301)]
    plan = _plan(out, "executedPlan").split("Initial Plan")[0]
    assert plan.count("ReusedExchange") == 1, plan


def test_plain_pages_are_cut_at_their_brackets():
    """a page of plain tables does without the reader, attributes and spans included."""
    page = "<!doctype html><body class='x y'><h2>A &amp; b</h2><table id=t border=1><caption>C</caption>" \
           "<thead><tr><th>I</th><th colspan=2>R</th></tr></thead><tr><td class=\"c\">a<br>b<td>1" \
           "</td><td>2</td></tr><tfoot><tr><td rowspan=2>s</table><p>t</p><table><TR><td>x &lt; y"
    tables = htmltables._plain_tables(page)
    assert [(t.caption, *t.expanded()) for t in tables] == [
        ("C", ["I", "R", "R"], [["a b", "1", "2"], ["s", "", ""]]),
        ("A & b", ["0"], [["x < y"]])]


def test_random_pages_read_both_ways():
    """where pages are cut at their brackets, the reader finds the same."""
    rng, plain = random.Random(4), 0
    kinds = ["table", "tr", "td", "th", "thead", "tbody", "tfoot", "caption", "h1", "br", "b"]
    forms = ["<{}>", "</{}>", "<{} class='a b'>", "<{} colspan=2>", "<{} title=\"a>b\">", "<{}/>",
             "<{} style='display:none'>", "<{} rowspan='2'\n>", "</{} x>", "<{} title='a"]
    texts = ["a", " b c ", "&amp;", "&lt;td&gt;", "\n", "<", ">", "<!-- c -->", "<script>", "</script>",
             "<!x>"]
    usual = [f.format(k) for f in forms[:4] for k in kinds] + texts[:5]
    every = [f.format(k) for f in forms for k in kinds] + texts

    def shown(tables):
        return [(t.index, t.caption, *t.expanded()) for t in tables]

    for _ in range(20000):
        parts = usual if rng.random() < 0.7 else every
        page = "".join(rng.choice(parts) for _ in range(rng.randint(1, 30)))
        tables = htmltables._plain_tables("<table>" + page)
        if tables is not None:
            plain += 1
            assert shown(tables) == shown(htmltables._read_tables("<table>" + page)), page
    assert plain > 3000
