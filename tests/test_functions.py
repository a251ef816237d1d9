"""Column functions against literal cases."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from rankloom.functions import classify as k
from rankloom.functions import numbers as n
from rankloom.functions import relevance as rel
from rankloom.functions import text as t
from rankloom.functions import urls as u
from rankloom.functions.embedded import initial_state, next_data, unescape
from rankloom.functions.rawcells import category_of, cell_entries, ranks_of
from rankloom.operators.grids import branch_header, last_rank_header
from rankloom.plans.sites import recent_years, with_cutoff_urls


def test_canonical_integer(apply):
    cases = {"1,234": 1234, " 56 ": 56, "": None, "-": None, "bad": None, "1234.0": 1234,
             "2.5": 2, "3.5": 4, "12d": None, "1e3": 1000, "NaN": None, None: None}
    assert apply(n.canon_int, list(cases)) == list(cases.values())


def test_noisy_rank(apply):
    cases = {"1,234": 1234, "1234 (Gen)": 1234, "Will be notified": None, "--": None,
             None: None, "987": 987, "98.7": 98, "0": None, "final 120": None,
             "15000000.0": 15000000}
    assert apply(n.noisy_rank, list(cases)) == list(cases.values())


def test_cell_rank(apply):
    cases = {"3.16E+04": 31600, "1,234": 1234, "-": None, "": None, "-5": 5, "TBA": None}
    assert apply(n.cell_rank, list(cases)) == list(cases.values())


def test_rank_range(apply):
    cases = {"200-500": (200, 500), "1,200 to 3,400": (1200, 3400), "200 – 500": (200, 500),
             "500": None, "a 2-3": None}
    got = [None if r is None else tuple(r) for r in apply(n.rank_range, list(cases))]
    assert got == list(cases.values())


def test_percentile_and_web_rank(apply):
    cases = {"99.87": True, "100.0": True, "50": False, "1234.5": False, "": False,
             "99.5%": True, None: False}
    assert apply(n.looks_like_percentile, list(cases)) == list(cases.values())
    web = {"1,234": 1234, "abc": None, "null": None, "2.5": 2}
    assert apply(n.web_rank, list(web)) == list(web.values())


def test_small_number_rules(apply):
    assert apply(n.leading_int, ["1,234 *", "x1", "7"]) == [1234, None, 7]
    assert apply(n.digits_only, ["12", "1,2", "1.0"]) == [12, None, None]
    assert apply(n.is_short_rank, ["1,234", "1234567", "G", None]) == [True, False, False, False]
    assert apply(n.year_in, ["AILET 2026 Round 1", "120260", None]) == [2026, None, None]


DOUBLED = {"BBiikkaanneerr": "Bikaner", "CCoolllleeggee,, AAllwwaarr": "College, Alwar",
           "CCoolllleeggee,,\nJJaaiippuurr": "College,\nJaipur", "MMaallee": "Male",
           "OOBBCC": "OBC", "SSCC": "SC"}
PLAIN = ["College", "Bhilwara", "Alappuzha", "IIT Bombay", "Bengaluru", "Male", "Female",
         "General", "OBC", "SC", "ST", "BOOK", "NOON"]


def test_dedouble(apply, spark):
    assert apply(lambda c: t.dedouble("v"), list(DOUBLED)) == list(DOUBLED.values())
    assert apply(lambda c: t.dedouble("v"), PLAIN) == PLAIN
    assert apply(lambda c: t.looks_doubled("v"), ["1122", "1123", None]) == [True, False, False]
    long_text = "ab" * 40000
    assert apply(lambda c: t.dedouble("v"), [long_text])[0] == long_text


def test_doubling_round_trip(apply):
    words = ["Government Engineering College", "Zürich Übung", "a-b_c", "naïve 𝒳 text"]
    twice = ["".join(ch * 2 for ch in w) for w in words]
    assert apply(lambda c: t.dedouble("v"), twice) == words


def test_clean_text_and_titles(apply):
    assert apply(lambda c: t.clean_text("v"), ["  a  \n b ", " ", None]) == ["a b", None, None]
    words = ["pune-maval", "new delhi", "o'brien", "ABC dEF"]
    assert apply(t.title_case, words) == [w.title() for w in words]
    assert apply(t.catalog_text, ["a – b", "nan", None]) == ["a - b", "", ""]
    assert apply(t.missing_to_blank, [" x ", "NaN", "<NA>", None]) == ["x", "", "", ""]


def test_city(spark):
    cases = {
        "000011--GGoovvtt.. PPoollyytteecchhnniicc CCoolllleeggee,, AAjjmmeerr": "Ajmer",
        "Government Engineering College, Kozhikkode": "Kozhikkode",
        "CIPET:IPT, BIHTA, PATNA": "Patna",
        "West Bengal University of Teachers, KB Sarani, Kolkata-700037 (WB)": "Kolkata",
        "Indian Institute of Technology Bombay": "Bombay", "Jadavpur University": None}
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, v string")
    out = k.with_city(df, F.col("v"), "city").orderBy("i").collect()
    assert [r["city"] for r in out] == list(cases.values())


def test_program(spark):
    cases = [("UG", "CIVIL ENGINEERING", "B.E./B.Tech"), ("PG", "Structural Engineering", "M.Tech"),
             ("UG", "ARCHITECTURE (C)", "B.Arch"), ("Diploma", "Mechanical", "Diploma"),
             ("UG", "BA- BAMS", "BAMS"), (None, None, "B.E./B.Tech"),
             ("UG", "B.Sc. (Hons.) Horticulture", "B.Sc (Agriculture & allied)")]
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(cases)],
                               "i int, l string, b string")
    out = df.select("i", k.program_of(F.col("l"), F.col("b")).alias("p")).orderBy("i").collect()
    assert [r["p"] for r in out] == [c[2] for c in cases]


GROUPS = {
    "General": "OPEN SM GMH GMRH GOPENS LOPENS TFWS OC OPEN(PH) GEN GEN-PH OPNO OPDF".split(),
    "OBC": "EZ OBC-NCL 2AG 1R 3BK GOBCS GVJS GNT1S GSEBCS BCA BCE BC(Girl) BCM MBC SEBC BC-I "
           "BC-II".split(),
    "SC": "SC SCKH GSCS SCI SCIII SC(AF) SCA".split(), "ST": "STH GSTS".split(),
    "EWS": "EWS OCEWS EWS(GL) EWS-PH EWNO".split(), "Other": ["BH", "STATE"],
    "Unspecified": ["Unspecified", None]}


def test_category_group(spark):
    cases = [(c, g) for g, codes in GROUPS.items() for c in codes]
    df = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(cases)], "i int, v string")
    out = k.with_category_group(df, F.col("v"), "g").orderBy("i").collect()
    assert [(c, r["g"]) for (c, _), r in zip(cases, out)] == cases


def test_exam_ladders(apply):
    cases = {
        "Kerala Law Entrance Examination": "Law",
        "All India Veterinary Entrance Test": "Veterinary",
        "Joint Entrance Examination (Main)": "Engineering & Technology",
        "Galileo Global Distribution System course": "Aviation & Maritime",
        "Indian Institute of Foreign Trade": "Management",
        "Centre for disaster management": "Multidisciplinary / University",
        "Rashtriya Raksha University (Police)": "Defence & Security"}
    assert apply(k.exam_category, list(cases)) == list(cases.values())
    assert apply(k.exam_level, ["Company Secretary Executive", "Institute of Postgraduate "
                                "Medical Education Nursing", "Goa Polytechnic"]) \
        == ["Certification", "UG", "Diploma"]
    states = {"West Bengal Joint Entrance": "West Bengal", "Joint Entrance Examination": "All India",
              "Guru Gobind Singh Indraprastha": "Delhi", "Cochin University": "Kerala"}
    assert apply(k.exam_state, list(states)) == list(states.values())


def test_buckets(apply):
    kinds = {"html_table_rank": "html", "html_something_new": "html", "js_only": "js",
             "pdf": "pdf", "pdf_multipage": "pdf", "http_404": "none", "http_418": "none",
             "error": "none", "no_url": "none", "": "none", "   ": "none", None: "none",
             "weird_new_bucket": "none"}
    assert [r["fetcher"] for r in apply(k.fetch_strategy, list(kinds))] == list(kinds.values())
    plans = apply(k.fetch_strategy, ["js_only", "pdf"])
    assert plans[0]["retries"] == 0 and plans[1]["timeout"] >= 45 and plans[1]["retries"] >= 2
    status = apply(k.probe_status, ["http_403", "error", "", "pdf", "odd"])
    assert [tuple(s) for s in status] == [
        ("dead", "blocked/dead (403)"), ("dead", "unreachable"), ("unknown", "unknown"),
        ("pdf", "pdf"), ("html", "odd")]


def test_headers(apply):
    cases = ["OC\nBOYS", "BC_A\nGIRLS", "OC_BO\nYS", "Institute Name"]
    got = [None if r is None else tuple(r) for r in apply(last_rank_header, cases)]
    assert got == [("OC", "Male"), ("BCA", "Female"), ("OC", "Male"), None]
    assert apply(branch_header, ["AD-Artificial Intelligence & Data Science",
                                 "CS- Computer Science"]) \
        == ["Artificial Intelligence & Data Science", "Computer Science"]


def test_raw_cells(apply):
    texts = ['{"Opening Rank":"1,000","Closing Rank":"12,345"}',
             '{"Category":"SC","Cut off":"1480"}', "not json", "[1]"]
    got = apply(lambda c: ranks_of(cell_entries(c)), texts)
    assert [tuple(r) for r in got] == [(1000, 12345), (None, 1480), (None, None), (None, None)]
    cats = ['{"Category":"OBC","Cut off":"330"}', '{"Category":"123"}']
    assert apply(lambda c: category_of(cell_entries(c)), cats) == ["OBC", None]


def test_captions(apply):
    assert apply(rel.is_caption, ["AILET 2026 Round 1 BA LLB Cut-Off",
                                  "AMU BA LLB Cut-Off 2024 Details",
                                  "Amrita School of Engineering, Coimbatore", ""]) \
        == [True, True, False, False]


def test_relevance(spark):
    cases = [
        ("MIT World Peace University Entrance Test",
         "https://zollege.in/mit-world-peace-university-mitwpu/cutoff", True),
        ("Vogue Institute of Art and Design", "https://x/fashion-technology-delhi/cut-off", False),
        ("University Entrance Test", "https://x/university", False)]
    df = spark.createDataFrame(cases, "e string, u string, want boolean")
    out = df.select("want", rel.is_relevant(F.col("e"), F.col("u")).alias("got")).collect()
    assert all(r["want"] == r["got"] for r in out)


def test_slugs(apply, spark):
    assert apply(u.slugify, ["All India Vet Test", "Zürich ﬁt", "½ way", None]) \
        == ["all-india-vet-test", "zurich-fit", "12-way", ""]
    assert apply(u.acronym, ["All India Vet Entrance Test", "Single"]) == ["aivet", None]
    df = spark.createDataFrame([("https://www.shiksha.com/search?q=a", "Vet Exam")],
                               "site_url string, exam string")
    urls = with_cutoff_urls(df, "shiksha").first()["urls"]
    assert urls[0]["url"] == "https://www.shiksha.com/engineering/a-exam-cutoff"
    assert len(urls) == 10
    assert recent_years(date(2026, 3, 1)) == [2025, 2024, 2023, 2022]


def test_urls(apply):
    links = ["http://a.b/x", "ask us", "https://", None, "HTTPS://A.b:8080?q=1"]
    assert apply(u.is_url, links) == [True, False, False, False, True]
    assert apply(u.host, links) == ["a.b", "", "", "", "a.b:8080"]
    assert apply(u.is_aggregator, ["https://law.careers360.com/x", "https://notshiksha.com"]) \
        == [True, False]
    assert apply(u.has_depth, ["https://a.b", "https://a.b/", "https://a.b/x", "https://a.b?q=1"]) \
        == [False, False, True, True]
    public = {"https://example.org": True, "http://localhost": False, "http://127.0.0.1": False,
              "http://169.254.169.254/x": False, "http://172.16.0.1": False,
              "http://172.32.0.1": True, "http://[::1]/": False, "ftp://example.org": False,
              "http://8.8.8.8:53/": True, "": False}
    assert apply(u.is_public_url, list(public)) == list(public.values())


def test_resolve_links(spark):
    html = '<a href="/d/a.pdf">x</a><a HREF=\'b.PDF?x=1\'>y</a><a href="/d/a.pdf">z</a>'
    df = spark.createDataFrame([(html, "https://s.org/p/q.html?z=1")], "h string, u string")
    got = df.select(u.pdf_links(F.col("h"), F.col("u")).alias("l")).first()["l"]
    assert got == ["https://s.org/d/a.pdf", "https://s.org/p/b.PDF?x=1"]


def test_embedded(apply):
    page = '<script>if (window.INITIAL_STATE) {}; window.INITIAL_STATE = {"a":{"Body":' \
           '"<table>x } {</table>"}} ;</script>'
    got = apply(initial_state, [page, "window.INITIAL_STATE = {bad", "none"])
    assert got[0]["article"] == "<table>x } {</table>"
    assert got[1]["state"] is None and got[2]["state"] is None
    blob = '<script id="__NEXT_DATA__" x>{"a": 1}</script>'
    assert apply(next_data, [blob, "<p>"]) == ['{"a": 1}', None]
    assert apply(unescape, ["A &amp; B", None]) == ["A & B", None]
