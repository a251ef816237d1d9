"""Whole plans: sources, build, partition, side tables, sites, entry contract."""

from __future__ import annotations

import gzip
import json
import uuid

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from rankloom import jobs
from rankloom.plans import catalog, ingest, segmentation, side, sites
from rankloom.schema import (
    CANON_COLUMNS, GRID, RAW, SEGMENT_COLUMNS, SNAPSHOT_COLUMNS, WEB_COLUMNS,
)
from rankloom.sources.bodies import BODIES, register_bodies
from rankloom.sources.files import (
    read_envelope, read_exam_batches, read_fidelity, read_segmentation, read_snapshot,
)
from rankloom.sources.registry import SourceMeta, SourceRegistry, SourceSpec
from rankloom.streaming.feeds import append_stream, snapshot_stream

SNAPSHOT = ",".join(SNAPSHOT_COLUMNS) + "\n" + "\n".join([
    'WBJEE,WBJEE,UG,West Bengal,2022,1,"Jadavpur ""U"", Kolkata",CSE,OPEN,HS,Gender-Neutral,22,206',
    "WBJEE,WBJEE,UG,West Bengal,2023,1,Other College,CSE,OPEN,NA,Gender-Neutral,nan,\"1,206\"",
    "WBJEE,WBJEE,UG,West Bengal,2023,1,Other College,CSE,OPEN,NA,Gender-Neutral,nan,\"1,206\""])


@pytest.fixture
def snapshots(tmp_path):
    folder = tmp_path / "snap"
    folder.mkdir()
    (folder / "wbjee_cached.csv").write_text(SNAPSHOT)
    with gzip.open(folder / "ipu_official.csv.gz", "wt") as f:
        f.write(SNAPSHOT.replace("WBJEE", "IPU"))
    return folder


def test_registry():
    registry = SourceRegistry()
    spec = registry.register(SourceSpec(SourceMeta("a", "A", "UG"), lambda s: None))
    assert registry.get("a") is spec and registry.names() == ["a"]
    with pytest.raises(ValueError):
        registry.register(spec)
    with pytest.raises(KeyError):
        registry.get("b")


def test_bodies(spark, snapshots):
    registry = register_bodies(SourceRegistry(), str(snapshots))
    assert len(BODIES) == 19 and len(registry.names()) == 20
    assert len(registry.all(include_optin=False)) == 19
    raw = read_snapshot(spark, str(snapshots / "wbjee_cached.csv")).collect()
    assert raw[0]["Institute"] == 'Jadavpur "U", Kolkata' and raw[1]["Quota"] is None
    assert registry.get("wbjee").load(spark).count() == 3
    assert registry.get("ipu").load(spark).count() == 2  # keep-first key
    assert registry.get("kcet").load(spark).count() == 0


def test_build(spark, snapshots, tmp_path):
    registry = register_bodies(SourceRegistry(), str(snapshots))
    out = str(tmp_path / "data")
    meta = ingest.run(spark, registry, out, deliverable_path=str(tmp_path / "client"), when="now")
    assert meta == {"generated_at": "now", "mode": "cached", "rows": 4, "sources": 19}
    assert ingest.load_meta(spark, out + "_meta")["rows"] == 4
    assert ingest.load_meta(spark, str(tmp_path / "none")) == {}
    rows = spark.read.parquet(out)
    assert rows.columns == CANON_COLUMNS
    first = rows.filter("Body = 'WBJEE' and Year = 2022").first()
    assert (first["City"], first["CategoryGroup"], first["Website"]) \
        == ("Kolkata", "General", "https://wbjeeb.nic.in/")
    assert spark.read.csv(str(tmp_path / "client"), header=True).count() == 4


def test_latest_reads_documents_and_falls_back(spark, snapshots, tmp_path):
    docs = tmp_path / "docs"
    spark.createDataFrame([
        ("d", 0, 0, 0, ["Institute", "Program", "Quota", "Category", "Opening Rank", "Closing Rank"]),
        ("d", 0, 0, 1, ["MAIT", "CSE", "HS", "OPNO", "1", "9"]),
        ("d", 1, 0, 0, ["MAIT", "CSE", "HS", "OPNO", "1", "9"])], GRID) \
        .write.parquet(str(docs / "ipu" / "grid"))
    registry = register_bodies(SourceRegistry(), str(snapshots), str(docs))
    fresh = registry.get("ipu").load(spark, "latest").collect()
    assert [(r["Body"], r["Round"], r["ClosingRank"]) for r in fresh] == [("IPU", "Round 1", 9)]
    assert registry.get("wbjee").load(spark, "latest").count() == 3


def test_segmentation(spark):
    universe = spark.createDataFrame([
        ("A", "http://h", "https://www.shiksha.com/x"), ("B", "no site", "see notice"),
        ("C", "", ""), (" D ", "http://d", ""), ("", "", ""),
        (segmentation.FOLDED[0], "", "")], "Exam string, Homepage string, CutoffURL string")
    links = spark.createDataFrame([
        ("A", "Official Cutoff", "https://x"), ("B", "No Cutoff Exists", "https://y"),
        ("C", "No Cutoff Exists", ""), ("D", "Official Merit List", ""),
        (segmentation.FOLDED_EXAM, "Official Cutoff", "")],
        "Exam string, CutoffStatus string, Shiksha string").withColumns(
            {c: F.lit("") for c in ("CollegeDunia", "Careers360", "CollegeDekho")})

    def kinds(**options):
        rows = segmentation.segment(universe, links, **options)
        assert rows.columns == SEGMENT_COLUMNS
        return {r["exam"]: r for r in rows.collect()}

    plain = kinds()
    assert [plain[e]["category"] for e in "ABCD"] == ["cat1", "cat2", "cat3", "cat1"]
    assert plain["A"]["aggregator_as_official"] and plain["A"]["n_competitor_links"] == 1
    assert plain["B"]["prose_homepage"] and plain["B"]["prose_cutoff_url"]
    assert plain[segmentation.FOLDED[0]]["category"] == "cat3"
    assert kinds(merit_list=False)["D"]["category"] == "cat3"
    folded = kinds(jee_remap=True)[segmentation.FOLDED[0]]
    assert folded["category"] == "cat1" and folded["jee_remapped"]
    totals = segmentation.counts(segmentation.segment(universe, links)).first()
    assert totals["cat1"] + totals["cat2"] + totals["cat3"] == totals["total"] == 5
    sheet = segmentation.website_map(
        segmentation.segment(universe, links),
        spark.createDataFrame([("C", "https://fix")], "exam string, official_cutoff_url string"))
    assert {r["exam"]: r["website"] for r in sheet.collect()} \
        == {"A": "https://www.shiksha.com/x", "C": "https://fix", "D": "http://d"}


RAW_ROWS = [
    dict(exam="KCET", institute_name="RV College", branch_or_course="CSE", year="2024",
         raw_cells='{"Closing Rank":"1500"}', page_url="p"),
    dict(exam="KCET", institute_name="RV College", branch_or_course="CSE", year="2024",
         raw_cells='{"Closing Rank":"1500"}', page_url="again"),
    dict(exam="KCET", raw_cells='{"Event":"Exam","Date":"To be notified"}'),
    dict(exam="AILET", raw_cells='{"Category":"SC","Cut off":"1480"}',
         institute_name="AILET 2026 Round 1 Cut-Off"),
    dict(exam="SWAP", opening_rank=5000, closing_rank=1000),
    dict(exam="PCT", cutoff_percentile="98"),
    dict(exam="MIX", opening_rank=64, cutoff_score_or_marks="49"),
]


def test_distil(spark):
    rows = [tuple(r.get(c) for c in RAW.names) + (i,) for i, r in enumerate(RAW_ROWS)]
    raw = spark.createDataFrame(rows, StructType([*RAW.fields, StructField("seq", IntegerType())]))
    sites_of = spark.createDataFrame([("KCET", "https://kea")], "exam string, website string")
    out = {r["Exam Name"]: r for r in side.distil(raw, sites_of, ["seq"]).collect()}
    assert len(out) == 5
    assert (out["KCET"]["Closing Rank"], out["KCET"]["Link of website"],
            out["KCET"]["Link - Data Taken from"]) == (1500, "https://kea", "p")
    assert (out["AILET"]["College Name"], out["AILET"]["Category"],
            out["AILET"]["Year - cutoff"]) == ("", "SC", 2026)
    assert (out["SWAP"]["Opening Rank"], out["SWAP"]["Closing Rank"]) == (1000, 5000)
    assert out["PCT"]["Closing Rank"] == 98 and out["MIX"]["Closing Rank"] is None


def test_web_batches(spark, tmp_path):
    one = {"E1": {"status": "ok", "source_url": "https://s", "note": "n", "rows": [
        {"College Name": "A", "Opening Rank": "1,234", "Closing Rank": None},
        {"College Name": "B", "Cutoff Percentile/Score": 98.5, "Link - Data Taken from": "https://l"},
        {"College Name": "C", "Closing Rank": "null"}]}, "bad": 3, "E2": {"status": "none", "rows": []},
        "E3": {"rows": [{"Closing Rank": 5}]}}
    two = {"E1": {"data_status": "later", "official_note": "o", "rows": []}}
    for folder, name, blob in (("a", "batch_01.json", one), ("b", "batch_00.json", two)):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / name).write_text(json.dumps(blob))
    (tmp_path / "a" / "batch_02.json").write_text("{broken")
    (tmp_path / "a" / "other.json").write_text(json.dumps(one))
    (tmp_path / "f.json").write_text(json.dumps({"E3": {"drop": True}, "E1": {"fidelity": "portal"}}))
    batches = read_exam_batches(spark, [str(tmp_path / "a"), str(tmp_path / "b"), str(tmp_path / "c")])
    verdicts = read_fidelity(spark, str(tmp_path / "f.json"))
    webs = spark.createDataFrame([("E9", "x")], "exam string, website string")
    rows = side.web_rows(batches, verdicts, webs)
    assert rows.columns == WEB_COLUMNS
    got = {r["College Name"]: r for r in rows.collect()}
    assert set(got) == {"A", "B"} and got["A"]["Opening Rank"] == 1234
    assert got["A"]["Link of website"] == "https://s" and got["A"]["Fidelity"] == "portal"
    assert got["B"]["Link - Data Taken from"] == "https://l"
    status = {r["exam"]: r for r in side.web_status(
        batches, verdicts, ["dir_order", "file", "pos"]).collect()}
    assert set(status) == {"E1", "E2"}
    assert (status["E1"]["rows_kept"], status["E1"]["status"], status["E1"]["note"]) \
        == (2, "later", "o")
    assert read_fidelity(spark, str(tmp_path / "no.json")).count() == 0


def test_envelopes(spark, tmp_path):
    record = {"exam": "E", "body": "B"}
    for i, blob in enumerate(([record], {"records": [record]}, {"result": {"records": [record]}},
                              {"other": 1})):
        (tmp_path / f"{i}.json").write_text(json.dumps(blob))
    counts = [read_envelope(spark, str(tmp_path / f"{i}.json"), "exam string, body string").count()
              for i in range(4)]
    assert counts == [1, 1, 1, 0]


def test_candidates_keep_order(spark):
    urls = ["https://wikipedia.org/a", "https://x.org/p", "https://x.org/p/?q=1",
            "https://y.org/vet-india-cutoff", "https://shiksha.com/z", "https://z.org/1",
            "https://z.org/2", "https://z.org/3"]
    df = spark.createDataFrame([("India Vet Test", i, u) for i, u in enumerate(urls)],
                               "exam string, position int, url string")
    got = [r["url"] for r in side.rank_candidates(df).orderBy("position").collect()]
    assert got == ["https://y.org/vet-india-cutoff", "https://shiksha.com/z", "https://x.org/p",
                   "https://z.org/1", "https://z.org/2"]


def test_catalog_overlays(spark):
    universe = spark.createDataFrame([("Kerala Law Exam", "h", "c"), ("Company Secretary", "h", "c")],
                                     "Exam string, Homepage string, CutoffURL string")
    more = spark.createDataFrame([
        ("Kerala Law Exam", "Some Board &amp; Council", "PG", "Score", "s"),
        ("Company Secretary", "Other", "", None, "")],
        "exam string, body string, level string, metric string, scope string")
    links = spark.createDataFrame([("Kerala Law Exam", "https://k", None, "KLEE")],
                                  "exam string, homepage string, cutoff string, acronym string")
    rows = {r["Exam"]: r for r in catalog.build_catalog(
        universe, enrichment=more, overlay=links).collect()}
    law, cs = rows["Kerala Law Exam"], rows["Company Secretary"]
    assert (law["Body"], law["Level"], law["CutoffURL"], law["Acronym"]) \
        == ("Some Board & Council", "PG", "", "KLEE")
    assert (cs["Body"], cs["Level"], cs["Metric"], cs["CutoffURL"]) \
        == ("ICSI", "Certification", "Pass/Fail", "c")


def test_targets(spark):
    rows = spark.createDataFrame([("A", "cat1", "https://s"), ("B", "cat2", "https://s"),
                                  ("C", "cat2", " ")], "exam string, category string, shiksha string")
    assert [r["exam"] for r in sites.targets(rows, "shiksha").collect()] == ["A", "B"]
    assert [r["exam"] for r in sites.targets(rows, "shiksha", "cat2").collect()] == ["B"]


def test_jobs(spark, tmp_path):
    (tmp_path / "u.csv").write_text("Exam,Homepage,CutoffURL\nVet Exam, http://h ,\n")
    (tmp_path / "l.csv").write_text(
        "Exam,CutoffStatus,CollegeDunia,Shiksha,Careers360,CollegeDekho\n"
        "Vet Exam,No Cutoff Exists,https://collegedunia.com/exams/vet,,,\n")
    out = str(tmp_path / "out")
    parse = jobs.parser().parse_args
    args = parse(["segments", "--out", out, "--universe", str(tmp_path / "u.csv"),
                  "--links", str(tmp_path / "l.csv")])
    assert args.run(spark, args)["cat2"] == 1
    assert read_segmentation(spark, f"{out}/segmentation").first()["n_competitor_links"] == 1
    html = "<table><tr><th>College</th><th>Closing Rank</th></tr><tr><td>A</td><td>9</td></table>"
    spark.createDataFrame([("https://collegedunia.com/exams/vet/cutoff", html)],
                          "url string, html string").write.parquet(str(tmp_path / "pages"))
    args = parse(["sites", "--out", out, "--segmentation", f"{out}/segmentation", "--pages",
                  str(tmp_path / "pages"), "--site", "collegedunia"])
    stats = args.run(spark, args)["collegedunia"]
    assert (stats["exams_attempted"], stats["exams_url_resolved"], stats["exams_with_rows"],
            stats["rows"]) == (1, 1, 1, 1)
    args = parse(["distil", "--out", out, "--segmentation", f"{out}/segmentation", "--raw",
                  f"{out}/competitor_collegedunia"])
    args.run(spark, args)
    rows = spark.read.csv(f"{out}/aggregator_cutoffs", header=True).collect()
    assert [(r["Exam Name"], r["Closing Rank"], r["Link of website"]) for r in rows] \
        == [("Vet Exam", "9", "http://h")]


def test_catalog_links_and_report_jobs(spark, tmp_path):
    parse = jobs.parser().parse_args
    out = str(tmp_path / "out")
    (tmp_path / "u.csv").write_text("Exam,Homepage,CutoffURL\nABC Exam,http://a.in/,http://a.in/c\n"
                                    "Other Exam,,\n")
    (tmp_path / "p.csv").write_text("url,bucket\nhttp://a.in/c,html_table_rank\n"
                                    "http://a.in/c,pdf\n")
    args = parse(["catalog", "--out", out, "--universe", str(tmp_path / "u.csv"), "--probe",
                  str(tmp_path / "p.csv")])
    assert args.run(spark, args)["exams"] == 2
    spark.createDataFrame([("http://a.in/", True), ("http://a.in/", True), ("http://a.in/c", False)],
                          "url string, ok boolean").write.parquet(f"{out}/status")
    # of several records for an exam the last one counts
    spark.createDataFrame([("ABC Exam", "", "", "ABC"), ("ABC Exam", "", "http://b.in/x", "ABC")],
                          "exam string, homepage string, cutoff string, acronym string") \
        .write.parquet(f"{out}/records")
    spark.createDataFrame([("http://b.in/x", True)], "url string, ok boolean") \
        .write.parquet(f"{out}/live")
    args = parse(["links", "--out", out, "--catalog", f"{out}/catalog", "--status",
                  f"{out}/status", "--records", f"{out}/records", "--live", f"{out}/live"])
    counts = args.run(spark, args)
    assert (counts["exams"], counts["homepage_kept"], counts["cutoff_found"],
            counts["cutoff_blank"]) == (2, 1, 1, 1)
    html = "<table><tr><th>College</th><th>Closing Rank</th></tr><tr><td>A</td><td>9</td></table>"
    spark.createDataFrame([("1", "http://a.in/c", html, "html", "ABC Exam", "B", "UG", "Goa", "w")],
                          "page_id string, url string, html string, kind string, exam string, "
                          "body string, level string, state string, website string") \
        .write.parquet(f"{out}/pages")
    args = parse(["harvest", "--out", out, "--pages", f"{out}/pages"])
    assert args.run(spark, args) == {"sources": 1, "rows": 1}
    args = parse(["union", "--out", out, "--web", f"{out}/web_cutoffs"])
    spark.createDataFrame([("E", "C", "2024", "7")], '`Exam Name` string, `College Name` string, '
                          '`Year - cutoff` string, `Closing Rank` string') \
        .write.parquet(f"{out}/web_cutoffs")
    assert args.run(spark, args)["layers"] == ["web"]
    assert spark.read.csv(f"{out}/all_cutoffs", header=True).count() == 1


def test_failing_refresh_gives_the_snapshot(spark):
    def broken(spark):
        return spark.range(1).filter("assert_true(id < 0) is null")
    kept = spark.range(3)
    spec = SourceSpec(SourceMeta("x", "X", "UG"), lambda _: kept, broken)
    with pytest.warns(UserWarning, match="refresh of x failed"):
        assert spec.load(spark, "latest").count() == 3


def test_refresh_that_breaks_in_its_last_partition(spark, tmp_path):
    """All partitions but one are written when it breaks: nothing of them is seen."""
    def torn(spark):
        return spark.range(0, 40, 1, 8).select(
            F.when(F.col("id") < 39, F.col("id")).otherwise(
                F.raise_error(F.lit("torn")).cast("long")).alias("id"))
    kept = spark.range(3)
    spec = SourceSpec(SourceMeta("x", "X", "UG"), lambda _: kept, torn)
    assert not torn(spark).limit(1).isEmpty()   # a look at the first partition sees no fault
    with pytest.warns(UserWarning, match="refresh of x failed"):
        assert spec.load(spark, "latest", str(tmp_path)).count() == 3
    assert not (tmp_path / "x" / "_SUCCESS").exists()


def test_refresh_is_read_from_what_was_written(spark, tmp_path):
    runs = spark.sparkContext.accumulator(0)

    def counted(batches):
        runs.add(1)
        yield from batches
    spec = SourceSpec(SourceMeta("x", "X", "UG"), lambda _: spark.range(3),
                      lambda s: s.range(5).coalesce(1).mapInPandas(counted, "id long"))
    fresh = spec.load(spark, "latest", str(tmp_path))
    assert fresh.count() == 5 and fresh.count() == 5 and runs.value == 1
    empty = SourceSpec(SourceMeta("y", "Y", "UG"), lambda _: spark.range(3), lambda s: s.range(0))
    with pytest.warns(UserWarning, match="refresh of y is empty"):
        assert empty.load(spark, "latest", str(tmp_path)).count() == 3


def test_run_removes_its_staged_refreshes(spark, tmp_path, monkeypatch):
    stage = tmp_path / "stage"
    monkeypatch.setattr(ingest, "shared_folder", lambda _: str(stage))
    registry = SourceRegistry()
    fresh = spark.createDataFrame([("A", 2024)], "Institute string, Year long")
    registry.register(SourceSpec(SourceMeta("x", "X", "UG"), lambda _: fresh.limit(0),
                                 lambda _: fresh))
    meta = ingest.run(spark, registry, str(tmp_path / "out"), mode="latest", when="now")
    assert meta["rows"] == 1 and not stage.exists()


def test_stream_appends(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text(SNAPSHOT)
    columns = ", ".join(f"{c} string" for c in SNAPSHOT_COLUMNS)
    name = f"test-{uuid.uuid4()}"  # the checkpoint folder outlives a test run
    for expected in (3, 6):
        stream = snapshot_stream(spark, str(tmp_path / "in"), columns)
        append_stream(stream, str(tmp_path / "data"), str(tmp_path / name)).awaitTermination(120)
        assert spark.read.parquet(str(tmp_path / "data")).count() == expected
        (tmp_path / "in" / "b.csv").write_text(SNAPSHOT)


def test_entry_contract(spark):
    import __spark_entry__ as contract

    names = set(contract.queries())
    assert names and set(contract.oracle_sql()) <= names
    assert contract.entry(spark).count() > 0


def test_bulk_source_walks_its_links(spark, snapshots, tmp_path):
    """The opt-in source on refresh: stored pages, probe and log decide which links give rows."""
    page = ("<table><tr><th>Institute</th><th>Branch</th><th>Closing Rank</th></tr>"
            "<tr><td>{0} College</td><td>Civil</td><td>12</td></tr></table>")
    urls = [f"https://h.in/{n}" for n in range(7)]
    frames = {
        "links": ([(n, f"E{n}", u, False, "https://home.in", None, "UG", None)
                   for n, u in enumerate(urls)], "position long, exam string, url string, prose "
                  "boolean, website string, body string, level string, state string"),
        "probe": ([(u, "http_404" if n == 1 else "html_table") for n, u in enumerate(urls)],
                  "url string, bucket string"),
        "log": ([(u, "boom" if n in (2, 3, 5) else None) for n, u in enumerate(urls)],
                "url string, error string"),
        "pages": ([(u, page.format(n) if n != 4 else "<p>none</p>") for n, u in enumerate(urls)],
                  "url string, html string")}
    paths = {}
    for name, (rows, schema) in frames.items():
        paths[name] = str(tmp_path / name)
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(paths[name])
    registry = register_bodies(SourceRegistry(), str(snapshots), None, None, paths["pages"],
                               paths["probe"], paths["links"], paths["log"])
    rows = registry.get("bulk_official").load(spark, "latest", str(tmp_path / "stage")).collect()
    # 1 is dead, 2, 3 and 5 fail, 4 is empty; with 5 the host is closed, so 6 is not tried
    assert [(r.Institute, r.SourceURL, r.Website) for r in rows] == [
        ("0 College", urls[0], "https://home.in")]
