"""Lower-trust side tables. None of them ever enters the canonical dataset."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.functions.numbers import noisy_rank, row_year, web_rank, year_in
from rankloom.functions.rawcells import category_of, cell_entries, ranks_of
from rankloom.functions.relevance import (
    CAPTION_CATEGORY, CAPTION_ROUND, CUTOFF_WORDS, build_query, clean_institute, count_tables,
    is_caption, is_relevant, looks_like_cutoff, page_title, url_key, JUNK_SITES, PREFERRED_SITES,
)
from rankloom.functions.rules import ladder
from rankloom.functions.text import first_group, missing_to_blank, strip
from rankloom.operators.conform import project_deliverable
from rankloom.operators.dedup import DISTIL_KEY, keep_best, keep_first, position, unique_by
from rankloom.operators.htmltables import html_tables
from rankloom.operators.keep import keep_where
from rankloom.operators.rawrows import raw_rows
from rankloom.schema import UNION_COLUMNS, WEB_COLUMNS


def with_website(df: DataFrame, websites: DataFrame, exam: str = "Exam") -> DataFrame:
    """Attach the official website by exam; of several rows for an exam the last is taken."""
    side = unique_by(websites.select(F.col("exam").alias("_exam"),
                                     F.col("website").alias("_website"), *position(websites)),
                     ["_exam"])
    return df.join(side, F.col(exam) == F.col("_exam"), "left").drop("_exam")


# --- third-party tables -------------------------------------------------------
def row_signal(raw: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Canonical rows of raw rows that carry a rank, percentile or score.

    Ranks fall back to the original cells; an inverted pair is swapped; a
    percentile or score stands in for the closing rank only without any rank; a
    caption posing as a college is blanked. ``Institute`` keeps "" for missing.
    """
    cells = raw.withColumn("_entries", cell_entries(F.col("raw_cells")))
    parsed = cells.withColumns({
        "_o": noisy_rank(F.col("opening_rank")), "_c": noisy_rank(F.col("closing_rank")),
        "_p": noisy_rank(F.col("cutoff_percentile")),
        "_s": noisy_rank(F.col("cutoff_score_or_marks"))})
    dug = parsed.withColumn("_dug", F.when(
        F.col("_o").isNull() & F.col("_c").isNull(), ranks_of(F.col("_entries"))))
    found = keep_where(dug.withColumns({"_o": F.coalesce("_o", "_dug.opening"),
                                        "_c": F.coalesce("_c", "_dug.closing")}),
                       F.coalesce("_o", "_c", "_p", "_s").isNotNull())
    swap = F.col("_o") > F.col("_c")
    opening = F.when(swap, F.col("_c")).otherwise(F.col("_o"))
    closing = F.when(swap, F.col("_o")).otherwise(F.col("_c"))

    def text(c: str) -> Column:
        return missing_to_blank(F.col(c))

    named = found.withColumns({
        "_inst": text("institute_name"), "_branch": text("branch_or_course"),
        "_program": text("program"), "_cat": text("category"), "_opening": opening,
        "_closing": closing})
    none = F.lit(None).cast("string")
    return named.select(
        text("exam").alias("Exam"), none.alias("Website"),
        F.when(is_caption(F.col("_inst")), "").otherwise(F.col("_inst")).alias("Institute"),
        none.alias("City"), none.alias("State"),
        F.nullif("_program", F.lit("")).alias("Program"),
        F.coalesce(F.nullif("_branch", F.lit("")), F.nullif("_program", F.lit("")))
        .alias("Branch"),
        F.coalesce(F.nullif("_cat", F.lit("")), category_of(F.col("_entries"))).alias("Category"),
        F.nullif(text("quota"), F.lit("")).alias("Quota"),
        F.nullif(text("gender"), F.lit("")).alias("Gender"),
        row_year(F.col("year"), *[text(c) for c in (
            "table_caption", "branch_or_course", "institute_name")]).alias("Year"),
        F.nullif(text("counselling_round"), F.lit("")).alias("Round"),
        F.col("_opening").alias("OpeningRank"),
        F.coalesce("_closing", F.when(F.col("_opening").isNull(), F.coalesce("_p", "_s")))
        .alias("ClosingRank"),
        F.nullif(text("page_url"), F.lit("")).alias("SourceURL"), *keep)


def distil(raw: DataFrame, websites: DataFrame, order: list[str],
           include_category: bool = True) -> DataFrame:
    """Raw rows to the client's shape: first of equal cutoffs, official website."""
    rows = row_signal(raw, tuple(order)).filter(F.col("Exam") != "")
    first = keep_first(rows, DISTIL_KEY, order)
    linked = with_website(first, websites).withColumn("Website", F.col("_website"))
    return project_deliverable(linked, include_category)


# The state whose articles feed the side table.
ARTICLE_EXAM, ARTICLE_STATE = "MP DTE", "Madhya Pradesh"


def article_table(raw: DataFrame, order: list[str], year: int | None = 2024) -> DataFrame:
    """Closing ranks of the state's articles, one row per seat and rank."""
    kept = raw.filter((F.coalesce("closing_rank", F.lit(0)) != 0)
                      & (F.coalesce("branch_or_course", F.lit("")) != ""))
    rows = kept.select(
        F.lit(ARTICLE_EXAM).alias("Exam"), F.lit(ARTICLE_STATE).alias("State"),
        strip(F.coalesce("institute_name", F.lit(""))).alias("Institute"),
        strip(F.col("branch_or_course")).alias("Branch"),
        F.col("category").alias("Category"), F.lit(year).cast("bigint").alias("Year"),
        F.col("opening_rank").alias("OpeningRank"), F.col("closing_rank").alias("ClosingRank"),
        F.col("page_url").alias("SourceURL"), *order) \
        .filter(F.col("Institute") != "")
    return project_deliverable(
        keep_first(rows, ["Institute", "Branch", "Category", "ClosingRank"], order))


def side_metrics(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows, closing ranks and year span of a side table per exam."""
    year = F.col("Year - cutoff").try_cast("double")
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"), F.count("Closing Rank").alias("with_closing"),
        *([F.count("Cutoff Percentile/Score").alias("with_percentile")]
          if "Cutoff Percentile/Score" in rows.columns else []),
        F.min(year).cast("bigint").alias("first_year"),
        F.max(year).cast("bigint").alias("last_year"))


def layer_statistics(rows: DataFrame) -> DataFrame:
    """One row about a side table: rows, exams, colleges."""
    return rows.agg(F.count(F.lit(1)).alias("rows"),
                    F.count_distinct("Exam Name").alias("exams"),
                    F.count_distinct("College Name").alias("colleges"))


# --- web research -------------------------------------------------------------
# Row fields of a research batch.
_WEB_FIELDS = [c for c in WEB_COLUMNS if c not in ("Exam Name", "Link of website", "Fidelity")]
_PAYLOAD = "status string, data_status string, source_url string, note string, " \
           "official_note string, rows array<map<string,string>>"


def _parsed(batches: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Batches with their verdict; exams marked unreliable are gone entirely."""
    side = verdicts.select(F.col("exam").alias("_exam"), "fidelity", "drop")
    return batches.join(side, F.col("exam") == F.col("_exam"), "left") \
        .filter(~F.coalesce("drop", F.lit(False))) \
        .withColumn("_info", F.from_json("payload", _PAYLOAD)) \
        .drop("_exam", "drop", "payload")


def _has_signal(values: list[Column]) -> Column:
    out = F.lit(False)
    for v in values:
        out = out | F.coalesce(~v.isin("", "null"), F.lit(False))
    return out


def web_rows(batches: DataFrame, verdicts: DataFrame, websites: DataFrame) -> DataFrame:
    """Researched rows with a rank or a percentile, in the client's shape, distinct.

    ``batches``: exam and payload (JSON object) in any order.
    """
    info = _parsed(batches, verdicts)
    rows = info.select("exam", "fidelity", F.col("_info.source_url").alias("_source"),
                       F.explode("_info.rows").alias("_r"))
    fields = {c: F.try_element_at("_r", F.lit(c)) for c in _WEB_FIELDS}
    fields["Opening Rank"] = web_rank(fields["Opening Rank"])
    fields["Closing Rank"] = web_rank(fields["Closing Rank"])
    flat = rows.select("exam", "fidelity", "_source",
                       *[v.alias(c) for c, v in fields.items()])
    score = F.col("Cutoff Percentile/Score")
    kept = flat.filter(F.col("Opening Rank").isNotNull() | F.col("Closing Rank").isNotNull()
                       | _has_signal([score]))
    taken = F.nullif("Link - Data Taken from", F.lit(""))
    linked = with_website(kept, websites, "exam").withColumns({
        "Exam Name": F.col("exam"),
        "Link of website": F.coalesce(F.nullif("_website", F.lit("")), "_source"),
        "Link - Data Taken from": F.coalesce(taken, "_source"),
        "Fidelity": F.col("fidelity")})
    return linked.select(*WEB_COLUMNS).dropDuplicates()


def web_status(batches: DataFrame, verdicts: DataFrame, order: list[str]) -> DataFrame:
    """Per exam: kept rows over all batches, status and note of the last one.

    ``order`` are the columns that say which batch comes later.
    """
    info = _parsed(batches, verdicts)

    def cell(name: str):
        return lambda r: F.try_element_at(r, F.lit(name))

    kept = F.filter(
        F.coalesce("_info.rows", F.array().cast("array<map<string,string>>")),
        lambda r: web_rank(cell("Opening Rank")(r)).isNotNull()
        | web_rank(cell("Closing Rank")(r)).isNotNull()
        | _has_signal([cell("Cutoff Percentile/Score")(r)]))
    flat = info.select(
        "exam", F.size(kept).alias("_kept"), F.struct(*order).alias("_at"),
        F.struct(
            F.coalesce(F.nullif("_info.status", F.lit("")), "_info.data_status").alias("status"),
            F.coalesce(F.nullif("_info.note", F.lit("")), "_info.official_note").alias("note"))
        .alias("_said"))
    out = flat.groupBy("exam").agg(F.sum("_kept").alias("rows_kept"),
                                   F.max_by("_said", "_at").alias("_said"))
    return out.select("exam", F.col("_said.status").alias("status"),
                      F.col("_said.note").alias("note"), "rows_kept")


# --- exams without a link -------------------------------------------------------
def rank_candidates(candidates: DataFrame, n: int = 5) -> DataFrame:
    """Search results per exam: junk dropped, one per page, the best ``n``.

    About this exam first, then cutoff pages, then the known sites; otherwise
    the search order stays. ``candidates``: exam, position, url.
    """
    url = F.col("url")
    preferred = F.lit(False)
    for site in PREFERRED_SITES:
        preferred = preferred | url.contains(site)
    real = candidates.filter(~url.rlike(JUNK_SITES)).withColumn("_key", url_key(url))
    first = keep_first(real, ["exam", "_key"], ["position"])
    scored = first.select(
        "exam", "url", F.col("position").alias("_found"),
        (~is_relevant(F.col("exam"), url)).cast("int").alias("_r"),
        (~F.lower(url).contains("cutoff")).cast("int").alias("_w"),
        (~preferred).cast("int").alias("_p"))
    best = keep_best(scored, ["exam"], [F.col("_r"), F.col("_w"), F.col("_p"), F.col("_found")], n)
    return best.select("exam", "position", "url")


def provenance(exams: DataFrame, candidates: DataFrame, pages: DataFrame,
               year: int | None = None, when: str = "") -> DataFrame:
    """One audit row per exam: its best candidate and what the page held.

    ``candidates``: ranked (exam, position, url). ``pages``: stored (url, html).
    """
    first = candidates.filter(F.col("position") == 1) \
        .select(F.col("exam").alias("_exam"), F.col("url").alias("candidate_url"))
    # pages meet the chosen addresses first; only those few are looked into
    seen = first.join(pages.select(F.col("url").alias("_url"), "html"),
                      F.col("candidate_url") == F.col("_url")).select(
        "_exam", count_tables(F.col("html")).alias("n_tables"),
        looks_like_cutoff(F.col("html")).alias("found"),
        (F.coalesce("html", F.lit("")) != "").alias("http_ok"))
    looked = first.join(unique_by(seen, ["_exam"]), "_exam", "left")
    out = exams.join(looked, F.col("exam") == F.col("_exam"), "left")
    none = F.lit(False)
    return out.select(
        "exam", build_query(F.col("exam"), year).alias("query"),
        F.coalesce("candidate_url", F.lit("")).alias("candidate_url"),
        F.coalesce("http_ok", none).alias("http_ok"),
        F.coalesce("n_tables", F.lit(0)).cast("bigint").alias("n_tables"),
        F.coalesce("found", none).alias("found"),
        ladder([(F.col("candidate_url").isNull(), "no search result"),
                (F.col("found"), "cutoff-like table found"),
                (F.col("http_ok"), "page fetched, no cutoff table")], "fetch failed/blocked")
        .alias("note"), F.lit(when).alias("generated_at"))


def quality_gate(raw: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Canonical rows of raw rows that are really cutoffs.

    A rank or percentile, a plausible closing rank, a branch that is not the
    college or the caption, and a caption that speaks of cutoffs. Category, year
    and round come from the caption where the row has none.
    """
    caption = F.coalesce("table_caption", F.lit(""))
    institute = strip(F.coalesce("institute_name", F.lit("")))
    branch = strip(F.coalesce("branch_or_course", F.lit("")))
    percentile = F.nullif("cutoff_percentile", F.lit(""))
    staged = raw.select("*", caption.alias("_caption"), institute.alias("_inst"),
                        branch.alias("_branch"), percentile.alias("_pct"))
    real = staged.filter(
        (F.col("closing_rank").isNotNull() | F.col("opening_rank").isNotNull()
         | F.col("_pct").isNotNull())
        & F.coalesce(F.col("closing_rank").between(1, 2_000_000), F.lit(True))
        & (F.col("_branch") != "") & (F.col("_branch") != F.col("_inst"))
        & (F.col("_branch") != F.col("_caption")) & F.col("_caption").rlike(CUTOFF_WORDS))
    rnd = first_group(F.col("_caption"), CAPTION_ROUND)
    return real.select(
        F.col("exam").alias("Exam"),
        clean_institute(F.coalesce(F.nullif("_inst", F.lit("")), "_caption"), F.col("exam"))
        .alias("Institute"),
        F.col("_branch").alias("Program"), F.col("_branch").alias("Branch"),
        F.coalesce(F.nullif("category", F.lit("")),
                   first_group(F.col("_caption"), CAPTION_CATEGORY)).alias("Category"),
        F.coalesce(F.nullif("year", F.lit("")),
                   year_in(F.col("_caption")).cast("string")).try_cast("bigint").alias("Year"),
        F.coalesce(F.nullif("counselling_round", F.lit("")),
                   F.concat(F.lit("Round "), rnd)).alias("Round"),
        F.col("gender").alias("Gender"), F.col("quota").alias("Quota"),
        F.col("opening_rank").alias("OpeningRank"), F.col("closing_rank").alias("ClosingRank"),
        F.col("_pct").alias("CutoffPercentile"), *keep)


_PAGE_KEY = ["Exam", "SourceURL", "Institute", "Branch", "Category", "Year", "OpeningRank",
             "ClosingRank", "CutoffPercentile"]


def found_rows(audit: DataFrame, pages: DataFrame) -> DataFrame:
    """Canonical rows of the pages found, the one step that parses them.

    A page is read only if its URL or title is about the exam; equal rows of a
    page count once.
    """
    found = audit.filter(F.col("found")).select(F.col("exam"), "candidate_url")
    hits = found.join(pages, F.col("candidate_url") == F.col("url"))
    about = is_relevant(F.col("exam"), F.col("url")) \
        | is_relevant(F.col("exam"), page_title(F.col("html")))
    none = F.lit(None).cast("string")
    context = hits.filter(about).select(
        F.concat_ws("|", "exam", "url").alias("page_id"), "url", "html",
        F.lit("cat3").alias("source_competitor"), "exam", F.lit("").alias("exam_slug"),
        F.col("url").alias("page_url"), F.lit("cat3_search").alias("page_type"),
        none.alias("year"), none.alias("pdf_url"))
    raw = raw_rows(html_tables(context, keep=(
        "source_competitor", "exam", "exam_slug", "page_url", "page_type", "year", "pdf_url")))
    order = ["table_index", "row_index", "slot_index"]
    rows = quality_gate(raw, ("page_url", *order)).withColumn("SourceURL", F.col("page_url"))
    return keep_first(rows, _PAGE_KEY, order)


def search_log(audit: DataFrame, rows: DataFrame) -> DataFrame:
    """The audit with the number of rows each exam gave."""
    counted = rows.groupBy(F.col("Exam").alias("_exam")).agg(F.count(F.lit(1)).alias("_n"))
    return audit.join(counted, F.col("exam") == F.col("_exam"), "left") \
        .withColumn("rows_extracted", F.coalesce("_n", F.lit(0))).drop("_exam", "_n")


def fill_missing(audit: DataFrame, pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(client-shaped rows, audit with rows_extracted) for the pages found.

    A job that needs both writes ``found_rows`` once and derives them from it.
    """
    rows = found_rows(audit, pages)
    return project_deliverable(rows), search_log(audit, rows)


def audit_statistics(audit: DataFrame) -> DataFrame:
    return audit.agg(
        F.count(F.lit(1)).alias("exams"), F.count_if("found").alias("found_pages"),
        F.count_if(F.col("rows_extracted") > 0).alias("exams_with_rows"),
        F.coalesce(F.sum("rows_extracted"), F.lit(0)).alias("cutoff_rows"))


# --- union of all layers ----------------------------------------------------------
# Layer -> (label, trust tier).
LAYERS = {
    "official": ("official-adapter", "official"),
    "aggregator": ("competitor-aggregator", "aggregator"),
    "articles": ("mp-aggregator", "aggregator"),
    "web": ("cat3-web-research", "web-research"),
    "search": ("cat3-provenance", "web-research"),
}


def union_export(layers: dict[str, DataFrame]) -> DataFrame:
    """Every layer in one labelled text table; the year as four digits.

    Layers are client-shaped; columns one lacks are null. The tier of a
    web-research row goes to the provenance note.
    """
    parts = []
    for name, df in layers.items():
        source, tier = LAYERS[name]
        note = F.col("Fidelity") if "Fidelity" in df.columns else F.lit(None)
        year = F.col("Year - cutoff").try_cast("double").try_cast("bigint").cast("string")
        labelled = df.select(
            F.lit(source).alias("Source"), F.lit(tier).alias("Fidelity"),
            note.cast("string").alias("Provenance Note"),
            *[(year if c == "Year - cutoff" else F.col(f"`{c}`").cast("string")).alias(c)
              for c in df.columns if c in UNION_COLUMNS[3:]])
        parts.append(labelled)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    for c in UNION_COLUMNS:
        if c not in out.columns:
            out = out.withColumn(c, F.lit(None).cast("string"))
    return out.select(*UNION_COLUMNS)


# Layers by trust.
COVERAGE_LAYERS = ["official", "aggregator", "web-research"]


def exam_coverage(official: DataFrame, aggregator: DataFrame, web: DataFrame) -> DataFrame:
    """(exam, layer): the most trusted layer that has the exam; each layer is read once."""
    layers = [(official, "Exam"), (aggregator, "Exam Name"), (web, "Exam Name")]
    tagged = [df.select(F.col(c).alias("exam"), F.lit(k).alias("_layer"))
              for k, (df, c) in enumerate(layers)]
    return tagged[0].unionByName(tagged[1]).unionByName(tagged[2]) \
        .filter(F.col("exam").isNotNull()).groupBy("exam").agg(F.min("_layer").alias("_layer")) \
        .select("exam", F.element_at(F.array(*map(F.lit, COVERAGE_LAYERS)), F.col("_layer") + 1)
                .alias("layer"))
