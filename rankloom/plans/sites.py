"""Third-party sites: cutoff-page URLs, stored pages, raw rows.

Fetching is not part of this: pages come as a table (url, html).
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.functions.embedded import initial_state
from rankloom.functions.text import first_group, strip
from rankloom.functions.urls import origin, path, pdf_links, with_candidate_slugs
from rankloom.operators.htmltables import html_tables
from rankloom.operators.rawrows import raw_rows
from rankloom.session import spread

SITES = ["collegedunia", "shiksha", "careers360", "collegedekho"]
# Page addresses of each site.
_BASE = {"collegedunia": "https://collegedunia.com", "shiksha": "https://www.shiksha.com",
         "careers360": "https://www.careers360.com",
         "collegedekho": "https://www.collegedekho.com"}
_SLUG = {"collegedunia": (r"^/exams/([^/?#]+)", 1), "collegedekho": (r"^/exam/([^/?#]+)", 1),
         "careers360": (r"^/(?:exams|articles)/([^/?#]+)", 1),
         "shiksha": (r"^/([^/]+)/(.+?)-exam(?:-cutoff)?/?$", 2)}
_STREAMS = ["engineering", "medicine", "science", "management", "law"]
_PAGE_TYPE = {"careers360": "article"}


def recent_years(today: date | None = None) -> list[int]:
    """The last four completed years, latest first."""
    year = (today or date.today()).year
    return list(range(year - 1, year - 5, -1))


def exam_slug(site: str, url: Column) -> Column:
    """Slug in a site link's path, null for search and landing links."""
    pattern, group = _SLUG[site]
    slug = first_group(path(url), pattern, group)
    return F.regexp_replace(slug, "-cut-?off$", "") if site == "careers360" else slug


def with_cutoff_urls(df: DataFrame, site: str, years: list[int] | None = None) -> DataFrame:
    """Add ``urls``: array<struct(slug, year, url)> of the pages to look for, in order.

    ``df`` holds exam and site_url. ``year`` is null for the current page, and
    set for a yearly archive. A link without a slug gives guessed ones.
    """
    url = F.col("site_url")
    years = recent_years() if years is None else years
    guessed = with_candidate_slugs(spread(df), url, F.col("exam"), "_guesses",
                                   2 if site == "shiksha" else 4)
    known = guessed.withColumns({
        "_base": origin(url, _BASE[site]), "_own": exam_slug(site, url),
        "_stream": first_group(path(url), _SLUG[site][0], 1)})

    def page(tail: str, year: str = "cast(null as string)") -> str:
        return f"named_struct('slug', s, 'year', {year}, 'url', concat(_base, {tail}))"

    if site == "collegedunia":
        pages = f"array({page("'/exams/', s, '/cutoff'")})"
    elif site == "collegedekho":
        archives = [page(f"'/exam/', s, '/cutoff-{y}-esp'", f"'{y}'") for y in years]
        pages = f"array({', '.join([page("'/exam/', s, '/cutoff'"), *archives])})"
    elif site == "careers360":
        pages = f"array({page("'/articles/', s, '-cutoff'")}, {page("'/articles/', s, '-cut-off'")})"
    else:
        streams = ", ".join(f"'{s}'" for s in _STREAMS)
        pages = f"transform(if(_stream is null, array({streams}), array(_stream)), " \
                f"t -> {page("'/', t, '/', s, '-exam-cutoff'")})"
    slugs = "if(_own is null, _guesses, array(_own))"
    return known.withColumn("urls", F.expr(
        f"array_distinct(flatten(transform({slugs}, s -> {pages})))")) \
        .drop("_guesses", "_base", "_own", "_stream")


# Scope of a run -> partition categories (None is every exam).
SCOPES = {"links": None, "cat2": ["cat2"], "cat1": ["cat1"], "all": ["cat1", "cat2"]}


def targets(segments: DataFrame, site: str, scope: str = "links",
            limit: int | None = None) -> DataFrame:
    """(exam, site_url) of the exams in scope that have a link to the site."""
    categories = SCOPES[scope]
    rows = segments if categories is None \
        else segments.filter(F.col("category").isin(categories))
    out = rows.select("exam", strip(F.coalesce(site, F.lit(""))).alias("site_url")) \
        .filter(F.col("site_url") != "")
    return out.orderBy("exam").limit(limit) if limit else out


def site_candidates(site: str, wanted: DataFrame, years: list[int] | None = None) -> DataFrame:
    """One row per page to look for: exam, position, slug, year, page_url, derived."""
    own = exam_slug(site, F.col("site_url"))
    return with_cutoff_urls(wanted, site, years).select(
        "exam", own.isNull().alias("derived"), F.coalesce(own, F.lit("")).alias("_own_slug"),
        # the outer form: the inner one makes Spark test the array in a filter, and
        # pushing that filter down would inline every step that built it
        F.posexplode_outer("urls").alias("position", "_u")) \
        .filter(F.col("position").isNotNull()) \
        .select("exam", "derived", "_own_slug", "position", F.col("_u.slug").alias("slug"),
                F.col("_u.year").alias("year"), F.col("_u.url").alias("page_url"))


def rows_of_sites(wanted: dict[str, DataFrame], pages: DataFrame,
                  years: list[int] | None = None) -> DataFrame:
    """Raw rows of the stored pages of all sites in ``wanted``; pages are read once.

    Site habits: one site shows the same article under two addresses, so the
    first with rows counts; another has yearly archives, looked at for a guessed
    slug only if its current page exists.
    """
    candidates = None
    for name, exams in wanted.items():
        part = site_candidates(name, exams, years).withColumn("site", F.lit(name))
        candidates = part if candidates is None else candidates.unionByName(part)
    stored = pages.filter(F.coalesce("html", F.lit("")) != "").select("url", "html")
    # Spark takes every text for 20 bytes, so it would send stored pages whole through the driver
    hits = candidates.join(stored.hint("merge"), candidates.page_url == stored.url)
    archived, doubled = F.col("site") == "collegedekho", F.col("site") == "careers360"
    if "collegedekho" in wanted:
        # the few pages of one exam and slug
        current = F.max(F.col("year").isNull()).over(Window.partitionBy("site", "exam", "slug"))
        hits = hits.withColumn("_current", current) \
            .filter(~archived | ~F.col("derived") | F.col("_current"))
    hits = hits.withColumn("slug", F.when(archived, F.col("slug"))
                           .otherwise(F.col("_own_slug")))
    if "careers360" in wanted:
        article = initial_state(F.when(doubled, F.col("html")))["article"]
        hits = hits.withColumn("html", F.coalesce(article, F.col("html")))
    kinds = F.create_map(*[F.lit(x) for name in wanted
                           for x in (name, _PAGE_TYPE.get(name, "exam_cutoff"))])
    context = hits.select(
        F.concat_ws("|", "site", "exam", F.col("position").cast("string")).alias("page_id"),
        "url", "html", F.col("site").alias("source_competitor"), "exam",
        F.col("slug").alias("exam_slug"), "page_url", kinds[F.col("site")].alias("page_type"),
        "year", F.get(pdf_links(F.col("html"), F.col("page_url")), F.lit(0)).alias("pdf_url"),
        "position")
    rows = raw_rows(html_tables(context, keep=(
        "source_competitor", "exam", "exam_slug", "page_url", "page_type", "year", "pdf_url",
        "position")), keep=("position",))
    if "careers360" in wanted:
        first = F.min("position").over(Window.partitionBy("source_competitor", "exam"))
        rows = rows.withColumn("_first", first).filter(
            (F.col("source_competitor") != "careers360")
            | (F.col("position") == F.col("_first"))).drop("_first")
    return rows.drop("position")


def site_rows(site: str, wanted: DataFrame, pages: DataFrame,
              years: list[int] | None = None) -> DataFrame:
    """Raw rows of one site's stored pages for the wanted exams."""
    return rows_of_sites({site: wanted}, pages, years)


def run_statistics(site: str, wanted: DataFrame, rows: DataFrame) -> DataFrame:
    """One row: exams attempted, resolved to a URL, with rows, and rows."""
    tried = with_cutoff_urls(wanted, site).agg(
        F.count(F.lit(1)).alias("exams_attempted"),
        F.count_if(F.size("urls") > 0).alias("exams_url_resolved"))
    got = rows.groupBy("exam").agg(F.count(F.lit(1)).alias("n")).agg(F.struct(
        F.count(F.lit(1)).alias("exams_with_rows"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows")).alias("got"))
    # each side is one row
    return tried.withColumn("got", got.scalar()).select(
        F.lit(site).alias("competitor"), "exams_attempted", "exams_url_resolved",
        "got.exams_with_rows", "got.rows")
