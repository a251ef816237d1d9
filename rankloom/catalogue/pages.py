"""Stored pages, links and fetch logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.catalogue.bridge import table
from rankloom.catalogue.registry import query
from rankloom.functions.classify import page_bucket
from rankloom.functions.embedded import initial_state, next_data, unescape
from rankloom.functions.numbers import round_options, year_in
from rankloom.functions.relevance import (
    build_query, count_tables, exam_from_query, is_relevant, looks_like_cutoff, page_title,
    relax_query,
)
from rankloom.functions.urls import (
    has_depth, host, is_aggregator, is_public_url, is_url, pdf_links, plain_links,
    redirect_links, report_links, search_term,
)
from rankloom.operators.htmltables import html_tables
from rankloom.operators.mapping import map_tables
from rankloom.operators.rawrows import raw_rows
from rankloom.plans import bulk, links, side, sites
from rankloom.session import shared_folder

_ITEM_SQL = """i AS (SELECT *, 'College ' || l_suppkey || ' of Arts' AS inst,
  'Branch ' || l_partkey AS branch, CAST(floor(l_extendedprice) AS BIGINT) AS hi,
  CAST(floor(l_extendedprice / 10) AS BIGINT) AS lo,
  l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS page_id
  FROM lineitem)"""

# One page per line item: heading, a rank table with its own caption, a second
# table without, and a table of notices.
_PAGE_HTML = """concat(
  '<html><body><h2>Heading &amp; more</h2><table><caption>', inst, ' Cut Off</caption>',
  '<thead><tr><th>Institute</th><th>Branch</th><th colspan=2>Closing Rank</th></tr></thead>',
  '<tr><td>', inst, '</td><td> ', branch, '<br></td><td>', format_number(cast(hi as bigint), 0),
  '<td>x</tr></table><table><tr><th>Notice</th><th>Date</th></tr><tr><td>n</td><td>1</td></tr>',
  '</table><p>tail</p><table><tr><td>loose</td><td>', lo, '</td></tr></table></body>')"""


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem", heavy=True).withColumns({
        "inst": F.expr("concat('College ', cast(l_suppkey as string), ' of Arts')"),
        "branch": F.expr("concat('Branch ', cast(l_partkey as string))"),
        "hi": F.expr("cast(cast(floor(l_extendedprice) as bigint) as string)"),
        "lo": F.expr("cast(cast(floor(l_extendedprice / 10) as bigint) as string)")})


def _rendered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _items(spark, sf_dir).selectExpr(
        "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) as page_id",
        "concat('https://x.org/', cast(l_orderkey as string), '/p.html') as url",
        f"{_PAGE_HTML} as html", "'html' as kind")


@query("html_tables", f"""
  WITH {_ITEM_SQL} SELECT page_id, CAST(k AS INT) AS table_idx,
    CASE k WHEN 0 THEN inst || ' Cut Off' ELSE 'Heading & more' END AS caption,
    CASE k WHEN 0 THEN 'Institute|Branch|Closing Rank|Closing Rank' WHEN 1 THEN 'Notice|Date'
      ELSE '0|1' END AS header,
    CASE k WHEN 0 THEN inst || '|' || branch || '|' || format('{{:,}}', hi) || '|x'
      WHEN 1 THEN 'n|1' ELSE 'loose|' || lo END AS cells
  FROM i, (VALUES (0), (1), (2)) t(k)""")
def tables_of_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = html_tables(_rendered(spark, sf_dir))
    return tables.select("page_id", "table_idx", "caption",
                         F.array_join("header", "|").alias("header"),
                         F.explode("rows").alias("r")) \
        .select("page_id", "table_idx", "caption", "header", F.array_join("r", "|").alias("cells"))


# The same tables as people write them, four kinds in turn: no end tags and capital
# letters; tables broken off, with text between the cells; spans and hidden rows;
# scripts, comments and entities without their semicolon.
_ROUGH_HTML = """case l_linenumber % 4
  when 0 then concat('<H2>Cut <I>off</I> &amp lists<TABLE border=1 class=wide><TR><TH>Institute<TH>',
    'Branch<TH>Closing Rank<TR bgcolor=red><TD>', inst, '<TD nowrap>', branch, '<BR>first<TD align=right>',
    hi, '</TABLE>')
  when 1 then concat('<h3>Round <b>1</b></h3><table>lost<tr><td>', inst, '</td>stray<td>', branch,
    '</td></p>more<td>', hi, '</td></tr>between<tr><td>', inst, '<td>', branch, '<td>', lo)
  when 2 then concat('<table><caption>Ranks<thead><tr><th>Institute<th colspan="2">Of seats</thead>',
    '<tbody><tr style="display: none"><td>no<td>no<td>no<tr><td rowspan=2>', inst, '<td>', branch, '<td>', hi,
    '<tr><td style="DISPLAY:none">x</td><td>other<td>', lo, '<td>over</tbody></table><p>tail')
  else concat('<script>var t = "<table><tr><td>no</td></tr></table>";</script><!-- <table><tr><td>',
    'c</td></tr></table> --><h1>A&nbsp;&lt;b&gt;</h1><table summary=x><tr><th>In&shy;stitute</th><th>Rank</th></tr>',
    '<tr><td>', inst, ' &amp Co</td><td>&#', 48 + l_linenumber, ';', hi, '</td></tr><tr></tr></table>') end"""


@query("html_rough", f"""
  WITH {_ITEM_SQL}, k AS (SELECT *, l_linenumber % 4 AS k FROM i)
  SELECT page_id, 'Cut off & lists' AS caption, 'Institute|Branch|Closing Rank' AS header, 0 AS row_idx,
    inst || '|' || branch || ' first|' || hi AS cells FROM k WHERE k = 0
  UNION ALL SELECT page_id, 'Round 1', '0|1|2', 0, inst || '|' || branch || '|' || hi FROM k WHERE k = 1
  UNION ALL SELECT page_id, 'Round 1', '0|1|2', 1, inst || '|' || branch || '|' || lo FROM k WHERE k = 1
  UNION ALL SELECT page_id, 'Ranks', 'Institute|Of seats|Of seats|', 0,
    inst || '|' || branch || '|' || hi || '|' FROM k WHERE k = 2
  UNION ALL SELECT page_id, 'Ranks', 'Institute|Of seats|Of seats|', 1, inst || '|other|' || lo || '|over'
    FROM k WHERE k = 2
  UNION ALL SELECT page_id, 'A <b>', 'In' || chr(173) || 'stitute|Rank', 0,
    inst || ' & Co|' || l_linenumber || hi FROM k WHERE k = 3""")
def html_rough(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables of pages with implied end tags, stray text, spans and hidden elements."""
    pages = _items(spark, sf_dir).selectExpr(
        "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) as page_id",
        "'https://x.org/' as url", f"{_ROUGH_HTML} as html")
    return html_tables(pages).select(
        "page_id", "caption", F.array_join("header", "|").alias("header"),
        F.posexplode("rows").alias("row_idx", "r")).select(
        "page_id", "caption", "header", "row_idx", F.array_join("r", "|").alias("cells"))


@query("html_to_canonical", f"""
  WITH {_ITEM_SQL} SELECT 'Exam X' AS "Exam", inst AS "Institute", branch AS "Branch",
    hi AS "ClosingRank", 'https://x.org/' || l_orderkey || '/p.html' AS "SourceURL" FROM i""")
def html_to_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = html_tables(_rendered(spark, sf_dir))
    out = map_tables(tables, {"Exam": F.lit("Exam X")}, keep=("url",))
    return out.select("Exam", "Institute", "Branch", "ClosingRank", F.col("url").alias("SourceURL"))


@query("harvest", f"""
  WITH {_ITEM_SQL} SELECT page_id AS "Exam", 'https://x.org/' || l_orderkey || '/p.html' AS url,
    'html' AS kind, count(*) OVER (PARTITION BY l_orderkey) AS rows,
    c AS colleges
  FROM i JOIN (SELECT l_orderkey AS k, count(DISTINCT inst) AS c FROM i GROUP BY 1)
    ON k = l_orderkey""")
def harvest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored responses to rows, and the per-source report over them."""
    none = F.lit(None).cast("string")
    pages = _rendered(spark, sf_dir).withColumns({
        "exam": F.col("page_id"), "body": none, "level": F.lit("UG"), "state": none,
        "website": F.lit("https://x.org/")})
    rows = bulk.parse_stored(pages)
    return bulk.harvest_report(pages, rows)


@query("routed_parse", f"""
  WITH {_ITEM_SQL} SELECT page_id AS "Exam", 'Board' AS "Body", inst AS "Institute",
    hi AS "ClosingRank", 'https://x.org/' || l_orderkey || '/p.html' AS "SourceURL",
    'https://x.org/' AS "Website" FROM i WHERE l_orderkey % 4 < 2
  UNION ALL SELECT page_id, 'Board', branch, lo, 'https://x.org/' || l_orderkey || '/p.html',
    'https://x.org/' FROM i WHERE l_orderkey % 4 = 2""")
def routed_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The probe bucket picks the reader: page tables, extracted grids, or nothing."""
    none = F.lit(None).cast("string")
    pages = _rendered(spark, sf_dir).drop("kind").withColumns({
        "exam": F.col("page_id"), "body": F.lit("Board"), "level": F.lit("UG"), "state": none,
        "website": F.lit("https://x.org/")})
    buckets = table(spark, sf_dir, "lineitem").select("l_orderkey").distinct().selectExpr(
        "concat('https://x.org/', l_orderkey, '/p.html') as url",
        "element_at(array('html_table_rank', 'js_only', 'pdf_multipage', 'http_404'), "
        "cast(l_orderkey % 4 + 1 as int)) as bucket")
    grid = table(spark, sf_dir, "lineitem").selectExpr(
        "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) as doc_id", "0 as page",
        "0 as table_idx", "inline(array(named_struct('row_idx', 0, 'cells', "
        "array('Institute', 'Closing Rank')), named_struct('row_idx', 1, 'cells', array("
        "concat('Branch ', l_partkey), "
        "cast(cast(floor(l_extendedprice / 10) as bigint) as string)))))")
    rows = bulk.routed_parse(pages, buckets, grid)
    return rows.select("Exam", "Body", "Institute", "ClosingRank", "SourceURL", "Website")


@query("content_kinds", """
  SELECT doc_id, CASE lang WHEN 'en' THEN 'pdf' WHEN 'fr' THEN 'pdf'
    WHEN 'de' THEN NULL ELSE 'html' END AS kind FROM documents""")
def content_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored bytes by their kind: by header, by signature, or nothing fetched."""
    from rankloom.sources.files import content_kind

    stored = table(spark, sf_dir, "documents").selectExpr(
        "doc_id", "if(lang = 'en', 'Application/PDF; x', 'text/plain') as ctype",
        "cast(case lang when 'fr' then concat('%PDF-1.7', text) when 'de' then '' "
        "else text end as binary) as content")
    return stored.select("doc_id", content_kind(F.col("ctype"), F.col("content")).alias("kind"))


@query("site_page_rows", f"""
  WITH {_ITEM_SQL} SELECT page_id AS exam, CAST(k AS INT) AS table_index,
    CASE k WHEN 0 THEN inst ELSE 'Heading & more' END AS institute_name,
    CASE k WHEN 0 THEN branch ELSE '' END AS branch_or_course,
    CASE k WHEN 0 THEN hi END AS closing_rank
  FROM i, (VALUES (0), (1), (2)) t(k)""")
def site_page_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every table of a third-party page as raw rows, noise included."""
    none = F.lit(None).cast("string")
    pages = _rendered(spark, sf_dir).withColumns({
        "source_competitor": F.lit("site"), "exam": F.col("page_id"), "exam_slug": F.lit(""),
        "page_url": F.col("url"), "page_type": F.lit("exam_cutoff"), "year": none,
        "pdf_url": none})
    rows = raw_rows(html_tables(pages, keep=(
        "source_competitor", "exam", "exam_slug", "page_url", "page_type", "year", "pdf_url")))
    return rows.select("exam", "table_index", "institute_name", "branch_or_course",
                       "closing_rank")


# --- page classification -----------------------------------------------------------
_RANK_RE = "(?i)opening rank|closing rank|cut\\s*off|cutoff|last rank|rank|merit"


@query("page_buckets", f"""
  WITH p AS (SELECT page_id, CASE WHEN page_id % 3 = 0
      THEN html || '<TABLE><tr><td>Merit</td></tr></table>' ELSE html END AS t,
    CASE WHEN page_id % 7 = 0 THEN 404 ELSE 200 END AS st,
    CASE WHEN page_id % 5 = 0 THEN 'application/PDF' WHEN page_id % 5 = 1 THEN NULL
      ELSE 'text/html' END AS ct,
    CASE WHEN page_id % 11 = 0 THEN 'timeout' ELSE '' END AS er FROM pages),
  c AS (SELECT *, len(regexp_extract_all(t, '(?i)<table')) AS nt,
    len(regexp_extract_all(t, '(?i)<script')) AS ns, len(regexp_extract_all(t, '{_RANK_RE}')) AS nr,
    len(list_filter(string_split_regex(regexp_replace(t, '<[^>]+>', ' ', 'g'), '\\s+'),
      lambda w: w <> '')) AS nw FROM p),
  e AS (SELECT *, CASE WHEN er <> '' THEN 'error' WHEN st >= 400 THEN 'http_' || st
    WHEN contains(lower(ct), 'pdf') THEN 'pdf'
    WHEN ct IS NULL AND NOT contains(lower(t), '<html') THEN 'non_html' END AS early FROM c)
  SELECT page_id, coalesce(early, CASE WHEN nt >= 1 AND nr >= 1 THEN 'html_table_rank'
      WHEN nt >= 1 THEN 'html_table_norank' WHEN nw < 250 AND ns >= 3 THEN 'js_only'
      WHEN nr >= 1 THEN 'html_rank_notable' ELSE 'html_other' END) AS bucket,
    CASE WHEN early IS NULL THEN nt ELSE 0 END AS n_tables,
    CASE WHEN early IS NULL THEN nr ELSE 0 END AS rank_headers,
    CASE WHEN early IS NULL THEN nw ELSE 0 END AS text_len,
    CASE WHEN early IS NULL THEN ns ELSE 0 END AS n_scripts FROM e""")
def page_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").selectExpr(
        "page_id", "if(page_id % 3 = 0, concat(html, '<TABLE><tr><td>Merit</td></tr></table>'), "
        "html) as html", "if(page_id % 7 = 0, 404, 200) as status",
        "case when page_id % 5 = 0 then 'application/PDF' when page_id % 5 = 1 then null "
        "else 'text/html' end as ctype", "if(page_id % 11 = 0, 'timeout', '') as err")
    found = pages.select("page_id", page_bucket(
        F.col("status"), F.col("ctype"), F.col("html"), F.col("err")).alias("b"))
    return found.select("page_id", "b.*")


@query("cutoff_like_pages", """
  SELECT page_id, CAST(CASE WHEN page_id % 3 = 0 THEN 2 ELSE 0 END
      + len(regexp_extract_all(html, '(?i)<table')) AS BIGINT) AS n_tables,
    page_id % 3 = 0 AS looks FROM pages""")
def cutoff_like_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    html = F.expr("if(page_id % 3 = 0, concat(html, '<table><TABLE>Merit\\nList'), html)")
    return table(spark, sf_dir, "pages").select(
        "page_id", count_tables(html).cast("bigint").alias("n_tables"),
        looks_like_cutoff(html).alias("looks"))


_HOST_WORD = "^https?://(?:[a-z]+\\.)?([a-z]+)\\.example"


@query("page_relevance", f"""
  WITH p AS (SELECT page_id, url, html, 'National University of ' ||
      regexp_extract(url, '{_HOST_WORD}', 1) || ' and ' || regexp_extract(html, 'lang="([a-z]+)', 1)
      || ' Test' AS exam FROM pages),
  t AS (SELECT *, list_filter(regexp_extract_all(lower(exam), '[a-z0-9]+'), lambda w:
      length(w) >= 3 AND w NOT IN ('national', 'university', 'and', 'test', 'the', 'for')) AS toks,
    regexp_replace(lower(url), '[^a-z0-9]+', ' ', 'g') AS u,
    regexp_replace(lower(regexp_extract(html, '(?s)<title>(.*?)</title>', 1)), '[^a-z0-9]+', ' ',
      'g') AS ti FROM p)
  SELECT page_id, exam, CAST(len(toks) AS INT) AS n_tokens,
    len(toks) > 0 AND len(list_filter(toks, lambda w: contains(u, w))) >= least(2, len(toks))
      AS by_url,
    len(toks) > 0 AND len(list_filter(toks, lambda w: contains(ti, w))) >= least(2, len(toks))
      AS by_title FROM t""")
def page_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rankloom.functions.relevance import exam_tokens

    pages = table(spark, sf_dir, "pages").withColumn("exam", F.concat(
        F.lit("National University of "), F.regexp_extract("url", _HOST_WORD, 1),
        F.lit(" and "), F.regexp_extract("html", 'lang="([a-z]+)', 1), F.lit(" Test")))
    return pages.select(
        "page_id", "exam", F.size(exam_tokens(F.col("exam"))).alias("n_tokens"),
        is_relevant(F.col("exam"), F.col("url")).alias("by_url"),
        is_relevant(F.col("exam"), page_title(F.col("html"))).alias("by_title"))


@query("rank_urls", """
  WITH c AS (SELECT regexp_extract(html, 'lang="([a-z]+)', 1) || ' example' AS exam,
      page_id * 2 + k AS position, CASE page_id % 6 WHEN 0 THEN url || '/Cutoff'
        WHEN 1 THEN 'https://www.shiksha.com/example/' || page_id
        WHEN 2 THEN 'https://en.wikipedia.org/' || page_id
        WHEN 3 THEN url || CASE k WHEN 0 THEN '' ELSE '?again=1' END ELSE url END AS url
    FROM pages, (VALUES (0), (1)) t(k)),
  d AS (SELECT *, rtrim(string_split(url, '?')[1], '/') AS key FROM c
    WHERE NOT contains(url, 'wikipedia')),
  f AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY exam, key ORDER BY position) = 1),
  s AS (SELECT *, CASE WHEN contains(regexp_replace(lower(url), '[^a-z0-9]+', ' ', 'g'), 'example')
      AND true THEN 0 ELSE 1 END AS r FROM f)
  SELECT exam, row_number() OVER (PARTITION BY exam ORDER BY r,
      CASE WHEN contains(lower(url), 'cutoff') THEN 0 ELSE 1 END,
      CASE WHEN contains(url, 'shiksha.com') THEN 0 ELSE 1 END, position) AS position, url
  FROM s QUALIFY row_number() OVER (PARTITION BY exam ORDER BY r,
      CASE WHEN contains(lower(url), 'cutoff') THEN 0 ELSE 1 END,
      CASE WHEN contains(url, 'shiksha.com') THEN 0 ELSE 1 END, position) <= 5""")
def rank_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    url = """case page_id % 6 when 0 then concat(url, '/Cutoff')
      when 1 then concat('https://www.shiksha.com/example/', cast(page_id as string))
      when 2 then concat('https://en.wikipedia.org/', cast(page_id as string))
      when 3 then concat(url, if(k = 0, '', '?again=1')) else url end as url"""
    found = pages.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("k")).selectExpr(
        "concat(regexp_extract(html, 'lang=\"([a-z]+)', 1), ' example') as exam",
        "page_id * 2 + k as position", url)
    return side.rank_candidates(found).withColumn("position", F.col("position").cast("bigint"))


@query("search_texts", """
  SELECT page_id, '"Exam ' || page_id || '" cutoff OR "merit list" rank 2024' AS query,
    'Exam ' || page_id || ' cutoff rank 2024 college closing rank' AS relaxed,
    'Exam ' || page_id AS exam FROM pages""")
def search_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    exam = F.concat(F.lit(" Exam "), F.col("page_id").cast("string"))
    text = build_query(exam, 2024)
    return table(spark, sf_dir, "pages").select(
        "page_id", text.alias("query"), relax_query(text).alias("relaxed"),
        exam_from_query(text).alias("exam"))


# --- links ---------------------------------------------------------------------------
@query("url_audit", r"""
  WITH u AS (SELECT page_id, CASE page_id % 9 WHEN 0 THEN 'no link yet'
      WHEN 1 THEN 'https://10.0.0.' || page_id % 200 || '/x' WHEN 2 THEN 'HTTP://LocalHost:80/'
      WHEN 3 THEN 'https://www.shiksha.com?q=Civil+Eng%20' || page_id
      WHEN 4 THEN 'https://8.8.8.8:443' WHEN 5 THEN 'ftp://x.org/a' ELSE url END AS url FROM pages)
  SELECT page_id, regexp_matches(url, '(?i)^https?://[^/?#]+') AS is_url,
    lower(regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)', 1)) AS host,
    page_id % 9 = 3 AS aggregator,
    CASE page_id % 9 WHEN 0 THEN true WHEN 1 THEN true WHEN 2 THEN false WHEN 3 THEN true
      WHEN 4 THEN false WHEN 5 THEN true ELSE regexp_matches(url, '^https?://[^/?#]+(/[^?#]+|[^#]*\?)')
      END AS depth,
    CASE WHEN page_id % 9 = 3 THEN 'Civil Eng ' || page_id END AS term,
    page_id % 9 NOT IN (0, 1, 2, 5) AS public FROM u""")
def url_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.expr("""case page_id % 9 when 0 then 'no link yet'
      when 1 then concat('https://10.0.0.', cast(page_id % 200 as string), '/x')
      when 2 then 'HTTP://LocalHost:80/'
      when 3 then concat('https://www.shiksha.com?q=Civil+Eng%20', cast(page_id as string))
      when 4 then 'https://8.8.8.8:443' when 5 then 'ftp://x.org/a' else url end""")
    links_ = table(spark, sf_dir, "pages").select("page_id", url.alias("url"))
    u = F.col("url")
    return links_.select("page_id", is_url(u).alias("is_url"), host(u).alias("host"),
                         is_aggregator(u).alias("aggregator"), has_depth(u).alias("depth"),
                         search_term(u).alias("term"), is_public_url(u).alias("public"))


@query("page_links", r"""
  SELECT page_id, 'pdf' AS kind, regexp_extract(url, '^https?://[^/?#]+') || '/f/' || page_id
      || '.pdf' AS link FROM pages
  UNION ALL SELECT page_id, 'pdf', regexp_replace(regexp_extract(url, '^[^?#]*'), '[^/]*$', '')
      || 'rel/x.PDF?y=1' FROM pages
  UNION ALL SELECT page_id, 'report', 'https://up.in/orcrreport?enc=' || page_id || '&z=1' FROM pages
  UNION ALL SELECT page_id, 'plain', 'https://up.in/orcrreport?enc=' || page_id || '&amp;z=1'
    FROM pages
  UNION ALL SELECT page_id, 'redirect', 'https://a.org/?x=1+2' FROM pages
  UNION ALL SELECT page_id, 'plain', unnest(list_filter(
    regexp_extract_all(html, 'href="(https?://[^"]+)"', 1), lambda h: true)) FROM pages""")
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").withColumn("html", F.expr(
        "concat(html, '<a href=''/f/', cast(page_id as string), '.pdf''>a</a>"
        "<a href=\"rel/x.PDF?y=1\">b</a><a href=\"rel/x.PDF?y=1\">b</a>"
        "<a href=\"https://up.in/orcrreport?enc=', cast(page_id as string), '&amp;z=1\">c</a>"
        "<a href=\"/l?uddg=https%3A%2F%2Fa.org%2F%3Fx%3D1+2&rut=1\">d</a>')"))
    h = F.col("html")
    kinds = F.map_from_arrays(
        F.array(*map(F.lit, ("pdf", "report", "redirect", "plain"))),
        F.array(pdf_links(h, F.col("url")), report_links(h), redirect_links(h), plain_links(h)))
    return pages.select("page_id", F.explode(kinds).alias("kind", "links")) \
        .select("page_id", "kind", F.explode("links").alias("link"))


def _link_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    pages = table(spark, sf_dir, "pages")
    existing = pages.selectExpr(
        "concat('E', cast(page_id as string)) as exam",
        "regexp_extract(url, '^https?://[^/?#]+', 0) as homepage",
        "if(page_id % 4 = 0, '', url) as cutoff", "'' as acronym")
    records = pages.filter("url like 'https%'").selectExpr(
        "concat('E', cast(page_id as string)) as exam", "'https://www.shiksha.com/' as homepage",
        "concat('https://new.org/', if(page_id % 2 = 0, '', cast(page_id as string))) as cutoff",
        "concat('A', cast(page_id as string)) as acronym")
    status = pages.selectExpr(
        "url", "case page_id % 5 when 0 then 404 when 1 then 403 else 200 end as status") \
        .unionByName(pages.filter("url like 'https%'").selectExpr(
            "concat('https://new.org/', cast(page_id as string)) as url",
            "if(page_id % 7 = 0, 500, 200) as status")) \
        .unionByName(pages.selectExpr("regexp_extract(url, '^https?://[^/?#]+', 0) as url")
                     .distinct().withColumn("status", F.lit(200))) \
        .groupBy("url").agg(F.max("status").alias("status"))
    return existing, records, status


@query("link_choice", r"""
  WITH p AS (SELECT *, regexp_extract(url, '^https?://[^/?#]+') AS home,
      'https://new.org/' || page_id AS newurl FROM pages),
  st AS (SELECT u, max(s) AS s FROM (
    SELECT url AS u, CASE page_id % 5 WHEN 0 THEN 404 WHEN 1 THEN 403 ELSE 200 END AS s FROM p
    UNION ALL SELECT newurl, CASE WHEN page_id % 7 = 0 THEN 500 ELSE 200 END FROM p
      WHERE url LIKE 'https%'
    UNION ALL SELECT home, 200 FROM p) GROUP BY 1),
  g AS (SELECT u FROM st WHERE s < 400 OR s IN (401, 403, 406, 409, 429, 451, 503))
  SELECT 'E' || page_id AS exam, CASE WHEN home IN (SELECT u FROM g) THEN home ELSE '' END
      AS homepage,
    CASE WHEN url LIKE 'https%' AND page_id % 2 <> 0 AND newurl IN (SELECT u FROM g) THEN newurl
      WHEN page_id % 4 <> 0 AND url IN (SELECT u FROM g) THEN url ELSE '' END AS cutoff,
    CASE WHEN url LIKE 'https%' THEN 'A' || page_id ELSE '' END AS acronym FROM p""")
def link_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deepest reachable cutoff page, first reachable homepage."""
    return links.choose_deep_links(*_link_tables(spark, sf_dir))


@query("link_probe", r"""
  SELECT 'E' || page_id AS "Exam", url AS "Homepage",
    CASE WHEN page_id % 5 IN (0, 1) THEN 'dead' ELSE 'official' END AS home_kind,
    page_id % 5 NOT IN (0, 1) AS home_show,
    CASE page_id % 3 WHEN 0 THEN 'none' WHEN 1 THEN 'aggregator' ELSE 'dead' END AS cutoff_kind,
    false AS cutoff_show FROM pages""")
def link_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    catalog = pages.selectExpr(
        "concat('E', cast(page_id as string)) as Exam", "'' as Body", "url as Homepage",
        "case page_id % 3 when 0 then 'ask the board' when 1 then "
        "'https://news.careers360.com/x' else 'http://gone.org' end as CutoffURL")
    status = pages.selectExpr("url", "page_id % 5 not in (0, 1) as ok")
    return links.probe_links(catalog, status).drop("Body", "CutoffURL")


@query("link_choice_first", r"""
  SELECT 'E' || page_id AS exam, CASE WHEN page_id % 5 NOT IN (0, 1) THEN url
      WHEN url LIKE 'https%' THEN 'https://res.org/' || page_id ELSE '' END AS homepage,
    CASE WHEN url LIKE 'https%' THEN 'https://res.org/c' ELSE '' END AS cutoff,
    CASE WHEN url LIKE 'https%' THEN 'A' ELSE '' END AS acronym FROM pages""")
def link_choice_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The original link if it shows, else a researched one that is live."""
    pages = table(spark, sf_dir, "pages")
    probed = pages.selectExpr(
        "concat('E', cast(page_id as string)) as Exam", "url as Homepage",
        "page_id % 5 not in (0, 1) as home_show", "'' as CutoffURL", "false as cutoff_show")
    records = pages.filter("url like 'https%'").selectExpr(
        "concat('E', cast(page_id as string)) as exam",
        "concat('https://res.org/', cast(page_id as string)) as homepage",
        "'https://res.org/c' as cutoff", "'A' as acronym")
    live = records.selectExpr("homepage as url").unionByName(
        records.selectExpr("cutoff as url")).distinct().withColumn("ok", F.lit(True))
    return links.choose_links(probed, records, live)


# --- sites ---------------------------------------------------------------------------
@query("url_candidates", """
  WITH p AS (SELECT p_partkey, 'All India ' || p_name || ' Entrance Test' AS exam,
      p_name || ' zürich' AS term, replace(p_name, ' ', '-') || '-zurich' AS s1,
      'all-india-' || replace(p_name, ' ', '-') || '-entrance-test' AS s2,
      p_name[1] || string_split(p_name, ' ')[2][1] || 'z' AS a1,
      'ai' || p_name[1] || string_split(p_name, ' ')[2][1] || 'et' AS a2 FROM part)
  SELECT p_partkey, 'collegedunia' AS site, CAST(k AS INT) AS position,
    'https://collegedunia.com/exams/' || [s1, s2, a1, a2][k + 1] || '/cutoff' AS url
  FROM p, (VALUES (0), (1), (2), (3)) t(k)
  UNION ALL SELECT p_partkey, 'careers360', CAST(k AS INT), 'https://law.careers360.com/articles/x'
    || p_partkey || CASE k WHEN 0 THEN '-cutoff' ELSE '-cut-off' END
  FROM p, (VALUES (0), (1)) t(k)
  UNION ALL SELECT p_partkey, 'collegedekho', CAST(k AS INT),
    'https://www.collegedekho.com/exam/x' || p_partkey || CASE k WHEN 0 THEN '/cutoff'
      ELSE '/cutoff-' || (2026 - k) || '-esp' END FROM p, (VALUES (0), (1), (2)) t(k)
  UNION ALL SELECT p_partkey, 'shiksha', CAST(k AS INT), 'https://www.shiksha.com/' ||
    ['engineering', 'medicine', 'science', 'management', 'law'][k % 5 + 1] || '/' ||
    [s1, s2][k // 5 + 1] || '-exam-cutoff' FROM p, (SELECT unnest(range(10)) AS k)""")
def url_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page addresses built from site links, or guessed from search text and name."""
    rows = table(spark, sf_dir, "part").selectExpr(
        "p_partkey", "concat('All India ', p_name, ' Entrance Test') as exam",
        "concat('?term=', replace(p_name, ' ', '+'), '+z%C3%BCrich') as q",
        "cast(p_partkey as string) as k")
    urls = {
        "collegedunia": F.concat(F.lit("https://collegedunia.com/e-search"), "q"),
        "careers360": F.concat(F.lit("https://law.careers360.com/exams/x"), "k", F.lit("-cutoff")),
        "collegedekho": F.concat(F.lit("https://www.collegedekho.com/exam/x"), "k"),
        "shiksha": F.concat(F.lit("https://www.shiksha.com/search"), "q")}
    out = None
    for site, url in urls.items():
        found = sites.with_cutoff_urls(
            rows.select("p_partkey", "exam", url.alias("site_url")), site, [2025, 2024]) \
            .select("p_partkey", F.posexplode_outer("urls").alias("position", "u")) \
            .filter(F.col("position").isNotNull())
        part = found.select("p_partkey", F.lit(site).alias("site"), "position",
                            F.col("u.url").alias("url"))
        out = part if out is None else out.unionByName(part)
    return out


def _site_pages(spark: SparkSession, sf_dir: str, url: str) -> DataFrame:
    cells = "'<table><tr><th>College</th><th>Closing Rank</th></tr><tr><td>', p_name, " \
            "'</td><td>', cast(p_size as string), '</td></tr></table>'"
    return table(spark, sf_dir, "part", heavy=True).selectExpr(f"{url} as url", f"concat({cells}) as html")


@query("site_rows", """
  SELECT 'X' || p_partkey AS exam, 'https://www.careers360.com/articles/x' || p_partkey
      || CASE WHEN p_partkey % 2 = 0 THEN '-cutoff' ELSE '-cut-off' END AS page_url,
    p_name AS institute_name, CAST(p_size AS BIGINT) AS closing_rank, CAST(NULL AS VARCHAR) AS year
  FROM part
  UNION ALL SELECT 'X' || p_partkey, 'https://www.collegedekho.com/exam/x' || p_partkey
      || CASE k WHEN 0 THEN '/cutoff' ELSE '/cutoff-2025-esp' END, p_name, p_size,
    CASE k WHEN 1 THEN '2025' END
  FROM part, (VALUES (0), (1)) t(k) WHERE k = 1 OR p_partkey % 2 = 0""")
def site_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First address with rows at one site; current page and archives at another."""
    part = table(spark, sf_dir, "part").selectExpr(
        "concat('X', cast(p_partkey as string)) as exam", "p_partkey")
    one = part.selectExpr("exam", "concat('https://www.careers360.com/exams/x', "
                          "cast(p_partkey as string)) as site_url")
    base = "concat('https://www.careers360.com/articles/x', cast(p_partkey as string), '{}')"
    pages = _site_pages(spark, sf_dir, base.format("-cut-off")).unionByName(
        _site_pages(spark, sf_dir, f"if(p_partkey % 2 = 0, {base.format('-cutoff')}, "
                    "cast(p_partkey as string))"))
    two = part.selectExpr("exam", "concat('https://www.collegedekho.com/exam/x', "
                          "cast(p_partkey as string)) as site_url")
    dekho = "concat('https://www.collegedekho.com/exam/x', cast(p_partkey as string), '{}')"
    pages2 = _site_pages(spark, sf_dir, dekho.format("/cutoff-2025-esp")).unionByName(
        _site_pages(spark, sf_dir, f"if(p_partkey % 2 = 0, {dekho.format('/cutoff')}, 'none')"))
    rows = sites.site_rows("careers360", one, pages).unionByName(
        sites.site_rows("collegedekho", two, pages2, [2025, 2024]))
    return rows.select("exam", "page_url", "institute_name", "closing_rank", "year")


def _site_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr(
        "concat('X', p_partkey) as exam",
        "case p_type when 'PROMO' then 'cat1' when 'SMALL' then 'cat3' else 'cat2' end as category",
        "if(p_type = 'LARGE', ' ', if(p_type = 'MEDIUM', 'https://collegedunia.com/x', "
        "concat(' https://collegedunia.com/exams/x', p_partkey))) as collegedunia")


@query("site_targets", """
  SELECT 'X' || p_partkey AS exam, CASE p_type WHEN 'MEDIUM' THEN 'https://collegedunia.com/x'
      ELSE 'https://collegedunia.com/exams/x' || p_partkey END AS site_url
  FROM part WHERE p_type NOT IN ('LARGE', 'PROMO', 'SMALL')""")
def site_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sites.targets(_site_segments(spark, sf_dir), "collegedunia", "cat2")


@query("run_statistics", """
  SELECT 'collegedunia' AS competitor, count(*) AS exams_attempted,
    count(*) AS exams_url_resolved, count_if(p_type = 'ECONOMY') AS exams_with_rows,
    count_if(p_type = 'ECONOMY') AS rows FROM part WHERE p_type <> 'LARGE' """)
def run_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attempted, resolved, with rows - over the stored pages of one site."""
    pages = _site_pages(spark, sf_dir, "if(p_type = 'ECONOMY', concat("
                        "'https://collegedunia.com/exams/x', p_partkey, '/cutoff'), 'none')")
    wanted = sites.targets(_site_segments(spark, sf_dir), "collegedunia")
    return sites.run_statistics("collegedunia", wanted,
                                sites.site_rows("collegedunia", wanted, pages))


@query("embedded_json", """
  SELECT page_id, '{"id": ' || page_id || '}' AS next_data,
    CASE WHEN page_id % 2 = 0 THEN '<TABLE>' || page_id || ' long</TABLE>' END AS article,
    replace(regexp_extract(html, '(?s)<title>(.*?)</title>', 1), '&amp;', '&') AS title
  FROM pages""")
def embedded_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page data blobs, article HTML dug out of application state, entities."""
    pages = table(spark, sf_dir, "pages").withColumn("html", F.expr(
        "concat(html, '<script id=\"__NEXT_DATA__\" type=\"x\"> {\"id\": ', "
        "cast(page_id as string), '} </script>', if(page_id % 2 = 0, concat("
        "'<script>window.INITIAL_STATE = {\"a\": [{\"Body\": \"<TABLE>', cast(page_id as string), "
        "' long</TABLE>\", \"x\": \"} {\"}], \"content\": \"<table></table>\"};</script>'), ''))"))
    state = initial_state(F.col("html"))
    return pages.select("page_id", next_data(F.col("html")).alias("next_data"),
                        state["article"].alias("article"),
                        unescape(page_title(F.col("html"))).alias("title"))


@query("page_years", """
  SELECT page_id, CAST(coalesce(try_cast(nullif(regexp_extract(html, '\\b(20[0-9]{2})\\b', 1), '')
    AS BIGINT), 2021) AS BIGINT) AS year, unnest(['1', '6']) AS round FROM pages""")
def page_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First year a page names, and the real options of its round list."""
    html = F.concat("html", F.lit(
        " in 2021 <select id=\"ctl_ddlroundno\"><option value=\"0\">--Select--</option>"
        "<option selected value='1'>One</option><option value=\"\">x</option>"
        "<option value=\"6\">Six</option></select>"))
    return table(spark, sf_dir, "pages").select(
        "page_id", year_in(html).alias("year"),
        F.explode(round_options(html, "ddlroundno")).alias("round"))


# --- fetch log -------------------------------------------------------------------------
_LOG = """SELECT event_id AS position, user_id AS h, CASE event_type WHEN 'error' THEN 'error'
  WHEN 'purchase' THEN 'ok' ELSE 'empty' END AS outcome, event_type, value FROM events"""


def _fetch_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(
        "event_id as position", "concat('E', cast(event_id as string)) as exam",
        "if(event_type = 'signup', 'see notice', concat('https://h', cast(user_id as string), "
        "'.org/', cast(event_id as string))) as url", "event_type = 'signup' as prose",
        "case event_type when 'click' then 'http_404' when 'view' then 'pdf_multipage' "
        "else 'html_table_rank' end as bucket",
        "case event_type when 'error' then 'error' when 'purchase' then 'ok' else 'empty' end "
        "as outcome", "cast(value as bigint) + 1 as n_rows", "'boom' as error")


@query("failure_streak", f"""
  WITH l AS ({_LOG}), o AS (SELECT h, position, outcome = 'error' AS e,
      count_if(outcome = 'ok') OVER (PARTITION BY h ORDER BY position) AS island
    FROM l WHERE outcome <> 'empty'),
  r AS (SELECT h, position, count_if(e) OVER (PARTITION BY h, island ORDER BY position) AS run
    FROM o)
  SELECT h AS user_id, min(position) AS opened_at FROM r WHERE run >= 3 GROUP BY 1""")
def failure_streak(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each host opens; small blocks, so streaks cross block borders."""
    from rankloom.operators.streaks import opening_positions

    log = table(spark, sf_dir, "events").selectExpr(
        "event_id", "user_id", "case event_type when 'error' then 'error' "
        "when 'purchase' then 'ok' else 'empty' end as outcome")
    return opening_positions(log, "user_id", "event_id", "outcome", rows_per_block=512)


@query("fetch_outcomes", f"""
  WITH l AS ({_LOG}), o AS (SELECT h, position, outcome = 'error' AS e,
      count_if(outcome = 'ok') OVER (PARTITION BY h ORDER BY position) AS island
    FROM l WHERE outcome <> 'empty'),
  r AS (SELECT h, position, count_if(e) OVER (PARTITION BY h, island ORDER BY position) AS run
    FROM o),
  a AS (SELECT h AS ah, min(position) AS opened FROM r WHERE run >= 3 GROUP BY 1),
  s AS (SELECT *, CASE WHEN event_type = 'signup' THEN 'skip' WHEN event_type = 'click' THEN 'dead'
      WHEN position > coalesce(opened, 9e15) THEN 'circuit-open' ELSE outcome END AS status
    FROM l LEFT JOIN a ON ah = h)
  SELECT position, CASE event_type WHEN 'click' THEN 'none' WHEN 'view' THEN 'pdf' ELSE 'html' END
      AS fetcher, status, CASE WHEN status = 'ok' THEN CAST(trunc(value) AS BIGINT) + 1 ELSE 0 END
      AS rows,
    CASE status WHEN 'skip' THEN 'no real URL' WHEN 'dead' THEN 'dead/blocked link -> cat3'
      WHEN 'circuit-open' THEN 'h' || h || '.org skipped' WHEN 'error' THEN 'boom' ELSE '' END
      AS note FROM s""")
def fetch_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The run report of a bulk pass."""
    from rankloom.functions.classify import fetch_strategy

    log = _fetch_log(spark, sf_dir).withColumn(
        "fetcher", fetch_strategy(F.col("bucket"))["fetcher"])
    return bulk.fetch_outcomes(log, rows_per_block=1024) \
        .select("position", "fetcher", "status", "rows", "note")


_OFFICIAL = """
  l AS (SELECT p_partkey AS position, p_size AS h, p_partkey % 17 = 0 AS prose,
      CASE p_partkey % 7 WHEN 0 THEN 'http_404' WHEN 1 THEN 'pdf_multipage' ELSE 'html_table_rank' END
      AS bucket, p_partkey % 5 IN (1, 3) AS failed, p_partkey % 3 = 0 AS bare FROM part),
  t AS (SELECT *, CASE WHEN prose THEN 'skip' WHEN bucket = 'http_404' THEN 'dead'
      WHEN failed THEN 'error' WHEN bare THEN 'empty' ELSE 'ok' END AS seen FROM l),
  o AS (SELECT h, position, seen = 'error' AS e,
      count_if(seen = 'ok') OVER (PARTITION BY h ORDER BY position) AS island
    FROM t WHERE seen IN ('ok', 'error')),
  r AS (SELECT h, position, count_if(e) OVER (PARTITION BY h, island ORDER BY position) AS run FROM o),
  a AS (SELECT h AS ah, min(position) AS opened FROM r WHERE run >= 3 GROUP BY 1),
  s AS (SELECT *, CASE WHEN seen IN ('skip', 'dead') THEN seen
      WHEN position > coalesce(opened, 9e15) THEN 'circuit-open' ELSE seen END AS status
    FROM t LEFT JOIN a ON ah = h)"""


def _official(spark: SparkSession, sf_dir: str) -> tuple[bulk.OfficialPass, bulk.OfficialPass]:
    """Parts are official links, walked in two passes; the second goes on from the first."""
    part = table(spark, sf_dir, "part").withColumn("url", F.expr(
        "if(p_partkey % 17 = 0, 'ask the office', "
        "concat('https://h', p_size, '.in/', p_partkey))"))
    none = F.lit(None).cast("string")
    links = part.select(
        F.col("p_partkey").alias("position"), F.col("p_name").alias("exam"), "url",
        (F.col("p_partkey") % 17 == 0).alias("prose"), F.lit("https://home.in/").alias("website"),
        none.alias("body"), F.lit("UG").alias("level"), none.alias("state"))
    probe = part.selectExpr("url", "case p_partkey % 7 when 0 then 'http_404' "
                                   "when 1 then 'pdf_multipage' else 'html_table_rank' end as bucket")
    log = part.selectExpr("url", "if(p_partkey % 5 in (1, 3), 'timed out', null) as error")
    pages = part.selectExpr(
        "url", "if(p_partkey % 3 = 0, '<p>No tables</p>', concat('<table><tr><th>Institute</th>"
        "<th>Branch</th><th>Closing Rank</th></tr><tr><td>College ', p_partkey, '</td><td>', p_type, "
        "'</td><td>', p_partkey + 1, '</td></tr></table>')) as html")
    grids = part.filter("p_partkey % 3 <> 0").selectExpr(
        "url as doc_id", "1L as page", "0L as table_idx", "inline(array("
        "struct(0L as row_idx, array('Institute', 'Branch', 'Closing Rank') as cells), "
        "struct(1L as row_idx, array(concat('College ', p_partkey), p_type, "
        "cast(p_partkey + 1 as string)) as cells)))")
    stage = shared_folder(spark)
    first = bulk.official_pass(links.filter("position < 1000"), probe, log, pages,
                               f"{stage}/1", grids, rows_per_block=64)
    second = bulk.official_pass(links.filter("position >= 1000"), probe, log, pages,
                                f"{stage}/2", grids, carried=first.hosts, rows_per_block=64)
    return first, second


@query("bulk_official", f"""WITH {_OFFICIAL} SELECT 'College ' || position AS "Institute",
    position + 1 AS "ClosingRank", 'https://h' || h || '.in/' || position AS "SourceURL",
    'https://home.in/' AS "Website" FROM s WHERE status = 'ok'""")
def bulk_official(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the links that a walk in two passes still tries."""
    passes = _official(spark, sf_dir)
    rows = passes[0].rows.unionByName(passes[1].rows)
    return rows.select("Institute", "ClosingRank", "SourceURL", "Website")


@query("bulk_official_report", f"""WITH {_OFFICIAL} SELECT position, status,
    CASE WHEN status = 'ok' THEN 1 ELSE 0 END AS rows FROM s""")
def bulk_official_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    passes = _official(spark, sf_dir)
    report = passes[0].report.unionByName(passes[1].report)
    return report.select("position", "status", "rows")


@query("bulk_official_hosts", f"""WITH {_OFFICIAL},
  k AS (SELECT h, position, seen = 'error' AS e FROM s WHERE status IN ('ok', 'error')),
  z AS (SELECT h, max(CASE WHEN NOT e THEN position END) AS good FROM k GROUP BY 1)
  SELECT 'h' || k.h || '.in' AS host, CAST(count(*) AS INTEGER) AS failures FROM k JOIN z USING (h)
  WHERE e AND position > coalesce(good, -1) GROUP BY 1""")
def bulk_official_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failures in a row that the two passes leave behind."""
    return _official(spark, sf_dir)[1].hosts


@query("strategy_tally", """
  SELECT CASE event_type WHEN 'click' THEN 'none' WHEN 'view' THEN 'pdf' WHEN 'error' THEN '(blank)'
    ELSE 'html' END AS value, count(*) AS n FROM events GROUP BY 1""")
def strategy_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _fetch_log(spark, sf_dir)
    buckets = log.select("url", "bucket").filter("url like 'http%'").dropDuplicates(["url"])
    routed = bulk.with_strategy(log.drop("bucket"), buckets, "url").selectExpr(
        "if(outcome = 'error', ' ', if(prose, 'html', fetcher)) as fetcher")
    return bulk.tally(routed, "fetcher")
