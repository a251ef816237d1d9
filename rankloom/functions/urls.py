"""URL rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.functions.rules import ladder
from rankloom.functions.text import ascii_fold, first_group, strip

_NETLOC = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)"
_AFTER_NETLOC = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)"

# Third-party sites whose link never counts as official.
AGGREGATORS = ["shiksha.com", "collegedekho.com", "careers360.com", "collegedunia.com"]
STUDY_PORTALS = [
    "shiksha.com", "careers360.com", "collegedekho.com", "getmyuni.com",
    "entrancezone.com", "collegepravesh.com", "collegeforme.in", "collegedunia.com",
    "embibe.com", "mbauniverse.com", "collegesearch.in", "successcds.net",
    "aglasem.com", "jagranjosh.com", "careerindia.com", "competishun.com",
    "vedantu.com", "byjus.com", "testbook.com", "oswaalbooks.com", "adda247.com",
    "catestseries.org", "aspirantmitraa.com",
]
LINK_AGGREGATORS = [*STUDY_PORTALS, "finance.careers360.com"]
RESEARCH_AGGREGATORS = [
    *STUDY_PORTALS, "youtube.com", "facebook.com", "wikipedia.org", "quora.com"]
DEEP_AGGREGATORS = [*RESEARCH_AGGREGATORS, "instagram.com", "linkedin.com"]
# Answers of an anti-bot wall; a person still reaches the page.
BOT_WALL = [401, 403, 406, 409, 429, 451, 503]


def host(url: Column) -> Column:
    """Lower-case network location, port included; "" when there is none."""
    return F.lower(F.regexp_extract(strip(F.coalesce(url, F.lit(""))), _NETLOC, 1))


def bare_host(url: Column) -> Column:
    return F.replace(host(url), F.lit("www."), F.lit(""))


def path(url: Column) -> Column:
    return F.regexp_extract(strip(F.coalesce(url, F.lit(""))), _AFTER_NETLOC, 1)


def origin(url: Column, default: str) -> Column:
    """scheme://host of a link, or the site's default."""
    text = strip(F.coalesce(url, F.lit("")))
    base = F.regexp_extract(text, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]+)", 1)
    return F.when(base != "", base).otherwise(default)


def is_url(url: Column) -> Column:
    """http or https with a host."""
    return strip(F.coalesce(url, F.lit(""))).rlike(r"(?i)^https?://[^/?#]+")


def has_http(url: Column) -> Column:
    return F.lower(strip(F.coalesce(url, F.lit("")))).startswith("http")


def on_domains(h: Column, domains: list[str]) -> Column:
    """Host equals one of the domains or is below it (fixed short list)."""
    hit = h.isin(domains)
    for domain in domains:
        hit = hit | h.endswith("." + domain)
    return hit


def is_aggregator(url: Column, domains: list[str] = AGGREGATORS) -> Column:
    return on_domains(host(url), domains)


def is_aggregator_bare(url: Column, domains: list[str] = LINK_AGGREGATORS) -> Column:
    """Same test on the host without "www."."""
    return on_domains(bare_host(url), domains)


def has_depth(url: Column) -> Column:
    """Points below the site root: a path or a query."""
    text = F.coalesce(url, F.lit(""))
    query = F.regexp_extract(text, r"^[^?#]*\?([^#]*)", 1)
    return ~path(text).isin("", "/") | (query != "")


def reachable(status: Column) -> Column:
    """The page answers, or answers a browser."""
    return F.coalesce((status < 400) | status.isin(BOT_WALL), F.lit(False))


# Parameters that carry a site's own search text.
SEARCH_PARAMS = ["term", "q", "query", "search", "keyword"]


def search_term(url: Column) -> Column:
    """Decoded text of the first search parameter that is present and not blank."""
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[^?#]*\?([^#]*)", 1)
    found = [first_group(query, rf"(?:^|[&;]){p}=([^&;]+)") for p in SEARCH_PARAMS]
    return F.try_url_decode(F.coalesce(*found))


# --- slugs ---------------------------------------------------------------------
# Words left out of acronyms, and out of shortened slugs.
SLUG_STOP = ["the", "of", "for", "and", "in", "a", "an", "to", "on"]
SLUG_NOISE = ["entrance", "exam", "examination", "test", "common", "joint",
              "admission", "national", "all", "india"]


def _slug_words(text: Column) -> Column:
    plain = F.lower(ascii_fold(F.coalesce(text, F.lit(""))))
    return F.filter(F.split(F.regexp_replace(plain, "[^a-z0-9]+", " "), " "),
                    lambda w: w != "")


def slugify(text: Column, drop: list[str] | None = None) -> Column:
    """Lower-case ASCII words joined by "-"; dropping all words drops none."""
    words = _slug_words(text)
    if drop:
        kept = F.filter(words, lambda w: ~w.isin(drop))
        words = F.when(F.size(kept) > 0, kept).otherwise(words)
    return F.array_join(words, "-")


def acronym(text: Column) -> Column:
    """First letters of the significant words; null below two words."""
    words = F.filter(_slug_words(text), lambda w: ~w.isin(SLUG_STOP))
    letters = F.array_join(F.transform(words, lambda w: F.substring(w, 1, 1)), "")
    return F.when(F.size(words) >= 2, letters)


def with_candidate_slugs(df: DataFrame, url: Column, exam: Column, name: str,
                         max_slugs: int = 4) -> DataFrame:
    """Add likely page slugs, most precise first: full, acronym, noise-free.

    The site's search text comes before the exam name. Words are folded once per
    seed, in a step of their own.
    """
    out = df.withColumns({"_term": search_term(url), "_exam": exam}).withColumn(
        "_other", F.expr("if(coalesce(_exam, '') <> '' and "
                         "(_term is null or _term <> _exam), _exam, null)")) \
        .withColumns({"_s0": _slug_words(F.col("_term")), "_s1": _slug_words(F.col("_other"))})
    stop = ", ".join(f"'{w}'" for w in SLUG_STOP)
    noise = ", ".join(f"'{w}'" for w in SLUG_NOISE)

    def seeds(text: str) -> str:
        return ", ".join(text.format(w=f"_s{i}") for i in (0, 1))

    short = f"filter({{w}}, x -> x not in ({stop}))"
    letters = f"if(size({short}) >= 2, array_join(transform({short}, x -> left(x, 1)), ''), '')"
    bare = f"filter({{w}}, x -> x not in ({noise}))"
    ordered = ", ".join([seeds("array_join({w}, '-')"), seeds(letters),
                         seeds(f"array_join(if(size({bare}) > 0, {bare}, {{w}}), '-')")])
    slugs = f"slice(array_distinct(filter(array({ordered}), x -> x <> '')), 1, {max_slugs})"
    return out.withColumn(name, F.expr(slugs)).drop("_term", "_exam", "_other", "_s0", "_s1")


# --- links inside pages ----------------------------------------------------------
def without_dots(url: Column) -> Column:
    """A URL with "." and ".." taken out of its path; ".." at the root is dropped."""
    whole = r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)([^?#]*)(.*)$"
    path = F.regexp_extract(url, whole, 2)
    parts = F.split(path, "/")
    last = F.element_at(parts, -1)
    # a path that ends in a dot segment is a folder
    open_end = F.when(last.isin(".", ".."), F.concat(parts, F.array(F.lit("")))).otherwise(parts)
    kept = F.aggregate(
        open_end, F.array().cast("array<string>"),
        lambda done, part: F.when(part == ".", done)
        .when(part == "..", F.when(F.size(done) > 1, F.slice(done, 1, F.size(done) - 1))
              .otherwise(done))
        .otherwise(F.concat(done, F.array(part))))
    clean = F.concat(F.regexp_extract(url, whole, 1), F.array_join(kept, "/"),
                     F.regexp_extract(url, whole, 3))
    return F.when(url.rlike(whole) & path.rlike(r"/\.\.?(/|$)"), clean).otherwise(url)


def resolve(base: Column, link: Column) -> Column:
    """Absolute form of a link found on a page, without dot segments."""
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1)
    root = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)", 1)
    page = F.regexp_extract(base, r"^([^?#]*)", 1)
    folder = F.when(F.length(page) > F.length(root), F.regexp_replace(page, r"[^/]*$", "")) \
        .otherwise(F.concat(root, F.lit("/")))
    return ladder([
        (link.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), link),
        (F.coalesce(base, F.lit("")) == "", link),
        (link.startswith("//"), without_dots(F.concat(scheme, F.lit(":"), link))),
        (link.startswith("/"), without_dots(F.concat(root, link))),
        (link.startswith("?"), F.concat(page, link)),
    ], without_dots(F.concat(folder, link)))


def pdf_links(html: Column, base: Column) -> Column:
    """Absolute, distinct links to PDF files in page order."""
    found = F.regexp_extract_all(
        F.coalesce(html, F.lit("")),
        F.lit(r"""(?i)href=["']([^"']+\.pdf[^"']*)["']"""), 1)
    return F.array_distinct(F.transform(found, lambda h: resolve(base, h)))


def report_links(html: Column) -> Column:
    """Distinct links to the opening/closing-rank reports of a portal page."""
    found = F.regexp_extract_all(
        F.coalesce(html, F.lit("")), F.lit(r"""(?i)href="([^"]*orcrreport[^"]*)\""""), 1)
    return F.array_distinct(F.transform(found, lambda h: F.replace(h, F.lit("&amp;"), F.lit("&"))))


def redirect_links(html: Column) -> Column:
    """Targets behind a search page's redirect parameter, decoded."""
    found = F.regexp_extract_all(
        F.coalesce(html, F.lit("")), F.lit(r"""uddg=([^&"']+)"""), 1)
    # percent-decoding only: "+" is a literal plus in a redirect target
    return F.transform(found, lambda u: F.try_url_decode(F.replace(u, F.lit("+"), F.lit("%2B"))))


def plain_links(html: Column) -> Column:
    return F.regexp_extract_all(
        F.coalesce(html, F.lit("")), F.lit(r"""href="(https?://[^"]+)\""""), 1)


# --- literal public-address audit ----------------------------------------------
# IPv4 blocks that are not public, as (network, prefix length).
_NON_PUBLIC_V4 = [
    ("0.0.0.0", 8), ("10.0.0.0", 8), ("127.0.0.0", 8), ("169.254.0.0", 16),
    ("172.16.0.0", 12), ("192.0.0.0", 24), ("192.0.2.0", 24), ("192.168.0.0", 16),
    ("198.18.0.0", 15), ("198.51.100.0", 24), ("203.0.113.0", 24),
    ("224.0.0.0", 4), ("240.0.0.0", 4),
]
_NON_PUBLIC_V6 = r"^(::1?$|::ffff:|f[cd][0-9a-f]{2}:|fe[89ab][0-9a-f]:|ff[0-9a-f]{2}:|" \
                 r"2001:db8:|100::)"


def _v4_number(dotted: str) -> int:
    a, b, c, d = (int(x) for x in dotted.split("."))
    return (a << 24) + (b << 16) + (c << 8) + d


def is_public_url(url: Column) -> Column:
    """http(s) and neither a local alias nor a non-public address literal.

    Names are taken as they are: resolving them is network work, not a column
    rule.
    """
    text = strip(F.coalesce(url, F.lit("")))
    netloc = F.regexp_replace(F.lower(F.regexp_extract(
        text, r"(?i)^https?://([^/?#]+)", 1)), r"^[^@]*@", "")
    v6 = F.regexp_extract(netloc, r"^\[([^\]]*)\]", 1)
    name = F.when(v6 != "", v6).otherwise(F.regexp_replace(netloc, r":[0-9]*$", ""))
    quad = r"^([0-9]{1,3})\.([0-9]{1,3})\.([0-9]{1,3})\.([0-9]{1,3})$"
    octets = [F.regexp_extract(name, quad, i).try_cast("bigint") for i in range(1, 5)]
    number = octets[0] * (1 << 24) + octets[1] * (1 << 16) + octets[2] * 256 + octets[3]
    private = F.lit(False)
    for net, bits in _NON_PUBLIC_V4:
        first = _v4_number(net)
        private = private | number.between(first, first + (1 << (32 - bits)) - 1)
    for o in octets:
        private = private | (o > 255)
    private = F.when(name.rlike(quad), private).otherwise(F.lit(False))
    bad = (name == "") | name.isin("localhost", "localhost.localdomain", "ip6-localhost") \
        | private | ((v6 != "") & v6.rlike(_NON_PUBLIC_V6))
    return text.rlike(r"(?i)^https?://") & ~bad
