"""Is a page about this exam, and does it look like a rank page?"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rankloom.functions.text import first_group, squeeze

# Wording of rank pages, and sites whose result is never one.
CUTOFF_WORDS = r"(?i)cut\s*off|closing\s*rank|opening\s*rank|merit\s*list|rank\s*list|" \
               r"category\s*wise|round\s*\d"
JUNK_SITES = r"(?i)ecosia|youtube|gstatic|amazonaws|syndicatedsearch|adsense|w3\.org|" \
             r"schema\.org|quora|reddit|scribd|facebook|twitter|instagram|linkedin|" \
             r"wikipedia|mozilla|pinterest|t\.me|whatsapp"
PREFERRED_SITES = ["collegedekho.com", "collegedunia.com", "shiksha.com", "careers360.com"]
# Exam words that identify nothing.
EXAM_STOP = [
    "university", "entrance", "exam", "examination", "test", "common", "of", "the", "and",
    "for", "in", "a", "an", "cet", "cutoff", "rank", "merit", "list", "admission",
    "national", "state", "college", "institute", "school", "bachelor", "undergraduate",
    "graduate", "engineering", "management",
]
# Categories that may appear only in a caption.
CAPTION_CATEGORY = r"(?i)\b(GOPEN[SH]?|OPEN|GENERAL|OBC(?:-NCL)?|SC|ST|EWS|PWD|VJ|NT|SEBC|" \
                   r"TFWS|LOPEN[SH]?|HOME\s*STATE|OTHER\s*STATE)\b"
CAPTION_ROUND = r"(?i)\bround[\s-]*([0-9IVX]+)\b"
# A "college" that is really a table caption.
CAPTION_WORDS = r"(?i)cut\s*-?\s*off|cutoff|\bround\b|\bdetail|merit list|\b20\d{2}\b"


def count_tables(html: Column) -> Column:
    return F.regexp_count(F.coalesce(html, F.lit("")), F.lit("(?i)<table"))


def has_cutoff_words(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).rlike(CUTOFF_WORDS)


def looks_like_cutoff(html: Column) -> Column:
    """At least one table, and rank wording anywhere on the page."""
    return (count_tables(html) > 0) & has_cutoff_words(html)


def page_title(html: Column) -> Column:
    return first_group(html, r"(?is)<title[^>]*>(.*?)</title>")


def exam_tokens(exam: Column) -> Column:
    """Distinctive words of an exam name, at least three characters each."""
    words = F.regexp_extract_all(F.lower(F.coalesce(exam, F.lit(""))), F.lit("([a-z0-9]+)"), 1)
    return F.filter(words, lambda w: (F.length(w) >= 3) & ~w.isin(EXAM_STOP))


def is_relevant(exam: Column, text: Column) -> Column:
    """Enough distinctive words of the exam occur in the text (two, or all of one)."""
    tokens = exam_tokens(exam)
    hay = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", " ")
    hits = F.size(F.filter(tokens, lambda t: hay.contains(t)))
    return (F.size(tokens) > 0) & (hits >= F.least(F.lit(2), F.size(tokens)))


def build_query(exam: Column, year: int | None = None) -> Column:
    tail = f'" cutoff OR "merit list" rank{f" {year}" if year else ""}'
    return F.concat(F.lit('"'), F.trim(exam), F.lit(tail))


def relax_query(query: Column) -> Column:
    """Quotes, operators and the merit-list phrase dropped for recall."""
    bare = F.replace(F.replace(query, F.lit('"'), F.lit(" ")), F.lit(" OR "), F.lit(" "))
    bare = F.regexp_replace(bare, r"(?i)\bmerit\s+list\b", " ")
    return F.concat(squeeze(bare), F.lit(" college closing rank"))


def exam_from_query(query: Column) -> Column:
    return F.coalesce(first_group(query, '"([^"]+)"'), query, F.lit(""))


def url_key(url: Column) -> Column:
    """URL without query and closing slashes: equal keys are one page."""
    return F.regexp_replace(F.substring_index(url, "?", 1), "/+$", "")


def clean_institute(caption: Column, exam: Column) -> Column:
    """College name of a caption (the part before "cut off"), else the exam."""
    before = F.regexp_replace(F.coalesce(caption, F.lit("")), r"(?is)\bcut[\s-]*off\b.*$", "")
    name = F.regexp_replace(before, "^[ \\-–—]+|[ \\-–—]+$", "")
    return F.coalesce(F.nullif(name, F.lit("")), exam, F.lit(""))


def is_caption(text: Column) -> Column:
    return F.coalesce((text != "") & text.rlike(CAPTION_WORDS), F.lit(False))
