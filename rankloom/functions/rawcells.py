"""Ranks and categories recovered from the JSON text of an original table row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rankloom.functions.numbers import noisy_rank
from rankloom.functions.text import missing_to_blank

# Key wording of rank and category cells.
OPENING_KEYS = ["opening", "first rank", "start rank"]
CLOSING_KEYS = ["closing", "cut off", "cutoff", "cut-off", "rank", "last rank"]
CATEGORY_KEYS = ["category", "caste", "community", "reservation", "quota"]


def cell_entries(raw: Column) -> Column:
    """Key-ordered entries of the JSON object; null if the text is not one."""
    # other texts cost the reader an exception each
    opened = F.ltrim(raw, F.lit(" \t\r\n")).startswith("{")
    return F.map_entries(F.from_json(F.when(opened, raw), "map<string,string>"))


def _has(text: Column, words: list[str]) -> Column:
    hit = F.lit(False)
    for word in words:
        hit = hit | text.contains(word)
    return hit


def _first(entries: Column, wanted, value) -> Column:
    found = F.filter(F.transform(F.filter(entries, wanted), value), lambda v: v.isNotNull())
    return F.get(found, F.lit(0))


def ranks_of(entries: Column) -> Column:
    """struct(opening, closing): first parseable value of each kind of key.

    An opening key is never read as a closing one, though it may say "rank".
    """
    opening = _first(entries, lambda e: _has(F.lower(e["key"]), OPENING_KEYS),
                     lambda e: noisy_rank(e["value"]))
    closing = _first(entries, lambda e: ~_has(F.lower(e["key"]), OPENING_KEYS)
                     & _has(F.lower(e["key"]), CLOSING_KEYS),
                     lambda e: noisy_rank(e["value"]))
    return F.struct(opening.alias("opening"), closing.alias("closing"))


def category_of(entries: Column) -> Column:
    """First value under a category-like key that is not a number or placeholder."""
    def value(e: Column) -> Column:
        text = missing_to_blank(e["value"])
        return F.when((text != "") & ~text.rlike("^[0-9]+$")
                      & (F.lower(text) != "select list"), text)

    return _first(entries, lambda e: _has(F.lower(e["key"]), CATEGORY_KEYS), value)
