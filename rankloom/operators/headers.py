"""Header logic shared by all table shapes: unique names, roles, positions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rankloom.functions.text import RUNS

# Column role by header wording, in order.
ROLES = [
    ("closing_rank", r"clos|cr\b|last\s*rank|cutoff\s*rank"),
    ("opening_rank", r"open|or\b|first\s*rank|start"),
    ("cutoff_percentile", r"percentile"),
    ("cutoff_score_or_marks", r"score|marks"),
    ("counselling_round", r"round"),
    ("year", r"\byear\b|^\s*20\d{2}\s*$"),
    ("category", r"categor|caste|quota\s*type"),
    ("quota", r"quota|region|domicile|home\s*state"),
    ("gender", r"gender|female|male"),
    ("branch_or_course", r"branch|course|program|specialis|stream|degree"),
    ("institute_name", r"college|institut|university|nit|iit|nlu"),
]
# What a header must hold, in lower case, to match a role's wording at all.
ROLE_WORDS = {
    "closing_rank": ["clos", "cr", "rank"],
    "opening_rank": ["open", "or", "rank", "start"],
    "cutoff_percentile": ["percentile"],
    "cutoff_score_or_marks": ["score", "marks"],
    "counselling_round": ["round"],
    "year": ["year", "20"],
    "category": ["categor", "caste", "quota"],
    "quota": ["quota", "region", "domicile", "home"],
    "gender": ["gender", "male"],
    "branch_or_course": ["branch", "course", "program", "specialis", "stream", "degree"],
    "institute_name": ["college", "institut", "university", "nit", "iit", "nlu"],
}
# Headers that are a reservation category themselves.
CATEGORY_HEADER = r"(?i)^(general|open|gen|ur|obc(?:-ncl)?|sc|st|ews|pwd|ph|gm|" \
                  r"obc\s*ncl|general-ews|gen-ews|crl)$"

# Header wording of the general-purpose mapper.
MAPPER = {
    "opening": r"open",
    "closing": r"clos|cut.?off|last rank|closing",
    "rank": r"rank|merit|cut.?off",
    "Institute": r"institut|college|university|campus|name of (the )?(institut|college)",
    "Branch": r"branch|course|program|programme|stream|discipline|subject|"
              r"specialis|specializ|academic program",
    "Category": r"categor|seat type|caste|community|reservation",
    "Quota": r"quota|seat pool|home state|all india",
    "Gender": r"gender|female|male",
    "Year": r"\byear\b",
    "Round": r"round|phase|allotment",
}


# Headers are given by column name: every rule below is one SQL text, parsed once
# on the JVM, and reads a header that an earlier step has materialised.
def unique_names(header: str) -> Column:
    """Repeated header labels get ``.1``, ``.2``...; the first stays bare.

    Most headers repeat nothing and are returned as they are. ``header`` is a column's
    name: an expression would be computed at each of its uses.
    """
    tries = "transform(sequence(1, size(taken) + 1), k -> concat(name, '.', k))"
    free = f"element_at(filter({tries}, t -> not array_contains(taken, t)), 1)"
    return F.expr(
        f"if(size(array_distinct({header})) = size({header}), {header}, "
        f"aggregate({header}, cast(array() as array<string>), (taken, name) -> "
        f"array_append(taken, if(array_contains(taken, name), {free}, name))))")


def squeezed_names(header: str) -> Column:
    """Runs of whitespace in the labels to one space, ends trimmed."""
    return F.expr(f"transform({header}, h -> trim(regexp_replace(h, r'{RUNS}', ' ')))")


def detect_roles(header: str) -> Column:
    """map(role -> 0-based column): each column takes its first free role.

    Plain searches for a role's words come first; a pattern costs ten times as much.
    """
    def words(role: str) -> str:
        return " or ".join(f"contains(p.low, '{w}')" for w in ROLE_WORDS[role])

    cases = " ".join(
        f"when ({words(role)}) and not map_contains_key(roles, '{role}') "
        f"and p.name rlike r'(?i){pattern}' "
        f"then map_concat(roles, map('{role}', p.at))" for role, pattern in ROLES)
    return F.expr(
        f"aggregate(transform({header}, (name, at) -> named_struct('name', name, "
        "'low', lower(name), 'at', at)), cast(map() as map<string,int>), "
        f"(roles, p) -> case {cases} else roles end)")


def role_position(header: str, roles: str, role: str) -> Column:
    """0-based position under a role: the first column that carries the role's label."""
    label = f"get({header}, try_element_at({roles}, '{role}'))"
    return F.expr(f"nullif(array_position({header}, {label}), 0) - 1").cast("int")


def category_headers(header: str, roles: str) -> Column:
    """Headers to melt.

    A single such header that serves as the opening or closing column is that
    rank column; two or more are categories whatever else they look like.
    """
    found = f"filter({header}, h -> trim(h) rlike r'{CATEGORY_HEADER}')"
    ranks = ", ".join(f"get({header}, try_element_at({roles}, '{r}'))"
                      for r in ("opening_rank", "closing_rank"))
    # a lambda's argument is computed once
    return F.expr(f"get(transform(array({found}), f -> "
                  f"if(size(f) <= 1, array_except(f, array({ranks})), f)), 0)")


def find_header(header: str, pattern: str, exclude: str | None = None) -> Column:
    """0-based position of the first header that matches, null if none does."""
    hit = f"h rlike r'(?i){pattern}'"
    if exclude:
        hit += f" and not h rlike r'(?i){exclude}'"
    return F.expr(f"cast(nullif(array_position(transform({header}, h -> {hit}), true), 0) - 1 "
                  "as int)")


def find_label(header: str, label: str) -> Column:
    """0-based position of an exact label, null if absent."""
    return F.expr(f"cast(nullif(array_position({header}, '{label}'), 0) - 1 as int)")


def cell(cells: Column, at: Column) -> Column:
    """Cell at a 0-based position; null when the position or the cell is missing."""
    return F.when(at.isNotNull(), F.get(cells, at))


def may_be_cutoff_table(header: str) -> Column:
    """True of every header that ``is_cutoff_table`` holds for once it is tidy."""
    return F.expr(f"exists({header}, h -> h rlike '(?i)rank|merit|cut')")


def is_cutoff_table(header: str) -> Column:
    return F.expr(f"exists({header}, h -> h rlike r'(?i){MAPPER['rank']}')")
