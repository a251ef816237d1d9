"""Rank and year parsing.

The published tables need several number rules that differ on noise words,
decimals, rounding and sign; each stays a function of its own. Everything goes
through ``try_cast`` because a bad cast raises under ANSI mode.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DoubleType, FloatType, IntegralType

from rankloom.functions.text import SPACE, first_group, strip

_NUMERIC = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
_FIRST_NUMBER = r"([0-9]+(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?)"
_RANGE = rf"(?i)^{SPACE}*([0-9][0-9,]*){SPACE}*(?:-|–|—|to){SPACE}*([0-9][0-9,]*){SPACE}*$"
_YEAR = r"\b(20[0-9]{2})\b"

# Cell texts that stand for "no rank", per source kind.
_CANON_BLANKS = ["", "-", "NA", "nan"]
_CELL_BLANKS = ["", "-", "na", "n/a", "nan", "none", "tba", "--"]
_WEB_BLANKS = ["", "-", "na", "n/a", "nan", "none", "null", "tba", "--"]
# Wording that marks a placeholder cell.
_NOISE = "(?i)will be|to be|notified|tba|n/a|na|--|yet to|coming soon|updated soon|select list"


def _half_even(text: Column) -> Column:
    """Number text to bigint, rounded half to even; null if out of range."""
    return F.bround(text.try_cast("double"), 0).try_cast("bigint")


def canon_int(c: Column, dtype: DataType | None = None) -> Column:
    """Canonical integer: commas and spaces dropped, whole text must be a number."""
    if isinstance(dtype, IntegralType):
        return c.cast("bigint")
    if isinstance(dtype, (DoubleType, FloatType)):
        return F.bround(c.cast("double"), 0).try_cast("bigint")
    text = strip(F.replace(c.cast("string"), F.lit(","), F.lit("")))
    keep = ~text.isin(_CANON_BLANKS) & text.rlike(_NUMERIC)
    return F.when(keep, _half_even(text))


def noisy_rank(c: Column) -> Column:
    """First run of digits in a messy cell; placeholders and zero are null."""
    text = c.cast("string")
    digits = F.replace(F.regexp_extract(text, "([0-9][0-9,]*)", 1), F.lit(","), F.lit(""))
    return F.when(~text.rlike(_NOISE), F.nullif(digits.try_cast("bigint"), F.lit(0)))


def bare_number(c: Column) -> Column:
    """A cell without its outer whitespace and its commas."""
    return F.replace(strip(c.cast("string")), F.lit(","), F.lit(""))


def bare_rank(text: Column) -> Column:
    """``cell_rank`` of a ``bare_number``, for plans that have it as a column already."""
    # no number gives the empty text, which is none either
    return F.when(~F.lower(text).isin(_CELL_BLANKS),
                  _half_even(F.regexp_extract(text, _FIRST_NUMBER, 1)))


def cell_rank(c: Column) -> Column:
    """First number of a cell, scientific notation allowed, sign ignored."""
    return bare_rank(bare_number(c))


def rank_range(c: Column) -> Column:
    """struct(low, high) when the whole cell is "low - high", else null."""
    def bound(group: int) -> Column:
        digits = F.replace(F.regexp_extract(c, _RANGE, group), F.lit(","), F.lit(""))
        return digits.try_cast("bigint")

    return F.when(c.rlike(_RANGE), F.struct(bound(1).alias("low"), bound(2).alias("high")))


def looks_like_percentile(c: Column) -> Column:
    """A decimal point and a value in 0..100."""
    text = F.rtrim(strip(c.cast("string")), F.lit("%"))
    text = F.replace(text, F.lit(","), F.lit(""))
    # most cells have no point: their text is not looked at further
    ok = c.cast("string").contains(".") & strip(text).rlike(_NUMERIC) \
        & text.try_cast("double").between(0.0, 100.0)
    return F.coalesce(ok, F.lit(False))


def web_rank(c: Column) -> Column:
    """Whole-text number of a researched cell; anything else is null."""
    text = F.replace(strip(c.cast("string")), F.lit(","), F.lit(""))
    keep = ~F.lower(text).isin(_WEB_BLANKS) & text.rlike(_NUMERIC)
    return F.when(keep, _half_even(text))


def leading_int(c: Column) -> Column:
    """Digits at the start of the cell once commas are gone."""
    text = F.replace(c, F.lit(","), F.lit(""))
    return first_group(text, r"^\s*([0-9]+)").try_cast("bigint")


def digits_only(c: Column) -> Column:
    """The cell must be nothing but digits."""
    return F.when(c.rlike(r"^[0-9]+$"), c.try_cast("bigint"))


def is_short_rank(c: Column) -> Column:
    """One to six digits, commas allowed."""
    return F.coalesce(F.replace(c, F.lit(","), F.lit("")).rlike(r"^[0-9]{1,6}$"),
                      F.lit(False))


def year_in(c: Column) -> Column:
    """First stand-alone 20xx in a text."""
    return first_group(c, _YEAR).try_cast("bigint")


def row_year(year: Column, *texts: Column) -> Column:
    """The year column when plausible, else the first text that names a year."""
    parsed = noisy_rank(year)
    return F.coalesce(F.when(parsed.between(2000, 2099), parsed),
                      *[year_in(t) for t in texts])


def with_split_ranks(df: DataFrame, opening: str, closing: str) -> DataFrame:
    """Add _opening, _closing and _range; a range cell fills both, closing cell first."""
    out = df.withColumns({"_open_range": rank_range(F.col(opening)),
                          "_close_range": rank_range(F.col(closing))}) \
        .withColumn("_chosen", F.coalesce("_close_range", "_open_range"))
    both = F.col("_chosen").isNotNull()
    bare = {f"_bare_{c}": F.when(~both, bare_number(F.col(c))) for c in {opening, closing}}
    return out.withColumns(bare).withColumns({
        "_opening": F.when(both, F.col("_chosen.low")).otherwise(
            bare_rank(F.col(f"_bare_{opening}"))),
        "_closing": F.when(both, F.col("_chosen.high")).otherwise(
            bare_rank(F.col(f"_bare_{closing}"))),
        "_range": F.when(F.col("_close_range").isNotNull(), strip(F.col(closing)))
        .when(both, strip(F.col(opening)))}) \
        .drop("_open_range", "_close_range", "_chosen", *bare)


# Form placeholders that are not real rounds.
def round_options(html: Column, select_id: str) -> Column:
    """Real option values of one drop-down, in page order."""
    block = F.regexp_extract(
        html, rf"""(?is)<select[^>]*id=["'][^"']*{select_id}["'][^>]*>(.*?)</select>""", 1)
    options = F.regexp_extract_all(
        block, F.lit(r"""(?s)(<option[^>]*value=["'][^"']*["'][^>]*>[^<]*</option>)"""), 1)
    pairs = F.transform(options, lambda o: F.struct(
        F.regexp_extract(o, r"""value=["']([^"']*)["']""", 1).alias("value"),
        F.trim(F.regexp_extract(o, r"(?s)>([^<]*)<", 1)).alias("label")))
    real = F.filter(pairs, lambda p: ~p["value"].isin("", "0")
                    & ~p["label"].isin("", "--Select--"))
    return F.transform(real, lambda p: p["value"])
