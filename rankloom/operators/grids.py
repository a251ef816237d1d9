"""Extracted document grids to canonical-shaped rows.

Input is ``grid(doc_id, page, table_idx, row_idx, cells)``. Tables sit on one
physical page, so work per table is small; what spans a document goes through
the block-wise carry. Every operator keeps the reading order
(doc_id, page, table_idx, row_idx, slot) for the keep-first step after it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.functions.classify import LINE_GENDER, SEAT_GENDER, seat_gender
from rankloom.functions.numbers import digits_only, is_short_rank, leading_int
from rankloom.functions.rules import lookup
from rankloom.functions.text import RUNS, first_group, squeeze
from rankloom.operators.carry import carry_forward, heading_above
from rankloom.operators.headers import cell, find_header
from rankloom.operators.keep import keep_where
from rankloom.session import deal

ORDER = ["doc_id", "page", "table_idx", "row_idx"]
TABLE = ["doc_id", "page", "table_idx"]


def _or_null(c: Column) -> Column:
    return F.when(c != "", c)


def clean_cells(cells: str) -> Column:
    return F.expr(f"transform({cells}, c -> trim(regexp_replace(coalesce(c, ''), "
                  f"r'{RUNS}', ' ')))")


def with_table_header(grid: DataFrame) -> DataFrame:
    """Rows below each table's first row, with that row as ``header``."""
    w = Window.partitionBy(*TABLE).orderBy("row_idx")
    return grid.withColumns({"header": F.first("cells").over(w),
                             "_n": F.row_number().over(w)}) \
        .filter(F.col("_n") > 1).drop("_n")


def grid_tables(grid: DataFrame) -> DataFrame:
    """Table records of a grid for the general-purpose mapper.

    Tables of one row, and ragged ones, are skipped.
    """
    lines = F.array_sort(F.collect_list(F.struct("row_idx", "cells")))
    tables = grid.groupBy(*TABLE).agg(lines.alias("_lines")) \
        .filter(F.size("_lines") >= 2)
    header = F.transform(F.col("_lines")[0]["cells"],
                         lambda c: F.trim(F.coalesce(c, F.lit(""))))
    rows = F.transform(F.slice("_lines", 2, 1 << 30), lambda r: r["cells"])
    return tables.select(*TABLE, header.alias("header"), rows.alias("rows")) \
        .filter(~F.exists("rows", lambda r: F.size(r) != F.size("header")))


# --- flat records -----------------------------------------------------------------
# Header wording -> field, per body, in order.
WESTERN_COLUMNS = [
    ("inst_name", "Institute"), ("inst name", "Institute"), ("course", "Branch"),
    ("alloted_cat", "Category"), ("cat", "Category"), ("quota", "Quota"),
    ("first rank", "OpeningRank"), ("last rank", "ClosingRank")]
CAPITAL_COLUMNS = [
    ("institute", "Institute"), ("program", "Branch"), ("quota", "Quota"),
    ("category", "Category"), ("opening rank", "OpeningRank"),
    ("closing rank", "ClosingRank")]


def flat_header(cells: str, columns: list[tuple[str, str]]) -> Column:
    """struct(field -> position) when the row is a header, else null.

    A field takes the first column whose label holds any of its wordings.
    """
    wordings: dict[str, list[str]] = {}
    for wording, field in columns:
        wordings.setdefault(field, []).append(wording)
    at = {}
    for field, words in wordings.items():
        hit = " or ".join(f"contains(lower(c), '{w}')" for w in words)
        at[field] = F.expr(f"cast(nullif(array_position(transform({cells}, c -> {hit}), true), "
                           "0) - 1 as int)")
    return F.when(at["Institute"].isNotNull() & at["ClosingRank"].isNotNull(),
                  F.struct(*[c.alias(f) for f, c in at.items()]))


def flat_records(grid: DataFrame, columns: list[tuple[str, str]]) -> DataFrame:
    """One row per record; the latest header applies, across pages."""
    clean = grid.select(*ORDER, clean_cells("cells").alias("cells"))
    head = flat_header("cells", columns)
    carried = carry_forward(clean.withColumn("_head", head), "doc_id", "page",
                            ["table_idx", "row_idx"], {"at": F.col("_head")})
    data = carried.filter(F.col("_head").isNull() & F.col("at").isNotNull()
                          & (F.size("cells") > F.col("at.ClosingRank")))
    fields = {f for _, f in columns}

    def value(field: str) -> Column:
        return cell(F.col("cells"), F.col(f"at.{field}")) if field in fields \
            else F.lit(None).cast("string")

    out = data.select(
        *ORDER, value("Institute").alias("Institute"),
        *[_or_null(value(c)).alias(c) for c in ("Branch", "Category", "Quota")],
        _or_null(seat_gender(value("Gender"), SEAT_GENDER)).alias("Gender"),
        leading_int(value("OpeningRank")).alias("OpeningRank"),
        leading_int(value("ClosingRank")).alias("ClosingRank"))
    return out.filter((F.col("Institute") != "") & F.col("ClosingRank").isNotNull())


# --- melts ------------------------------------------------------------------------
def last_rank_header(header: Column) -> Column:
    """struct(category, gender) of a "<category> <BOYS|GIRLS>" header, else null."""
    token = F.regexp_replace(F.upper(header), "[^A-Z]", "")
    pattern = "^(.+)(BOYS|GIRLS)$"
    return F.when(token.rlike(pattern), F.struct(
        F.regexp_extract(token, pattern, 1).alias("category"),
        F.when(F.regexp_extract(token, pattern, 2) == "BOYS", "Male").otherwise("Female")
        .alias("gender")))


def _clean_tables(grid: DataFrame) -> DataFrame:
    """``with_table_header`` of cleaned cells: every row is cleaned once, headers too."""
    return with_table_header(grid.select(*ORDER, clean_cells("cells").alias("cells")))


def _melted(rows: DataFrame, wanted: Column) -> DataFrame:
    """An entry of ``_slots`` per row, as ``slot`` and ``_s``; both null if not ``wanted``.

    No filter: Spark would push it below the steps that made its columns and compute
    all of them again, once for each use in it.
    """
    return rows.withColumn("_slots", F.when(wanted, F.col("_slots"))) \
        .select("*", F.posexplode_outer("_slots").alias("slot", "_s"))


def last_rank_melt(grid: DataFrame) -> DataFrame:
    """Category x gender columns to rows; digits-only cells."""
    rows = _clean_tables(grid).withColumnRenamed("header", "h")
    placed = rows.select(
        *ORDER, "h", "cells",
        find_header("h", "institute name|inst.?name|inst_name").alias("i"),
        F.coalesce(find_header("h", "branch name"),
                   find_header("h", "branch.?code|branch_?code")).alias("b"),
        find_header("h", "^place$").alias("p"))
    ranked = F.filter(
        F.transform("h", lambda x, k: F.struct(k.alias("at"), last_rank_header(x).alias("head"))),
        lambda s: s["head"].isNotNull())
    need = F.greatest(F.array_max(F.transform("_slots", lambda s: s["at"])), "i",
                      F.coalesce("b", F.lit(0)), F.coalesce("p", F.lit(0)))
    melted = _melted(placed.withColumn("_slots", ranked),
                     F.col("i").isNotNull() & (F.size("_slots") > 0)
                     & (F.size("cells") > need) & (cell(F.col("cells"), F.col("i")) != ""))
    return melted.select(
        *ORDER, "slot", cell(F.col("cells"), F.col("p")).alias("City"),
        cell(F.col("cells"), F.col("i")).alias("Institute"),
        F.coalesce(cell(F.col("cells"), F.col("b")), F.lit("")).alias("Branch"),
        F.col("_s.head.category").alias("Category"), F.col("_s.head.gender").alias("Gender"),
        digits_only(cell(F.col("cells"), F.col("_s.at"))).alias("ClosingRank")) \
        .filter(F.col("ClosingRank").isNotNull())


# Community columns of the southern tables.
COMMUNITIES = ["OC", "BC", "BCM", "MBC", "SC", "SCA", "ST", "MBCDNC", "DNC", "BCO"]


def community_melt(grid: DataFrame) -> DataFrame:
    """One row per community column that holds a whole number."""
    rows = _clean_tables(grid).select(
        *ORDER, "cells", F.transform("header", lambda x: F.upper(x)).alias("h"))
    placed = rows.select("*", find_header("h", "COLLEGE NAME").alias("i"),
                         find_header("h", "BRANCH NAME").alias("b"))
    slots = F.filter(F.transform("h", lambda x, k: F.struct(k.alias("at"), x.alias("name"))),
                     lambda s: s["name"].isin(COMMUNITIES))
    need = F.greatest(F.array_max(F.transform("_slots", lambda s: s["at"])), "i")
    melted = _melted(placed.withColumn("_slots", slots),
                     F.col("i").isNotNull() & (F.size("_slots") > 0)
                     & (F.size("cells") > need) & (cell(F.col("cells"), F.col("i")) != ""))
    return melted.select(
        *ORDER, "slot", cell(F.col("cells"), F.col("i")).alias("Institute"),
        F.coalesce(cell(F.col("cells"), F.col("b")), F.lit("")).alias("Branch"),
        F.col("_s.name").alias("Category"),
        digits_only(cell(F.col("cells"), F.col("_s.at"))).alias("ClosingRank")) \
        .filter(F.col("ClosingRank").isNotNull())


def branch_header(header: Column) -> Column:
    """Branch label without its short code."""
    return squeeze(F.regexp_replace(squeeze(header), r"^[A-Z0-9]{1,3}\s*-\s*", ""))


def branch_melt(grid: DataFrame) -> DataFrame:
    """Branch columns (from the fourth on) of the college-code tables."""
    rows = _clean_tables(grid).withColumnRenamed("header", "h")
    slots = F.filter(F.transform("h", lambda x, k: F.struct(k.alias("at"), x.alias("name"))),
                     lambda s: (s["at"] >= 3) & (s["name"] != ""))
    melted = _melted(rows.withColumn("_slots", slots),
                     F.get("h", F.lit(0)).contains("College Code")
                     & (F.size("cells") >= 3) & (F.get("cells", F.lit(1)) != ""))
    return melted.select(
        *ORDER, "slot", F.get("cells", F.lit(1)).alias("Institute"),
        _or_null(branch_header(F.col("_s.name"))).alias("Branch"),
        _or_null(F.get("cells", F.lit(2))).alias("Category"),
        digits_only(cell(F.col("cells"), F.col("_s.at"))).alias("ClosingRank")) \
        .filter(F.col("ClosingRank").isNotNull())


# --- matrices under headings ---------------------------------------------------------
COLLEGE_LINE = r"(?U)^\s*\d+\s+([A-Z]\d{3,4})\s+(.+?)\s*$"
INSTITUTE_LINE = r"^([0-9]{5})\s*-\s*(.+?)\s*$"
COURSE_LINE = r"^([0-9]{10})\s*-\s*(.+?)\s*$"


def college_headings(lines: DataFrame) -> DataFrame:
    return lines.select("doc_id", "page", "line_idx", "top",
                        first_group(F.col("text"), COLLEGE_LINE, 2).alias("Institute")) \
        .filter(F.col("Institute").isNotNull())


def course_headings(lines: DataFrame) -> DataFrame:
    course = first_group(F.col("text"), COURSE_LINE, 2)
    read = lines.withColumn("Branch", course).select(
        "doc_id", "page", "line_idx", "top",
        F.when(F.col("Branch").isNull(), first_group(F.col("text"), INSTITUTE_LINE, 2))
        .alias("Institute"), "Branch")
    return keep_where(read, F.col("Institute").isNotNull() | F.col("Branch").isNotNull())


def _headed(tables: DataFrame, headings: DataFrame, values: list[str]) -> DataFrame:
    """``heading_above`` for tables that rows are joined to: those of no document have none.

    Said here, and not by that join alone, which would send it to one of the two uses of the
    sweep only; the two could then not share their shuffle.
    """
    named = F.col("doc_id").isNotNull()
    return heading_above(tables.filter(named), headings.filter(named), values)


def _matrix(grid: DataFrame, headed: DataFrame) -> DataFrame:
    """Cells below each header, with the table's heading and the column label."""
    rows = with_table_header(grid)
    plain = [c for c in headed.columns if c not in (*TABLE, "top")]
    joined = rows.join(headed.select(*TABLE, *plain), TABLE)
    pairs = F.arrays_zip(
        F.slice("header", 2, 1 << 30).alias("label"),
        F.slice("cells", 2, 1 << 30).alias("value"))
    return joined.select(*ORDER, *plain, F.get("cells", F.lit(0)).alias("first"),
                         F.least(F.size("header"), F.size("cells")).alias("_width"),
                         F.posexplode_outer(pairs).alias("slot", "_p")) \
        .filter(F.col("slot") < F.col("_width") - 1) \
        .select("*", F.col("_p.label").alias("label"), F.col("_p.value").alias("value")) \
        .drop("_p", "_width")


def headed_matrix(grid: DataFrame, lines: DataFrame, tables: DataFrame) -> DataFrame:
    """Branch x category matrix under a college heading."""
    headed = _headed(tables, college_headings(lines), ["Institute"])
    cells = _matrix(grid, headed.filter(F.col("Institute").isNotNull()))
    branch = F.trim(F.replace(F.coalesce("first", F.lit("")), F.lit("\n"), F.lit(" ")))
    return cells.select(
        *ORDER, "slot", "Institute", branch.alias("Branch"),
        F.trim(F.coalesce("label", F.lit(""))).alias("Category"),
        digits_only(F.trim(F.coalesce("value", F.lit("")))).alias("ClosingRank")) \
        .filter((F.col("Branch") != "") & F.col("ClosingRank").isNotNull())


def staged_matrix(grid: DataFrame, lines: DataFrame, tables: DataFrame,
                  round_label: str | Column) -> DataFrame:
    """Stage x category matrix under an institute and a course heading."""
    headed = _headed(tables, course_headings(lines), ["Institute", "Branch"])
    known = headed.filter(F.col("Institute").isNotNull() & F.col("Branch").isNotNull())
    cells = _matrix(grid, known)
    label = round_label if isinstance(round_label, Column) else F.lit(round_label)
    stage = F.trim(F.coalesce("first", F.lit("")))
    category = F.trim(F.replace(F.coalesce("label", F.lit("")), F.lit("\n"), F.lit("")))
    rank = first_group(F.col("value"), r"(?U)^\s*([0-9]+)").try_cast("bigint")
    return cells.select(
        *ORDER, "slot", "Institute", "Branch", category.alias("Category"),
        F.when(stage != "", F.concat(label, F.lit(" Stage "), stage)).otherwise(label)
        .alias("Round"), rank.alias("ClosingRank")) \
        .filter((F.col("Category") != "") & F.col("ClosingRank").isNotNull())


# Category columns and row markers of the sectioned matrix.
SECTION_CATEGORIES = ["SM", "EZ", "MU", "LA", "DV", "VK", "BH", "BX", "KN", "KU", "SC",
                      "ST", "EW", "FW", "DK", "KO", "BP", "GU", "TM"]
OWNERSHIP_MARKS = ["G", "A", "S", "P", "N"]


def sectioned_matrix(grid: DataFrame) -> DataFrame:
    """Matrix whose single-cell rows name the branch of the rows that follow."""
    clean = grid.select(*ORDER, clean_cells("cells").alias("cells"))
    filled = F.filter("cells", lambda c: c != "")
    is_head = F.exists("cells", lambda c: F.lower(c).contains("name of college"))
    slots = F.filter(
        F.transform("cells", lambda c, k: F.struct(k.alias("at"), F.upper(c).alias("code"))),
        lambda s: s["code"].isin(SECTION_CATEGORIES))
    section = ~F.col("_head") & (F.size("_filled") == 1) \
        & ~is_short_rank(F.get("_filled", F.lit(0)))
    marked = keep_where(clean.withColumns({"_filled": filled, "_head": is_head}),
                        F.size("_filled") > 0).withColumn("_section", section) \
        .withColumns({"_slots": F.when(F.col("_head"), slots),
                      "_name": F.when(F.col("_section"), F.get("_filled", F.lit(0)))}) \
        .drop("_filled")
    carried = carry_forward(marked, "doc_id", "page", ["table_idx", "row_idx"],
                            {"slots": F.col("_slots"), "Branch": F.col("_name")})
    names = F.filter("cells", lambda c: (c != "") & ~is_short_rank(c)
                     & ~F.upper(c).isin(OWNERSHIP_MARKS))
    # longest text cell; of equal lengths the first
    ranked = F.transform(names, lambda c, k: F.struct(F.length(c).alias("n"), (-k).alias("k"),
                                                      c.alias("c")))
    data = carried.filter(~F.col("_head") & ~F.col("_section") & (F.size("slots") > 0)) \
        .withColumn("Institute", F.array_max(ranked)["c"])
    melted = keep_where(data, F.length("Institute") >= 4).select(*ORDER, "Institute", F.coalesce("Branch", F.lit("")).alias("Branch"),
                         "cells", F.posexplode_outer("slots").alias("slot", "_s"))
    value = F.get("cells", F.col("_s.at"))
    return melted.filter(is_short_rank(value)).select(
        *ORDER, "slot", "Institute", "Branch", F.col("_s.code").alias("Category"),
        F.replace(value, F.lit(","), F.lit("")).try_cast("bigint").alias("ClosingRank"))


# --- allotments -------------------------------------------------------------------
# Header wording of the allotment list; the first hit per column.
ALLOTMENT_LABELS = [("rank", "cml rank"), ("Institute", "alloted institute"),
                    ("Branch", "alloted branch"), ("Category", "seat alloted category")]


def allotment_kinds(cells: Column) -> Column:
    """The field that each cell's wording names, "" for none."""
    low = F.transform(cells, lambda c: F.lower(c))
    return F.transform(low, lambda c: _first_wording(c))


def allotment_header(kinds: Column) -> Column:
    """struct(field -> position) of an allotment header, else null.

    ``kinds`` is a column made by ``allotment_kinds``: it is read several times. A later
    column with the same wording replaces an earlier one.
    """
    at = {}
    for field, _ in ALLOTMENT_LABELS:
        back = F.array_position(F.reverse(kinds), F.lit(field))
        at[field] = F.when(back > 0, (F.size(kinds) - back).cast("int"))
    return F.when(at["Institute"].isNotNull() & at["rank"].isNotNull(),
                  F.struct(*[c.alias(f) for f, c in at.items()]))


def _first_wording(c: Column) -> Column:
    out = None
    for field, wording in ALLOTMENT_LABELS:
        hit = c.contains(wording)
        out = F.when(hit, field) if out is None else out.when(hit, field)
    return out.otherwise("")


def allotment_rows(grid: DataFrame) -> DataFrame:
    """(Institute, Branch, Category, rank) of every allotted candidate."""
    clean = grid.select(*ORDER, clean_cells("cells").alias("cells"))
    marked = clean.withColumn("_kinds", allotment_kinds(F.col("cells"))) \
        .withColumn("_head", allotment_header(F.col("_kinds"))).drop("_kinds")
    carried = carry_forward(marked, "doc_id", "page", ["table_idx", "row_idx"],
                            {"at": F.col("_head")})
    at = F.col("at")
    last = F.greatest(*[F.coalesce(at[f], F.lit(0)) for f, _ in ALLOTMENT_LABELS])
    data = carried.filter(F.col("_head").isNull() & at.isNotNull()
                          & (F.size("cells") > last))
    return data.select(
        cell(F.col("cells"), at["Institute"]).alias("Institute"),
        F.coalesce(cell(F.col("cells"), at["Branch"]), F.lit("")).alias("Branch"),
        F.coalesce(cell(F.col("cells"), at["Category"]), F.lit("")).alias("Category"),
        digits_only(cell(F.col("cells"), at["rank"])).alias("rank")) \
        .filter((F.col("Institute") != "") & F.col("rank").isNotNull())


def allotment_cutoffs(rows: DataFrame) -> DataFrame:
    """Best and last allotted rank per seat group are its opening and closing rank."""
    return rows.groupBy("Institute", "Branch", "Category").agg(
        F.min("rank").alias("OpeningRank"), F.max("rank").alias("ClosingRank")) \
        .withColumns({"Branch": _or_null(F.col("Branch")),
                      "Category": _or_null(F.col("Category"))})


# --- borderless lines ---------------------------------------------------------------
# Header words in column order, and the middle columns' vocabularies.
LINE_HEADERS = ["INSTITUTE", "STREAM", "QUOTA", "CATEGORY", "SEAT", "OPENING", "CLOSING"]
_SEAT = r"(?i)(Gender Neutral|Female Only|Male Only|PWD)"
_SEAT_CATEGORY = r"(?i)\b(General|OBC[- ]?NCL|OBC|SEBC|SC|ST|EWS|PWD|PH|TFW|ESM|GC)\b"
_SEAT_QUOTA = r"\b(HS|OS|AI|NRI|GC)\b"


def _without(df: DataFrame, text: str, *parts: str) -> DataFrame:
    """``df`` with each part's first occurrence in ``text`` made a space.

    One step per part: as one expression, each part would repeat all those before it.
    """
    for part in parts:
        df = df.withColumn("_at", F.instr(text, F.coalesce(part, F.lit("\u0000")))).withColumn(
            text, F.when(F.col("_at") > 0, F.concat(
                F.substring(text, F.lit(1), F.col("_at") - 1), F.lit(" "),
                F.substring(text, F.col("_at") + F.length(part), F.lit(1 << 30))))
            .otherwise(F.col(text)))
    return df.drop("_at")


def _lines_of(words: DataFrame) -> DataFrame:
    """(doc_id, page, row_idx, _words): the words below a page's header, line by line.

    Words are shuffled once, by page: its header is found among its header words, which
    are few; then all words meet it in one join that sorts none of them. A word falls to
    the last header that starts at or left of it, ``_col``.
    """
    # what the words of a page have in common, its number and name, stands side by side
    # from one row to the next, which halves what is written
    dealt = deal(words.filter(F.col("doc_id").isNotNull() & F.col("page").isNotNull())
                 .select("page", "word_idx", "top", "x0", "text", "doc_id"), ["doc_id", "page"])
    names = F.array(*[F.lit(h) for h in LINE_HEADERS])
    heads = keep_where(dealt.withColumn("_h", F.array_position(names, F.upper("text")) - 1),
                       F.col("_h") >= 0).drop("text")
    first = F.min_by("top", F.when(F.col("_h") == 0, F.col("word_idx")))
    band = heads.withColumn("htop", first.over(Window.partitionBy("doc_id", "page"))) \
        .filter(F.col("top").between(F.col("htop") - 12, F.col("htop") + 6))
    anchors = band.groupBy("doc_id", "page").agg(F.max("htop").alias("htop"), *[
        F.min_by("x0", F.when(F.col("_h") == i, F.col("word_idx"))).alias(f"_x{i}")
        for i in range(len(LINE_HEADERS))])
    for i in range(len(LINE_HEADERS)):
        anchors = anchors.filter(F.col(f"_x{i}").isNotNull())
    # a plain comparison would send "top is not null" below the shuffle, on this side only,
    # and the two sides could no longer share it
    body = dealt.join(anchors.hint("shuffle_hash"), ["doc_id", "page"]) \
        .filter(F.coalesce(F.col("top") > F.col("htop") + 6, F.lit(False)))
    column = F.greatest(*[F.when(F.col("x0") >= F.col(f"_x{i}") - 4, F.lit(i))
                          for i in range(len(LINE_HEADERS))])
    return body.withColumns({"row_idx": F.rint("top").cast("int"), "_col": column}) \
        .filter(F.col("_col").isNotNull()) \
        .groupBy("doc_id", "page", "row_idx") \
        .agg(F.sort_array(F.collect_list(F.struct("x0", "word_idx", "_col", "text")))
             .alias("_words"))


def borderless_rows(words: DataFrame) -> DataFrame:
    """Positioned words to records: words fall to the header at or left of them.

    Headers are found per page; quota, category and seat type bleed together in
    the middle, so they are read from the joined text by vocabulary and what is
    left belongs to the branch.
    """
    def joined(i: int) -> Column:
        return F.expr(f"trim(array_join(filter(_words, w -> w._col = {i}).text, ' '))")

    cells = _lines_of(words).select("doc_id", "page", "row_idx",
                                    *[joined(i).alias(f"_c{i}") for i in range(7)])
    ranked = keep_where(cells.withColumn(
        "ClosingRank", first_group(F.col("_c6"), "^([0-9]+)").try_cast("bigint")),
        (F.col("_c0") != "") & F.col("ClosingRank").isNotNull())
    blob = F.trim(F.concat_ws(" ", *[_or_null(F.col(f"_c{i}")) for i in (2, 3, 4)]))
    parts = ranked.withColumn("_left", blob).withColumns({
        "_seat": first_group(F.col("_left"), _SEAT),
        "Category": first_group(F.col("_left"), _SEAT_CATEGORY),
        "Quota": first_group(F.col("_left"), _SEAT_QUOTA)})
    return _without(parts, "_left", "_seat", "Category", "Quota") \
        .withColumn("_left", squeeze(F.col("_left"))).select(
        "doc_id", "page", F.lit(0).alias("table_idx"), "row_idx",
        F.col("_c0").alias("Institute"),
        F.nullif(F.concat_ws(" ", _or_null(F.col("_c1")), _or_null(F.col("_left"))), F.lit(""))
        .alias("Branch"),
        "Quota", "Category",
        F.coalesce(lookup(F.lower("_seat"), LINE_GENDER), F.col("_seat")).alias("Gender"),
        first_group(F.col("_c5"), "^([0-9]+)").try_cast("bigint").alias("OpeningRank"),
        "ClosingRank")
