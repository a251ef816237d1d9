"""Cleaning, classification, de-duplication and dataset-building queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.catalogue.bridge import (
    GROUP_CASE, canonical, canonical_for_distinct, canonical_of, star, table, with_star,
)
from rankloom.catalogue.registry import query
from rankloom.functions import classify
from rankloom.functions.rules import ladder
from rankloom.functions.text import dedouble, looks_doubled, squeeze
from rankloom.operators.conform import dedouble_rows as repair_rows
from rankloom.operators.conform import deliverable, enrich, normalize
from rankloom.operators.dedup import keep_first, keep_last
from rankloom.plans.ingest import combine, scale_years
from rankloom.schema import CANON_COLUMNS, SNAPSHOT_COLUMNS, deliverable_columns
from rankloom.sources.bodies import BODIES, Body, snapshot_rows
from rankloom.sources.registry import SourceMeta, SourceRegistry, SourceSpec

_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
_KEYS = ", ".join(_KEY)


def _doubled(column: str):
    return F.regexp_replace(F.col(column), r"(?s)(.)", "$1$1")


@query("normalize_ranks", with_star(f"""
  SELECT {_KEYS}, "Institute", "Branch", "City", "Year", CASE l_linenumber
    WHEN 1 THEN "ClosingRank" WHEN 2 THEN "ClosingRank" + "ClosingRank" % 2
    WHEN 5 THEN "ClosingRank" * 10 WHEN 7 THEN "ClosingRank" END AS "ClosingRank",
    CASE WHEN l_linenumber = 1 THEN "OpeningRank" END AS "OpeningRank"
  FROM star"""))
def normalize_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messy text in, canonical types out; a column short and a column over."""
    n = F.col("l_linenumber")
    closing = F.col("ClosingRank").cast("string")
    rows = canonical(spark, sf_dir, *_KEY)
    messy = rows.withColumns({
        "Institute": F.concat(F.lit("  "), F.replace("Institute", F.lit(" "),
                                                          F.lit(" \n ")), F.lit("\t")),
        "Branch": F.concat(F.lit(" "), "Branch"),
        "Year": F.col("Year").cast("double"),
        "ClosingRank": ladder([
            (n == 1, F.concat(F.lit(" "), F.format_number("ClosingRank", 0), F.lit(" "))),
            (n == 2, F.concat(closing, F.lit(".5"))), (n == 3, F.lit("NA")),
            (n == 4, F.concat(closing, F.lit("d"))), (n == 5, F.concat(closing, F.lit("e1"))),
            (n == 6, F.lit("-"))], closing),
        "OpeningRank": F.when(n == 1, F.col("OpeningRank").cast("string")).otherwise("bad"),
        "extra": F.lit("dropped")}).drop("City")
    return normalize(messy, _KEY).select(*_KEY, "Institute", "Branch", "City", "Year",
                                         "OpeningRank", "ClosingRank")


@query("dedouble_roundtrip", """
  SELECT p_partkey, p_name || ', ' || p_brand AS repaired, p_name AS untouched,
    true AS was_doubled FROM part""")
def dedouble_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part") \
        .withColumn("label", F.concat("p_name", F.lit(", "), "p_brand")) \
        .withColumn("twice", _doubled("label"))
    return part.select("p_partkey", dedouble("twice").alias("repaired"),
                       dedouble("p_name").alias("untouched"),
                       looks_doubled("twice").alias("was_doubled"))


@query("document_text", """
  WITH c AS (SELECT doc_id, text, string_split(text, '') AS g FROM documents),
  f AS (SELECT doc_id, text, len(g) AS n, g,
    len(list_filter(list_zip(g[1:len(g) - 1], g[2:]), lambda p: p[1] = p[2])) AS near,
    len(list_filter(list_zip(g[1:len(g):2], g[2:len(g):2]), lambda p: p[1] = p[2])) AS pairs
    FROM c)
  SELECT doc_id,
    (n >= 4 AND n % 2 = 0 AND pairs * 2 = n) OR (n >= 8 AND near >= (n - 1) * 0.4) AS doubled,
    CAST(length(t) AS BIGINT) AS n_chars, md5(t) AS digest
  FROM (SELECT *, trim(regexp_replace(text,
    '[\\s\\x{0B}\\x{1C}-\\x{1F}\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+',
    ' ', 'g')) AS t FROM f)""")
def document_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Doubling test and whitespace repair over whole documents."""
    text = squeeze(F.col("text"))
    return table(spark, sf_dir, "documents").select(
        "doc_id", looks_doubled("text").alias("doubled"),
        F.length(text).cast("bigint").alias("n_chars"), F.md5(text).alias("digest"))


@query("dedouble_rows", with_star(f"""
  SELECT {_KEYS}, "Institute", "Branch", "Category", "ClosingRank" FROM star"""))
def dedouble_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Undergraduate rows come with every glyph twice, rank digits included."""
    rows = canonical(spark, sf_dir, *_KEY) \
        .withColumn("ClosingRank", F.col("ClosingRank").cast("string"))
    twice = F.col("Level") == "UG"
    broken = rows.withColumns({
        c: F.when(twice, _doubled(c)).otherwise(F.col(c))
        for c in ("Institute", "Branch", "Category", "ClosingRank")})
    repaired = repair_rows(broken, ["Institute", "Branch", "Gender"])
    return normalize(repaired, _KEY).select(
        *_KEY, "Institute", "Branch", "Category", "ClosingRank")


@query("city", """
  SELECT c_custkey, CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'Nation_'
    WHEN 'BUILDING' THEN 'New-Building' WHEN 'HOUSEHOLD' THEN 'Nation_'
    WHEN 'MACHINERY' THEN 'Jaipur' END AS city FROM customer""")
def city(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = table(spark, sf_dir, "customer").join(
        table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    segment = F.col("c_mktsegment")
    institute = ladder([
        (segment == "AUTOMOBILE", F.concat("c_name", F.lit(" Polytechnic, "), F.lower("n_name"),
                                           F.lit("-700037 (WB)"))),
        (segment == "BUILDING", F.concat(F.lit("009-Govt. College, Old Road, New-"),
                                         F.lower(segment))),
        (segment == "FURNITURE", F.concat("n_name", F.lit(" College of Engineering"))),
        (segment == "HOUSEHOLD", F.concat(F.lit("Indian Institute of Technology "), "n_name")),
    ], F.lit("CCoolllleeggee,,\nJJaaiippuurr"))
    return classify.with_city(people, institute, "city").select("c_custkey", "city")


@query("program", """
  SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN CASE WHEN p_type = 'PROMO' THEN 'M.Arch'
      ELSE 'B.Arch' END
    WHEN 1 THEN CASE WHEN p_type = 'PROMO' THEN 'M.Pharm' ELSE 'B.Pharm' END
    WHEN 2 THEN 'BAMS' WHEN 3 THEN 'B.Sc (Agriculture & allied)'
    ELSE CASE p_type WHEN 'PROMO' THEN 'M.Tech' WHEN 'SMALL' THEN 'Diploma'
      ELSE 'B.E./B.Tech' END END AS program FROM part""")
def program(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size") % 5
    branch = F.concat("p_name", F.lit(" "), ladder([
        (size == 0, "ARCHITECTURE (C)"), (size == 1, "Pharmacy"), (size == 2, "BA- BAMS"),
        (size == 3, "B.Sc. (Hons.) Horticulture")], ""))
    level = ladder([(F.col("p_type") == "PROMO", "pg"), (F.col("p_type") == "SMALL", "DIPLOMA")],
                   "UG")
    return table(spark, sf_dir, "part").select(
        "p_partkey", classify.program_of(level, branch).alias("program"))


# Published codes of several bodies and the group each belongs to.
CODE_GROUPS = [
    ("OPEN", "General"), ("gm", "General"), ("GMRH", "General"), ("TFWS", "General"),
    ("OPEN(PH)", "General"), ("GEN-PH", "General"), ("OPDF", "General"), ("EZ", "OBC"),
    ("2AG", "OBC"), ("3BK", "OBC"), ("GVJS", "OBC"), ("GNT1S", "OBC"), ("BC(Girl)", "OBC"),
    ("MBC", "OBC"), ("BC-II", "OBC"), ("SCKH", "SC"), ("GSCS", "SC"), ("SCIII", "SC"),
    ("SCA", "SC"), ("STH", "ST"), ("GSTS", "ST"), ("OCEWS", "EWS"), ("EWS(GL)", "EWS"),
    ("EWNO", "EWS"), ("PwD", "PwD"), ("STATE", "Other"), ("BH", "Other"),
    ("Unspecified", "Unspecified"), ("", "Unspecified"), ("OC", "General"),
]


@query("category_group", "SELECT o_orderkey, CASE o_orderkey % {} {} END AS grp FROM orders".format(
    len(CODE_GROUPS), " ".join(f"WHEN {i} THEN '{g}'" for i, (_, g) in enumerate(CODE_GROUPS))))
def category_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    slot = F.col("o_orderkey") % len(CODE_GROUPS)
    code = ladder([(slot == i, c) for i, (c, _) in enumerate(CODE_GROUPS)])
    return classify.with_category_group(table(spark, sf_dir, "orders"), code, "grp") \
        .select("o_orderkey", "grp")


# Exam wordings with their discipline, level and state.
EXAM_WORDINGS = [
    ("Kerala Law Entrance Examination", "Law", "UG", "Kerala"),
    ("Andhra Pradesh Polytechnic Entrance Test", "Polytechnic & Diploma", "Diploma",
     "Andhra Pradesh"),
    ("National Institute of Fashion Technology", "Design", "UG", "All India"),
    ("Bihar Engineering Entrance Examination", "Engineering & Technology", "UG", "Bihar"),
    ("All India Veterinary Entrance Test", "Veterinary", "UG", "All India"),
    ("Andhra Pradesh Engineering and Agriculture and Pharmacy Common Entrance Test",
     "Engineering & Technology", "UG", "Andhra Pradesh"),
    ("Galileo Global Distribution System course", "Aviation & Maritime", "UG", "All India"),
    ("Indian Institute of Foreign Trade", "Management", "UG", "All India"),
    ("Rashtriya Raksha University (Police)", "Defence & Security", "UG", "All India"),
    ("Chartered Accountancy Final", "Accountancy & Finance", "Certification", "All India"),
    ("Company Secretary Executive", "Accountancy & Finance", "Certification", "All India"),
    ("Jawaharlal Institute of Postgraduate Nursing", "Nursing", "UG", "All India"),
    ("West Bengal Joint Entrance Examination", "Engineering & Technology", "UG", "West Bengal"),
    ("Guru Gobind Singh Indraprastha University", "Multidisciplinary / University", "UG",
     "Delhi"),
    ("Cochin University MBA", "Management", "PG", "Kerala"),
    ("School of disaster management", "Multidisciplinary / University", "UG", "All India"),
    ("Pune Master of Arts", "Multidisciplinary / University", "PG", "Maharashtra"),
]


def _wording_case(column: int, name: str) -> str:
    cases = " ".join(f"WHEN {i} THEN '{w[column]}'" for i, w in enumerate(EXAM_WORDINGS))
    return f"CASE o_orderkey % {len(EXAM_WORDINGS)} {cases} END AS {name}"


@query("exam_classes", f"""
  SELECT o_orderkey, {_wording_case(1, 'category')}, {_wording_case(2, 'level')},
    {_wording_case(3, 'state')} FROM orders""")
def exam_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    slot = F.col("o_orderkey") % len(EXAM_WORDINGS)
    name = F.concat(ladder([(slot == i, w[0]) for i, w in enumerate(EXAM_WORDINGS)]),
                    F.lit(" "), "o_orderkey")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", classify.exam_category(name).alias("category"),
        classify.exam_level(name).alias("level"), classify.exam_state(name).alias("state"))


_FIRST_KEY = ["Institute", "Branch", "Category", "Year"]


def _ranked_sql(direction: str) -> str:
    order = ", ".join(f"{k} {direction}" for k in _KEY)
    return with_star(f"""
      SELECT {_KEYS}, "Institute", "Branch", "Category", "Year", "ClosingRank" FROM star
      QUALIFY row_number() OVER (PARTITION BY "Institute", "Branch", "Category", "Year"
        ORDER BY {order}) = 1""")


@query("keep_first", _ranked_sql("ASC"))
def first_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = canonical(spark, sf_dir, *_KEY).select(*_KEY, *_FIRST_KEY, "ClosingRank")
    return keep_first(rows, [*_FIRST_KEY, "NoSuchColumn"], _KEY)


@query("keep_last", _ranked_sql("DESC"))
def last_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = canonical(spark, sf_dir, *_KEY).select(*_KEY, *_FIRST_KEY, "ClosingRank")
    return keep_last(rows, _FIRST_KEY, _KEY)


@query("distinct_union", with_star("""
  SELECT DISTINCT "Body", "Exam", "Institute", "Branch", "Year", "OpeningRank" IS NULL AS no_opening
  FROM star"""))
def distinct_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two overlapping halves; null equals null."""
    rows = canonical(spark, sf_dir).select(
        "Body", "Exam", "Institute", "Branch", "Year", "Level",
        F.col("OpeningRank").isNull().alias("no_opening"))
    low = rows.filter(F.col("Level").isin("UG", "PG"))
    high = rows.filter(F.col("Level").isin("PG", "Diploma"))
    return low.unionByName(high).drop("Level").dropDuplicates()


_PROGRAM_CASE = """CASE "Level" WHEN 'Diploma' THEN 'Diploma' WHEN 'PG' THEN 'M.Tech'
  ELSE 'B.E./B.Tech' END"""


def _enriched_list() -> str:
    over = {"City": "'Nation_'", "Program": _PROGRAM_CASE, "CategoryGroup": GROUP_CASE}
    return ", ".join(f'{over[c]} AS "{c}"' if c in over else f'"{c}"' for c in CANON_COLUMNS)


@query("enrich", with_star(f"SELECT {_enriched_list()} FROM star"))
def enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich(canonical(spark, sf_dir), "https://example.org/", "")


@query("ingest_run", with_star("SELECT DISTINCT " + _enriched_list().replace(
    '"Website"', """CASE WHEN "Body" IN ('AFRICA', 'ASIA') THEN 'https://south.example.org/'
      ELSE 'https://north.example.org/' END AS "Website" """) + " FROM star"))
def ingest_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three sources, the third overlapping the first, through the whole build."""
    registry = SourceRegistry()

    def slice_of(condition):
        return lambda s: canonical(s, sf_dir).filter(condition).drop("Website")

    south = F.col("Body").isin("AFRICA", "ASIA")
    for name, condition, site in [
            ("south", south, "https://south.example.org/"),
            ("north", ~south, "https://north.example.org/"),
            ("africa", F.col("Body") == "AFRICA", "https://south.example.org/")]:
        registry.register(SourceSpec(
            SourceMeta(name, exam="", level="UG", website=site), slice_of(condition)))
    return combine(spark, registry.all())


def _deliverable_sql(category: bool) -> str:
    names = ", ".join(f'"{c}" AS "{label}"' for c, label in deliverable_columns(category))
    return with_star(f"SELECT DISTINCT {names} FROM star")


@query("deliverable", _deliverable_sql(False))
def client_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deliverable(canonical_for_distinct(spark, sf_dir))


@query("deliverable_category", _deliverable_sql(True))
def client_table_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deliverable(canonical_for_distinct(spark, sf_dir), include_category=True)


@query("snapshot_years", with_star(f"""
  SELECT {_KEYS}, y AS "Year",
    CAST(round_even("OpeningRank" * f, 0) AS BIGINT) AS "OpeningRank",
    CAST(round_even("ClosingRank" * f, 0) AS BIGINT) AS "ClosingRank"
  FROM star, (VALUES (CAST(2024 AS BIGINT), CAST(1.0 AS DOUBLE)), (2023, 0.5), (2022, 1.25)) t(y, f)"""))
def snapshot_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = canonical_of(star(spark, sf_dir), *_KEY)
    years = scale_years(rows, {2024: 1.0, 2023: 0.5, 2022: 1.25}, ["OpeningRank", "ClosingRank"])
    return years.select(*_KEY, "Year", "OpeningRank", "ClosingRank")


# --- the registered bodies -----------------------------------------------------
# Snapshot columns of line items; each body gets the orders of its number.
_SNAPSHOT = {
    "Body": "'x'", "Exam": "'E'", "Level": "'UG'", "State": "'S'",
    "Year": "if(l_linenumber = 2, '', '2024')", "Round": "cast(l_linenumber as string)",
    "Institute": "concat(' College ', l_suppkey % 10)", "Branch": "concat('Branch ', l_partkey % 7)",
    "Category": "if(l_linenumber = 1, 'NA', 'OPEN')", "Quota": "l_returnflag",
    "Gender": "l_linestatus", "OpeningRank": "''", "ClosingRank": "concat(cast(l_quantity as int), '.0')",
}
_LINES_SQL = """
  SELECT l_orderkey % 19 AS k, CASE WHEN l_linenumber <> 2 THEN 2024 END AS "Year",
    CAST(l_linenumber AS VARCHAR) AS "Round", 'College ' || l_suppkey % 10 AS "Institute",
    'Branch ' || l_partkey % 7 AS "Branch", CASE WHEN l_linenumber <> 1 THEN 'OPEN' END AS "Category",
    l_returnflag AS "Quota", l_linestatus AS "Gender", 'x' AS "Program",
    CAST(NULL AS BIGINT) AS "OpeningRank", CAST(l_quantity AS BIGINT) AS "ClosingRank"
  FROM lineitem"""


def _body_sql(number: int, body: Body) -> str:
    """Rows a body's snapshot must give: distinct on its key, repairs applied."""
    name = body.meta.name
    rows = f"(SELECT * FROM lines WHERE k = {number})" if not body.key else \
        "(SELECT DISTINCT {} FROM lines WHERE k = {})".format(
            ", ".join(f'"{c}"' for c in body.key if c != "Program"), number)
    named = name in ("rajpoly", "keralavet", "icar", "bihareng")
    filled = name == "biharpoly"
    unspecified = 'count_if("Category" IS NULL)' if named else "0"
    label = f"'{body.meta.body_label}'" if named or filled else "'x'"
    return f"""SELECT '{name}' AS source, {label} AS body, count(*) AS n,
      CAST(sum("ClosingRank") AS BIGINT) AS closing,
      {unspecified} AS unspecified, {'count_if("Year" IS NULL)' if filled else "0"} AS filled_years
      FROM {rows}"""


@query("source_snapshots", f"WITH lines AS ({_LINES_SQL})\n" + "\nUNION ALL ".join(
    _body_sql(i, b) for i, b in enumerate(BODIES)))
def source_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every registered body's snapshot: repairs, labels, keep-first."""
    lines = table(spark, sf_dir, "lineitem")
    out = None
    for i, body in enumerate(BODIES):
        raw = lines.filter(F.col("l_orderkey") % 19 == i).selectExpr(
            *[f"{_SNAPSHOT.get(c, "''")} as {c}" for c in SNAPSHOT_COLUMNS]) \
            .select([F.when(~F.col(c).isin("", "NA"), F.col(c)).alias(c) for c in SNAPSHOT_COLUMNS])
        rows = snapshot_rows(body, raw).agg(
            F.lit(body.meta.name).alias("source"), F.max("Body").alias("body"),
            F.count(F.lit(1)).alias("n"), F.sum("ClosingRank").alias("closing"),
            F.count_if(F.col("Category") == "Unspecified").cast("int").alias("unspecified"),
            F.count_if(F.col("Year") == 2025).cast("int").alias("filled_years"))
        out = rows if out is None else out.unionByName(rows)
    return out


# Codes put together from a stem and a tail; the check states the rules a second time.
_STEMS = ["GM", "SC", "ST", "1", "2A", "3B", "OBC", "EWS", "OPEN", "UR", "PH", "GOPEN", "LSC",
          "LST", "GNT1", "LVJ", "TFW", "SCI", "MBCDNC", "BCM", "E-UR", "XYZ", "Scheduled Caste",
          "backward", "na", "", "OC", "DEFR"]
_TAILS = ["", "G", "KH", "S", "O", "-PH", " (W)", "H"]
_WORDS = "'{}'".format


@query("category_vocabulary", f"""
  WITH raw AS (SELECT o_orderkey, [{", ".join(map(_WORDS, _STEMS))}][o_orderkey % {len(_STEMS)} + 1]
      || [{", ".join(map(_WORDS, _TAILS))}][o_custkey % {len(_TAILS)} + 1] AS code FROM orders),
  c AS (SELECT o_orderkey, trim(regexp_replace(trim(regexp_replace(upper(trim(code)),
      '\\s*\\([^)]*\\)\\s*', '', 'g')), '-(PH|PWD|PWBD|VI|HI)$', '')) AS c FROM raw)
  SELECT o_orderkey, CASE
    WHEN c IN ('', 'UNSPECIFIED', 'UNKNOWN', 'NA', 'N/A', '-') THEN 'Unspecified'
    WHEN c LIKE '%EWS%' OR c LIKE 'EW%' OR c IN ('E-UR', 'EUR') THEN 'EWS'
    WHEN c = 'SC' OR c LIKE '%SCHEDULED CASTE%' THEN 'SC'
    WHEN c = 'ST' OR c LIKE '%SCHEDULED TRIBE%' THEN 'ST'
    WHEN c LIKE '%OBC%' OR c LIKE '%BACKWARD%' OR c LIKE '%SEBC%' OR c LIKE 'BC%'
      OR c IN ('MBC', 'EZ', 'MU') THEN 'OBC'
    WHEN c LIKE '%GENERAL%' OR c LIKE '%OPEN%' OR c LIKE 'OP%'
      OR c IN ('UR', 'GM', 'GEN', 'SM', 'UNRESERVED') THEN 'General'
    WHEN c LIKE '%PWD%' OR c IN ('PH', 'PD', 'DV') THEN 'PwD'
    WHEN regexp_full_match(c, 'GM(G|K|R|H|KH|RH)') THEN 'General'
    WHEN regexp_full_match(c, 'SC(G|K|R|H|KH|RH)') THEN 'SC'
    WHEN regexp_full_match(c, 'ST(G|K|R|H|KH|RH)') THEN 'ST'
    WHEN regexp_full_match(c, '(1|2A|2B|3A|3B)(G|K|R|H|KH|RH)?') THEN 'OBC'
    WHEN length(c) > 3 AND right(c, 1) IN ('S', 'H', 'O') AND regexp_matches(c, 'TFW|DEF')
      THEN 'General'
    WHEN length(c) > 3 AND right(c, 1) IN ('S', 'H', 'O')
      AND regexp_matches(c, 'VJ|NT1|NT2|NT3') THEN 'OBC'
    WHEN length(c) > 3 AND right(c, 1) IN ('S', 'H', 'O') AND c LIKE '%SC%' THEN 'SC'
    WHEN length(c) > 3 AND right(c, 1) IN ('S', 'H', 'O') AND c LIKE '%ST%' THEN 'ST'
    WHEN c = 'OC' THEN 'General' WHEN c IN ('SCI', 'SCII', 'SCIII', 'SCA') THEN 'SC'
    WHEN c IN ('MBCDNC', 'DNC', 'BCO') THEN 'OBC' ELSE 'Other' END AS grp FROM c""")
def category_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stem of the vocabularies with every tail."""
    def pick(words: list[str], key: str):
        return F.element_at(F.array(*map(F.lit, words)), (F.col(key) % len(words) + 1).cast("int"))
    code = F.concat(pick(_STEMS, "o_orderkey"), pick(_TAILS, "o_custkey"))
    return classify.with_category_group(table(spark, sf_dir, "orders"), code, "grp") \
        .select("o_orderkey", "grp")
