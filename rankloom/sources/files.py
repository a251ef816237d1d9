"""File readers with explicit schemas: nothing is inferred."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from rankloom.functions.text import catalog_text, strip
from rankloom.operators.dedup import (
    POSITION, keep_first, keep_last, position, with_file_order,
)
from rankloom.schema import (
    CANON, LINK_COLUMNS, RAW, SEGMENT, SNAPSHOT_COLUMNS, empty_canonical,
)

# Cell texts a snapshot reader takes for missing.
NA_TOKENS = ["", " ", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
             "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
             "nan", "null"]


def path_exists(spark: SparkSession, path: str) -> bool:
    """Does a path (any file system Spark knows) or glob match something?"""
    try:
        spark.read.format("binaryFile").load(path).schema
        return True
    except AnalysisException:
        return False


def text_schema(columns: list[str]) -> StructType:
    return StructType([StructField(c, StringType()) for c in columns])


def read_text_csv(spark: SparkSession, path: str, columns: list[str],
                  multi_line: bool = True) -> DataFrame:
    """Header CSV as text. Doubled quotes are honoured.

    With ``multi_line`` quoted line breaks are too, and a file is one task;
    without it Spark splits large files.
    """
    return spark.read.csv(path, schema=text_schema(columns), header=True, multiLine=multi_line,
                          quote='"', escape='"', enforceSchema=False, encoding="UTF-8")


def reading_order(df: DataFrame, name: str = "_seq") -> DataFrame:
    """Position of a row of a file scan: file, block in the file, place in the block."""
    return df.withColumn(name, F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row")))


def read_snapshot(spark: SparkSession, path: str, columns: list[str] = SNAPSHOT_COLUMNS,
                  multi_line: bool = False, ordered: bool = False) -> DataFrame:
    """Snapshot (plain or gzip): all text, missing tokens to null, split where plain.

    ``multi_line`` is for snapshots with line breaks inside quotes; ``ordered``
    adds the rows' position as ``_seq``.
    """
    df = read_text_csv(spark, path, columns, multi_line)
    if ordered:
        df = reading_order(df)
    return df.select([F.when(~F.col(c).isin(NA_TOKENS), F.col(c)).alias(c) for c in columns]
                     + (["_seq"] if ordered else []))


def read_sheet(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Curated sheet: every value stripped, null is "", no missing tokens."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], text_schema(columns))
    df = read_text_csv(spark, path, columns)
    return df.select([strip(F.coalesce(F.col(c), F.lit(""))).alias(c) for c in columns])


def read_canonical(spark: SparkSession, path: str, renormalize: bool = True) -> DataFrame:
    """Canonical Parquet; a missing path is the empty table."""
    from rankloom.operators.conform import normalize

    if not path_exists(spark, path):
        return empty_canonical(spark)
    df = spark.read.schema(CANON).parquet(path).select(*CANON.names)
    return normalize(df) if renormalize else df


def read_raw_tables(spark: SparkSession, path: str, foreign: bool = False) -> DataFrame:
    """Raw third-party Parquet files with their file and row order attached.

    ``foreign`` files were not written by this library: their own columns are read and
    conformed, so a column of another type is cast and does not break the scan.
    """
    from rankloom.operators.conform import conform_to

    if not foreign:
        return with_file_order(spark.read.schema(RAW).parquet(path))
    rows = with_file_order(spark.read.option("mergeSchema", True).parquet(path))
    return conform_to(rows, RAW, ("_file", "_row"))


# --- sheets --------------------------------------------------------------------
UNIVERSE_COLUMNS = ["Exam", "Homepage", "CutoffURL"]
LINK_SHEET_COLUMNS = ["Exam", "CutoffStatus", *LINK_COLUMNS]


def read_exam_sheets(spark: SparkSession, universe: str, links: str,
                     ) -> tuple[DataFrame, DataFrame]:
    """The exam universe, and the links sheet with its last row per exam."""
    rows = read_sheet(spark, universe, UNIVERSE_COLUMNS)
    if not path_exists(spark, links):
        return rows, read_sheet(spark, links, LINK_SHEET_COLUMNS)
    sheet = reading_order(read_text_csv(spark, links, LINK_SHEET_COLUMNS)).select(
        *[strip(F.coalesce(F.col(c), F.lit(""))).alias(c) for c in LINK_SHEET_COLUMNS], "_seq")
    return rows, keep_last(sheet.filter(F.col("Exam") != ""), ["Exam"], ["_seq"]).drop("_seq")


def read_ordered(spark: SparkSession, path: str, schema: str | StructType | None = None
                 ) -> DataFrame:
    """Parquet rows with their position ``_seq``: file, then row in the file."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.parquet(path).withColumn(POSITION, F.struct(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")))


def last_by_key(df: DataFrame, key: str) -> DataFrame:
    """Last row per key by ``_seq``; a frame without it is taken in the order Spark reads it."""
    if POSITION not in df.columns:
        df = df.withColumn(POSITION, F.monotonically_increasing_id())
    return keep_last(df, [key], [POSITION]).drop(POSITION)


# Headings of the spreadsheet variant of the links sheet.
EXTRAS_RENAMES = {"Exam Name": "Exam", "Status of cutoff": "CutoffStatus",
                  "Collge duniya": "CollegeDunia", "Career 360": "Careers360",
                  "collge dekho": "CollegeDekho"}


def tidy_extras(sheet: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Links sheet for the catalog: cleaned, leaked header dropped, first row wins."""
    df = sheet.withColumnsRenamed(EXTRAS_RENAMES)
    if order is None:
        if POSITION not in df.columns:
            df = df.withColumn(POSITION, F.monotonically_increasing_id())
        order = [POSITION]
    cols = [(catalog_text(F.col(c)) if c in df.columns else F.lit("")).alias(c)
            for c in LINK_SHEET_COLUMNS]
    df = df.select(*cols, *order).filter(F.col("Exam") != "Exam Name")
    return keep_first(df, ["Exam"], order).select(*LINK_SHEET_COLUMNS)


def probe_buckets(probe: DataFrame, order: list[str] | None = None) -> DataFrame:
    """(url, bucket), trimmed, blank urls dropped, last row per url."""
    df = probe.select(strip(F.col("url")).alias("url"),
                      strip(F.coalesce("bucket", F.lit(""))).alias("bucket"),
                      *(order or position(probe))) \
        .filter(F.coalesce(F.col("url"), F.lit("")) != "")
    return keep_last(df, ["url"], order).drop(*order) if order else last_by_key(df, "url")


def as_flag(c: Column) -> Column:
    return F.lower(strip(F.coalesce(c.cast("string"), F.lit("")))).isin("true", "1", "yes")


def read_segmentation(spark: SparkSession, path: str) -> DataFrame:
    """The partition table, typed back from its text file."""
    text = read_sheet(spark, path, SEGMENT.names)
    return text.select(*[
        as_flag(F.col(f.name)).alias(f.name) if f.dataType.simpleString() == "boolean"
        else F.coalesce(F.col(f.name).try_cast("int"), F.lit(0)).alias(f.name)
        if f.dataType.simpleString() == "int" else F.col(f.name)
        for f in SEGMENT.fields])


# --- JSON ----------------------------------------------------------------------
def read_envelope(spark: SparkSession, path: str, record_ddl: str) -> DataFrame:
    """Records of a JSON file: a list, {records}, or {result: {records}}."""
    whole = spark.read.text(path, wholetext=True)
    return unwrap_records(whole, "value", record_ddl)


def unwrap_records(df: DataFrame, column: str, record_ddl: str,
                   keep: tuple[str, ...] = ()) -> DataFrame:
    """Explode the record list of a JSON text column; malformed text gives nothing."""
    body = F.try_parse_json(F.col(column))
    records = F.coalesce(
        F.to_json(F.try_variant_get(body, "$.result.records", "variant")),
        F.to_json(F.try_variant_get(body, "$.records", "variant")),
        F.when(F.trim(F.col(column)).startswith("["), F.col(column)))
    parsed = F.from_json(records, f"array<struct<{record_ddl}>>")
    return df.select(*keep, F.inline(parsed))


def read_exam_batches(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(dir_order, file, exam, payload) of exam-keyed JSON batch files.

    Two steps on purpose: parsing straight into structs would lose a whole file
    over one value that is not an object.
    """
    parts = []
    for i, path in enumerate(paths):
        if not path_exists(spark, path):
            continue
        df = spark.read.option("pathGlobFilter", "batch_*.json").text(path, wholetext=True)
        parts.append(df.select(F.lit(i).alias("dir_order"),
                               F.col("_metadata.file_name").alias("file"), "value"))
    if not parts:
        return spark.createDataFrame(
            [], "dir_order int, file string, pos int, exam string, payload string")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return exam_payloads(out, "value", ["dir_order", "file"])


def exam_payloads(df: DataFrame, column: str, keep: list[str]) -> DataFrame:
    """Explode {exam: object}; values that are not objects are skipped."""
    entries = F.map_entries(F.from_json(F.col(column), "map<string,string>"))
    return df.select(*keep, F.posexplode(entries).alias("pos", "_entry")) \
        .select(*keep, "pos", F.col("_entry.key").alias("exam"),
                F.col("_entry.value").alias("payload")) \
        .filter(F.ltrim(F.col("payload")).startswith("{"))


def read_fidelity(spark: SparkSession, path: str) -> DataFrame:
    """(exam, fidelity, drop) verdicts; a missing file gives none."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], "exam string, fidelity string, drop boolean")
    whole = spark.read.text(path, wholetext=True)
    rows = exam_payloads(whole, "value", [])
    verdict = F.from_json("payload", "fidelity string, drop boolean, note string")
    return rows.select("exam", verdict["fidelity"].alias("fidelity"),
                       F.coalesce(verdict["drop"], F.lit(False)).alias("drop"))


# --- fetched bytes -------------------------------------------------------------
def content_kind(ctype: Column, content: Column) -> Column:
    """"pdf", "html" or null (nothing fetched) for a stored response."""
    head = F.substring(content, 1, 5).cast("string")
    pdf = F.coalesce(F.lower(ctype).contains("pdf"), F.lit(False)) | (head == "%PDF-")
    return F.when(content.isNull() | (F.octet_length(content) == 0), F.lit(None)) \
        .when(pdf, "pdf").otherwise("html")


def read_stored_pages(spark: SparkSession, path: str) -> DataFrame:
    """Files of a folder as (url, content, kind)."""
    df = spark.read.format("binaryFile").load(path)
    return df.select(F.col("path").alias("url"), "content",
                     content_kind(F.lit(""), F.col("content")).alias("kind"))
