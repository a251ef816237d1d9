"""Conformance to the fixed schemas, repairs, enrichment and projection."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (
    ArrayType, DataType, FractionalType, IntegralType, MapType, StringType, StructType,
)

from rankloom.functions.classify import program_of, with_category_group, with_city
from rankloom.functions.numbers import canon_int
from rankloom.functions.text import clean_text, dedouble, halved, looks_doubled, squeeze, strip
from rankloom.schema import CANON, CANON_INTS, deliverable_columns


def _first_of_each(df: DataFrame) -> DataFrame:
    """Repeated column labels: the first stays."""
    if len(set(df.columns)) == len(df.columns):
        return df
    unique = [f"{c}#{i}" for i, c in enumerate(df.columns)]
    first = {}
    for name, tag in zip(df.columns, unique):
        first.setdefault(name, tag)
    return df.toDF(*unique).select([F.col(f"`{t}`").alias(n) for n, t in first.items()])


def normalize(df: DataFrame, keep: Iterable[str] = ()) -> DataFrame:
    """Any frame as the canonical table: missing null, extra dropped, bad null.

    ``keep`` names columns (an order, say) to carry along untouched.
    """
    df = _first_of_each(df)
    types = dict((f.name, f.dataType) for f in df.schema.fields)
    texts = [c for c in CANON.names if c in types and c not in CANON_INTS]
    # the collapsed form of each text is computed once, in a step below its uses
    staged = df.select(
        *[F.col(f"`{c}`").cast("string").alias(c) for c in texts],
        *[halved(f"cast(`{c}` as string)").alias(f"_half_{c}") for c in texts],
        *[canon_int(F.col(c), types[c]).alias(c) for c in CANON_INTS if c in types],
        *[F.col(k) for k in keep])

    def conformed(name: str) -> Column:
        if name not in types:
            return F.lit(None).cast(CANON[name].dataType).alias(name)
        if name in CANON_INTS:
            return F.col(name)
        return clean_text(name, f"_half_{name}").alias(name)

    return staged.select(*[conformed(c) for c in CANON.names], *[F.col(k) for k in keep])


def dedouble_rows(df: DataFrame, check: Iterable[str]) -> DataFrame:
    """Clean every text cell of the rows whose ``check`` cells are glyph-doubled.

    Runs before number parsing: the digits of such a row are doubled too, while
    a clean row's 1122 must stay 1122.
    """
    columns = [c for c in check if c in df.columns]
    if not columns:
        return df
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, StringType)]
    staged = df.withColumns({
        **{f"_half_{c}": halved(f"`{c}`") for c in texts},
        **{f"_bare_{c}": strip(F.col(f"`{c}`")) for c in columns}})
    flag = reduce(or_, [looks_doubled(f"`_bare_{c}`") for c in columns])
    cleaned = staged.withColumn("_doubled", flag).withColumns({
        c: F.when(F.col("_doubled"), squeeze(dedouble(f"`{c}`", f"`_half_{c}`")))
        .otherwise(F.col(f"`{c}`")) for c in texts})
    return cleaned.select(*df.columns)


def is_blank(c: Column) -> Column:
    return c.isNull() | (strip(c) == "")


def fill_blank(c: Column, value: Column | str | None) -> Column:
    """``value`` where the cell is null or blank; a blank value changes nothing."""
    if value is None or (isinstance(value, str) and value == ""):
        return c
    v = F.lit(value) if isinstance(value, str) else F.when(value != "", value)
    return F.when(is_blank(c), F.coalesce(v, c)).otherwise(c)


def enrich(df: DataFrame, website: Column | str | None = None,
           source_url: Column | str | None = None) -> DataFrame:
    """Links from the source where missing; city, programme and group derived."""
    out = with_category_group(with_city(df, F.col("Institute"), "_city"), F.col("Category"))
    return out.withColumns({
        "Website": fill_blank(F.col("Website"), website),
        "SourceURL": fill_blank(F.col("SourceURL"), source_url),
        "City": F.when(is_blank(F.col("City")), F.col("_city")).otherwise(F.col("City")),
        "Program": F.when(is_blank(F.col("Program")),
                          program_of(F.col("Level"), F.col("Branch")))
        .otherwise(F.col("Program")),
    }).drop("_city")


def attach_links(df: DataFrame, website: Column, source_url: Column) -> DataFrame:
    return df.withColumns({"Website": fill_blank(F.col("Website"), website),
                           "SourceURL": fill_blank(F.col("SourceURL"), source_url)})


def project_deliverable(df: DataFrame, include_category: bool = False) -> DataFrame:
    """Canonical columns under the client's labels; absent ones are null."""
    out = []
    for name, label in deliverable_columns(include_category):
        col = F.col(name) if name in df.columns \
            else F.lit(None).cast(CANON[name].dataType)
        out.append(col.alias(label))
    return df.select(*out)


def deliverable(df: DataFrame, include_category: bool = False) -> DataFrame:
    """The projection without the rows that became equal by dropping columns."""
    return project_deliverable(df, include_category).dropDuplicates()


# --- other fixed tables ---------------------------------------------------------
def _as_type(column: str, found: DataType, wanted: DataType) -> Column:
    """A cell in the wanted type; null where it cannot be read as that."""
    c = F.col(f"`{column}`")
    if found == wanted:
        return c
    if isinstance(wanted, StringType) and isinstance(found, ArrayType | MapType | StructType):
        return F.to_json(c)
    if isinstance(wanted, IntegralType) and isinstance(found, FractionalType):
        return F.when(c == F.floor(c), c.try_cast(wanted))     # no part of a number is cut off
    return c.try_cast(wanted)


def conform_to(df: DataFrame, schema: StructType, keep: tuple[str, ...] = ()) -> DataFrame:
    """Exactly the columns of ``schema``, in its order and types, and ``keep``.

    Extra columns are dropped, missing ones are null, cells that cannot be read in
    their column's type are null (see ``conformance_report``).
    """
    types = {f.name: f.dataType for f in df.schema.fields}
    return df.select(*[
        (_as_type(f.name, types[f.name], f.dataType) if f.name in types
         else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema.fields], *keep)


def conformance_report(df: DataFrame, schema: StructType) -> DataFrame:
    """What ``conform_to`` does to each column, counted in one pass.

    ``column, action, found_type, wanted_type, filled, unreadable``: the action is
    kept, cast, missing or dropped; ``filled`` counts the cells that are not null,
    ``unreadable`` those of them that become null.
    """
    types = {f.name: f.dataType for f in df.schema.fields}
    wanted = {f.name: f.dataType for f in schema.fields}
    entries, counts = [], []
    for at, name in enumerate([*wanted, *[c for c in types if c not in wanted]]):
        found, target = types.get(name), wanted.get(name)
        action = "missing" if found is None else "dropped" if target is None \
            else "kept" if found == target else "cast"
        cell = F.col(f"`{name}`") if found is not None else F.lit(None)
        read = _as_type(name, found, target) if action in ("kept", "cast") else cell
        counts += [F.count(cell).alias(f"f{at}"),
                   F.count_if(cell.isNotNull() & read.isNull()).alias(f"u{at}")]
        entries.append(F.struct(
            F.lit(name).alias("column"), F.lit(action).alias("action"),
            F.lit(found and found.simpleString()).cast("string").alias("found_type"),
            F.lit(target and target.simpleString()).cast("string").alias("wanted_type"),
            F.col(f"f{at}").alias("filled"), F.col(f"u{at}").alias("unreadable")))
    return df.agg(*counts).select(F.inline(F.array(*entries)))
