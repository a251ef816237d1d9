"""Corpus pipeline: each stage applies one operator to all documents its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.llm import mixing, ngram_join, packing, secrets, toxicity
from rankloom.llm.queries import TOXIC, table, toxic_labels
from rankloom.llm.tables import stored

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no category of the classifier chain rejects; labels come from ``sf_dir``."""
    docs = docs.select(*COLUMNS)
    chain = toxicity.fit(docs, toxic_labels(spark, sf_dir), TOXIC)
    return toxicity.drop_toxic(docs, chain, *TOXIC)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked documents: the one with the smallest doc_id.

    Rows without doc_id cannot be named by the join and stay; rows that share a
    doc_id stay or go together.
    """
    docs = docs.select(*COLUMNS)
    kept = ngram_join.links(docs).where("doc_id = component_id").select("doc_id")
    return docs.join(kept, "doc_id", "left_semi").select(*COLUMNS) \
        .union(docs.where("doc_id is null"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; secrets in its text are masked and n_chars follows."""
    clean = secrets.redact(docs.select(*COLUMNS))
    return clean.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), "n_chars")) \
        .select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, in files that follow the schedule of the sources' target weights."""
    return mixing.mixed(docs.select(*COLUMNS))


def in_schedule(written: DataFrame) -> DataFrame:
    """Documents read from the mixing stage's files, with ``place``: their row in its order.

    Spark reads files back in any order; file names and rows within a file keep it.
    """
    rows = written.select(*COLUMNS, F.col("_metadata.file_name").alias("_file"),
                          F.col("_metadata.row_index").alias("_row"))
    # one number per file
    counts = sorted(((r[0], r[1]) for r in rows.groupBy("_file").count().collect()),
                    key=lambda c: (int(c[0].split("-")[1]), c[0]))     # part-<number>-...
    before, firsts = 0, []
    for name, n in counts:
        firsts.append((name, before))
        before += n
    first = written.sparkSession.createDataFrame(firsts, "_file string, _first long")
    return rows.join(F.broadcast(first), "_file") \
        .select(*COLUMNS, (F.col("_first") + F.col("_row")).alias("place"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of every document with their sequence and offset.

    Sequences follow the schedule where the documents have a ``place`` in it.
    """
    if "place" in docs.columns:
        return packing.pack_in_order(docs, "place")
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_copies),
    ("secret_scan", mask_secrets),
    ("source_mixing", mix_sources),
    ("best_fit_packing", pack_sequences),
]

# A fitted classifier and token counts are beyond SQL; the tests hold run() against a
# brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    for at, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at + 1 < len(STAGES):
            docs = stored(docs)
        if stage is mix_sources:
            docs = in_schedule(docs)
    return docs
