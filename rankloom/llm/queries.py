"""The thin queries: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.llm import (embedding_dedup, lang_id, line_dedup, mixing, ngram_join,
                          packing, quality_rff, quality_rules, secrets, toxicity)
from rankloom.llm.registry import query
from rankloom.llm.tables import crc_slot

SCHEMAS = {
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "labels": "doc_id bigint, quality int, toxic int",
    "benchmark": "item_id bigint, text string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def _held_out(modulus: int, remainder: int) -> Column:
    """A row without doc_id is neither learnt from nor held out."""
    return F.coalesce(crc_slot("doc_id", modulus) == remainder, F.lit(False)).alias("held_out")


@query("op1_language_id")
def language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    found = lang_id.identify(docs, crc_slot("doc_id", 3) != 1, ["doc_id"])
    return found.select("doc_id", _held_out(3, 1),
                        "lang_pred", "score", "rejected")


# The kinds of toxic text that the labels tell apart, in the chain's order.
TOXIC = ["toxic", "toxic_prose", "toxic_junk"]


def toxic_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxic at all, in text of good quality, in junk."""
    toxic, quality = F.col("toxic") == 1, F.col("quality")
    return table(spark, sf_dir, "labels").select(
        "doc_id", toxic.alias("toxic"),
        (toxic & F.coalesce(quality == 1, F.lit(False))).alias("toxic_prose"),
        (toxic & F.coalesce(quality == 0, F.lit(False))).alias("toxic_junk"))


@query("op2_toxicity_chain")
def toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    chain = toxicity.fit(docs, toxic_labels(spark, sf_dir), TOXIC)
    return toxicity.predict(docs, chain).withColumn(
        "rejected", F.greatest(*[F.col(f"p_{c}") for c in TOXIC]) >= 0.5)


@query("op3_source_mixing")
def source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.schedule(docs, keep=["doc_id", "source"])


@query("op4_embedding_near_dedup")
def embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.links(table(spark, sf_dir, "embeddings"))


@query("op5_ngram_jaccard_join")
def ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.links(table(spark, sf_dir, "documents"))


@query("op6_quality_classifier")
def quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality_rff.score(docs, table(spark, sf_dir, "labels"), crc_slot("doc_id", 4) != 2)
    return scored.select("doc_id", _held_out(4, 2), "score",
                         "predicted")


@query("op7_line_dedup")
def line_dedup_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.remove_repeats(docs).select(
        "doc_id", "text", "removed", F.size("removed").alias("n_removed"))


@query("op8_secret_scan")
def secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))
    spans = F.array_join(F.transform("found", lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256",
                        spans.alias("spans"), "n_random")


@query("op9_quality_rules")
def rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines",
                         "n_repeat_words", "base_failed", "kept",
                         F.array_join("failed_rules", ",").alias("failed_rules"))


@query("op10_best_fit_packing")
def best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))
