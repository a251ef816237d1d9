"""Which links to show: probe results, researched links, depth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.functions.rules import ladder
from rankloom.functions.text import strip
from rankloom.functions.urls import (
    DEEP_AGGREGATORS, LINK_AGGREGATORS, RESEARCH_AGGREGATORS, bare_host, has_depth, has_http,
    is_aggregator_bare, on_domains, reachable,
)
from rankloom.operators.dedup import keep_best, position, unique_by
from rankloom.operators.lookup import look_up


def link_kind(url: Column, ok: Column) -> Column:
    """aggregator, dead, none or official."""
    return ladder([
        (is_aggregator_bare(url, LINK_AGGREGATORS), "aggregator"),
        (~has_http(url), "none"), (~ok, "dead")], "official")


def _by_url(status: DataFrame, name: str) -> DataFrame:
    return status.select(F.col("url").alias(f"_{name}_url"), F.col("ok").alias(f"_{name}_ok"),
                         *position(status))


def probe_links(catalog: DataFrame, status: DataFrame) -> DataFrame:
    """Kind and showability of both links of every exam.

    ``status``: probed urls with ``ok``; the last probe of a url counts.
    """
    out = catalog
    for name, column in (("home", "Homepage"), ("cutoff", "CutoffURL")):
        side = _by_url(status, name)
        out = look_up(out, strip(F.col(column)), side, f"_{name}_url") \
            .withColumn(f"_{name}_ok", F.coalesce(f"_{name}_ok", F.lit(False))) \
            .withColumn(f"{name}_kind", link_kind(F.col(column), F.col(f"_{name}_ok"))) \
            .withColumn(f"{name}_show", F.col(f"{name}_kind") == "official")
    return out.select("Exam", "Body", "Homepage", "home_kind", "home_show", "CutoffURL",
                      "cutoff_kind", "cutoff_show")


def _text(c: str) -> Column:
    return strip(F.coalesce(F.col(c), F.lit("")))


def choose_links(probed: DataFrame, records: DataFrame, live: DataFrame) -> DataFrame:
    """The original link if showable, else the researched one if valid, else "".

    ``records``: exam, homepage, cutoff, acronym. ``live``: urls with ``ok``.
    """
    found = records.select(F.trim("exam").alias("_exam"), _text("homepage").alias("_home"),
                           _text("cutoff").alias("_cut"), _text("acronym").alias("acronym"),
                           *position(records))
    out = look_up(probed, F.trim("Exam"), found, "_exam")
    for name in ("home", "cut"):
        side = _by_url(live, name)
        out = look_up(out, F.col(f"_{name}"), side, f"_{name}_url") \
            .withColumn(f"_{name}_valid", F.coalesce(
                has_http(F.col(f"_{name}"))
                & ~is_aggregator_bare(F.col(f"_{name}"), RESEARCH_AGGREGATORS)
                & F.col(f"_{name}_ok"), F.lit(False)))
    return out.select(
        F.col("Exam").alias("exam"),
        ladder([(F.col("home_show"), F.col("Homepage")), (F.col("_home_valid"), F.col("_home"))],
               "").alias("homepage"),
        ladder([(F.col("cutoff_show"), F.col("CutoffURL")), (F.col("_cut_valid"), F.col("_cut"))],
               "").alias("cutoff"),
        F.coalesce("acronym", F.lit("")).alias("acronym"))


def link_counters(probed: DataFrame, chosen: DataFrame) -> DataFrame:
    """One row: exams, links kept as they were, links taken from research, left blank."""
    old = probed.groupBy(F.col("Exam").alias("_exam")).agg(
        F.max(F.struct("home_show", "cutoff_show")).alias("_shown"))
    both = chosen.join(old, F.col("exam") == F.col("_exam"), "left")

    def counts(name: str, shown: str) -> list[Column]:
        kept = F.coalesce(F.col(f"_shown.{shown}"), F.lit(False))
        given = F.coalesce(F.col(name), F.lit("")) != ""
        return [F.count_if(kept & given).alias(f"{name}_kept"),
                F.count_if(~kept & given).alias(f"{name}_found"),
                F.count_if(~given).alias(f"{name}_blank")]
    return both.agg(F.count(F.lit(1)).alias("exams"), *counts("homepage", "home_show"),
                    *counts("cutoff", "cutoff_show"))


def choose_deep_links(existing: DataFrame, records: DataFrame, status: DataFrame) -> DataFrame:
    """Best link per exam after a deeper search.

    Homepage: the first reachable, old before new. Cutoff page: the deepest
    reachable, new before old. All candidates meet the status table in one join.
    """
    new = records.select(F.trim("exam").alias("_exam"), _text("homepage").alias("_home"),
                         _text("cutoff").alias("_cut"), _text("acronym").alias("_acr"),
                         *position(records))
    both = look_up(existing, F.trim("exam"), new, "_exam")

    def option(field: str, at: int, column: str) -> Column:
        return F.struct(F.lit(field).alias("field"), F.lit(at).alias("at"),
                        strip(F.coalesce(F.col(column), F.lit(""))).alias("url"))

    options = both.select("exam", F.inline(F.array(
        option("home", 0, "homepage"), option("home", 1, "_home"),
        option("cut", 0, "_cut"), option("cut", 1, "cutoff")))) \
        .filter(has_http(F.col("url"))) \
        .filter(~on_domains(bare_host(F.col("url")), DEEP_AGGREGATORS))
    codes = unique_by(status.select(F.col("url").alias("_url"),
                                    F.col("status").alias("_code"), *position(status)),
                      ["_url"])
    good = options.join(codes, F.col("url") == F.col("_url")) \
        .filter(reachable(F.col("_code")))
    depth = F.when(F.col("field") == "cut", (~has_depth(F.col("url"))).cast("int")).otherwise(0)
    best = keep_best(good, ["exam", "field"], [depth, F.col("at")], 1)
    chosen = best.groupBy(F.col("exam").alias("_for")).agg(
        F.max(F.when(F.col("field") == "home", F.col("url"))).alias("_best_home"),
        F.max(F.when(F.col("field") == "cut", F.col("url"))).alias("_best_cut"))
    return both.join(chosen, F.col("exam") == F.col("_for"), "left").select(
        "exam", F.coalesce("_best_home", F.lit("")).alias("homepage"),
        F.coalesce("_best_cut", F.lit("")).alias("cutoff"),
        F.coalesce(F.nullif("_acr", F.lit("")), _text("acronym")).alias("acronym"))
