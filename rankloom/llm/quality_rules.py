"""Quality rules with thresholds learnt per language and source.

Statistics of every text are written once; mergeable quantile sketches per
(lang, source), language and table turn them into fences; a join puts each text
beside its fences. How many counts above its fence a text may have comes from the
same groups: from the share of their texts that have none at all.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import exp, factorial, log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.llm.tables import map_batches, prepare, stored, texts_of
from rankloom.llm.words import (blocks, char_starts, count_between, read_block,
                                window_hashes, word_hashes)

MIN_WORDS = 50
# Measures and what they are shares of.
MEASURES = {"symbols_per_word": "n_words", "dup_line_share": "n_lines",
            "repeat_share": "n_words", "upper_share": "n_ascii_letters",
            "mark_share": "n_words"}
# What each measure counts.
COUNTS = {"symbols_per_word": "n_symbols", "dup_line_share": "n_dup_lines",
          "repeat_share": "n_repeat_words", "upper_share": "n_upper", "mark_share": "n_marked"}
# A text fails where a measure lies above q50 + SPREAD * spread of its group; the spread is
# q90 - q50. Of the whole table, q90 counts only within REACH times q80 - q50: beyond that
# it is junk and not the body.
SPREAD = 4.0
REACH = 8.0
# A group whose spread is over CAP times the one above it (language, table) and over CAP
# times its own q50 - q20 is lifted by junk and gets the larger of the two instead. All
# spreads lean on the one above as if PRIOR texts had that one, and a group of fewer than
# LEAST texts has the median above.
CAP = 2.0
PRIOR = 30
LEAST = 20
# Guard against ties and single slips: if texts of a group have a count of 0 with chance z,
# chance counts have rate -ln(z), and so many of them pass above the fence as one text in
# 1 / TAIL exceeds. z counts as MOST_HIT at least: beyond that the spread speaks.
TAIL = 1e-6
MOST_HIT = 0.5
ACCURACY = 1000
_SYMBOLS = np.zeros(256, dtype=bool)
_SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True
_UPPER = np.zeros(256, dtype=bool)
_UPPER[65:91] = True
_LETTER = np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = True

STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
         "n_lines", "n_upper", "n_ascii_letters", "n_marked"]


def _repeated(words: np.ndarray) -> int:
    """Words inside 3-word windows that occur twice or more."""
    windows = window_hashes(words, 3)
    if len(windows) < 2:
        return 0
    order = np.sort(windows)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0
    hit = np.isin(windows, twice)
    covered = np.zeros(len(words), dtype=bool)
    for k in range(3):
        covered[k:k + len(windows)] |= hit
    return int(covered.sum())


def text_stats(texts: list[bytes]) -> np.ndarray:
    """One row per text, columns as in STATS."""
    parts = [np.zeros((0, len(STATS)), dtype=np.int64)]
    for low, high in blocks(texts):
        chunk = texts[low:high]
        b = read_block(chunk)
        hashes = word_hashes(b)
        out = np.zeros((len(chunk), len(STATS)), dtype=np.int64)
        out[:, 0] = b.last - b.first
        starts = char_starts(b.data)
        inside = np.zeros(len(b.data) + 1, dtype=np.int8)
        inside[b.start] += 1
        inside[b.stop] -= 1
        in_word = np.cumsum(inside)[:-1].astype(bool)
        out[:, 1] = count_between(starts & in_word, b.begin, b.end)
        out[:, 2] = count_between(_SYMBOLS[b.data], b.begin, b.end)
        out[:, 6] = count_between(_UPPER[b.data], b.begin, b.end)
        out[:, 7] = count_between(_LETTER[b.data], b.begin, b.end)
        # words that end in a symbol or an exclamation mark
        tail = b.data[b.stop - 1]
        marked = np.zeros(len(b.start) + 1, dtype=np.int64)
        np.cumsum(_SYMBOLS[tail] | (tail == 33), out=marked[1:])
        out[:, 8] = marked[b.last] - marked[b.first]
        for i, text in enumerate(chunk):
            lines = [x for x in text.split(b"\n") if x.split()]
            out[i, 5] = len(lines)
            out[i, 3] = len(lines) - len(set(lines))
            out[i, 4] = _repeated(hashes[b.first[i]:b.last[i]])
        parts.append(out)
    return np.concatenate(parts)


def document_stats(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the counts of STATS for every row (null text: empty)."""
    prepare(docs.sparkSession)
    schema = "doc_id long, lang string, source string, " + ", ".join(f"{s} long" for s in STATS)

    def measure(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        stats = text_stats(texts_of(batch.column(3)))
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:3], *[pa.array(stats[:, k]) for k in range(len(STATS))]],
            names=["doc_id", "lang", "source", *STATS])
    return map_batches(docs.select(F.col("doc_id").cast("long"), "lang", "source", "text"),
                       schema, measure)


def measures(stats: DataFrame) -> DataFrame:
    """The relative measures that fences are put on; 0 where a text has no words."""
    def share(top: str, bottom: str):
        return F.coalesce(F.col(top) / F.nullif(F.col(bottom), F.lit(0)), F.lit(0.0))
    return stats.withColumns({
        "symbols_per_word": share("n_symbols", "n_words"),
        "dup_line_share": share("n_dup_lines", "n_lines"),
        "repeat_share": share("n_repeat_words", "n_words"),
        "upper_share": share("n_upper", "n_ascii_letters"),
        "mark_share": share("n_marked", "n_words")})


def guard_rates() -> list[float]:
    """Per k from 0: the Poisson rate at which more than k counts have the chance TAIL."""
    def beyond(rate: float, k: int) -> float:
        return sum(exp(-rate) * rate ** i / factorial(i) for i in range(k + 1, k + 30))
    rates: list[float] = []
    while not rates or rates[-1] < -log(MOST_HIT):
        low, high = 0.0, 2.0
        for _ in range(60):
            middle = (low + high) / 2
            low, high = (middle, high) if beyond(middle, len(rates)) < TAIL else (low, middle)
        rates.append(high)
    return rates


def _sketches(measured: DataFrame, by: list[str], prefix: str) -> DataFrame:
    """``prefix``n and, per measure, q20, q50, q80, q90 and the texts without a count."""
    return measured.groupBy(*by).agg(
        F.count(F.lit(1)).alias(f"{prefix}n"),
        *[F.count_if(F.col(c) == 0).alias(f"{prefix}{m}_none") for m, c in COUNTS.items()],
        *[F.percentile_approx(m, F.array(*map(F.lit, (0.2, 0.5, 0.8, 0.9))), ACCURACY)
          .alias(f"{prefix}{m}") for m in MEASURES]) \
        .withColumnsRenamed({c: f"{prefix}{c}" for c in by})


def fences(measured: DataFrame) -> DataFrame:
    """Upper fences and guards per (lang, source) from mergeable sketches of all its texts.

    Texts that fail the base rules count too. Each task keeps one sketch per
    group and measure, whatever the group's size. ``<measure>_guard`` is how many counts
    above the fence pass.
    """
    own = _sketches(measured, ["lang", "source"], "g_")
    joined = own.join(_sketches(measured, ["lang"], "l_"),
                      F.col("g_lang").eqNullSafe(F.col("l_lang"))) \
        .crossJoin(_sketches(measured, [], "t_"))    # one row

    def spread(level: str, m: str, above: Column) -> Column:
        q, n = F.col(f"{level}_{m}"), F.col(f"{level}_n")
        own, below = q[3] - q[1], CAP * (q[1] - q[0])
        sound = F.when(own <= F.greatest(CAP * above, below), own) \
            .otherwise(F.greatest(above, below))
        return (n * sound + PRIOR * above) / (n + PRIOR)

    def fence(m: str) -> Column:
        q = F.col(f"t_{m}")
        whole = F.when(q[3] - q[1] <= REACH * (q[2] - q[1]), q[3] - q[1]) \
            .otherwise(q[2] - q[1])
        middle = F.when(F.col("g_n") >= LEAST, F.col(f"g_{m}")[1]) \
            .when(F.col("l_n") >= LEAST, F.col(f"l_{m}")[1]).otherwise(q[1])
        return middle + SPREAD * spread("g", m, spread("l", m, whole))
    def guard(m: str) -> Column:
        none = F.col(f"t_{m}_none") / (F.col("t_n") + 1)
        for level in ("l", "g"):
            n = F.col(f"{level}_n")
            none = (F.col(f"{level}_{m}_none") + PRIOR * none) / (n + PRIOR)
        rate = -F.ln(F.greatest(none, F.lit(MOST_HIT)))
        return sum(((rate > r).cast("int") for r in guard_rates()), F.lit(0))
    return joined.select(F.col("g_lang").alias("lang"), F.col("g_source").alias("source"),
                         *[fence(m).alias(f"{m}_max") for m in MEASURES],
                         *[guard(m).alias(f"{m}_guard") for m in MEASURES])


def judge(docs: DataFrame) -> DataFrame:
    """Counts, measures, fences and verdict of every document.

    ``base_failed``: fewer than MIN_WORDS words, or over half of them in
    repeated windows. ``failed_rules`` names the measures above their fence by more
    counts than the group's guard. ``kept`` is false if either holds. Null lang or source form groups of their
    own; an empty table gives an empty result.
    """
    measured = measures(stored(document_stats(docs)))
    limits = fences(measured).withColumnsRenamed({"lang": "_lang", "source": "_source"})
    joined = measured.join(limits, F.col("lang").eqNullSafe(F.col("_lang"))
                           & F.col("source").eqNullSafe(F.col("_source"))) \
        .drop("_lang", "_source")
    failed = F.filter(F.array(*[F.when(
        (F.col(m) - F.col(f"{m}_max")) * F.col(n) > F.col(f"{m}_guard"), F.lit(m))
        for m, n in MEASURES.items()]), lambda x: x.isNotNull())
    base = (F.col("n_words") < MIN_WORDS) \
        | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return joined.withColumns({"base_failed": base, "failed_rules": failed}) \
        .withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))
