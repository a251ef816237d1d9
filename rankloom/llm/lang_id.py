"""Language identification with Kneser-Ney character models in sorted hash arrays.

Letters are folded to 63 symbols and everything between them to one boundary
symbol, so a 4-gram is a 24-bit hash. That bounds a language's model to 2**24
entries whatever the corpus, which makes the models safe to send to every task.
4-grams of all training texts are counted; interpolated Kneser-Ney estimates for
the orders 4 to 1 lie in sorted arrays of hashes. A text gets the language of
the lowest cross-entropy per symbol.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm.tables import map_batches, prepare, stored, texts_of

ORDER = 4
BITS = 6
UNKNOWN = "und"
# Languages whose models are held at a time, by the driver and by a worker.
LANGUAGES_AT_ONCE = 64
# Standard deviations above a language's mean cross-entropy at which a text is rejected.
REJECT_AT = 6.0
BLOCK_BYTES = 1 << 20
_MASK = [(1 << (BITS * k)) - 1 for k in range(ORDER + 1)]


def _symbol(code: int) -> int:
    letter = chr(code)
    if not letter.isalpha():
        return 0
    low = letter.lower()[0]
    if "a" <= low <= "z":
        return ord(low) - 96
    return 27 + (ord(low) * 2654435761 >> 9) % 37


_cache: dict[str, np.ndarray] = {}


def _symbols(codes: np.ndarray) -> np.ndarray:
    """Symbols of code points: 0 for what is no letter, 1-26 for a-z, 27-63 for others."""
    if "plane0" not in _cache:
        _cache["plane0"] = np.array([_symbol(c) for c in range(1 << 16)], dtype=np.uint8)
    out = _cache["plane0"][np.minimum(codes, 0xFFFF)]
    high = np.flatnonzero(codes > 0xFFFF)
    if len(high):
        found, where = np.unique(codes[high], return_inverse=True)
        out[high] = np.array([_symbol(int(c)) for c in found], dtype=np.uint8)[where]
    return out


def _blocks(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    low, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > BLOCK_BYTES:
            yield low, i
            low, size = i, 0
        size += len(t) + ORDER
    if low < len(texts):
        yield low, len(texts)


def gram_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """4-gram hashes of all texts, the text of each, and whether a text has a letter."""
    joined = b"".join(b"\n" * ORDER + t for t in texts).decode("utf-8", "replace")
    codes = np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32)
    # code points per text, from its UTF-8 lead bytes
    sizes = np.array([ORDER + len(t.decode("utf-8", "replace")) for t in texts])
    owner = np.repeat(np.arange(len(texts)), sizes)
    symbols = _symbols(codes)
    lettered = np.bincount(owner[symbols > 0], minlength=len(texts)) > 0
    # one boundary between words; every text starts with ORDER - 1 of them
    within = np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    keep = (symbols > 0) | (within < ORDER - 1)
    keep[1:] |= (symbols[:-1] > 0) & (owner[1:] == owner[:-1])
    symbols, owner, within = symbols[keep].astype(np.uint32), owner[keep], within[keep]
    grams = symbols.copy()
    for k in range(1, ORDER):
        grams[k:] |= symbols[:-k] << np.uint32(BITS * k)
    real = within >= ORDER - 1
    return grams[real], owner[real], lettered


class Level(NamedTuple):
    """One order: seen n-grams with log probabilities, contexts with log back-off weights."""
    grams: np.ndarray
    logp: np.ndarray
    contexts: np.ndarray
    backoff: np.ndarray


def _find(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray
          ) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return keys[at] == wanted, values[at]


def kneser_ney(grams: np.ndarray, counts: np.ndarray) -> list[Level]:
    """Levels for the orders 1 to ORDER from sorted top-order hashes and their counts.

    Below the top order an n-gram's count is the number of symbols that precede
    it. The discount of an order is n1 / (n1 + 2 n2).
    """
    by_order = [(grams, counts.astype(np.float64))]
    for k in range(ORDER - 1, 0, -1):
        lower, number = np.unique(by_order[0][0] & np.uint32(_MASK[k]), return_counts=True)
        by_order.insert(0, (lower, number.astype(np.float64)))
    levels: list[Level] = []
    for k, (keys, number) in enumerate(by_order, start=1):
        n1, n2 = (number == 1).sum(), (number == 2).sum()
        discount = min(max(n1 / max(1, n1 + 2 * n2), 0.1), 0.9)
        contexts, where = np.unique(keys >> np.uint32(BITS), return_inverse=True)
        total, kinds = np.bincount(where, weights=number), np.bincount(where)
        weight = discount * kinds / total
        if k == 1:
            below = np.full(len(keys), 1.0 / (1 << BITS))
        else:
            _, logp = _find(levels[-1].grams, levels[-1].logp, keys & np.uint32(_MASK[k - 1]))
            below = np.exp(logp)
        p = np.maximum(number - discount, 0) / total[where] + weight[where] * below
        levels.append(Level(keys, np.log(p), contexts, np.log(weight)))
    return levels


def log_probabilities(levels: list[Level], grams: np.ndarray) -> np.ndarray:
    """Log probability of each hash's last symbol after the ones before it."""
    out = np.zeros(len(grams))
    open_at = np.arange(len(grams))
    for k in range(ORDER, 0, -1):
        level = levels[k - 1]
        wanted = grams[open_at] & np.uint32(_MASK[k])
        seen, logp = _find(level.grams, level.logp, wanted)
        out[open_at[seen]] += logp[seen]
        open_at, wanted = open_at[~seen], wanted[~seen]
        known, weight = _find(level.contexts, level.backoff, wanted >> np.uint32(BITS))
        out[open_at] += np.where(known, weight, 0.0)
        if not len(open_at):
            break
    out[open_at] -= BITS * np.log(2)     # a symbol never seen: uniform
    return out


def count_grams(docs: DataFrame) -> DataFrame:
    """(lang, gram, n) over all whole texts of ``docs`` (lang, text)."""
    def merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        grams, where = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
        n = np.bincount(where, weights=np.concatenate([c for _, c in parts]))
        return grams, n.astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        for batch in batches:
            langs = batch.column(0).to_pylist()
            texts = texts_of(batch.column(1))
            for lang in set(langs):
                mine = [t for t, x in zip(texts, langs) if x == lang]
                for low, high in _blocks(mine):
                    grams, _, _ = gram_hashes(mine[low:high])
                    grams.sort()
                    edge = np.flatnonzero(np.append(True, grams[1:] != grams[:-1]))
                    parts = held.setdefault(lang, [])
                    parts.append((grams[edge], np.diff(np.append(edge, len(grams)))))
                    if len(parts) > 8:
                        held[lang] = [merge(parts)]
        for lang, parts in held.items():
            grams, n = merge(parts)
            for low in range(0, len(grams), 1 << 16):
                g, c = grams[low:low + (1 << 16)], n[low:low + (1 << 16)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(g)), pa.array(g.astype(np.int32)), pa.array(c)],
                    names=["lang", "gram", "n"])
    counted = docs.where("text is not null").select("lang", "text").mapInArrow(
        run, "lang string, gram int, n long")
    return counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def languages(docs: DataFrame) -> list[str]:
    """The languages of ``docs`` by name."""
    return sorted(r[0] for r in docs.where("lang is not null").select("lang").distinct().collect())


def train(docs: DataFrame, names: list[str] | None = None) -> dict[str, list[Level]]:
    """Models of the languages ``names`` (all) of ``docs``; at most 2**24 hashes each."""
    names = languages(docs) if names is None else names
    table = count_grams(docs.where(F.col("lang").isin(names))).toArrow()
    langs = table.column("lang").to_numpy()
    grams = table.column("gram").to_numpy().astype(np.uint32)
    counts = table.column("n").to_numpy()
    models = {}
    for lang in sorted(names):
        at = np.flatnonzero(langs == lang)
        if len(at):
            order = np.argsort(grams[at])
            models[lang] = kneser_ney(grams[at][order], counts[at][order])
    return models


def score(docs: DataFrame, models: dict[str, list[Level]], keep: list[str]) -> DataFrame:
    """Columns ``keep`` (doc_id first) with ``best``, ``entropy``, ``margin`` and ``n_symbols``.

    ``entropy`` is the best language's cross-entropy per symbol in nats, ``margin``
    how much the next one's is higher. Texts without a letter have n_symbols 0.
    """
    names = sorted(models)
    sent = docs.sparkSession.sparkContext.broadcast([models[n] for n in names])
    types = dict(docs.dtypes)
    schema = ", ".join(f"{c} {types[c]}" for c in keep) \
        + ", best string, entropy double, margin double, n_symbols long"

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts = texts_of(batch.column("text"))
        if "place" not in _cache:
            _cache["place"] = np.zeros(1 << (BITS * ORDER), dtype=np.int32)
        place = _cache["place"]
        size = np.zeros(len(texts), np.int64)
        entropy = np.zeros((len(names), len(texts)))
        for low, high in _blocks(texts):
            grams, owner, lettered = gram_hashes(texts[low:high])
            if not len(grams):
                continue
            order = np.sort(grams)
            distinct = order[np.append(True, order[1:] != order[:-1])]
            place[distinct] = np.arange(len(distinct), dtype=np.int32)
            at = place[grams]
            size[low:high] = np.where(lettered, np.bincount(owner, minlength=high - low), 0)
            for k, levels in enumerate(sent.value):
                entropy[k, low:high] = -np.bincount(
                    owner, weights=log_probabilities(levels, distinct)[at],
                    minlength=high - low)
        entropy /= np.maximum(size, 1)
        best = entropy.argmin(axis=0) if names else np.zeros(len(texts), int)
        ranked = np.sort(entropy, axis=0)
        margin = ranked[1] - ranked[0] if len(names) > 1 else np.zeros(len(texts))
        yield pa.RecordBatch.from_arrays(
            [*[batch.column(c) for c in keep],
             pa.array([names[b] if n and names else None for b, n in zip(best, size)],
                      pa.string()),
             pa.array(ranked[0] if names else np.zeros(len(texts))), pa.array(margin),
             pa.array(size)],
            names=[*keep, "best", "entropy", "margin", "n_symbols"])
    return map_batches(docs.select(*keep, "text"), schema, run)


def _evidence(margin, size):
    """What a margin is worth: longer texts make the same margin surer (capped at 30)."""
    return F.least(margin * F.log1p(size), F.lit(30.0))


def calibrate(scored: DataFrame) -> tuple[float, float]:
    """Logistic (offset, slope) for "the best language is right", over all training rows.

    Rows are counted in bins of evidence first, so the driver sees at most some
    hundred counts.
    """
    bins = scored.where("lang is not null and n_symbols > 0").groupBy(
        F.round(_evidence(F.col("margin"), F.col("n_symbols")), 1).alias("z"),
        (F.col("best") == F.col("lang")).alias("right")).count().collect()
    if not bins:
        return 0.0, 0.0
    z = np.array([b["z"] for b in bins])
    y = np.array([float(b["right"]) for b in bins])
    n = np.array([b["count"] for b in bins], dtype=float)
    x = np.stack([np.ones_like(z), z])
    w = np.zeros(2)
    for _ in range(60):     # Newton steps with a small ridge, so separable bins stay finite
        p = 1 / (1 + np.exp(-np.clip(w @ x, -30, 30)))
        gradient = x @ (n * (y - p)) - 1e-2 * w
        hessian = (x * (n * p * (1 - p))) @ x.T + 1e-2 * np.eye(2)
        w = w + np.clip(np.linalg.solve(hessian, gradient), -2, 2)
    return float(w[0]), float(max(w[1], 0.0))


def reject_limits(scored: DataFrame) -> DataFrame:
    """Per language: mean entropy and variance per symbol of its own training texts."""
    e, n = F.col("entropy"), F.col("n_symbols")
    sums = scored.where("n_symbols > 0 and best = lang").groupBy("best").agg(
        F.sum(n).alias("s0"), F.sum(e * n).alias("s1"), F.sum(e * e * n).alias("s2"),
        F.count(F.lit(1)).alias("rows"))
    return sums.select("best", (F.col("s1") / F.col("s0")).alias("mean"), F.greatest(
        F.lit(0.0), (F.col("s2") - F.col("s1") * F.col("s1") / F.col("s0")) / F.col("rows"))
        .alias("spread"))


def score_all(docs: DataFrame, names: list[str], keep: list[str],
              at_once: int = LANGUAGES_AT_ONCE) -> DataFrame:
    """``score`` of the models of all ``names``, learnt where ``_training`` holds; written.

    Models go to the workers ``at_once`` languages at a time. With more languages the
    passes are merged row by row: the lowest entropy of all stays, and its margin to the
    next one.
    """
    groups = [names[low:low + at_once] for low in range(0, len(names), at_once)] or [[]]
    if len(groups) == 1:
        return stored(score(docs, train(docs.where("_training"), groups[0]), keep))
    rows = stored(docs.select(*dict.fromkeys([*keep, "_training", "lang", "text"]))
                  .withColumn("_row", F.monotonically_increasing_id()))
    passes = [stored(score(rows, train(rows.where("_training"), group), ["_row", *keep])
                     .withColumn("_next", F.when(F.lit(len(group) > 1),
                                                 F.col("entropy") + F.col("margin"))))
              for group in groups]
    found = passes[0]
    for more in passes[1:]:
        found = found.union(more)
    # two entropies per pass
    both = F.array_sort(F.flatten(F.collect_list(F.array_compact(F.array(
        F.struct("entropy", "best"),
        F.when(F.col("_next").isNotNull(), F.struct(
            F.col("_next").alias("entropy"), F.lit(None).cast("string").alias("best"))))))))
    merged = found.groupBy("_row", *keep).agg(both.alias("_e"), F.max("n_symbols").alias("n_symbols"))
    return stored(merged.select(
        *keep, F.col("_e")[0]["best"].alias("best"), F.col("_e")[0]["entropy"].alias("entropy"),
        (F.col("_e")[1]["entropy"] - F.col("_e")[0]["entropy"]).alias("margin"), "n_symbols"))


def identify(docs: DataFrame, is_training, keep: list[str]) -> DataFrame:
    """``keep`` and ``lang_pred, score, rejected, entropy`` for every row of ``docs``.

    Models and calibration come from the rows where the column ``is_training``
    holds and lang is not null. ``lang_pred`` is a learned language, or ``und``
    where the text is null or has no letter, or nothing was learned. ``score`` is
    the calibrated probability that it is right (0 for ``und``). ``rejected``
    tells that the text's cross-entropy lies far above what texts of that
    language have: callers who want "unknown" read ``und`` there. Equal entropies
    go to the first language by name. Rows are scored one by one; an empty table
    gives an empty result.
    """
    prepare(docs.sparkSession)
    marked = docs.withColumn("_training", F.coalesce(is_training, F.lit(False)))
    inner = [*keep, "_training", *(["lang"] if "lang" not in keep else [])]
    scored = score_all(marked, languages(marked.where("_training")), inner)
    learning = scored.where("_training")
    offset, slope = calibrate(learning)
    limits = reject_limits(learning).withColumnRenamed("best", "_best")
    logit = F.lit(offset) + F.lit(slope) * _evidence(F.col("margin"), F.col("n_symbols"))
    far = F.col("mean") + REJECT_AT * F.sqrt(F.col("spread") / F.col("n_symbols"))
    return scored.join(F.broadcast(limits), scored["best"] == limits["_best"], "left").select(
        *keep, F.coalesce("best", F.lit(UNKNOWN)).alias("lang_pred"),
        F.when(F.col("best").isNull(), 0.0).otherwise(1 / (1 + F.exp(-logit))).alias("score"),
        (F.col("best").isNull() | F.coalesce(F.col("entropy") > far, F.lit(False)))
        .alias("rejected"), "entropy")
