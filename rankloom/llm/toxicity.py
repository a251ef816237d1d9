"""Toxicity by a classifier chain.

Categories are predicted one after the other; each linear model sees the text and
the probabilities of the categories before it. While training, those
probabilities are out-of-fold predictions, so that a later model learns how far
an earlier one can be trusted on unseen texts. The text is seen as the presence
of words and of word beginnings, chosen by how differently they occur inside and
outside each category.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm.quality_rules import text_stats
from rankloom.llm.ranks import md5_order
from rankloom.llm.tables import crc_slot, map_batches, prepare, stored, texts_of
from rankloom.llm.words import blocks, mix64, read_block, word_hashes

# The classifier is fitted on at most so many labelled documents.
MAX_LABELLED = 12_000
# Words and beginnings kept per category.
TERMS = 1500
MIN_DOCUMENTS = 4
# A term's rates inside and outside must differ by so many standard errors.
LEAST_ERRORS = 3.0
FOLDS = 5
BEGINNINGS = (4, 5, 6)
STEPS = 300
RIDGE = 1e-3
_SEPARATOR = np.array([not (c >= 128 or chr(c).isalnum()) for c in range(256)])
_SHARES = 4


def _terms(texts: list[bytes]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Per block of texts: its range, and (owner, hash) of all words and beginnings."""
    for low, high in blocks(texts):
        b = read_block([t.lower() for t in texts[low:high]], _SEPARATOR)
        owner = np.repeat(np.arange(high - low), b.last - b.first)
        hashes = [word_hashes(b)]
        owners = [owner]
        for n in BEGINNINGS:
            long = (b.stop - b.start) >= n
            hashes.append(mix64(word_hashes(b, n)[long] + np.uint64(n)))
            owners.append(owner[long])
        yield low, high, np.concatenate(owners), np.concatenate(hashes)


def _dense(texts: list[bytes]) -> np.ndarray:
    """Shares of symbols, repeats, capitals and marks: junk is toxic differently."""
    s = text_stats(texts).astype(np.float64)
    n = np.maximum(s[:, 0], 1)
    return np.clip(np.stack([s[:, 2] / n, s[:, 4] / n, s[:, 6] / np.maximum(s[:, 7], 1),
                             s[:, 8] / n], axis=1), 0, 1)


def _presence(texts: list[bytes], vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, term index) of every vocabulary term in every text, once, in order."""
    pairs = [np.zeros(0, np.int64)]
    if len(vocabulary):
        for low, _, owner, hashes in _terms(texts):
            at = np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)
            hit = vocabulary[at] == hashes
            pairs.append(np.unique((owner[hit] + low) * len(vocabulary) + at[hit]))
    found = np.concatenate(pairs)
    return np.divmod(found, max(1, len(vocabulary)))


def term_counts(sample: DataFrame, categories: list[str]) -> DataFrame:
    """Documents per term, in all and in each category (``term, n, c0, c1, ...``)."""
    width = len(categories)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch.column(0))
            y = np.stack([batch.column(1 + k).to_numpy() for k in range(width)], axis=1)
            for low, _, owner, hashes in _terms(texts):
                order = np.lexsort((owner, hashes))
                owner, hashes = owner[order], hashes[order]
                once = np.append(True, (owner[1:] != owner[:-1]) | (hashes[1:] != hashes[:-1])) \
                    if len(owner) else np.zeros(0, bool)
                owner, hashes = owner[once], hashes[once]
                if not len(owner):
                    continue
                start = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1]))
                sums = np.add.reduceat(y[low + owner].astype(np.int64), start, axis=0)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(hashes[start].view(np.int64)),
                     pa.array(np.diff(np.append(start, len(owner)))),
                     *[pa.array(sums[:, k]) for k in range(width)]],
                    names=["term", "n", *[f"c{k}" for k in range(width)]])
    schema = "term long, n long, " + ", ".join(f"c{k} long" for k in range(width))
    found = sample.select("text", *categories).mapInArrow(run, schema)
    return found.groupBy("term").agg(F.sum("n").alias("n"),
                                     *[F.sum(f"c{k}").alias(f"c{k}") for k in range(width)])


def choose_terms(counts: DataFrame, totals: list[int], rows: int) -> np.ndarray:
    """The terms that tell a category best: difference of rates over its error, both ways.

    Differences within ``LEAST_ERRORS`` errors may be chance and are left out.
    """
    chosen = []
    for k, inside in enumerate(totals):
        outside = rows - inside
        if not inside or not outside:
            continue
        p, q = F.col(f"c{k}") / inside, (F.col("n") - F.col(f"c{k}")) / outside
        rate = F.col("n") / rows
        error = F.sqrt(rate * (1 - rate) * (1 / inside + 1 / outside) + 1e-9)
        chosen.append(counts.where(F.col("n") >= MIN_DOCUMENTS)
                      .select("term", (F.abs(p - q) / error).alias("z"))
                      .where(F.col("z") >= LEAST_ERRORS)
                      .orderBy(F.desc("z"), "term").limit(TERMS).select("term"))
    if not chosen:
        return np.zeros(0, np.uint64)
    terms = chosen[0]
    for more in chosen[1:]:
        terms = terms.union(more)
    return np.unique(terms.toArrow().column(0).to_numpy().view(np.uint64))


class Rows:
    """Sparse presence rows beside a few dense columns."""

    def __init__(self, row: np.ndarray, term: np.ndarray, dense: np.ndarray, width: int) -> None:
        self.row, self.term, self.dense, self.width = row, term, dense, width

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights=w[self.term], minlength=len(self.dense)) \
            + self.dense @ w[self.width:]

    def transposed(self, g: np.ndarray) -> np.ndarray:
        return np.append(np.bincount(self.term, weights=g[self.row], minlength=self.width),
                         g @ self.dense)

    def only(self, at: np.ndarray) -> Rows:
        new = np.cumsum(at) - 1
        inside = at[self.row]
        return Rows(new[self.row[inside]], self.term[inside], self.dense[at], self.width)

    def beside(self, column: np.ndarray) -> Rows:
        return Rows(self.row, self.term, np.column_stack([self.dense, column]), self.width)


def fit_logistic(x: Rows, y: np.ndarray) -> np.ndarray:
    """Ridge logistic regression by Adam on the full batch; the constant is a dense column."""
    size = x.width + x.dense.shape[1]
    w, m, v = np.zeros(size), np.zeros(size), np.zeros(size)
    if not len(y):
        return w
    for t in range(1, STEPS + 1):
        p = 1 / (1 + np.exp(-np.clip(x.dot(w), -30, 30)))
        g = x.transposed(p - y) / len(y) + RIDGE * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= 0.1 * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.99 ** t)) + 1e-8)
    return w


def fit_chain(x: Rows, y: np.ndarray, fold: np.ndarray) -> list[np.ndarray]:
    """One weight vector per category, in order."""
    models = []
    for k in range(y.shape[1]):
        models.append(fit_logistic(x, y[:, k]))
        unseen = np.zeros(len(y))
        for f in range(FOLDS):
            out = fold == f
            if out.any():
                w = fit_logistic(x.only(~out), y[~out, k])
                unseen[out] = 1 / (1 + np.exp(-np.clip(x.only(out).dot(w), -30, 30)))
        x = x.beside(unseen)
    return models


def predict_chain(x: Rows, models: list[np.ndarray]) -> np.ndarray:
    out = []
    for w in models:
        p = 1 / (1 + np.exp(-np.clip(x.dot(w), -30, 30)))
        out.append(p)
        x = x.beside(p)
    return np.stack(out, axis=1)


def _rows(texts: list[bytes], vocabulary: np.ndarray) -> Rows:
    row, term = _presence(texts, vocabulary)
    return Rows(row, term, np.column_stack([_dense(texts), np.ones(len(texts))]),
                len(vocabulary))


class Chain:
    """A fitted chain: vocabulary (bounded by TERMS per category) and weights."""

    def __init__(self, categories: list[str], vocabulary: np.ndarray,
                 models: list[np.ndarray]) -> None:
        self.categories, self.vocabulary, self.models = categories, vocabulary, models

    def __call__(self, texts: list[bytes]) -> np.ndarray:
        return predict_chain(_rows(texts, self.vocabulary), self.models)


def fit(docs: DataFrame, labels: DataFrame, categories: list[str],
        max_labelled: int = MAX_LABELLED) -> Chain:
    """A chain over boolean ``categories`` of ``labels`` (doc_id first), in that order.

    It is fitted on the first ``max_labelled`` labelled documents in a shuffled
    order; rows of ``labels`` with a null category teach nothing.
    """
    spark = prepare(docs.sparkSession)
    taught = labels.where(" and ".join(f"{c} is not null" for c in categories)) \
        .orderBy(md5_order("doc_id"), "doc_id").limit(max_labelled) \
        .select(F.col("doc_id").cast("long"), *[F.col(c).cast("int").alias(c)
                                                for c in categories])
    # at most max_labelled rows of a few numbers
    sample = stored(docs.select(F.col("doc_id").cast("long"), "text")
                    .join(F.broadcast(taught), "doc_id"))
    totals = sample.agg(F.count(F.lit(1)), *[F.sum(c) for c in categories]).first()
    vocabulary = choose_terms(stored(term_counts(sample, categories)),
                              [t or 0 for t in totals[1:]], totals[0])
    sent = spark.sparkContext.broadcast(vocabulary)

    def encode(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts = texts_of(batch.column("text"))
        row, term = _presence(texts, sent.value)
        cuts = np.searchsorted(row, np.arange(len(texts) + 1)).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [batch.column("fold"), pa.ListArray.from_arrays(pa.array(cuts), pa.array(term)),
             pa.array(_dense(texts).tolist(), pa.list_(pa.float64())),
             *[batch.column(c) for c in categories]],
            names=["fold", "terms", "dense", *categories])
    schema = "fold long, terms array<long>, dense array<double>, " \
        + ", ".join(f"{c} int" for c in categories)
    table = map_batches(sample.withColumn("fold", crc_slot("doc_id", FOLDS)), schema, encode) \
        .toArrow().combine_chunks()
    n = table.num_rows
    terms = table.column("terms").combine_chunks()
    y = np.stack([table.column(c).to_numpy() for c in categories], axis=1).astype(float)
    dense = np.array(table.column("dense").to_pylist(), float).reshape(n, _SHARES)
    row = np.repeat(np.arange(n), [len(t) for t in terms]) if n else np.zeros(0, np.int64)
    term = np.asarray(terms.flatten(), dtype=np.int64) if n else np.zeros(0, np.int64)
    x = Rows(row, term, np.column_stack([dense, np.ones(n)]), len(vocabulary))
    return Chain(categories, vocabulary, fit_chain(x, y, table.column("fold").to_numpy()))


def predict(docs: DataFrame, chain: Chain) -> DataFrame:
    """``doc_id`` and ``p_<category>`` for every row of ``docs``.

    A null or empty text gets what the chain says of a text without words; an
    empty table gives an empty result; columns other than doc_id and text are
    ignored.
    """
    spark = prepare(docs.sparkSession)
    sent = spark.sparkContext.broadcast(chain)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        p = sent.value(texts_of(batch.column(1)))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *[pa.array(p[:, k]) for k in range(p.shape[1])]],
            names=["doc_id", *[f"p_{c}" for c in chain.categories]])
    schema = "doc_id long, " + ", ".join(f"p_{c} double" for c in chain.categories)
    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), schema, run)


def drop_toxic(docs: DataFrame, chain: Chain, *categories: str, cutoff: float = 0.5
               ) -> DataFrame:
    """``docs`` without the rows whose probability of any of ``categories`` reaches ``cutoff``."""
    spark = prepare(docs.sparkSession)
    sent = spark.sparkContext.broadcast(chain)
    at = [chain.categories.index(c) for c in categories]

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        keep = sent.value(texts_of(batch.column("text")))[:, at].max(axis=1) < cutoff
        yield batch.filter(pa.array(keep))
    return map_batches(docs, docs.schema, run)
