"""Quality scores: random Fourier features, summed normal equations, isotonic calibration.

The features are statistics of whole texts (``features.dense_features``), scaled
with the training rows' means and deviations. Cosines of random projections
approximate a Gaussian kernel over them. Every partition sums its part of the
ridge system per fold, Spark adds the parts up, and the driver solves systems of the
size of the feature map: one of all rows, and one without each fold. Scores are
calibrated by isotonic regression over counts per bin of out-of-fold scores.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.llm.features import NAMES, dense_features
from rankloom.llm.tables import map_batches, prepare, stored, texts_of

COMPONENTS = 256
SEED = 77
RIDGE = 1.0
# Kernel width in standard deviations of the scaled statistics.
WIDTH = 4.0
# Scaled statistics are cut here, so that extreme texts stay in the kernel's reach.
LIMIT = 6.0
BINS = 4096
# Training documents are dealt to so many folds, for scores of rows that the weights
# have not seen.
FOLDS = 5
CUTOFF = 0.7


def scale(x: np.ndarray, center: np.ndarray, spread: np.ndarray) -> np.ndarray:
    return np.clip((x - center) / spread, -LIMIT, LIMIT)


def feature_map(x: np.ndarray, components: int = COMPONENTS) -> np.ndarray:
    """Random Fourier features of scaled rows, with the rows themselves and a constant."""
    rng = np.random.default_rng(SEED)
    w = rng.standard_normal((x.shape[1], components)) / WIDTH
    phase = rng.uniform(0, 2 * np.pi, components)
    return np.hstack([np.sqrt(2.0 / components) * np.cos(x @ w + phase), x / LIMIT,
                      np.ones((len(x), 1))])


def describe(docs: DataFrame) -> DataFrame:
    """``doc_id, x``: the statistics of every whole text, by one pass."""
    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        x = dense_features(texts_of(batch.column(1)))
        flat = pa.array(x.reshape(-1))
        lists = pa.ListArray.from_arrays(
            pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), flat)
        yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["doc_id", "x"])
    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"),
                       "doc_id long, x array<double>", run)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), len(NAMES))


def moments(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Means and standard deviations of the statistics (1 where nothing varies)."""
    found = rows.agg(*[f(F.col("x")[k]).alias(f"{name}{k}") for k in range(len(NAMES))
                       for name, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    center = np.array([found[f"m{k}"] or 0.0 for k in range(len(NAMES))])
    spread = np.array([found[f"s{k}"] or 0.0 for k in range(len(NAMES))])
    return center, np.where(spread > 1e-9, spread, 1.0)


def normal_equations(rows: DataFrame, center: np.ndarray, spread: np.ndarray,
                     components: int) -> tuple[np.ndarray, np.ndarray]:
    """Ridge matrices and right sides per fold, summed over partitions of ``x, y, fold`` rows."""
    width = components + len(NAMES) + 1
    upper = np.triu_indices(width)
    cells = len(upper[0]) + width

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = np.zeros((FOLDS, width, width)), np.zeros((FOLDS, width))
        for batch in batches:
            if batch.num_rows:
                z = feature_map(scale(_matrix(batch.column(0)), center, spread), components)
                y = batch.column(1).to_numpy().astype(np.float64)
                fold = batch.column(2).to_numpy()
                for k in np.unique(fold):
                    mine = z[fold == k]
                    a[k] += mine.T @ mine
                    b[k] += mine.T @ y[fold == k]
        for k in range(FOLDS):
            if a[k].any():
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(cells, dtype=np.int32) + k * cells),
                     pa.array(np.append(a[k][upper], b[k]))], names=["cell", "value"])
    parts = rows.select("x", "y", "fold").mapInArrow(sums, "cell int, value double")
    total = parts.groupBy("cell").agg(F.sum("value").alias("value")).toArrow()
    found = np.zeros(FOLDS * cells)
    found[total.column("cell").to_numpy()] = total.column("value").to_numpy()
    found = found.reshape(FOLDS, cells)
    a = np.zeros((FOLDS, width, width))
    a[:, upper[0], upper[1]] = found[:, :len(upper[0])]
    return a + np.triu(a, 1).transpose(0, 2, 1), found[:, len(upper[0]):]


def solve(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Ridge weights; zeros where there is nothing to learn from."""
    return np.linalg.solve(a + RIDGE * np.eye(len(b)), b) if a.any() else np.zeros(len(b))


def isotonic(position: np.ndarray, value: np.ndarray, weight: np.ndarray
             ) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: knots and levels of the best non-decreasing fit."""
    blocks: list[list[float]] = []      # level, weight, sum of positions * weight
    for p, v, w in zip(position, value, weight):
        blocks.append([v, w, p * w])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v2, w2, p2 = blocks.pop()
            v1, w1, p1 = blocks[-1]
            blocks[-1] = [(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, p1 + p2]
    return (np.array([b[2] / b[1] for b in blocks]), np.array([b[0] for b in blocks]))


def score(docs: DataFrame, labels: DataFrame, is_training: Column,
          components: int = COMPONENTS) -> DataFrame:
    """``doc_id, score, predicted`` for every row of ``docs``.

    ``labels`` has ``doc_id, quality``; rows without a 0/1 quality teach nothing,
    a document labelled twice counts twice. ``is_training`` is a condition on
    doc_id; all rows of a document fall into one fold. Null and empty texts are scored
    as texts without words. Without any usable label every score is 0.5. An empty table
    gives an empty result; other columns are ignored.
    """
    prepare(docs.sparkSession)
    facts = stored(describe(docs))
    taught = labels.where("quality in (0, 1)").select(
        F.col("doc_id").cast("long"), F.col("quality").cast("double").alias("y"))
    fold = F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)).cast("int")
    rows = stored(facts.where(is_training).join(taught, "doc_id")
                  .select("x", "y", fold.alias("fold")))
    center, spread = moments(rows)
    a, b = normal_equations(rows, center, spread, components)
    weights = solve(a.sum(0), b.sum(0))
    unseen = np.stack([solve(a.sum(0) - a[k], b.sum(0) - b[k]) for k in range(FOLDS)])

    def features(column: pa.Array) -> np.ndarray:
        return feature_map(scale(_matrix(column), center, spread), components)

    def place(raw: np.ndarray) -> np.ndarray:
        return (raw + 0.5) / 2 * BINS

    def binned(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        mine = unseen[batch.column(2).to_numpy()]
        at = np.clip(place((features(batch.column(0)) * mine).sum(1)), 0, BINS - 1)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), batch.column(1)],
                                         names=["bin", "y"])
    table = map_batches(rows, "bin int, y double", binned).groupBy("bin").agg(
        F.avg("y").alias("y"), F.count(F.lit(1)).alias("n")).orderBy("bin").collect()
    knots, levels = isotonic(*(np.array([r[c] for r in table], dtype=np.float64)
                               for c in ("bin", "y", "n"))) if table \
        else (np.zeros(1), np.full(1, 0.5))

    def judge(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        at = place(features(batch.column(1)) @ weights) - 0.5
        p = np.clip(np.interp(at, knots, levels), 0.0, 1.0)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(p), pa.array((p >= CUTOFF).astype(np.int32))],
            names=["doc_id", "score", "predicted"])
    return map_batches(facts, "doc_id long, score double, predicted int", judge)
