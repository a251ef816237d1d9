"""Hard negatives of anchors by slot-decomposed selection.

An anchor's positives give the upper limits of its windows, and these limits cut the
scores into disjoint slots. Each task keeps the best of every slot, a second
selection merges the tasks, and one pass over an anchor's slots from the lowest to
the highest answers all of its overlapping windows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.llm.tables import map_batches, prepare, stored
from rankloom.llm.vectors import (Block, best_of, block_numbers, integer_rows, kth_largest,
                                  meet, packed, products)

SCALE = 256
POSITIVES = 5
NEGATIVES = 5
# A window reaches from this share of the positive's score up to the score itself.
LOWEST = (80, 100)

SCORED = "anchor_row long, anchor_id long, slot int, row long, vec_id long, score long"
ANSWERS = ("anchor_id long, positive_id long, rank int, negative_id long, "
           "positive_score long, negative_score long")


def by_label(label: np.ndarray, vec_id: np.ndarray) -> np.ndarray:
    """Members of a block ordered by label, then id."""
    return np.lexsort((vec_id, label))


def _segment(block: Block, label: int) -> slice:
    """Members of ``label`` in a block that is ordered by label."""
    return slice(*np.searchsorted(block.label, [label, label + 1]))


def _rows(a: Block, i: np.ndarray, c: Block, j: np.ndarray, slot: np.ndarray,
          score: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(a.row[i]), pa.array(a.vec_id[i]), pa.array(slot.astype(np.int32)),
         pa.array(c.row[j]), pa.array(c.vec_id[j], mask=~c.named[j]), pa.array(score)],
        names=["anchor_row", "anchor_id", "slot", "row", "vec_id", "score"])


def nearest_of_label(a: Block, c: Block, k: int) -> pa.RecordBatch | None:
    """The ``k`` best candidates of each anchor's own label, without the anchor's own row."""
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for label in np.intersect1d(a.label, c.label).tolist():
        mine, theirs = _segment(a, label), _segment(c, label)
        score = products(a.cells[mine], c.cells[theirs])
        score[a.row[mine, None] == c.row[None, theirs]] = -np.inf
        i, j = np.nonzero((score >= kth_largest(score, k)[:, None]) & (score > -np.inf))
        found.append((i + mine.start, j + theirs.start, score[i, j].astype(np.int64)))
    if not found:
        return None
    i, j, score = (np.concatenate(x) for x in zip(*found))
    best = best_of(i, score, (c.vec_id[j], c.row[j]), k)
    return _rows(a, i[best], c, j[best], np.zeros(len(best)), score[best])


def best_of_slots(a: Block, c: Block, k: int) -> pa.RecordBatch | None:
    """The ``k`` best candidates of another label in each of an anchor's slots.

    An anchor's limits fall; slot s holds scores at most limit s and above limit
    s + 1. Scores below every window of the anchor are left out.
    """
    limits = a.limits
    score = products(a.cells, c.cells)
    other = np.ones(score.shape, dtype=bool)
    for label in np.intersect1d(a.label, c.label).tolist():
        other[_segment(a, label), _segment(c, label)] = False
    # windows of falling limits start lower and lower; negative limits have none
    real = np.where(limits >= 0, limits, np.iinfo(np.int64).max).min(axis=1)
    least = np.array([-(-LOWEST[0] * int(x) // LOWEST[1]) for x in real], dtype=object)
    if score.dtype != object:
        least = np.minimum(least, 1 << 53).astype(np.float64)
    i, j = np.nonzero(other & (score <= limits[:, :1]) & (score >= least[:, None]))
    value = score[i, j].astype(np.int64)
    slot = (limits[i] >= value[:, None]).sum(axis=1) - 1
    best = best_of(i * limits.shape[1] + slot, value, (c.vec_id[j], c.row[j]), k)
    return _rows(a, i[best], c, j[best], slot[best], value[best])


def merge_slots(slots: list[list[tuple]], limits: list[int], k: int) -> list[list[tuple]]:
    """The first ``k`` entries of each limit's window.

    ``slots`` are lists of ``(score, ...)``, best first; slot s and those after it hold
    all that is at most limit s. One pass from the last slot upwards carries the best
    ``k`` of all slots so far, which is what the window of limit s starts with.
    """
    carried: list[tuple] = []
    answers: list[list[tuple]] = [[] for _ in limits]
    for at in range(len(limits) - 1, -1, -1):
        carried = (slots[at] + carried)[:k]
        answers[at] = [x for x in carried if LOWEST[1] * x[0] >= LOWEST[0] * limits[at]]
    return answers


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("anchor_row", "slot").orderBy(
        F.desc("score"), F.asc_nulls_last("vec_id"), "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _list(df: DataFrame, name: str) -> DataFrame:
    """One row per anchor: its few rows as a list."""
    return df.groupBy("anchor_row").agg(F.collect_list(
        F.struct("slot", "rank", "vec_id", "score")).alias(name))


def mine(embeddings: DataFrame, is_anchor: Column, label: Column, positives: int = POSITIVES,
         negatives: int = NEGATIVES, scale: int = SCALE) -> DataFrame:
    """For every anchor and positive, the best negatives below the positive's score.

    ``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.
    Components become floor(scale * x); scores are inner products; ties go to the
    smaller ``vec_id``, nulls last. An anchor's positives are its first
    ``positives`` other rows of the same ``label``; the negatives are rows of
    other labels with 80 * positive <= 100 * score <= 100 * positive, the first
    ``negatives`` of them, so a positive with a score below 0 has none. Rows without
    label or vector, or with a null or non-finite component, take no part; vectors of
    different lengths do not meet. A repeated row is a row of its own, as an anchor
    too; a null id is no anchor. Scores beyond 64 bits count as the largest or
    smallest such number. An empty table gives no rows; other columns are ignored.
    """
    prepare(embeddings.sparkSession)
    rows = integer_rows(embeddings, scale, label)
    chosen = F.coalesce(is_anchor, F.lit(False))
    numbers = block_numbers(rows, chosen)
    blocks = stored(packed(rows, numbers, "many", layout=by_label))
    anchors = rows.where(chosen)
    liked = stored(_best(meet(
        packed(anchors, numbers, "many_queries", layout=by_label), blocks, numbers, SCORED,
        lambda a, c: nearest_of_label(a, c, positives)), positives))

    limits = _list(liked, "liked").select(F.col("anchor_row").alias("row"), F.transform(
        F.sort_array("liked"), lambda x: x["score"]).alias("limits"))
    limited = packed(anchors.join(limits, "row"), numbers, "many_queries", positives, by_label)
    found = stored(_best(meet(limited, blocks, numbers, SCORED,
                              lambda a, c: best_of_slots(a, c, negatives)), negatives))

    def answer(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for anchor, good, bad in zip(*(batch.column(c).to_pylist()
                                       for c in ("anchor_id", "liked", "found"))):
            good = sorted(good, key=lambda x: x["rank"])
            slots: list[list[tuple]] = [[] for _ in good]
            for x in sorted(bad, key=lambda x: x["rank"]):
                slots[x["slot"]].append((x["score"], x["vec_id"]))
            answers = merge_slots(slots, [x["score"] for x in good], negatives)
            out += [(anchor, p["vec_id"], at, vec_id, p["score"], score)
                    for p, window in zip(good, answers)
                    for at, (score, vec_id) in enumerate(window, 1)]
        names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score",
                 "negative_score"]
        columns = list(zip(*out)) or [()] * len(names)
        yield pa.RecordBatch.from_arrays(
            [pa.array(x, pa.int32() if n == "rank" else pa.int64())
             for n, x in zip(names, columns)], names=names)
    both = _list(liked, "liked").join(_list(found, "found"), "anchor_row").join(
        anchors.select(F.col("row").alias("anchor_row"), F.col("vec_id").alias("anchor_id")),
        "anchor_row")
    return map_batches(both.select("anchor_id", "liked", "found"), ANSWERS, answer)
