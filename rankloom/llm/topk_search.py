"""Exact top-k search by inner product: branch and bound over blocks of components.

A block of candidates is laid out by component, the components that hold most of its
mass first. Scores are accumulated a few components at a time; what the remaining
components can add is bounded by the product of the remaining lengths. Candidates
that cannot reach a query's limit leave; the survivors are compacted.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.llm.tables import prepare, stored
from rankloom.llm.vectors import (NONE, Block, best_of, block_numbers, integer_rows,
                                  kth_largest, meet, number_type, packed, within_long)

SCALE = 64
TOP = 20
# Components added between two looks at the bounds.
STEP = 8
# Share of pairs still in question below which they are listed one by one.
LISTED = 0.1
# Candidate blocks of the first round, and how many times more each later round has.
GROWTH = 16

FOUND = "query_row long, query_id long, row long, vec_id long, score long"


def remaining(cells: np.ndarray, step: int) -> np.ndarray:
    """Length of what follows each multiple of ``step``: (vectors, steps + 1)."""
    n, dim = cells.shape
    squares = np.zeros((n, -(-dim // step) + 1))
    for at, low in enumerate(range(0, dim, step)):
        squares[:, at] = np.square(cells[:, low:low + step], dtype=np.float64).sum(axis=1)
    return np.sqrt(np.cumsum(squares[:, ::-1], axis=1)[:, ::-1])


def _reach(rest_q: np.ndarray, rest_c: np.ndarray) -> np.ndarray:
    """The most that the remaining components add; 0 where one side has none left."""
    with np.errstate(invalid="ignore"):
        return np.nan_to_num(rest_q * rest_c, nan=0.0, posinf=np.inf)


def branch_and_bound(queries: Block, candidates: Block, k: int, step: int = STEP
                     ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(query, candidate, score)`` of all pairs that may be among a query's ``k`` best.

    ``queries.limits`` is a score that ``k`` other candidates are known to reach, or
    ``NONE``. A pair of one row with itself is left out.
    """
    kind = number_type(queries.cells, candidates.cells)
    mass = np.square(candidates.cells, dtype=np.float64).sum(axis=0)
    order = np.argsort(-mass, kind="stable")
    q = queries.cells[:, order].astype(kind)
    layout = np.ascontiguousarray(candidates.cells[:, order].T.astype(kind))
    dim, n = layout.shape
    # a little more than the true lengths, so that rounding never prunes
    rest_q = remaining(queries.cells[:, order], step) * (1 + 1e-6)
    rest_c = remaining(candidates.cells[:, order], step)
    if kind is object:      # sums beyond doubles: nothing is pruned
        rest_q = np.where(rest_q > 0, np.inf, rest_q)
    limit = np.where(queries.limits[:, 0] == NONE, -np.inf, queries.limits[:, 0].astype(
        object if kind is object else np.float64))
    score = np.zeros((len(q), n), dtype=kind)
    for at in np.flatnonzero(np.isin(queries.row, candidates.row)):
        score[at, candidates.row == queries.row[at]] = -np.inf
    left = np.arange(n)
    pairs: tuple[np.ndarray, np.ndarray] | None = None
    part = np.zeros(0, dtype=kind)

    for at, low in enumerate(range(0, dim, step), 1):
        block = slice(low, low + step)
        if pairs is None:
            score += q[:, block] @ layout[block][:, left]
            reach = _reach(rest_q[:, at, None], rest_c[left, at][None, :])
            if kind is not object and np.isinf(limit).any():
                limit = np.maximum(limit, kth_largest(score - reach, k))
            alive = score + reach >= limit[:, None]
            if alive.mean() < LISTED:
                i, j = np.nonzero(alive)
                pairs, part = (i, left[j]), score[i, j]
            else:
                used = alive.any(axis=0)
                if used.mean() < 0.75:
                    left, score = left[used], score[:, used]
        else:
            i, j = pairs
            part = part + (q[i, block] * layout[block, :][:, j].T).sum(axis=1, dtype=kind)
            stay = part + _reach(rest_q[i, at], rest_c[j, at]) >= limit[i]
            pairs, part = (i[stay], j[stay]), part[stay]
    if pairs is None:
        score = within_long(score)
        limit = np.maximum(limit, kth_largest(score, k))
        i, j = np.nonzero(score >= limit[:, None])
        pairs, part = (i, left[j]), score[i, j]
    i, j = pairs
    real = part > -np.inf
    return i[real], j[real], part[real].astype(np.int64)


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_row").orderBy(
        F.desc("score"), F.asc_nulls_last("vec_id"), "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(embeddings: DataFrame, is_query: Column, k: int = TOP, scale: int = SCALE,
           step: int = STEP, growth: int = GROWTH) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` best rows for each query row, exactly.

    ``is_query`` picks the queries by ``vec_id``. Components become
    floor(scale * x); the score is their inner product; ties go to the smaller
    ``vec_id``, nulls last. All rows but the query's own are candidates, fewer than
    ``k`` are all returned. Null vectors and vectors with a null or non-finite
    component take no part; vectors of different lengths do not meet. A repeated
    row is a row of its own, as a query too; a null id is no query. Scores beyond
    64 bits count as the largest or smallest such number. An empty table gives no
    rows; other columns are ignored.

    Candidate blocks come in rounds: the first is one block, each later one ``growth``
    times as many, pruned by the ``k``-th score that the rounds before found.
    """
    prepare(embeddings.sparkSession)
    rows = integer_rows(embeddings, scale)
    chosen = F.coalesce(is_query, F.lit(False))
    numbers = block_numbers(rows, chosen)
    blocks = stored(packed(rows, numbers, "many"))
    queries = rows.where(chosen)

    def scan(q: Block, c: Block) -> pa.RecordBatch:
        i, j, score = branch_and_bound(q, c, k, step)
        best = best_of(i, score, (c.vec_id[j], c.row[j]), k)
        i, j, score = i[best], j[best], score[best]
        return pa.RecordBatch.from_arrays(
            [pa.array(q.row[i]), pa.array(q.vec_id[i]), pa.array(c.row[j]),
             pa.array(c.vec_id[j], mask=~c.named[j]), pa.array(score)],
            names=["query_row", "query_id", "row", "vec_id", "score"])

    most = numbers.agg(F.max("many")).first()[0] or 0
    best: DataFrame | None = None
    low, high = 0, 1
    while low < most or best is None:
        limited = queries
        if best is not None:
            limits = best.where(F.col("rank") == k).select(
                F.col("query_row").alias("row"), F.array("score").alias("limits"))
            limited = queries.join(limits, "row", "left")
        query_blocks = packed(limited, numbers, "many_queries")
        found = meet(query_blocks, blocks, numbers, FOUND, scan, low, high)
        if best is not None:
            found = found.union(best.drop("rank"))
        best = stored(_best(found, k))
        low, high = high, high + growth * (high - low)
    return best.select("query_id", F.col("rank").cast("int"), "vec_id", "score")
