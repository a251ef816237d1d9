"""Integer vectors in packed blocks, and blocks of two sets that meet pairwise.

A block is one row: its members and their components in one binary value, so that
a search moves few large rows. Sums of products are exact: the number type of a
product follows from the lengths of the vectors that meet.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.llm.tables import map_batches, stored

# Vectors per block, and components per block where vectors are long.
CANDIDATES = 2048
QUERIES = 512
CELLS = 1 << 20
_KINDS = [np.dtype(t) for t in ("int8", "int16", "int32", "int64")]
_LONG = np.iinfo(np.int64)
NONE = _LONG.min

MEMBERS = "row binary, vec_id binary, named binary, label binary, limits binary"
PACKED = f"dim int, block int, n int, kind string, {MEMBERS}, cells binary"


def integer_rows(embeddings: DataFrame, scale: int, label: Column | None = None) -> DataFrame:
    """``row, vec_id, label, dim, v``: vectors as floor(scale * component).

    Left out: null vectors, vectors with a null or non-finite component, and, where
    ``label`` is given, rows whose label is null. ``row`` numbers the rows, so
    that repeated or null ids stay apart. Components beyond 64 bits become the
    largest or smallest 64-bit number. The table is written.
    """
    whole = F.col("embedding").cast("array<double>")
    rows = embeddings.select(
        F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long"),
        (F.lit(0) if label is None else label).cast("long").alias("label"), whole.alias("_v"))
    unfit = F.exists("_v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    sound = F.col("_v").isNotNull() & F.col("label").isNotNull() & ~F.coalesce(unfit, F.lit(True))
    return stored(rows.where(sound).select(
        "row", "vec_id", "label", F.size("_v").alias("dim"),
        F.transform("_v", lambda x: F.floor(x * float(scale))).alias("v")))


@dataclass
class Block:
    """Vectors of one length: ``cells`` is (vectors, components).

    ``limits`` is (vectors, limits), whole numbers, filled up with ``NONE``.
    """

    row: np.ndarray
    vec_id: np.ndarray
    named: np.ndarray
    label: np.ndarray
    limits: np.ndarray
    cells: np.ndarray

    @classmethod
    def read(cls, values: dict, side: str) -> "Block":
        """The block in columns ``{side}_*`` of one row."""
        n, dim = values[f"{side}_n"], values["dim"]
        long = {c: np.frombuffer(values[f"{side}_{c}"], np.int64)
                for c in ("row", "vec_id", "label")}
        cells = np.frombuffer(values[f"{side}_cells"], values[f"{side}_kind"])
        return cls(**long, named=np.frombuffer(values[f"{side}_named"], bool),
                   limits=np.frombuffer(values[f"{side}_limits"], np.int64).reshape(n, -1),
                   cells=cells.reshape(n, dim))


def number_type(left: np.ndarray, right: np.ndarray) -> type:
    """The fastest type that holds every partial sum of products of two blocks exactly."""
    if not left.size or not right.size:
        return np.float64
    most = float(np.sqrt(np.square(left, dtype=np.float64).sum(axis=1).max())) \
        * float(np.sqrt(np.square(right, dtype=np.float64).sum(axis=1).max()))
    return np.float32 if most < 2 ** 23 else np.float64 if most < 2 ** 52 else object


def products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Inner products of all pairs, exact; beyond 64 bits the largest or smallest such number."""
    kind = number_type(left, right)
    return within_long(left.astype(kind) @ right.T.astype(kind))


def within_long(scores: np.ndarray) -> np.ndarray:
    """Python numbers beyond 64 bits become the largest or smallest such number.

    Minus infinity marks a pair that does not count and stays.
    """
    if scores.dtype != object:
        return scores
    cut = np.minimum(np.maximum(scores, int(_LONG.min)), int(_LONG.max))
    return np.where(scores == -np.inf, scores, cut)


def best_of(group: np.ndarray, score: np.ndarray, tie: tuple[np.ndarray, ...], k: int) -> np.ndarray:
    """Positions of the ``k`` highest scores of each group; ties to the smallest ``tie``."""
    order = np.lexsort((*reversed(tie), -score, group))
    sorted_group = group[order]
    first = np.flatnonzero(np.r_[True, sorted_group[1:] != sorted_group[:-1]]) \
        if len(order) else np.zeros(0, np.int64)
    rank = np.arange(len(order)) - np.repeat(first, np.diff(np.r_[first, len(order)]))
    return order[rank < k]


def kth_largest(score: np.ndarray, k: int) -> np.ndarray:
    """The ``k``-th largest number of each row; minus infinity where there are fewer."""
    if score.shape[1] < k:
        return np.full(len(score), -np.inf)
    if score.dtype == object:
        return np.sort(score, axis=1)[:, -k]
    return np.partition(score, -k, axis=1)[:, -k]


def _members(dim: Column, most: int) -> Column:
    return F.greatest(F.lit(64), F.least(F.lit(most), F.floor(F.lit(CELLS) / F.greatest(
        dim, F.lit(1)))))


def block_numbers(rows: DataFrame, query: Column) -> DataFrame:
    """``dim, many, many_queries``: how many blocks each length of vector has; written."""
    return stored(rows.groupBy("dim").agg(
        F.count(F.lit(1)).alias("_n"), F.count(F.when(query, 1)).alias("_q")).select(
        "dim", F.ceil(F.col("_n") / _members(F.col("dim"), CANDIDATES)).cast("int").alias("many"),
        F.ceil(F.col("_q") / _members(F.col("dim"), QUERIES)).cast("int").alias("many_queries")))


def packed(rows: DataFrame, numbers: DataFrame, many: str, width: int = 1,
           layout: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """One row per block; rows are dealt to the blocks of their length by chance.

    ``rows`` may have a column ``limits`` of up to ``width`` whole numbers. ``layout``
    orders the members of a block from their labels and ids; else they stand by row.
    """
    if "limits" not in rows.columns:
        rows = rows.withColumn("limits", F.lit(None).cast("array<long>"))
    dealt = rows.join(numbers.select("dim", many), "dim").where(F.col(many) > 0) \
        .withColumn("block", F.pmod(F.xxhash64("row"), F.col(many)).cast("int")) \
        .select("dim", "block", "row", "vec_id", "label", "limits", "v")

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by("row").combine_chunks()
        n, dim = table.num_rows, table.column("dim")[0].as_py()
        named = table.column("vec_id").is_valid().to_numpy().astype(bool)
        vec_id = table.column("vec_id").fill_null(_LONG.max).to_numpy().astype(np.int64)
        label = table.column("label").to_numpy().astype(np.int64)
        limits = np.full((n, width), NONE)
        for at, found in enumerate(table.column("limits").to_pylist()):
            limits[at, :len(found or ())] = found or ()
        cells = table.column("v").combine_chunks().flatten().to_numpy().reshape(n, dim)
        order = layout(label, vec_id) if layout else np.arange(n)
        low, high = (int(cells.min()), int(cells.max())) if cells.size else (0, 0)
        kind = next(t for t in _KINDS if np.iinfo(t).min <= low and high <= np.iinfo(t).max)
        row = table.column("row").to_numpy()
        parts = [row, vec_id, named, label, limits, cells.astype(kind)]
        return pa.table({
            "dim": pa.array([dim], pa.int32()), "block": table.column("block").slice(0, 1),
            "n": pa.array([n], pa.int32()), "kind": [kind.str],
            **{name: pa.array([np.ascontiguousarray(part[order]).tobytes()], pa.binary())
               for name, part in zip(("row", "vec_id", "named", "label", "limits", "cells"),
                                     parts)}})
    return dealt.groupBy("dim", "block").applyInArrow(pack, PACKED)


def meet(queries: DataFrame, candidates: DataFrame, numbers: DataFrame, schema: str,
         function: Callable[[Block, Block], pa.RecordBatch | None],
         low: int = 0, high: int | None = None) -> DataFrame:
    """``function`` over every pair of a query block and a candidate block of one length.

    Only candidate blocks from ``low`` to below ``high`` take part. A block is sent
    once per block that it meets, under the pair's key, so pairs spread over all
    tasks and one pair is held at a time.
    """
    last = F.col("many") - 1 if high is None else F.least(F.col("many") - 1, F.lit(high - 1))
    sizes = numbers.where((F.col("many_queries") > 0) & (F.col("many") > low))
    names = [c for c in queries.columns if c not in ("dim", "block")]
    left = queries.join(sizes, "dim").select(
        "dim", F.col("block").alias("query_block"), *[F.col(c).alias(f"q_{c}") for c in names],
        F.explode(F.sequence(F.lit(low), last)).alias("block"))
    right = candidates.where(F.col("block").between(low, (high or 1 << 31) - 1)) \
        .join(sizes, "dim").select(
        "dim", "block", *[F.col(c).alias(f"c_{c}") for c in names],
        F.explode(F.sequence(F.lit(0), F.col("many_queries") - 1)).alias("query_block"))

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for at in range(batch.num_rows):
            values = {c: batch.column(c)[at].as_py() for c in batch.schema.names}
            out = function(Block.read(values, "q"), Block.read(values, "c"))
            if out is not None and out.num_rows:
                yield out
    return map_batches(left.join(right, ["dim", "block", "query_block"]), schema, run)
