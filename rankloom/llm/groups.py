"""Walks over sorted groups inside tasks, and bounded blocks of large groups."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def block_pairs(df: DataFrame, keys: list[str], member: str, size: str, block: int) -> DataFrame:
    """Split groups of more than ``block`` members into blocks that meet pairwise.

    ``size`` is the column with the group's size. Adds ``side`` (the member's
    block), ``low`` and ``high`` (the two blocks that meet); a row is repeated
    once per block of its group, so each pair of members meets in one task of
    about two blocks at most. A group of one block stays one task.
    """
    many = F.ceil(F.col(size) / F.lit(block)).cast("int")
    mine = F.pmod(F.xxhash64(member, *keys), many).cast("int")
    out = df.withColumn("side", mine).withColumn(
        "_other", F.explode(F.sequence(F.lit(0), many - 1)))
    return out.withColumns({"low": F.least("side", "_other"),
                            "high": F.greatest("side", "_other")}).drop("_other")


def walk_groups(df: DataFrame, keys: list[str], schema: str,
                function: Callable[[pa.Table], pa.RecordBatch | None]) -> DataFrame:
    """``function`` over the rows of each key, many groups per task.

    Only one group is held at a time; the caller keeps groups bounded.
    """
    dealt = df.repartition(*keys).sortWithinPartitions(*keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        held_key: tuple | None = None

        def close() -> Iterator[pa.RecordBatch]:
            if held:
                out = function(pa.Table.from_batches(held))
                if out is not None and out.num_rows:
                    yield out

        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
            change = np.zeros(batch.num_rows, dtype=bool)
            change[0] = True
            for c in columns:
                change[1:] |= c[1:] != c[:-1]
            cuts = [*np.flatnonzero(change).tolist(), batch.num_rows]
            for low, high in zip(cuts[:-1], cuts[1:]):
                key = tuple(c[low] for c in columns)
                if key != held_key:
                    yield from close()
                    held, held_key = [], key
                held.append(batch.slice(low, high - low))
        yield from close()
    return dealt.mapInArrow(run, schema)


def merge_labels(labels: np.ndarray, member: int, others: np.ndarray) -> None:
    """Unite the labels of ``member`` and ``others`` in place; the smallest stays."""
    found = np.unique(labels[others])
    found = found[found != labels[member]]
    if len(found):
        found = np.append(found, labels[member])
        labels[np.isin(labels, found)] = found.min()
