"""Mixing sources to target weights by Pfair scheduling.

Each source is cut into blocks of about equal text. Block k of a source with
weight w is released at slot floor((k - 1) / w) and due by slot ceil(k / w); the
earliest deadline among the released blocks goes first. At every slot a source
is then less than one block away from its share. Weights are taken as exact
fractions over the whole run, so no rounding adds up.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm.ranks import md5_order, rank_in_groups
from rankloom.llm.tables import map_batches, prepare

BLOCK_CHARS = 16_384


def whole_weights(weights: dict[str, float]) -> dict[str, int]:
    """Whole numbers in the exact proportion of the weights."""
    exact = {s: Fraction(w) for s, w in weights.items()}
    common = math.lcm(*(w.denominator for w in exact.values())) if exact else 1
    return {s: int(w * common) for s, w in exact.items()}


def sweep(shares: dict[str, int], blocks: dict[str, int]) -> Iterator[list[str]]:
    """The source of every slot, in phases; every block of ``blocks`` gets its slot.

    A phase lasts until a source has given its last block; the others then go
    on in the proportion of their shares, counted from there. A source is first
    looked at when its first deadline of a phase comes up, so a phase costs its
    slots and not its sources.
    """
    order = sorted((s for s in blocks if blocks[s]), key=lambda s: (-shares[s], s))
    after = dict(zip([None, *order], [*order, None]))    # linked, so that sources can leave
    before = dict(zip([*order, None], [None, *order]))
    left = {s: blocks[s] for s in order}
    total = sum(shares[s] for s in order)
    while left:
        waiting: list[tuple[int, str, int]] = []         # release, source, block
        ready: list[tuple[int, int, str, int]] = []      # deadline, -share, source, block
        fresh = after[None]                              # first blocks, by falling share
        out: list[str] = []
        if len(left) == 1:
            yield [fresh] * left[fresh]
            return
        while True:
            slot = len(out)
            while waiting and waiting[0][0] <= slot:
                _, s, k = heapq.heappop(waiting)
                heapq.heappush(ready, (-(-k * total // shares[s]), -shares[s], s, k))
            if fresh is not None:
                first = (-(-total // shares[fresh]), -shares[fresh], fresh, 1)
                if not ready or first < ready[0]:
                    heapq.heappush(ready, first)
                    fresh = after[fresh]
            _, _, s, k = heapq.heappop(ready)
            out.append(s)
            if k == left[s]:
                break
            heapq.heappush(waiting, (k * total // shares[s], s, k + 1))
        yield out
        for x, n in Counter(out).items():
            left[x] -= n
        del left[s]
        total -= shares[s]
        after[before[s]], before[after[s]] = after[s], before[s]


def plan(blocks: dict[str, int], weights: dict[str, float]) -> dict[str, np.ndarray]:
    """Per source the slot of each of its blocks, in order."""
    shares = whole_weights({s: weights[s] for s in blocks})
    slots = {s: np.zeros(n, np.int64) for s, n in blocks.items()}
    taken = dict.fromkeys(blocks, 0)
    slot = 0
    for phase in sweep(shares, blocks):
        for s in phase:
            slots[s][taken[s]] = slot
            taken[s] += 1
            slot += 1
    return slots


def tempered(sizes: dict[str, int], power: float = 0.5) -> dict[str, float]:
    """Weights by a power of the sources' sizes: small sources get more than their part."""
    return {s: max(n, 1) ** power for s, n in sizes.items()}


_NULL = "\0null"    # a null source is a source of its own


def _planned(docs: DataFrame, keep: list[str], weights: dict[str, float] | None,
             block_chars: int) -> DataFrame:
    """``doc`` (a struct of the columns ``keep``), ``id``, ``block`` and ``slot``."""
    prepare(docs.sparkSession)
    marked = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in keep]).alias("doc"), F.col("doc_id").alias("id"),
        F.coalesce("source", F.lit(_NULL)).alias("_source"), md5_order("doc_id").alias("_order"),
        F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("_size"))
    sizes = {r[0]: r[1] for r in marked.groupBy("_source").agg(F.sum("_size")).collect()}
    if weights is None:
        weights = tempered(sizes)
    else:
        weights = {_NULL if s is None else s: w for s, w in weights.items()}
        unknown = sorted(set(sizes) - {s for s, w in weights.items() if w > 0})
        if unknown:
            raise ValueError(f"sources without a positive weight: {unknown}")
    slots = plan({s: n // block_chars + 1 for s, n in sizes.items()}, weights)
    sent = docs.sparkSession.sparkContext.broadcast(slots)
    ranked = rank_in_groups(marked, ["_source"], "_order", ["id", "_size"], "_size") \
        .withColumn("block", F.floor(F.col("weight_before") / block_chars).cast("long")) \
        .drop("_order", "_size", "weight_before", "group_rank")

    def place(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        source = np.array(batch.column("_source").to_pylist(), dtype=object)
        block = batch.column("block").to_numpy()
        slot = np.zeros(len(block), np.int64)
        for s in set(source):
            at = np.flatnonzero(source == s)
            slot[at] = sent.value[s][block[at]]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc"), batch.column("id"), batch.column("block"), pa.array(slot)],
            names=["doc", "id", "block", "slot"])
    types = dict(ranked.dtypes)
    return map_batches(ranked, f"doc {types['doc']}, id {types['id']}, block long, slot long",
                       place)


def schedule(docs: DataFrame, weights: dict[str, float] | None = None,
             keep: list[str] | None = None, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The columns ``keep`` (default: all) with ``block`` and ``slot`` of every row.

    ``weights`` maps each source to its target (default: the root of its size).
    Nothing is left out. A source's documents are taken in a shuffled order that
    depends on doc_id only; a document lies in the block in which its text
    starts, so a text longer than a block leaves the blocks inside it without
    documents. Null source is a source, null text has no length, and repeated
    rows stay repeated. Columns of ``docs`` that are called block or slot give
    way. An empty table gives an empty result.
    """
    keep = [c for c in keep or docs.columns if c not in ("block", "slot")]
    planned = _planned(docs, keep, weights, block_chars)
    return planned.select(*[F.col("doc")[c].alias(c) for c in keep], "block", "slot")


def mixed(docs: DataFrame, weights: dict[str, float] | None = None,
          block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``docs`` dealt and sorted by slot: written files follow the schedule."""
    planned = _planned(docs, docs.columns, weights, block_chars)
    return planned.repartitionByRange("slot").sortWithinPartitions("slot", md5_order("id"), "id") \
        .select(*[F.col("doc")[c].alias(c) for c in docs.columns])
