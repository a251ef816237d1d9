"""Near-duplicate embeddings: random-hyperplane sign hashing in several tables.

Vectors of equal label meet where the sign bits of one table agree; every pair
that meets is verified by its exact cosine, in the first table where it meets, so
it counts once. Linked vectors form components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm.components import connected_components
from rankloom.llm.groups import block_pairs, merge_labels, walk_groups
from rankloom.llm.tables import map_batches, prepare, stored

THRESHOLD = 0.93
# A pair at the threshold agrees in all bits of a table with probability
# (1 - acos(0.93) / pi) ** 16 = 0.13; all 64 tables miss it once in 7,300 pairs, and a
# pair at 0.95 once in 380,000. Strangers meet in one of 65,536 buckets of a label.
TABLES = 64
BITS = 16
BLOCK = 2048
SEED = 20240601
# Pairs whose table signatures are compared at a time.
_PAIRS = 100_000

_planes: dict[tuple[int, int, int], np.ndarray] = {}


def hyperplanes(dim: int, tables: int, bits: int) -> np.ndarray:
    """Normal vectors, the same in every task."""
    key = (dim, tables, bits)
    if key not in _planes:
        _planes[key] = np.random.default_rng([SEED, dim]).standard_normal((dim, tables * bits))
    return _planes[key]


def signatures(vectors: np.ndarray, tables: int, bits: int) -> np.ndarray:
    """Sign bits of each table as one number: (vectors, tables), 16-bit."""
    signs = vectors @ hyperplanes(vectors.shape[1], tables, bits) > 0
    weights = (1 << np.arange(bits)).astype(np.int64)
    return (signs.reshape(len(vectors), tables, bits) @ weights).astype(np.uint16)


def near_pairs(vectors: np.ndarray, marks: np.ndarray, table: int, threshold: float,
               sides: np.ndarray | None) -> Iterator[tuple[int, np.ndarray]]:
    """``(i, partners)`` with cosine at or above ``threshold`` that meet first in ``table``.

    ``sides``: only pairs of different sides; None: all pairs.
    """
    norms = np.sqrt((vectors * vectors).sum(axis=1))
    step = max(1, _PAIRS // max(1, len(vectors)))
    for low in range(0, len(vectors), step):
        rows = np.arange(low, min(low + step, len(vectors)))
        cosine = (vectors[rows] @ vectors.T) / (norms[rows, None] * norms[None, :])
        i, j = np.nonzero(cosine >= threshold)
        at = j > rows[i]
        if sides is not None:
            at &= sides[rows[i]] != sides[j]
        i, j = rows[i[at]], j[at]
        if table:
            earlier = (marks[i, :table] == marks[j, :table]).any(axis=1)
            i, j = i[~earlier], j[~earlier]
        for member in np.unique(i):
            yield int(member), j[i == member]


def links(embeddings: DataFrame, threshold: float = THRESHOLD, tables: int = TABLES,
          bits: int = BITS, block: int = BLOCK) -> DataFrame:
    """One row per vector: ``vec_id, n_links, component_id, kept``.

    Vectors that are null, zero, empty, or hold null or non-finite components,
    and vectors without label, link with nothing; neither do vectors of
    different lengths. Equal vectors of a label are one class before hashing:
    copies link with each other and share the links of their class. Each row
    counts as a vector, also under a repeated vec_id; a null vec_id comes back
    with a null component and ``kept`` false unless it links. Other columns are
    ignored. A bucket may hold any number of vectors: it is cut into blocks that
    meet pairwise.
    """
    prepare(embeddings.sparkSession)
    rows = embeddings.select(F.col("vec_id").cast("long"), F.col("label").cast("long"),
                             F.col("embedding").cast("array<double>").alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = F.col("label").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) \
        & F.coalesce(~bad, F.lit(False)) & F.exists("v", lambda x: x != 0)
    rows = stored(rows.withColumn("ok", F.coalesce(usable, F.lit(False)))
                  .withColumn("v", F.when(F.col("ok"), F.transform("v", lambda x: x + 0.0))))
    whole = rows.where("ok")
    classes = stored(whole.groupBy("label", "v").agg(
        F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
        .withColumn("id", F.xxhash64("label", "v")))

    def sign(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        vectors = batch.column("v")
        dims = np.diff(np.asarray(vectors.offsets))
        for dim in np.unique(dims):
            at = np.flatnonzero(dims == dim)
            x = np.stack([np.asarray(vectors[int(i)].values) for i in at])
            yield pa.RecordBatch.from_arrays(
                [batch.column("label").take(pa.array(at)), pa.array(np.full(len(at), dim, np.int32)),
                 batch.column("id").take(pa.array(at)), batch.column("copies").take(pa.array(at)),
                 pa.array([r.tobytes() for r in x], pa.binary()),
                 pa.array(signatures(x, tables, bits).astype(np.int32).tolist(),
                          pa.list_(pa.int32()))],
                names=["label", "dim", "id", "copies", "x", "marks"])

    signed = stored(map_batches(
        classes.select("label", "v", "id", "copies"),
        "label long, dim int, id long, copies long, x binary, marks array<int>", sign))
    # only keys and ids are grouped; vectors go to the buckets of two members or more
    keys = ["label", "dim", "tab", "bucket"]
    hashed = signed.select("label", "dim", "id", F.posexplode("marks").alias("tab", "bucket"))
    crowd = hashed.groupBy(*keys).agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    dealt = block_pairs(hashed.join(crowd, keys), keys, "id", "members", block) \
        .join(signed.select("id", "copies", "x", "marks"), "id")

    def verify(group: pa.Table) -> pa.RecordBatch | None:
        if group.num_rows < 2:
            return None
        ident, copies, side = (group.column(c).to_numpy() for c in ("id", "copies", "side"))
        x = np.stack([np.frombuffer(b, np.float64) for b in group.column("x").to_pylist()])
        marks = np.array(group.column("marks").to_pylist(), dtype=np.uint16)
        across = group.column("low")[0].as_py() != group.column("high")[0].as_py()
        label, degree = np.arange(len(ident)), np.zeros(len(ident), np.int64)
        for at, partners in near_pairs(x, marks, group.column("tab")[0].as_py(), threshold,
                                       side if across else None):
            degree[at] += copies[partners].sum()
            np.add.at(degree, partners, copies[at])
            merge_labels(label, at, partners)
        linked = np.flatnonzero(degree)
        return pa.RecordBatch.from_arrays(
            [pa.array(ident[linked]), pa.array(ident[label[linked]]), pa.array(degree[linked])],
            names=["id", "root", "degree"])

    found = stored(walk_groups(dealt, [*keys, "low", "high"],
                               "id long, root long, degree long", verify))
    degrees = found.groupBy("id").agg(F.sum("degree").alias("degree"))
    roots = connected_components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    smallest = roots.join(classes, roots["node"] == classes["id"]) \
        .groupBy("component").agg(F.min("rep").alias("least"))
    facts = classes.select("id", "rep", "copies").join(
        roots.join(smallest, "component").select(F.col("node").alias("id"), "least"),
        "id", "left").join(degrees, "id", "left").select(
        "id", F.coalesce("least", "rep").alias("least"),
        (F.col("copies") - 1 + F.coalesce("degree", F.lit(0))).alias("n_links"))
    named = rows.withColumn("id", F.when(F.col("ok"), F.xxhash64("label", "v")))
    return named.select("vec_id", "id").join(facts, "id", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("least", "vec_id").alias("component_id")) \
        .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
