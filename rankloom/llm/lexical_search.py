"""Ranked lexical search: term-at-a-time scoring with a limited number of accumulators.

The postings of the queries' terms are kept per block of documents, in one row each.
Every block of queries meets every block of documents. There, a query's terms are
taken rarest first; once the terms that are left cannot lift a new document to the
k-th partial score, no accumulator is created any more, and the documents that can
still get there are updated exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankloom.llm.tables import map_batches, prepare, stored, texts_of

TOP = 20
# Documents and postings per block.
DOCUMENTS = 4096
POSTINGS = 1 << 20
# Queries per block.
ITEMS = 256
# Slots of the table that tells which terms the queries may hold; 128 KB in all.
SLOTS = 1 << 20
# Terms that a worker remembers between blocks.
REMEMBERED = 1 << 18

# A-Z become a-z, all other ASCII characters but digits and letters become spaces;
# bytes from 0x80 on belong to characters beyond ASCII, which are parts of terms.
_TO_TERMS = bytes(c if c >= 0x80 or chr(c).isalnum() else 0x20
                  for c in bytes(range(256)).lower())

INDEX = ("block string, n_docs int, n_terms long, names binary, named binary, lengths binary, "
         "terms array<binary>, dfs array<int>, docs binary, counts binary")
BLOCK = ["names", "named", "lengths", "terms", "dfs", "docs", "counts"]
FOUND = "item long, row_name long, score long"


def terms_of(text: bytes) -> list[bytes]:
    """Maximal runs of ASCII letters, digits and all characters beyond ASCII, A-Z lowered."""
    return text.translate(_TO_TERMS).split()


def slot_of(term: bytes) -> int:
    """The term's slot, the same in every task."""
    return int.from_bytes(term[-3:], "little") * 0x9E3779B1 + len(term) * 0x85EBCA6B \
        + int.from_bytes(term[:4], "little") * 0xC2B2AE35 >> 7 & SLOTS - 1


class _Codes(dict):
    """Numbers for terms whose slot is taken, in order of appearance; -1 for all others."""

    def __init__(self, taken: np.ndarray) -> None:
        super().__init__()
        self._taken = taken
        self.terms: list[bytes] = []

    def __missing__(self, term: bytes) -> int:
        code = -1
        if self._taken[slot_of(term)]:
            code = len(self.terms)
            self.terms.append(term)
        self[term] = code
        return code


class _Builder:
    """Postings of the documents of one block."""

    def __init__(self) -> None:
        self.names: list[int | None] = []
        self.lengths: list[int] = []
        self.held = 0
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, names: list[int | None], found: list[list[bytes]], codes: _Codes) -> None:
        lengths = [len(x) for x in found]
        code = np.fromiter((codes[t] for x in found for t in x), np.int64, sum(lengths))
        doc = np.repeat(np.arange(len(self.names), len(self.names) + len(found)), lengths)
        known = code >= 0
        key, count = np.unique(code[known] << 32 | doc[known], return_counts=True)
        self.parts.append((key >> 32, key & 0xFFFFFFFF, count))
        self.held += len(key)
        self.names += names
        self.lengths += lengths

    def close(self, block: str, terms: list[bytes]) -> pa.RecordBatch:
        code, doc, count = (np.concatenate(x) for x in zip(*self.parts))
        order = np.argsort(code, kind="stable")     # documents of a term stay in order
        code, doc, count = code[order], doc[order], count[order]
        used, dfs = np.unique(code, return_counts=True)
        lengths = np.array(self.lengths, dtype=np.int64)
        return pa.RecordBatch.from_pylist([{
            "block": block, "n_docs": int((lengths > 0).sum()), "n_terms": int(lengths.sum()),
            "names": np.array([n or 0 for n in self.names], np.int64).tobytes(),
            "named": np.array([n is not None for n in self.names], bool).tobytes(),
            "lengths": lengths.tobytes(), "terms": [terms[c] for c in used.tolist()],
            "dfs": dfs.tolist(), "docs": doc.astype(np.int32).tobytes(),
            "counts": count.astype(np.int32).tobytes()}], schema=_SCHEMA)


_SCHEMA = pa.schema([
    ("block", pa.string()), ("n_docs", pa.int32()), ("n_terms", pa.int64()),
    ("names", pa.binary()), ("named", pa.binary()), ("lengths", pa.binary()),
    ("terms", pa.list_(pa.binary())), ("dfs", pa.list_(pa.int32())), ("docs", pa.binary()),
    ("counts", pa.binary())])


def build_index(docs: DataFrame, taken: np.ndarray, documents: int = DOCUMENTS,
                postings: int = POSTINGS) -> DataFrame:
    """Blocks of postings, made where the documents are read: nothing is shuffled.

    Only terms whose slot is ``taken`` are kept, all of them with every document;
    lengths count all terms. A block closes at ``documents`` documents or
    ``postings`` postings, between two documents.
    """
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        task, number = TaskContext.get().partitionId(), 0
        codes, held = _Codes(taken), _Builder()
        for batch in batches:
            names = batch.column(0).to_pylist()
            texts = texts_of(batch.column(1))
            step = 64       # documents whose terms are listed at a time
            for low in range(0, len(names), step):
                held.add(names[low:low + step],
                         [terms_of(t) for t in texts[low:low + step]], codes)
                if len(held.names) >= documents or held.held >= postings:
                    yield held.close(f"{task}-{number}", codes.terms)
                    number, held = number + 1, _Builder()
                    if len(codes) > REMEMBERED:
                        codes = _Codes(taken)
        if held.names:
            yield held.close(f"{task}-{number}", codes.terms)
    return docs.mapInArrow(build, INDEX)


def item_terms(items: DataFrame) -> DataFrame:
    """``item, term, repeats`` of query rows ``item, text``; a null text has no term."""
    def split(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for item, text in zip(batch.column(0).to_pylist(), texts_of(batch.column(1))):
            found: dict[bytes, int] = {}
            for term in terms_of(text):
                found[term] = found.get(term, 0) + 1
            yield pa.RecordBatch.from_arrays(
                [pa.array([item] * len(found), pa.int64()), pa.array(list(found), pa.binary()),
                 pa.array([slot_of(t) for t in found], pa.int32()),
                 pa.array(list(found.values()), pa.int64())],
                names=["item", "term", "slot", "repeats"])
    return map_batches(items, "item long, term binary, slot int, repeats long", split)


class Postings:
    """One block of documents, ready to be scored."""

    def __init__(self, values: dict, n_docs: int, n_terms: int) -> None:
        self.names = np.frombuffer(values["names"], np.int64)
        self.named = np.frombuffer(values["named"], bool)   # where doc_id is not null
        lengths = np.frombuffer(values["lengths"], np.int64)
        self.docs = np.frombuffer(values["docs"], np.int32)
        counts = np.frombuffer(values["counts"], np.int32).astype(np.int64)
        m = 100 - 25 + 25 * lengths * n_docs // max(n_terms, 1)
        self.shares = 1_000_000_000 * counts // (1000 * counts + 12 * m[self.docs])
        ends = np.cumsum(values["dfs"], dtype=np.int64)
        self.at = {t: (int(e) - n, int(e))
                   for t, e, n in zip(values["terms"], ends, values["dfs"])}
        # the most that one occurrence in a query can add, per unit of weight
        most = np.maximum.reduceat(self.shares, ends - values["dfs"]) if len(ends) else ()
        self.most = dict(zip(values["terms"], np.asarray(most).tolist()))

    def best(self, terms: list[tuple[bytes, int, int]], k: int, floor: int
             ) -> tuple[np.ndarray, np.ndarray]:
        """Documents with a score above 0 that may be among the ``k`` best, with their scores.

        ``terms`` are ``(term, weight, repeats)``, rarest first; ``floor`` is a score
        that ``k`` documents elsewhere are known to reach, or 0.
        """
        here = [(*self.at[t], w * r, w * r * self.most[t]) for t, w, r in terms if t in self.at]
        left = np.cumsum([0, *[x[3] for x in reversed(here)]])[::-1]    # what terms from here add
        sums = np.zeros(len(self.names), dtype=np.int64)
        at, limit = 0, floor
        # every document of a term gets an accumulator while a new one may reach the limit
        while at < len(here) and left[at] >= limit:
            low, high, weight, _ = here[at]
            sums[self.docs[low:high]] += weight * self.shares[low:high]
            at += 1
            if at < len(here) and len(sums) > k and left[at] <= sums.max():
                limit = max(limit, int(np.partition(sums, -k)[-k]))
        alive = np.flatnonzero((sums > 0) & (sums + left[at] >= limit))
        for low, high, weight, most in here[at:]:
            docs = self.docs[low:high]
            place = np.searchsorted(docs, alive)
            place[place == len(docs)] = 0
            has = docs[place] == alive
            sums[alive[has]] += weight * self.shares[low:high][place[has]]
        score = sums[alive]
        if len(score) > k:
            limit = max(limit, int(np.partition(score, -k)[-k]))
        kept = (score >= limit) & (score > 0)
        return alive[kept], score[kept]


def _packed_items(weighted: DataFrame, many: int) -> DataFrame:
    """One row per block of queries: their terms, rarest first, with weights and repeats."""
    entry = F.struct(F.col("df"), F.col("term"), F.col("weight"), F.col("repeats"))
    per_item = weighted.groupBy("item").agg(F.sort_array(F.collect_list(entry)).alias("terms"))
    return per_item.groupBy(F.pmod(F.xxhash64("item"), F.lit(many)).cast("int").alias("items")) \
        .agg(F.collect_list(F.struct("item", "terms")).alias("queries"))


def rank(docs: DataFrame, items: DataFrame, k: int = TOP, documents: int = DOCUMENTS,
         per_block: int = ITEMS) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` best documents of each query, exactly.

    ``docs`` has ``doc_id, text``, ``items`` ``item_id, text``. A term of df documents
    weighs floor(1000 * ln((2N + 2) / (2df + 1))); a document adds, for every
    occurrence of a term in the query, weight * (10^9 tf div (1000 tf + 12 m)) with m =
    75 + 25 n N div L, where n are its own and L all documents' terms and N the
    documents with any term. Equal scores go to the smaller doc_id, nulls last; only
    scores above 0 count, and fewer than ``k`` are all returned. Null and empty texts
    have no terms. Repeated rows are rows of their own, queries too, so a repeated
    item_id has several lists. Empty tables give no rows; other columns are ignored.
    """
    spark = prepare(docs.sparkSession)
    queries = stored(items.select(F.monotonically_increasing_id().alias("item"),
                                  F.col("item_id").cast("long"), "text"))
    terms = stored(item_terms(queries.select("item", "text")))
    # at most SLOTS numbers, however many terms there are
    slots = terms.select("slot").distinct().toArrow().column(0).to_numpy()
    taken = np.zeros(SLOTS, dtype=bool)
    taken[slots] = True
    index = stored(build_index(docs.select(F.col("doc_id").cast("long"), "text"),
                               taken, documents))
    totals = index.agg(F.sum("n_docs"), F.sum("n_terms"), F.count(F.lit(1))).first()
    n_docs, n_terms, blocks = (int(x or 0) for x in totals)

    df = index.select(F.explode(F.arrays_zip("terms", "dfs")).alias("t")) \
        .groupBy(F.col("t.terms").alias("term")).agg(F.sum("t.dfs").alias("df"))
    weight = F.floor(1000 * F.log((F.lit(2.0 * n_docs + 2)) / (2 * F.col("df") + 1)))
    weighted = terms.join(df, "term").select("item", "term", "repeats", "df",
                                             weight.cast("long").alias("weight"))
    many = max(1, -(-queries.count() // per_block))
    # every query block goes to each share of the document blocks, so that a share is a task
    shares = max(1, min(blocks, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    left = _packed_items(weighted, many).withColumn(
        "share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))
    right = index.withColumn("share", F.pmod(F.xxhash64("block"), F.lit(shares)).cast("int")) \
        .withColumn("items", F.explode(F.sequence(F.lit(0), F.lit(many - 1)))) \
        .select("share", "items", *BLOCK)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[int, bool, int]]] = {}
        floors: dict[int, int] = {}
        now: int | None = None
        asked: list[tuple[int, list[tuple[bytes, int, int]]]] = []

        def close() -> Iterator[pa.RecordBatch]:
            rows = [(item, -doc if named else None, total) for item, best in held.items()
                    for total, named, doc in best]
            held.clear()
            floors.clear()
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, pa.int64()) for x in zip(*rows)],
                    names=["item", "row_name", "score"])

        for batch in batches:
            for at in range(batch.num_rows):
                if now != (number := batch.column("items")[at].as_py()):
                    yield from close()
                    now = number
                    asked = [(q["item"], [(t["term"], t["weight"], t["repeats"])
                                          for t in q["terms"]])
                             for q in batch.column("queries")[at].as_py()]
                values = {c: batch.column(c)[at].as_py() for c in BLOCK}
                block = Postings(values, n_docs, n_terms)
                for item, wanted in asked:
                    alive, sums = block.best(wanted, k, floors.get(item, 0))
                    if not len(alive):
                        continue
                    best = held.setdefault(item, [])
                    # nulls come last among equal scores
                    best += zip(sums.tolist(), block.named[alive].tolist(),
                                [-doc for doc in block.names[alive].tolist()])
                    best.sort(reverse=True)
                    del best[k:]
                    if len(best) == k:
                        floors[item] = best[-1][0]
        yield from close()

    dealt = left.join(right, ["share", "items"]).sortWithinPartitions("items")
    found = dealt.mapInArrow(score, FOUND)
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("row_name"))
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.join(queries.select("item", "item_id"), "item").select(
        "item_id", F.col("rank").cast("int"), F.col("row_name").alias("doc_id"), "score")
