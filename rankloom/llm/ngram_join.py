"""Jaccard join of documents over word n-grams, by a prefix tree of ordered sets.

1. One pass turns every text into its set of hashed n-grams; texts with equal
   sets form one class. N-grams travel packed by hash range; each range reports
   the n-grams that at least two classes share, with their frequency. Others can
   add to no overlap, so they only count in a set's size.
2. Two sets that pass the threshold share one of their rarest n-grams (prefix
   rule). Classes tied by such n-grams form candidate groups. A large group is cut
   into blocks; where most of its n-grams stand in few blocks (a chain of texts that
   each overlap the next), only blocks that share a prefix n-gram meet.
3. Blocks that meet are stored in a trie of globally ordered sets; each set walks the
   trie, overlaps of shared paths are counted once, and subtrees whose remaining
   lengths cannot reach the threshold are pruned.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm.components import connected_components
from rankloom.llm.groups import block_pairs, merge_labels, walk_groups
from rankloom.llm.tables import prepare, stored, texts_of
from rankloom.llm.words import blocks, mix64, read_block, window_hashes, word_hashes

SIZE = 5
PERCENT = 75
# Characters of text per hash range: bounds the n-grams that one group holds.
RANGE_CHARS = 4_000_000
# N-grams packed together by a task before they are sent.
CHUNK = 1_000_000
# An n-gram in so many classes of one chunk is sent apart, so that no range is hot.
HOT = 512
HOT_FREQUENCY = 1 << 40
# Classes per block of a candidate group.
BLOCK = 2048
# Blocks that a posting's n-gram may stand in on average, for blocks to meet by n-grams.
WIDE = 8

# Rows between the two halves of the first pass. kind 0: n-grams of one hash range with
# the place of their class in the chunk; kind 1: facts on documents; kind 2: hot n-grams
# with their classes; kind 3: hot n-grams alone, told to their range.
_PACKED = pa.schema([("part", pa.int32()), ("kind", pa.int32()), ("chunk", pa.int64()),
                     ("places", pa.binary()), ("grams", pa.binary())])
_FACTS = pa.schema([("kind", pa.int32()), ("a", pa.int64()), ("b", pa.int64()),
                    ("c", pa.int64()), ("d", pa.int64())])
# Classes per chunk: their places are 16-bit numbers. n-grams travel as 6 bytes, the
# range standing for the rest.
_PLACES = 1 << 16
_BYTES = 6


def gram_sets(texts: list[bytes], size: int = SIZE) -> Iterator[np.ndarray]:
    """Sorted distinct n-gram hashes of each text; fewer words than ``size`` are one."""
    for low, high in blocks(texts):
        b = read_block([t.lower() for t in texts[low:high]])    # bytes: only A-Z change
        hashes = word_hashes(b)
        for first, last in zip(b.first.tolist(), b.last.tolist()):
            n = last - first
            yield np.unique(window_hashes(hashes[first:last], min(size, n))) if n \
                else np.zeros(0, dtype=np.uint64)


def _signature(grams: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(grams.tobytes(), digest_size=8).digest(), "little",
                          signed=True)


def _low_bits(parts: int) -> int:
    """Bits of an n-gram's hash that are kept beside its range, 63 together at most."""
    return min(8 * _BYTES, 63 - parts.bit_length())


def _rows(rows: list[tuple[int, int, int, bytes, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _PACKED)],
                                      schema=_PACKED)


def _short(grams: np.ndarray) -> bytes:
    return grams.view(np.uint8).reshape(-1, 8)[:, :_BYTES].tobytes()


def _long(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // _BYTES, 8), np.uint8)
    out[:, :_BYTES] = np.frombuffer(data, np.uint8).reshape(-1, _BYTES)
    return out.view(np.uint64).reshape(-1)


def _hot_range(chunk: int, parts: int) -> int:
    """A range for a chunk's hot n-grams; chunk numbers are multiples of _PLACES."""
    return int(mix64(np.array([chunk // _PLACES], np.uint64))[0] % np.uint64(parts))


def _pack(sets: list[np.ndarray], chunk: int, parts: int) -> pa.RecordBatch:
    """The n-grams of a chunk of classes, by hash range; hot ones apart."""
    owner = np.repeat(np.arange(len(sets), dtype=np.uint16), [len(s) for s in sets])
    grams = np.concatenate(sets)
    low = _low_bits(parts)
    part = ((grams >> np.uint64(40)) * np.uint64(parts)) >> np.uint64(24)
    grams = grams & np.uint64((1 << low) - 1)
    rows: list[tuple] = []
    if len(sets) >= HOT:
        whole = (part << np.uint64(low)) | grams
        order = np.sort(whole)
        hot = np.unique(order[HOT - 1:][order[HOT - 1:] == order[:len(order) - HOT + 1]])
        if len(hot):
            apart = np.isin(whole, hot)
            rows.append((_hot_range(chunk, parts), 2, chunk, owner[apart].tobytes(),
                         whole[apart].tobytes()))
            for r in np.unique(hot >> np.uint64(low)):
                mine = hot[hot >> np.uint64(low) == r] & np.uint64((1 << low) - 1)
                rows.append((int(r), 3, chunk, b"", _short(mine)))
            owner, grams, part = owner[~apart], grams[~apart], part[~apart]
    order = np.argsort(part.astype(np.uint16 if parts <= 1 << 16 else np.uint32),
                       kind="stable")
    part, owner, grams = part[order], owner[order], grams[order]
    cuts = np.append(np.flatnonzero(np.append(True, part[1:] != part[:-1])), len(part)) \
        if len(part) else np.zeros(1, int)
    rows += [(int(part[a]), 0, chunk, owner[a:z].tobytes(), _short(grams[a:z]))
             for a, z in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
    return _rows(rows)


def _facts(kind: int, *columns) -> pa.RecordBatch:
    number = len(columns[0])
    full = [np.asarray(c, np.int64) for c in columns] + [np.zeros(number, np.int64)] * (
        4 - len(columns))
    return pa.RecordBatch.from_arrays([pa.array(np.full(number, kind, np.int32)),
                                       *map(pa.array, full)], schema=_FACTS)


def _shared(table: pa.Table, low: int) -> pa.RecordBatch | None:
    """Facts of one hash range.

    kind 0: (owner, n-gram, frequency) for n-grams of two owners or more;
    kind 1: (document, class, size, owner) passed on.
    """
    out: list[pa.RecordBatch] = []
    owners, grams, hot = [], [], [np.zeros(0, np.uint64)]
    for row in table.to_pylist():
        kind, chunk = row["kind"], row["chunk"]
        if kind == 1:
            out.append(_facts(1, np.frombuffer(row["places"], np.int64),
                              *np.frombuffer(row["grams"], np.int64).reshape(3, -1)))
        elif kind == 2:
            places = np.frombuffer(row["places"], np.uint16)
            out.append(_facts(0, places.astype(np.int64) + chunk,
                              np.frombuffer(row["grams"], np.int64),
                              np.full(len(places), HOT_FREQUENCY)))
        elif kind == 3:
            hot.append(_long(row["grams"]))
        else:
            owners.append(np.frombuffer(row["places"], np.uint16).astype(np.int64) + chunk)
            grams.append(_long(row["grams"]))
    if grams:
        owner, gram, hot = np.concatenate(owners), np.concatenate(grams), np.concatenate(hot)
        order = np.argsort(gram)
        g = gram[order]
        same = np.append(False, g[1:] == g[:-1])
        often = same | np.append(same[1:], False)
        if len(hot):
            often |= np.isin(g, hot)
        g, owner = g[often], owner[order[often]]
        if len(g):
            start = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
            length = np.diff(np.append(start, len(g)))
            frequency = np.repeat(np.where(np.isin(g[start], hot), HOT_FREQUENCY, length), length)
            g = g | np.uint64(table.column("part")[0].as_py() << low)
            order = np.argsort(owner, kind="stable")
            out.append(_facts(0, owner[order], g[order].view(np.int64), frequency[order]))
    out = [b for b in out if b.num_rows]
    return pa.Table.from_batches(out).combine_chunks().to_batches()[0] if out else None


def shared_grams(docs: DataFrame, size: int, range_chars: int) -> tuple[DataFrame, DataFrame]:
    """``postings`` (owner, gram, frequency) and ``members`` (doc_id, sig, n, owner).

    One pass over the texts. An owner is a class as one chunk of a task saw it;
    owners of one class in several chunks hold the same n-grams.
    """
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = int(min(max(64, chars // range_chars), 1 << 22))
    low = _low_bits(parts)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 36
        sets: list[np.ndarray] = []
        places: dict[int, int] = {}
        held = 0
        for batch in batches:
            texts = texts_of(batch.column(1))
            sigs, sizes, owners = (np.zeros(len(texts), np.int64) for _ in range(3))
            for i, grams in enumerate(gram_sets(texts, size)):
                sig = _signature(grams)
                if len(grams) and sig not in places:
                    places[sig] = len(sets)
                    sets.append(grams)
                    held += len(grams)
                sigs[i], sizes[i], owners[i] = sig, len(grams), chunk + places.get(sig, 0)
                if held >= CHUNK or len(sets) == _PLACES:
                    yield _pack(sets, chunk, parts)
                    chunk, sets, places, held = chunk + _PLACES, [], {}, 0
            known = ~np.asarray(batch.column(0).is_null())
            if known.any():
                ids = np.array([i for i in batch.column(0).to_pylist() if i is not None], np.int64)
                facts = np.stack([sigs[known], sizes[known], owners[known]])
                yield _rows([(int(ids[0] % parts), 1, chunk, ids.tobytes(), facts.tobytes())])
        if sets:
            yield _pack(sets, chunk, parts)

    packed = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        pack, "part int, kind int, chunk long, places binary, grams binary")
    facts = stored(walk_groups(packed, ["part"], "kind int, a long, b long, c long, d long",
                               lambda table: _shared(table, low)), "kind")
    postings = facts.where("kind = 0").select(
        F.col("a").alias("owner"), F.col("b").alias("gram"), F.col("c").alias("frequency"))
    members = facts.where("kind = 1").select(
        F.col("a").alias("doc_id"), F.col("b").alias("sig"), F.col("c").alias("n"),
        F.col("d").alias("owner"))
    return postings, members


class Trie:
    """A path-compressed trie over ordered sets, walked level by level.

    Sets are runs of ``tokens`` (ascending ids), sorted as sequences. A node
    covers the sets ``low..high-1`` and the tokens from its parent's depth to its
    own; ``spare`` is the longest rest below it, ``small``/``large`` bound the
    sizes of its sets. Every set has a leaf of its own.
    """

    def __init__(self, sets: list[np.ndarray], sizes: np.ndarray) -> None:
        self.offset = np.append(0, np.cumsum([len(s) for s in sets])).astype(np.int64)
        self.tokens = np.concatenate(sets) if len(sets) else np.zeros(0, np.int64)
        lengths = np.diff(self.offset)
        common = [self._common(a, b) for a, b in zip(sets[:-1], sets[1:])] + [-1]
        low, depth, parent = [0], [0], [-1]     # the root
        stack, leaf_parent = [0], []
        for i, shared in enumerate(common):
            # a leaf hangs below the deepest node it shares with a neighbour
            need = max(common[i - 1] if i else 0, shared, 0)
            if depth[stack[-1]] < need:
                low.append(i)
                depth.append(need)
                parent.append(stack[-1])
                stack.append(len(low) - 1)
            leaf_parent.append(stack[-1])
            while shared >= 0 and depth[stack[-1]] > shared:
                last = stack.pop()
                if depth[stack[-1]] < shared:
                    low.append(low[last])
                    depth.append(shared)
                    parent.append(stack[-1])
                    parent[last] = len(low) - 1
                    stack.append(len(low) - 1)
        inner, n = len(low), len(sets)
        self.leaf0 = inner
        self.parent = np.array(parent + leaf_parent, np.int64)
        self.depth = np.append(np.array(depth, np.int64), lengths)
        self.low = np.append(np.array(low, np.int64), np.arange(n))
        self.high = np.zeros(inner + n, np.int64)
        self.high[inner:] = np.arange(1, n + 1)
        self.small = np.full(inner + n, np.iinfo(np.int64).max)
        self.large = np.zeros(inner + n, np.int64)
        longest = np.zeros(inner + n, np.int64)
        self.small[inner:] = self.large[inner:] = sizes
        longest[inner:] = lengths
        order = np.argsort(-self.depth[:inner], kind="stable")
        for values, rule in ((self.high, np.maximum), (self.small, np.minimum),
                             (self.large, np.maximum), (longest, np.maximum)):
            rule.at(values, self.parent[inner:], values[inner:])
            for node in order.tolist():
                if node:
                    up = self.parent[node]
                    values[up] = rule(values[up], values[node])
        self.spare = longest - self.depth
        by_parent = np.argsort(self.parent, kind="stable")
        self.children = by_parent[1:]           # the root's entry comes first
        self.first = np.searchsorted(self.parent[self.children], np.arange(inner))
        self.last = np.searchsorted(self.parent[self.children], np.arange(inner), "right")

    @staticmethod
    def _common(a: np.ndarray, b: np.ndarray) -> int:
        n = min(len(a), len(b))
        differ = np.flatnonzero(a[:n] != b[:n])
        return int(differ[0]) if len(differ) else n

    def walk(self, at: int, size: int, marks: np.ndarray, percent: int) -> np.ndarray:
        """Later sets (sorted positions) that link with set ``at`` of ``size`` n-grams."""
        mine = self.tokens[self.offset[at]:self.offset[at + 1]]
        marks[mine] = 1
        used = np.append(np.cumsum(marks), 0)   # my tokens up to an id; -1: none
        nodes = np.zeros(1, np.int64)
        overlap = np.zeros(1, np.int64)
        links = [np.zeros(0, np.int64)]
        while len(nodes):
            width = self.last[nodes] - self.first[nodes]
            up = np.repeat(np.arange(len(nodes)), width)
            place = np.arange(len(up)) - np.repeat(np.cumsum(width) - width, width)
            below = self.children[self.first[nodes][up] + place]
            base, seen = self.depth[nodes][up], overlap[up]
            # partners below: later ones, of a size that the threshold allows
            ok = (self.high[below] > at + 1) \
                & (100 * self.large[below] >= percent * size) \
                & (100 * size >= percent * self.small[below])
            # the best overlap still possible: all that is left on both sides
            least = np.maximum(self.small[below], -(-percent * size // 100))
            need = -(-percent * (size + least) // (100 + percent))
            start = self.offset[self.low[below]]
            rest = self.depth[below] - base + self.spare[below]
            left = len(mine) - np.where(base > 0, used[self.tokens[start + base - 1]]
                                        if len(self.tokens) else 0, 0)
            ok &= seen + np.minimum(rest, left) >= need
            below, base, seen, start, need = (v[ok] for v in (below, base, seen, start, need))
            if not len(below):
                break
            # overlap of each node's own tokens, counted once for all sets below it
            long = self.depth[below] - base
            ends = np.cumsum(long)
            flat = np.arange(ends[-1]) - np.repeat(ends - long - start - base, long)
            sums = np.append(0, np.cumsum(marks[self.tokens[flat]], dtype=np.int64))
            seen = seen + sums[ends] - sums[ends - long]
            leaf = below >= self.leaf0
            other = below[leaf] - self.leaf0
            found = seen[leaf]
            both = size + self.large[below[leaf]] - found
            links.append(other[(other > at) & (100 * found >= percent * both)])
            deeper = ~leaf & (seen + self.spare[below] >= need)
            nodes, overlap = below[deeper], seen[deeper]
        marks[mine] = 0
        return np.concatenate(links)


def trie_join(sets: list[tuple[np.ndarray, np.ndarray]], sizes: np.ndarray, percent: int
              ) -> Iterator[tuple[int, np.ndarray]]:
    """Linked pairs ``(i, partners)``, each pair once.

    A set is its shared n-grams and their frequencies; the global order is most
    frequent first, so that paths from the root are shared the most.
    """
    lengths = [len(g) for g, _ in sets]
    grams = np.concatenate([g for g, _ in sets])
    frequency = np.concatenate([f for _, f in sets])
    distinct, where, inverse, count = np.unique(grams, return_index=True, return_inverse=True,
                                                return_counts=True)
    rank = np.empty(len(distinct), np.int64)
    rank[np.lexsort((distinct, -frequency[where]))] = np.arange(len(distinct))
    ids, here = rank[inverse], count[inverse] > 1   # others meet no partner in this block
    cuts = np.append(0, np.cumsum(lengths))
    ordered = [np.sort(ids[a:b][here[a:b]]) for a, b in zip(cuts[:-1], cuts[1:])]
    order = sorted(range(len(sets)), key=lambda i: ordered[i].astype(">u4").tobytes())
    order = np.array(order, np.int64)
    trie = Trie([ordered[i] for i in order], sizes[order])
    marks = np.zeros(len(distinct), np.int8)
    for at in range(len(order) - 1):
        partners = trie.walk(at, int(sizes[order[at]]), marks, percent)
        if len(partners):
            yield int(order[at]), order[partners]


def _ragged(column: pa.ChunkedArray) -> list[np.ndarray]:
    return [np.asarray(v.values) for v in column.combine_chunks()] if len(column) else []


def meetings(groups: DataFrame, sets: DataFrame, keys: DataFrame, block: int) -> DataFrame:
    """``sig, component, side, low, high``: each class in every pair of blocks it is part of.

    A group of at most ``block`` classes is one block. In a larger one the classes with
    the same smallest n-gram form blocks, and blocks meet that share a prefix n-gram, if
    its postings stand in WIDE blocks or fewer on average: the meetings are then at most
    WIDE times the postings. In a denser group, as of many edits of one text, blocks by
    hash meet pairwise.
    """
    sized = groups.join(groups.groupBy("component").agg(F.count(F.lit(1)).alias("members")),
                        "component").select(F.col("node").alias("sig"), "component", "members")
    large = sized.where(F.col("members") > block).join(
        sets.select("sig", F.array_min(F.col("grams.gram")).alias("least")), "sig")
    alike = large.groupBy("component", "least").agg(F.count(F.lit(1)).alias("alike"))
    part = F.pmod(F.xxhash64("sig"), F.ceil(F.col("alike") / F.lit(block)))
    placed = stored(large.join(alike, ["component", "least"]).select(
        "sig", "component", "members", F.xxhash64("least", part).alias("side")))

    met = keys.join(placed, "sig").groupBy("component", "gram", "side").agg(
        F.count(F.lit(1)).alias("n"))
    spread = met.groupBy("component", "gram").agg(F.count(F.lit(1)).alias("sides"),
                                                  F.sum("n").alias("n"))
    sparse = stored(spread.groupBy("component").agg(
        F.sum(F.col("sides") * F.col("n")).alias("meet"), F.sum("n").alias("n"))
        .where(F.col("meet") <= WIDE * F.col("n")).select("component"))
    pairs = stored(
        met.join(sparse, "component", "left_semi").groupBy("component", "gram")
        .agg(F.sort_array(F.collect_set("side")).alias("sides")).where(F.size("sides") > 1)
        .select("component", "sides").distinct()
        .select("component", "sides", F.posexplode("sides").alias("at", "low"))
        .select("component", "low", F.explode(F.slice(
            "sides", F.col("at") + 2, F.size("sides"))).alias("high")).distinct())
    near = placed.join(sparse, "component", "left_semi").select("sig", "component", "side")
    columns = ["sig", "component", "side", "low", "high"]
    ends = [near.join(pairs.withColumn("side", F.col(end)), ["component", "side"])
            .select(*columns) for end in ("low", "high")]
    dense = sized.where(F.col("members") <= block).unionByName(
        placed.join(sparse, "component", "left_anti").drop("side"))
    return near.withColumns({"low": F.col("side"), "high": F.col("side")}) \
        .union(ends[0]).union(ends[1]).union(
            block_pairs(dense, ["component"], "sig", "members", block)
            .select(*[F.col(c).cast("long") for c in columns]))


def links(docs: DataFrame, size: int = SIZE, percent: int = PERCENT, block: int = BLOCK,
          range_chars: int = RANGE_CHARS) -> DataFrame:
    """One row per document: ``doc_id, n_shingles, n_links, component_id``.

    Documents link when 100 * intersection >= percent * union of their n-gram
    sets (A-Z lower-cased). ``n_links`` counts linked documents, copies too;
    ``component_id`` is the smallest doc_id that links reach, itself included.
    Texts without words, and null texts, have size 0 and no links. Rows with a
    null doc_id cannot be named in a result and are left out; a repeated doc_id
    is a document of its own each time. Other columns are ignored.
    """
    prepare(docs.sparkSession)
    postings, members = shared_grams(docs, size, range_chars)
    classes = members.where("n > 0").groupBy("sig").agg(
        F.first("n").alias("n"), F.min("doc_id").alias("rep"), F.min("owner").alias("owner"),
        F.count(F.lit(1)).alias("copies"))
    lists = postings.groupBy("owner").agg(
        F.sort_array(F.collect_set(F.struct("frequency", "gram"))).alias("grams"))
    # rarest first; n-grams of no other class come before all of these
    prefix = F.size("grams") - F.ceil(F.col("n") * percent / F.lit(100)).cast("int") + 1
    sets = stored(lists.join(classes, "owner").withColumn("prefix", prefix).where("prefix > 0"))

    keys = sets.select("sig", F.explode(F.slice("grams", 1, F.col("prefix"))).alias("g")) \
        .select("sig", F.col("g.gram").alias("gram"))
    hubs = keys.groupBy("gram").agg(F.min("sig").alias("hub"))
    ties = keys.join(hubs, "gram").where("sig != hub") \
        .select(F.col("sig").alias("a"), F.col("hub").alias("b")).distinct()
    groups = stored(connected_components(ties))
    dealt = sets.join(meetings(groups, sets, keys, block), "sig").select(
        "component", "side", "low", "high", "sig", "n", "copies",
        F.col("grams.gram").alias("grams"), F.col("grams.frequency").alias("frequency"))

    def join(table: pa.Table) -> pa.RecordBatch | None:
        sig, n, copies, side = (table.column(c).to_numpy() for c in ("sig", "n", "copies",
                                                                     "side"))
        across = table.column("low")[0].as_py() != table.column("high")[0].as_py()
        sets = list(zip(_ragged(table.column("grams")), _ragged(table.column("frequency"))))
        if len(sets) < 2:
            return None
        label, degree = np.arange(len(sig)), np.zeros(len(sig), np.int64)
        for at, partners in trie_join(sets, n, percent):
            if across:
                partners = partners[side[partners] != side[at]]
            if len(partners):
                degree[at] += copies[partners].sum()
                degree[partners] += copies[at]
                merge_labels(label, at, partners)
        linked = np.flatnonzero(degree)
        return pa.RecordBatch.from_arrays(
            [pa.array(sig[linked]), pa.array(sig[label[linked]]), pa.array(degree[linked])],
            names=["sig", "root", "degree"])

    found = stored(walk_groups(dealt, ["component", "low", "high"],
                               "sig long, root long, degree long", join))
    degrees = found.groupBy("sig").agg(F.sum("degree").alias("degree"))
    roots = connected_components(found.select(F.col("sig").alias("a"), F.col("root").alias("b")))
    return _per_document(members, classes, degrees, roots)


def _per_document(members: DataFrame, classes: DataFrame, degrees: DataFrame,
                  roots: DataFrame) -> DataFrame:
    """Spread the classes' links and components over their documents."""
    named = roots.join(classes.select("sig", "rep"), roots["node"] == classes["sig"])
    smallest = named.groupBy("component").agg(F.min("rep").alias("least"))
    facts = classes.join(
        roots.join(smallest, "component").select(F.col("node").alias("sig"), "least"),
        "sig", "left").join(degrees, "sig", "left").select(
        "sig", F.coalesce("least", "rep").alias("least"),
        (F.col("copies") - 1 + F.coalesce("degree", F.lit(0))).alias("n_links"))
    return members.join(facts, "sig", "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("least", "doc_id").alias("component_id"))
