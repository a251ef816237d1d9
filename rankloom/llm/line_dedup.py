"""Removal of repeated passages by hashing normalised units.

Units are lines; inside a line a unit also ends after every word whose hash falls
into a fixed third, so that a passage set into other text is cut at the same
words wherever it stands. A digest covers the words of RUN units in a row (A-Z
lower-cased, white space ignored): common short units alone match nothing,
however large the corpus. Digests are grouped globally; the occurrence in the
smallest doc_id, then the first in the text, stays. Runs of units with later
occurrences, of at least ``min_words`` words, are removed with their offsets kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm.groups import walk_groups
from rankloom.llm.tables import prepare, stored, texts_of
from rankloom.llm.words import (blocks, char_starts, mix64, read_block, window_hashes,
                                word_hashes)

MIN_WORDS = 25
CUT_EVERY = 3
# Units per digest: about a dozen words.
RUN = 4
RANGE_CHARS = 4_000_000
CHUNK = 1_000_000
_STEP = np.uint64(0xD6E8FEB86659FD93)

_PACKED = pa.schema([("part", pa.int32()), ("kind", pa.int32()), ("ids", pa.binary()),
                     ("rows", pa.binary()), ("units", pa.binary()), ("digests", pa.binary())])


def units(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Per text: digest, words, first byte and end byte of every unit, in order."""
    for low, high in blocks(texts):
        chunk = texts[low:high]
        b = read_block([t.lower() for t in chunk])
        hashes = word_hashes(b)
        ends = (hashes >> np.uint64(20)) % np.uint64(CUT_EVERY) == 0
        if len(hashes):
            feeds = np.append(0, np.cumsum(b.data == 10))
            ends[:-1] |= feeds[b.start[1:]] > feeds[b.stop[:-1]]
            ends[-1] = True
        stop = np.flatnonzero(ends) + 1
        start = np.append(0, stop[:-1]) if len(stop) else stop
        power = np.full(len(hashes), _STEP, dtype=np.uint64)
        digests = np.zeros(len(stop), np.uint64)
        if len(stop):
            # word k of a unit is multiplied by STEP ** k
            place = np.arange(len(hashes)) - np.repeat(start, stop - start)
            steps = np.cumprod(np.append(np.uint64(1), power[:int(place.max())]))
            digests = mix64(np.add.reduceat(hashes * steps[place], start)
                            + (stop - start).astype(np.uint64))
        cut = np.searchsorted(start, b.first), np.searchsorted(start, b.last)
        for i, (f, g) in enumerate(zip(*cut)):
            base = b.begin[i]
            yield (digests[f:g], stop[f:g] - start[f:g], b.start[start[f:g]] - base,
                   b.stop[stop[f:g] - 1] - base)


def run_digests(digests: np.ndarray) -> np.ndarray:
    """Digest of every RUN units in a row, by the first one; a shorter text has one."""
    return window_hashes(digests, min(RUN, len(digests))) if len(digests) else digests


def _pack(ids: np.ndarray, rows: np.ndarray, unit: np.ndarray, digest: np.ndarray, parts: int
          ) -> pa.RecordBatch:
    """A chunk's first occurrences by hash range, and its later ones as known repeats."""
    order = np.lexsort((unit, rows, ids, digest))
    ids, rows, unit, digest = ids[order], rows[order], unit[order], digest[order]
    first = np.append(True, digest[1:] != digest[:-1])
    # the same row read twice is one occurrence
    leader = np.maximum.accumulate(np.where(first, np.arange(len(first)), 0))
    again = ~first & ((rows != rows[leader]) | (unit != unit[leader]))
    out = []
    if again.any():
        out.append((int(digest[0] % np.uint64(parts)), 1, ids[again], rows[again], unit[again],
                    digest[:0]))
    ids, rows, unit, digest = ids[first], rows[first], unit[first], digest[first]
    part = ((digest >> np.uint64(40)) * np.uint64(parts)) >> np.uint64(24)  # ascending
    cuts = np.append(np.flatnonzero(np.append(True, part[1:] != part[:-1])), len(part))
    out += [(int(part[a]), 0, ids[a:z], rows[a:z], unit[a:z], digest[a:z])
            for a, z in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
    part, kind, *arrays = map(list, zip(*out))
    return pa.RecordBatch.from_arrays(
        [pa.array(part, pa.int32()), pa.array(kind, pa.int32()),
         *[pa.array([x.tobytes() for x in a], pa.binary()) for a in arrays]], schema=_PACKED)


def _later(table: pa.Table) -> pa.RecordBatch | None:
    """(row, unit) of every occurrence but the earliest of each digest in a hash range."""
    found: list[tuple[np.ndarray, np.ndarray]] = []
    parts = []
    for row in table.to_pylist():
        ids, rows = (np.frombuffer(row[c], np.int64) for c in ("ids", "rows"))
        unit = np.frombuffer(row["units"], np.int32)
        if row["kind"] == 1:
            found.append((rows, unit))
        else:
            parts.append((ids, rows, unit, np.frombuffer(row["digests"], np.uint64)))
    if parts:
        ids, rows, unit, digest = map(np.concatenate, zip(*parts))
        order = np.argsort(digest)
        same = np.append(False, digest[order][1:] == digest[order][:-1])
        keep = order[same | np.append(same[1:], False)]
        if len(keep):
            ids, rows, unit, digest = ids[keep], rows[keep], unit[keep], digest[keep]
            order = np.lexsort((unit, rows, ids, digest))
            rows, unit, digest = rows[order], unit[order], digest[order]
            first = np.append(True, digest[1:] != digest[:-1])
            leader = np.maximum.accumulate(np.where(first, np.arange(len(first)), 0))
            again = ~first & ((rows != rows[leader]) | (unit != unit[leader]))
            found.append((rows[again], unit[again]))
    if not found:
        return None
    rows, unit = map(np.concatenate, zip(*found))
    return pa.RecordBatch.from_arrays([pa.array(rows), pa.array(unit)], names=["row", "unit"])


def _row_key():
    return F.xxhash64("doc_id", "text")


def repeated_units(docs: DataFrame, range_chars: int = RANGE_CHARS) -> DataFrame:
    """(row, units): per row key, where runs start that occur earlier elsewhere."""
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = int(min(max(64, chars // range_chars), 1 << 22))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0
        for batch in batches:
            ids, rows = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for i, (digest, _, _, _) in enumerate(units(texts_of(batch.column(2)))):
                digest = run_digests(digest)
                n = len(digest)
                held.append((np.full(n, ids[i]), np.full(n, rows[i]),
                             np.arange(n, dtype=np.int32), digest))
                size += n
            if size >= CHUNK:
                yield _pack(*map(np.concatenate, zip(*held)), parts)
                held, size = [], 0
        if size:
            yield _pack(*map(np.concatenate, zip(*held)), parts)
    last = F.lit((1 << 63) - 1).cast("long")    # rows without doc_id rank last
    packed = docs.select(F.coalesce(F.col("doc_id").cast("long"), last), _row_key(), "text") \
        .mapInArrow(run, "part int, kind int, ids binary, rows binary, units binary, "
                         "digests binary")
    later = walk_groups(packed, ["part"], "row long, unit int", _later)
    return later.groupBy("row").agg(F.sort_array(F.collect_set("unit")).alias("units"))


_SPANS = "array<struct<start:long,end:long,words:long>>"


def removed_spans(text: bytes, repeated: np.ndarray, min_words: int
                  ) -> list[tuple[int, int, int]]:
    """Stretches of repeated runs with at least ``min_words`` words, as byte offsets."""
    _, words, start, end = next(units([text]))
    mark = np.zeros(len(words) + 2, dtype=np.int8)
    for k in range(min(RUN, len(words))):
        mark[repeated + 1 + k] = 1
    edge = np.diff(mark)
    out = []
    for low, high in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)):
        total = int(words[low:high].sum())
        if total >= min_words:
            out.append((int(start[low]), int(end[high - 1]), total))
    return out


def remove_repeats(docs: DataFrame, min_words: int = MIN_WORDS,
                   range_chars: int = RANGE_CHARS) -> DataFrame:
    """``docs`` with cleaned ``text`` and ``removed``, the spans taken out.

    Spans are code points of the original text, ends exclusive. The earliest
    occurrence by doc_id stays, a null doc_id coming last; rows equal in doc_id
    and text count as one. A text that repeats others as a whole becomes empty;
    null and empty texts stay as they are. Other columns pass through.
    """
    prepare(docs.sparkSession)
    repeated = stored(repeated_units(docs, range_chars))
    docs = docs.drop("removed")
    # the caller's columns stay in one struct, so that no name of theirs meets one of these
    joined = docs.select(F.struct(*docs.columns).alias("doc"), _row_key().alias("row")).join(
        repeated, "row", "left").select("doc", "units")
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, all_spans = [], []
            doc = dict(zip(names, batch.column("doc").flatten()))
            for text, positions in zip(doc["text"].to_pylist(),
                                       batch.column("units").to_pylist()):
                spans = []
                if text and positions:
                    data = text.encode()
                    runs = removed_spans(data, np.array(positions), min_words)
                    if runs:
                        at = np.append(0, np.cumsum(char_starts(np.frombuffer(data, np.uint8))))
                        spans = [{"start": int(at[s]), "end": int(at[e]), "words": n}
                                 for s, e, n in runs]
                        cuts = [0, *[x for s in spans for x in (s["start"], s["end"])],
                                len(text)]
                        text = "".join(text[a:z] for a, z in zip(cuts[::2], cuts[1::2]))
                texts.append(text)
                all_spans.append(spans)
            columns = [pa.array(texts, pa.string()) if n == "text" else doc[n] for n in names]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(all_spans, pa.list_(pa.struct(
                    [("start", pa.int64()), ("end", pa.int64()), ("words", pa.int64())])))],
                names=[*names, "removed"])
    types = dict(docs.dtypes)
    schema = ", ".join(f"`{n}` {types[n]}" for n in names) + f", removed {_SPANS}"
    return joined.mapInArrow(run, schema)
