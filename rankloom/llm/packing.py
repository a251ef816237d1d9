"""Best-fit packing of token pieces, planned over a histogram of lengths.

``tokenize_pieces`` cuts each document into pieces of at most ``capacity``
tokens; ``plan_best_fit`` runs best-fit decreasing over (length, count) pairs,
so its work depends on the capacity and not on the number of documents;
``pack`` gives every piece the planned slot of its rank within its length.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm.ranks import md5_order, rank_in_groups
from rankloom.llm.tables import map_batches, prepare, stored

CAPACITY = 2048
VOCABULARY = "word_bpe_49k.json"
# Words remembered per Python worker (about 250 bytes each); then forgotten together.
CACHE_WORDS = 600_000
# Documents per stretch where their order counts: one stretch is planned in one task.
STRETCH = 8192

# Texts of these characters only (ASCII and Latin letters up to U+017F, without the
# dotted capital I) are cut into words here: composition leaves them as they are,
# lower case is one character each, and the pattern below equals the vocabulary's.
_PLAIN = re.compile("[\t\n\r -~À-ÖØ-öø-įı-ſ]*\\Z")
_PIECE = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ſ]+|[0-9]"
                    "|[^\\sa-z0-9ß-öø-ſ]+")
_SPECIAL = re.compile(r"<\|(?:startoftext|endoftext)\|>")

PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"


def vocabulary_path(name: str = VOCABULARY) -> str:
    """Where the installed public tokenizers keep a vocabulary file."""
    import public_tokenizers
    return public_tokenizers.path(name)


def _byte_letters() -> dict[int, str]:
    """The printable character by which a byte-level vocabulary writes each byte."""
    shown = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or b >= 0xAE]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + at) for at, b in enumerate(hidden)}


class _Words(dict):
    """Ids of words as bytes; a word not yet known is merged by the vocabulary's own rules."""

    def __init__(self, tokenizer) -> None:
        super().__init__()
        self._merge = tokenizer.model.tokenize
        self._letters = _byte_letters()

    def __missing__(self, word: str) -> bytes:
        written = word if word.isascii() else \
            word.encode().decode("latin-1").translate(self._letters)
        ids = self[word] = np.array([t.id for t in self._merge(written)], "<u4").tobytes()
        return ids


class WordTokenizer:
    """Ids of whole texts, with the ids of known words remembered.

    The vocabulary never joins characters over white space or over the bounds
    of its word pattern, so a text's ids are those of its words one after the
    other. Texts beyond plain Latin go to the tokenizer as they are.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer
        self._tokenizer = Tokenizer.from_file(path)
        self._known = _Words(self._tokenizer)

    def _whole(self, text: str) -> bytes:
        ids = self._tokenizer.encode(text, add_special_tokens=False).ids
        return np.array(ids, dtype="<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        out: list[bytes] = []
        for text in texts:
            if not _PLAIN.match(text) or ("<|" in text and _SPECIAL.search(text)):
                out.append(self._whole(text))
                continue
            if len(self._known) > CACHE_WORDS:
                self._known.clear()
            out.append(b"".join(map(self._known.__getitem__, _PIECE.findall(text.lower()))))
        return out


_tokenizers: dict[str, WordTokenizer] = {}


def tokenizer_of(path: str) -> WordTokenizer:
    """One tokenizer per Python worker and vocabulary file."""
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]


def tokenize_pieces(docs: DataFrame, capacity: int = CAPACITY,
                    vocabulary: str = VOCABULARY, place: str | None = None) -> DataFrame:
    """Pieces of at most ``capacity`` tokens: each document's ids, then id 0.

    Only documents longer than ``capacity`` are cut; the last piece may be
    shorter. A null or empty text is the single id 0. Rows are handled one by
    one, so repeated ids stay repeated. ``place`` names a column to keep beside
    every piece, as ``place``.
    """
    def pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        tokenizer = tokenizer_of(vocabulary_path(vocabulary))
        ids: list[int | None] = []
        of: list[int] = []
        rows: list[tuple[int, int, int, int]] = []
        texts = ["" if t is None else t for t in batch.column(1).to_pylist()]
        for at, (doc, data) in enumerate(zip(batch.column(0).to_pylist(),
                                             tokenizer.encode(texts))):
            data += b"\0\0\0\0"
            for piece, low in enumerate(range(0, len(data), 4 * capacity)):
                part = data[low:low + 4 * capacity]
                ids.append(doc)
                of.append(at)
                rows.append((piece, low // 4, len(part) // 4, zlib.crc32(part)))
        piece, start, length, crc = zip(*rows)
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(piece, pa.int32()),
             *[pa.array(x, pa.int64()) for x in (start, length, crc)],
             *[c.take(pa.array(of)) for c in batch.columns[2:]]],
            names=["doc_id", "piece", "start", "length", "ids_crc32", *batch.schema.names[2:]])
    kept = [F.col(place).cast("long").alias("place")] if place else []
    return map_batches(docs.select(F.col("doc_id").cast("long"), "text", *kept),
                       PIECE_SCHEMA + ", place long" * bool(place), pieces)


def plan_best_fit(histogram: dict[int, int], capacity: int = CAPACITY
                  ) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts.

    Bins that look alike are one run ``(free, first bin, number)``. Items of a
    length go to the open run with the least room that holds them, as many per
    bin as fit, which is what best fit does one by one. Returns slots
    ``(length, rank_from, rank_to, first_bin, per_bin, offset)``: the item of
    rank r lies in bin ``first_bin + (r - rank_from) // per_bin``, from token
    ``offset + ((r - rank_from) % per_bin) * length`` on.
    """
    open_runs: list[tuple[int, int, int]] = []
    slots: list[tuple[int, int, int, int, int, int]] = []
    bins = 0
    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            at = bisect_left(open_runs, (length, -1, -1))
            if at < len(open_runs):
                free, first, number = open_runs.pop(at)
            else:
                free, first = capacity, bins
                number = -(-left // (capacity // length))
                bins += number
            per_bin = free // length
            full = min(number, left // per_bin)
            rest = left - full * per_bin if full < number else 0
            if full:
                slots.append((length, rank, rank + full * per_bin, first, per_bin,
                              capacity - free))
                rank, left = rank + full * per_bin, left - full * per_bin
                if free - per_bin * length:
                    insort(open_runs, (free - per_bin * length, first, full))
            if rest:
                slots.append((length, rank, rank + rest, first + full, rest, capacity - free))
                rank, left = rank + rest, 0
                if free - rest * length:
                    insort(open_runs, (free - rest * length, first + full, 1))
            used = full + bool(rest)
            if used < number:
                insort(open_runs, (free, first + used, number - used))
    return slots


def _places(plan: np.ndarray, rank: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of the pieces of one length by their rank."""
    plan = plan[np.searchsorted(plan[:, 0], rank, side="right") - 1]
    within = rank - plan[:, 0]
    return plan[:, 2] + within // plan[:, 3], plan[:, 4] + within % plan[:, 3] * length


def _by_length(slots: list[tuple[int, int, int, int, int, int]]) -> dict[int, np.ndarray]:
    found: dict[int, list[tuple]] = {}
    for slot in slots:
        found.setdefault(slot[0], []).append(slot[1:])
    return {k: np.array(v, dtype=np.int64) for k, v in found.items()}


def pack(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY) -> DataFrame:
    """Every piece of every document with its sequence and its place there.

    The driver sees one count per length (at most ``capacity``); the plan it
    sends out has at most a few slots per length. Pieces of one length may be a
    third of all: they are ranked in slices (``rank_in_groups``). An empty
    table gives an empty result; columns other than doc_id and text are ignored.
    """
    prepare(docs.sparkSession)
    pieces = stored(tokenize_pieces(docs, capacity, vocabulary))
    counts = pieces.groupBy("length").count().collect()
    by_length = _by_length(plan_best_fit({r["length"]: r["count"] for r in counts}, capacity))

    ranked = rank_in_groups(pieces.withColumn("_order", md5_order("doc_id")), ["length"],
                            "_order", ["doc_id", "piece", "ids_crc32"]).drop("_order")

    def place(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        length = batch.column("length").to_numpy()
        rank = batch.column("group_rank").to_numpy()
        sequence, offset = np.zeros_like(rank), np.zeros_like(rank)
        for value in np.unique(length):
            at = np.flatnonzero(length == value)
            sequence[at], offset[at] = _places(by_length[int(value)], rank[at], int(value))
        names = ["doc_id", "piece", "start", "length", "ids_crc32"]
        yield pa.RecordBatch.from_arrays(
            [*[batch.column(n) for n in names], pa.array(sequence), pa.array(offset)],
            names=[*names, "sequence_id", "offset"])
    return map_batches(ranked, PIECE_SCHEMA + ", sequence_id long, offset long", place)


def pack_in_order(docs: DataFrame, place: str, capacity: int = CAPACITY,
                  vocabulary: str = VOCABULARY, stretch: int = STRETCH) -> DataFrame:
    """``pack`` of documents whose order counts: column ``place`` numbers them from 0.

    Best fit is planned per stretch of ``stretch`` places, whose sequences follow
    those of the stretches before; pieces of one length are taken by place. The
    driver sees one number per stretch.
    """
    prepare(docs.sparkSession)
    pieces = tokenize_pieces(docs, capacity, vocabulary, place) \
        .withColumn("stretch", F.floor(F.col("place") / stretch).cast("long"))

    def fit(table: pa.Table) -> pa.Table:
        table = table.sort_by([(c, "ascending") for c in (
            "length", "place", "piece", "doc_id", "ids_crc32")])
        length = table.column("length").to_numpy()
        values, first, number = np.unique(length, return_index=True, return_counts=True)
        plans = _by_length(plan_best_fit(dict(zip(values.tolist(), number.tolist())), capacity))
        sequence, offset = np.zeros_like(length), np.zeros_like(length)
        for value, low, n in zip(values.tolist(), first.tolist(), number.tolist()):
            sequence[low:low + n], offset[low:low + n] = _places(plans[value], np.arange(n), value)
        return table.drop_columns(["place"]).append_column("sequence_id", pa.array(sequence)) \
            .append_column("offset", pa.array(offset))
    fitted = stored(pieces.groupBy("stretch").applyInArrow(
        fit, PIECE_SCHEMA + ", stretch long, sequence_id long, offset long"))
    number = {r[0]: r[1] + 1 for r in fitted.groupBy("stretch").agg(F.max("sequence_id")).collect()}
    keys = np.array(sorted(number), dtype=np.int64)
    before = np.cumsum([0, *[number[k] for k in keys.tolist()]])

    def shift(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        at = np.searchsorted(keys, batch.column("stretch").to_numpy())
        columns = {n: batch.column(n) for n in batch.schema.names if n != "stretch"}
        columns["sequence_id"] = pa.array(columns["sequence_id"].to_numpy() + before[at])
        yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))
    return map_batches(fitted, PIECE_SCHEMA + ", sequence_id long, offset long", shift)
