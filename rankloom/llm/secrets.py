"""Secret scan: fixed patterns, and spans that a tokenizer cannot compress.

The method's own test: a run of key-like characters whose characters per token
under a public byte-pair vocabulary stay low is random, not language. Digests,
UUIDs and identifiers are left out: a digest is known by its size, unless the word in
front of it names a secret; an identifier is one only if the same vocabulary finds its
parts to be words, whatever their shape.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm.tables import map_batches, prepare

VOCABULARY = "byte_bpe_50k.tiktoken"
# A run of at least MIN_RUN characters with fewer characters per token than MAX_RATIO.
MIN_RUN = 20
MAX_RATIO = 2.0

# Fixed patterns of the row contract; the second group of `assign` is the value.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
                    r"([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
_NAMES = re.compile(r"password|passwd|secret|token|api_?key", re.IGNORECASE | re.ASCII)
MIN_ASSIGN, MIN_ACCESS = 12, 18
KINDS = {"assign": 0, "access": 1, "hex": 2, "random": 3}

_RUN = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % MIN_RUN)
# Sizes of known digests (MD5, SHA-1, SHA-224, SHA-256, SHA-384, SHA-512), as hex digits
# that end a run: the run's own beginning may name them (sha256=...).
_DIGEST = re.compile(r"(?:.*[=_-])?([0-9a-fA-F]{128}|[0-9a-fA-F]{96}|[0-9a-fA-F]{64}"
                     r"|[0-9a-fA-F]{56}|[0-9a-fA-F]{40}|[0-9a-fA-F]{32})\Z")
# A run of a digest's size is a finding where the last such word among the NAMED
# characters before it, on its line, names a secret and not a digest.
NAMED = 32
_NAMED = re.compile(r"(?P<secret>password|passwd|secret|token|credential|bearer|(?<![a-z])key)"
                    r"|md5|sha-?[0-9]{1,3}|checksum|digest|hash|fingerprint",
                    re.IGNORECASE | re.ASCII)
_UUID = re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}\Z")
# Parts of an identifier: words by case, and numbers.
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]{1,8}")
# A part is a word if its own characters per token reach this.
WORD_RATIO = 3.0
# Shorter parts ("of", "x", numbers) tell nothing; words must hold half of the characters.
MIN_WORD = 3

SCHEMA = ("doc_id long, n_assign long, n_access long, n_hex long, n_random long, "
          "base_sha256 string, "
          "found array<struct<kind:string,start:long,end:long,text:string,ratio:double>>")

Span = tuple[int, int, str]    # start, end, kind


def base_spans(text: str) -> list[Span]:
    """Spans of the fixed patterns, leftmost and non-overlapping within a kind."""
    out: list[Span] = []
    if _NAMES.search(text):
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text)
                if len(m.group(2)) >= MIN_ASSIGN]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)
                if m.end() - m.start() >= MIN_ACCESS]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS[s[2]]))


_encodings: dict[str, object] = {}


def encoding_of(vocabulary: str):
    """The byte-pair encoding of a public vocabulary file, once per Python worker."""
    if vocabulary not in _encodings:
        import public_tokenizers
        import tiktoken
        with open(public_tokenizers.path(vocabulary), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        _encodings[vocabulary] = tiktoken.Encoding(
            vocabulary, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
            special_tokens={})
    return _encodings[vocabulary]


def is_word(part: str, encoding) -> bool:
    """Language by the vocabulary: few tokens in lower case, alone or behind a space."""
    part = part.lower()
    tokens = min(len(encoding.encode_ordinary(part)), len(encoding.encode_ordinary(" " + part)))
    return len(part) >= WORD_RATIO * tokens


def made_of_words(run: str, encoding) -> bool:
    """Whether every part of MIN_WORD letters or more is a word, and words hold half of it."""
    parts = _PARTS.findall(run)
    words = [p for p in parts if len(p) >= MIN_WORD and not p.isdigit()]
    return 2 * sum(map(len, words)) >= sum(map(len, parts)) \
        and all(is_word(w, encoding) for w in words)


def is_known_digest(run: str, before: str) -> bool:
    """Hex digits of a digest's size, but where the word in front names a secret."""
    digest = _DIGEST.match(run)
    if not digest:
        return False
    front = (before + run[:digest.start(1)])[-NAMED:].rpartition("\n")[2]
    names = list(_NAMED.finditer(front))
    return not (names and names[-1].group("secret"))


def excluded(run: str, before: str, encoding) -> bool:
    """Known digests, UUIDs, and identifiers whose parts are words (or that have no part)."""
    return bool(_UUID.match(run) or is_known_digest(run, before)
                or made_of_words(run, encoding))


def inefficient_spans(text: str, encoding, max_ratio: float = MAX_RATIO
                      ) -> list[tuple[int, int, float]]:
    """Runs with few characters per token, as (start, end, ratio)."""
    out = []
    for m in _RUN.finditer(text):
        run = m.group()
        ratio = len(run) / len(encoding.encode_ordinary(run))
        if ratio < max_ratio and not excluded(
                run, text[max(0, m.start() - NAMED):m.start()], encoding):
            out.append((m.start(), m.end(), ratio))
    return out


def joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def scan(docs: DataFrame, vocabulary: str = VOCABULARY, max_ratio: float = MAX_RATIO
         ) -> DataFrame:
    """Secrets of every whole text: counts, the digest of the base spans, all spans.

    Offsets are code points, ends exclusive. Null is the empty text: no spans,
    and the digest of the empty string. Rows are independent of each other, so
    repeated rows repeat; other columns are ignored.
    """
    prepare(docs.sparkSession)

    def find(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        encoding = encoding_of(vocabulary)
        rows = []
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            text = text or ""
            base = base_spans(text)
            number = Counter(kind for _, _, kind in base)
            found = [{"kind": k, "start": s, "end": e, "text": text[s:e], "ratio": None}
                     for s, e, k in base]
            low = inefficient_spans(text, encoding, max_ratio)
            found += [{"kind": "random", "start": s, "end": e, "text": text[s:e], "ratio": r}
                      for s, e, r in low]
            found.sort(key=lambda x: (x["start"], KINDS[x["kind"]]))
            rows.append({"doc_id": doc, **{f"n_{k}": number[k] for k in ("assign", "access",
                                                                         "hex")},
                         "n_random": len(low), "found": found,
                         "base_sha256": hashlib.sha256(joined(base).encode()).hexdigest()})
        yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)
    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), SCHEMA, find)


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()),
                   ("text", pa.string()), ("ratio", pa.float64())])
_ARROW = pa.schema([("doc_id", pa.int64()), *[(f"n_{k}", pa.int64()) for k in KINDS],
                    ("base_sha256", pa.string()), ("found", pa.list_(_SPAN))])


def redact(docs: DataFrame, mask: str = "[secret]", vocabulary: str = VOCABULARY,
           max_ratio: float = MAX_RATIO) -> DataFrame:
    """``docs`` with every found span replaced by ``mask``; overlapping spans become one.

    Columns, row count and texts without a span stay as they are (null too).
    """
    prepare(docs.sparkSession)
    at = docs.columns.index("text")

    def clean(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        encoding = encoding_of(vocabulary)
        texts = []
        for text in batch.column(at).to_pylist():
            if text:
                spans = [s[:2] for s in base_spans(text)]
                spans = sorted(spans + [s[:2] for s in inefficient_spans(text, encoding,
                                                                         max_ratio)])
                parts, done = [], 0
                for start, end in spans:
                    if start >= done:
                        parts += [text[done:start], mask]
                    done = max(done, end)
                text = "".join(parts) + text[done:]
            texts.append(text)
        columns = list(batch.columns)
        columns[at] = pa.array(texts, pa.string())
        yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)
    return map_batches(docs, docs.schema, clean)
