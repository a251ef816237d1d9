"""Words, word hashes and word windows of many texts at once (numpy, inside tasks).

A word is a run of bytes other than space and 0x09-0x0D, as the row contracts
say; texts are handled as UTF-8 bytes, so no Unicode white space splits a word.
All functions work over a *block*: texts joined by line feeds.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np

BLOCK_BYTES = 1 << 20

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser: every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * _BASE) | np.uint64(1)
_powers: dict[str, np.ndarray] = {}


def _power_tables(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, grown on demand."""
    have = _powers.get("base")
    if have is None or len(have) < size:
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        for name, factor in (("base", _BASE), ("inverse", inverse)):
            table = np.full(size, factor, dtype=np.uint64)
            table[0] = 1
            _powers[name] = np.cumprod(table)
    return _powers["base"], _powers["inverse"]


class Block(NamedTuple):
    """Texts side by side: ``first``/``last`` give the word range of each text."""
    data: np.ndarray    # bytes of all texts, a line feed after each
    begin: np.ndarray   # first byte of each text
    end: np.ndarray     # byte after each text
    start: np.ndarray   # first byte of each word
    stop: np.ndarray    # byte after each word
    first: np.ndarray
    last: np.ndarray


def blocks(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Index ranges whose texts fill about BLOCK_BYTES; a longer text stands alone."""
    low, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > BLOCK_BYTES:
            yield low, i
            low, size = i, 0
        size += len(t) + 1
    if low < len(texts):
        yield low, len(texts)


def read_block(texts: list[bytes], space: np.ndarray = _SPACE) -> Block:
    """``space``: which bytes separate words (the line feed must be one)."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    sizes = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
    stops = np.cumsum(sizes)
    gap = space[data]
    edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1
    if not gap[0]:
        edge = np.concatenate(([0], edge))
    start, stop = edge[0::2], edge[1::2]
    begin, end = stops - sizes, stops - 1
    return Block(data, begin, end, start, stop,
                 np.searchsorted(start, begin), np.searchsorted(start, end))


def word_hashes(block: Block, lead: int = 0) -> np.ndarray:
    """One 64-bit hash per word: a polynomial over random byte values, finalised.

    With ``lead``, of each word's first ``lead`` bytes (the whole word if shorter).
    """
    powers, inverse = _power_tables(len(block.data))
    sums = np.zeros(len(block.data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[block.data] * powers[:len(block.data)], out=sums[1:])
    stop = np.minimum(block.stop, block.start + lead) if lead else block.stop
    return mix64((sums[stop] - sums[block.start]) * inverse[block.start])


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` word hashes; entry i starts at word i."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    total = np.zeros(n, dtype=np.uint64)
    for k in range(size):
        total += words[k:k + n] * mix64(np.array([k + 1 + 64 * size], dtype=np.uint64))
    return mix64(total)


def count_between(flags: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """How many true flags lie in each [begin, end)."""
    sums = np.zeros(len(flags) + 1, dtype=np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[end] - sums[begin]


def char_starts(data: np.ndarray) -> np.ndarray:
    """True where a byte starts a code point."""
    return (data & 0xC0) != 0x80
