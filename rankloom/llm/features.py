"""Dense statistics of whole texts, shared by the classifiers."""

from __future__ import annotations

import numpy as np

from rankloom.llm.quality_rules import text_stats
from rankloom.llm.words import blocks, count_between, read_block, word_hashes

_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[48:58] = True
_POINT = np.zeros(256, dtype=bool)
_POINT[[ord(c) for c in ".,;:?"]] = True
_BAR = np.zeros(256, dtype=bool)
_BAR[[ord(c) for c in "|{}[]\\/_=@"]] = True
_SHOUT = np.zeros(256, dtype=bool)
_SHOUT[ord("!")] = True

NAMES = ["log_words", "log_chars", "word_length", "symbols", "dup_lines", "repeats",
         "line_words", "upper", "marked", "digits", "points", "bars", "shouts",
         "distinct", "top_word", "other_bytes", "last_line"]


def dense_features(texts: list[bytes]) -> np.ndarray:
    """One row per text, columns as in NAMES; an empty text is a row of zeros."""
    stats = text_stats(texts).astype(np.float64)
    words, chars, symbols, dups, repeats, lines, upper, letters, marked = stats.T
    out = np.zeros((len(texts), len(NAMES)))
    n, size = np.maximum(words, 1), np.maximum(chars, 1)
    out[:, 0], out[:, 1] = np.log1p(words), np.log1p(chars)
    out[:, 2] = np.log1p(chars / n)
    out[:, 3], out[:, 4] = symbols / n, dups / np.maximum(lines, 1)
    out[:, 5], out[:, 6] = repeats / n, np.log1p(words / np.maximum(lines, 1))
    out[:, 7], out[:, 8] = upper / np.maximum(letters, 1), marked / n
    done = 0
    for low, high in blocks(texts):
        b = read_block(texts[low:high])
        hashes = word_hashes(b)
        rows = slice(done, done + high - low)
        for k, table in ((9, _DIGIT), (10, _POINT), (11, _BAR), (12, _SHOUT)):
            out[rows, k] = count_between(table[b.data], b.begin, b.end)
        out[rows, 15] = count_between(b.data > 127, b.begin, b.end)
        for i, (first, last) in enumerate(zip(b.first.tolist(), b.last.tolist())):
            if last > first:
                order = np.sort(hashes[first:last])
                edge = np.flatnonzero(np.append(True, order[1:] != order[:-1]))
                out[done + i, 13] = len(edge)
                out[done + i, 14] = np.diff(np.append(edge, last - first)).max()
        done += high - low
    out[:, 9] /= size
    out[:, 15] /= size
    for k in (10, 11, 12, 13, 14):
        out[:, k] /= n
    out[:, 16] = [np.log1p(len(t) - 1 - t.rfind(b"\n")) for t in texts]
    out[words == 0] = 0.0
    return out
