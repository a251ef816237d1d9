"""Hot n-grams of many chunks spread over the ranges."""

from __future__ import annotations

import pytest

from rankloom.llm import ngram_join


@pytest.mark.parametrize("parts", [64, 7680, 8192])
def test_hot_grams_spread(parts):
    chunks = [(p << 36) + k * ngram_join._PLACES for p in range(200) for k in range(10)]
    ranges = [ngram_join._hot_range(c, parts) for c in chunks]
    assert all(0 <= r < parts for r in ranges)
    assert len(set(ranges)) >= 0.5 * min(parts, len(chunks))
