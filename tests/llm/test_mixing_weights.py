"""Schedules beside the target weights themselves, over many periods."""

from __future__ import annotations

import random
from collections import Counter
from fractions import Fraction

import pytest

from rankloom.llm import mixing

RNG = random.Random(11)
TARGETS = {
    "two": {"a": 0.9, "b": 0.1}, "rare": {"a": 0.999, "b": 0.001},
    "many": {"a": 0.91, **{f"s{k}": 0.09 / 199 for k in range(199)}},
    "random": {f"s{k}": RNG.random() + 1e-3 for k in range(40)},
}


def _phases(weights, blocks):
    return mixing.sweep(mixing.whole_weights(weights), blocks)


@pytest.mark.parametrize("name", TARGETS)
def test_every_slot_is_within_one_block_of_the_weights(name):
    weights = {s: Fraction(w) for s, w in TARGETS[name].items()}
    total = sum(weights.values())
    slots = 8_000 if name == "two" else 3_000
    phase = next(_phases(TARGETS[name], {s: 10 ** 6 for s in weights} | {
        max(weights, key=weights.get): int(max(weights.values()) / total * slots)}))
    assert len(phase) >= 0.9 * slots
    number = Counter()
    for t, s in enumerate(phase, start=1):
        number[s] += 1
        if t % 17 == 0 or name == "two":
            assert all(abs(number[x] * total - t * w) < total for x, w in weights.items()), t


def test_dry_sources_leave_and_the_rest_stays_in_proportion():
    rng = random.Random(3)
    weights = {f"s{k}": rng.random() + 0.01 for k in range(12)}
    blocks = {s: rng.randrange(1, 300) for s in weights}
    left = dict(blocks)
    for phase in _phases(weights, blocks):
        exact = {s: Fraction(weights[s]) for s in left}
        total, number = sum(exact.values()), Counter()
        for t, s in enumerate(phase, start=1):
            number[s] += 1
            assert all(abs(number[x] * total - t * w) < total for x, w in exact.items())
        left = {s: n - number[s] for s, n in left.items() if n > number[s]}
    assert not left
    slots = mixing.plan(blocks, weights)
    assert sorted(x for v in slots.values() for x in v.tolist()) == list(
        range(sum(blocks.values())))


def test_more_than_a_thousand_sources(spark):
    rows = [(i, f"s{i % 1500}", "x" * 50) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    found = mixing.schedule(docs, block_chars=40).collect()
    assert len(found) == 3000 and len({(r.source, r.block) for r in found}) \
        == len({r.slot for r in found})
