"""Fences follow the spread of their group, and junk does not lift them."""

from __future__ import annotations

import math
import random

import pytest

from rankloom.llm import quality_rules

SCHEMA = "doc_id long, lang string, source string, text string"


def _text(i, symbols, n=100):
    return " ".join(f"w{i}x{k}" + "#" * (k < symbols) for k in range(n))


@pytest.fixture(scope="module")
def judged(spark):
    rows = []
    for i in range(200):    # narrow, wide; a third of "junky" and all of "tiny" are junk
        rows += [(i, "en", "narrow", _text(i, i % 3)), (i + 1000, "en", "wide", _text(i, i % 21)),
                 (i + 2000, "en", "plain", _text(i, 0)),
                 (i + 3000, "en", "junky", _text(i, 95 if i % 3 == 0 else i % 3))]
    rows += [(5000, "en", "tiny", _text(9, 95)), (6000, None, None, _text(8, 90)),
             (7000, "en", "narrow", _text(5, 26)), (7001, "en", "wide", _text(6, 26))]
    return {r.doc_id: r for r in quality_rules.judge(spark.createDataFrame(rows, SCHEMA)).collect()}


def test_fences_differ_through_their_spread(judged):
    narrow, wide = judged[7000], judged[7001]
    assert 0 < narrow.symbols_per_word_max < 0.26 < wide.symbols_per_word_max < 0.9
    assert narrow.failed_rules[:1] == ["symbols_per_word"] and not wide.failed_rules
    assert all(judged[i].kept and judged[i + 1000].kept for i in range(200))


def test_junk_does_not_lift_its_own_fence(judged):
    assert all(judged[3000 + i].kept == (i % 3 != 0) for i in range(200))
    assert not judged[5000].kept and not judged[6000].kept


def test_guards_follow_the_share_of_texts_without_a_count(spark):
    """Chance symbols in 40 % of a group's texts allow more of them than none at all."""
    rows = [(i, "en", "none", _text(i, 0)) for i in range(300)]
    rows += [(1000 + i, "de", "some", _text(i, i % 5 < 2)) for i in range(300)]
    found = {r.source: r for r in quality_rules.judge(
        spark.createDataFrame(rows, SCHEMA)).collect()}
    assert found["none"].symbols_per_word_guard < found["some"].symbols_per_word_guard


def test_guard_rates_are_poisson_tails():
    rates = quality_rules.guard_rates()
    assert rates == sorted(rates) and rates[-1] >= -math.log(quality_rules.MOST_HIT)
    for k, rate in enumerate(rates):
        chance = 1 - sum(math.exp(-rate) * rate ** i / math.factorial(i) for i in range(k + 1))
        assert chance == pytest.approx(quality_rules.TAIL, rel=1e-3)


def _least(values, share):
    """The smallest value that at least ``share`` of the values do not exceed."""
    values = sorted(values)
    return values[max(math.ceil(share * len(values)) - 1, 0)]


def test_fences_and_verdicts_beside_brute_force(spark):
    """Every fence, guard and failed rule recomputed from the measures in plain Python."""
    rng = random.Random(4)
    sizes = {("en", "a"): 120, ("en", "b"): 40, ("de", "a"): 60, (None, "a"): 5, ("de", None): 30}
    rows = []
    for (lang, source), n in sizes.items():
        for _ in range(n):
            symbols = rng.choice([0, 0, 0, 1, 2, 5, 80]) if source == "a" else rng.randrange(9)
            rows.append((len(rows), lang, source, _text(len(rows), symbols)))
    found = quality_rules.judge(spark.createDataFrame(rows, SCHEMA)).collect()
    rules, rates = quality_rules, quality_rules.guard_rates()
    for m, count in rules.COUNTS.items():
        def sketch(members):
            return ([_least([r[m] for r in members], p) for p in (0.2, 0.5, 0.8, 0.9)],
                    len(members), sum(r[count] == 0 for r in members))

        def spread(found, above):
            (q20, q50, _, q90), n, _ = found
            own, below = q90 - q50, rules.CAP * (q50 - q20)
            sound = own if own <= max(rules.CAP * above, below) else max(above, below)
            return (n * sound + rules.PRIOR * above) / (n + rules.PRIOR)
        table = sketch(found)
        q = table[0]
        whole = q[3] - q[1] if q[3] - q[1] <= rules.REACH * (q[2] - q[1]) else q[2] - q[1]
        for r in found:
            lang = sketch([x for x in found if x.lang == r.lang])
            group = sketch([x for x in found if (x.lang, x.source) == (r.lang, r.source)])
            middle = next((s[0][1] for s in (group, lang) if s[1] >= rules.LEAST), q[1])
            fence = middle + rules.SPREAD * spread(group, spread(lang, whole))
            none = table[2] / (table[1] + 1)
            for s in (lang, group):
                none = (s[2] + rules.PRIOR * none) / (s[1] + rules.PRIOR)
            guard = sum(-math.log(max(none, rules.MOST_HIT)) > x for x in rates)
            assert r[f"{m}_max"] == pytest.approx(fence) and r[f"{m}_guard"] == guard
            over = (r[m] - fence) * r[rules.MEASURES[m]]
            if abs(over - guard) > 1e-9:
                assert (m in r.failed_rules) == (over > guard)
    assert all(r.kept == (not r.base_failed and not r.failed_rules) for r in found)
    assert any(r.failed_rules for r in found) and any(r.kept for r in found)
