"""Search operators against brute force, and their rules for nulls, ties and clashes."""

from __future__ import annotations

import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankloom.llm import hard_negatives, lexical_search, topk_search
from rankloom.llm.vectors import Block, number_type

VECTORS = "vec_id long, embedding array<double>, label int, row string, v int, dim string, n int"
TERM = re.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def _rows(seed: int, count: int = 700, dim: int = 11):
    """Vectors with many ties, repeated and null ids, unusable rows and other lengths."""
    rng = np.random.default_rng(seed)
    rows = []
    for at in range(count):
        v = (rng.integers(-9, 10, dim if at % 50 else 3) / 16).tolist()
        if at % 5 == 0 and rows:
            v = rows[-1][1]
        rows.append((None if at % 97 == 0 else at // 2 if at % 11 == 0 else at, v,
                     None if at % 41 == 0 else int(rng.integers(0, 4)), "x", at, "y", 1))
    rows += [(20, None, 1, "x", 0, "", 0), (40, [0.5, None] + [0.1] * 9, 1, "", 0, "", 0),
             (60, [float("nan")] * dim, 1, "", 0, "", 0), (80, [float("inf")] * dim, 1, "", 0, "", 0),
             (100, [], 2, "", 0, "", 0), (200, [], 3, "", 0, "", 0)]
    return rows


def _sound(rows, scale):
    return [(at, i, [math.floor(scale * x) for x in v], label)
            for at, (i, v, label, *_) in enumerate(rows)
            if v is not None and all(x is not None and math.isfinite(x) for x in v)]


def _dot(a, b):
    return min(max(sum(x * y for x, y in zip(a, b)), -2 ** 63), 2 ** 63 - 1)


def _topk_by_hand(rows, every, k):
    out = []
    rows = _sound(rows, 64)
    for at, i, v, _ in rows:
        if i is None or i % every:
            continue
        found = sorted(((-_dot(v, w), j is None, j or 0, j) for other, j, w, _ in rows
                        if other != at and len(w) == len(v)), key=lambda x: x[:3])[:k]
        out += [(i, rank, x[3], -x[0]) for rank, x in enumerate(found, 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_topk_equals_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr("rankloom.llm.vectors.CANDIDATES", 64)     # several blocks and rounds
    rows = _rows(seed)
    df = spark.createDataFrame(rows, VECTORS)
    got = topk_search.search(df, F.col("vec_id") % 20 == 0, k=7, step=4, growth=2).collect()
    assert sorted(map(tuple, got), key=repr) == _topk_by_hand(rows, 20, 7)


def test_topk_of_large_components_and_few_rows(spark):
    rows = [(0, [2.0 ** 50, 1.0], 0), (1, [2.0 ** 50, 3.0], 0), (2, [-2.0 ** 50, 2.0], 0),
            (3, [2.0 ** 10, 2.0], 0), (20, [2.0 ** 9, 4.0], 0), (4, [2.0 ** 30, -2.0 ** 29], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = [tuple(r) for r in topk_search.search(df, F.col("vec_id") % 20 == 0).collect()]
    assert sorted(got, key=repr) == _topk_by_hand(rows, 20, 20)


def test_pruned_pairs_are_never_among_the_best():
    rng = np.random.default_rng(5)
    cells = (rng.standard_normal((400, 40)) * np.linspace(30, 1, 40)).astype(np.int16)
    ids = np.arange(400)
    block = Block(ids, ids, ids >= 0, ids * 0, np.full((400, 1), 900), cells)
    i, j, score = topk_search.branch_and_bound(block, block, 5)
    whole = cells.astype(int) @ cells.T.astype(int)
    np.fill_diagonal(whole, -1 << 40)
    assert (whole[i, j] == score).all() and len(i) < 400 * 400 / 10
    missed = whole.copy()
    missed[i, j] = -1 << 40
    fifth = np.sort(whole, axis=1)[:, -5]
    assert ((missed < fifth[:, None]) | (missed < 900)).all()


def test_number_types_hold_every_sum():
    big = np.full((1, 64), 1 << 30)
    assert number_type(np.ones((2, 3), np.int8), np.ones((2, 3), np.int8)) is np.float32
    assert number_type(big, np.ones((1, 64), np.int64)) is np.float64
    assert number_type(big, big) is object


def _mined_by_hand(rows, every, positives, negatives):
    out = []
    rows = [r for r in _sound(rows, 256) if r[3] is not None]
    for at, i, v, label in rows:
        if i is None or i % every:
            continue
        scored = sorted(((-_dot(v, w), j is None, j or 0, other, j, y) for other, j, w, y in rows
                         if other != at and len(w) == len(v)), key=lambda x: x[:4])
        for p in [x for x in scored if x[5] == label][:positives]:
            fits = [x for x in scored if x[5] != label
                    and 80 * -p[0] <= 100 * -x[0] <= 100 * -p[0]][:negatives]
            out += [(i, p[4], rank, x[4], -p[0], -x[0]) for rank, x in enumerate(fits, 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed", [3, 4])
def test_negatives_equal_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr("rankloom.llm.vectors.CANDIDATES", 64)
    rows = _rows(seed)
    df = spark.createDataFrame(rows, VECTORS)
    got = hard_negatives.mine(df, F.col("vec_id") % 10 == 0, F.col("label"), 4, 3).collect()
    assert got and sorted(map(tuple, got), key=repr) == _mined_by_hand(rows, 10, 4, 3)


def test_slots_answer_overlapping_windows():
    slots = [[(98, 1)], [(90, 2), (85, 3)], [(70, 4)]]
    assert hard_negatives.merge_slots(slots, [100, 90, 80], 3) == [
        [(98, 1), (90, 2), (85, 3)], [(90, 2), (85, 3)], [(70, 4)]]
    assert hard_negatives.merge_slots([[], [(5, 1)]], [5, 5], 3) == [[(5, 1)], [(5, 1)]]
    assert hard_negatives.merge_slots([[(-10, 1)]], [-10], 3) == [[]]


def test_empty_vector_tables(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert topk_search.search(df, F.col("vec_id") % 20 == 0).count() == 0
    assert hard_negatives.mine(df, F.col("vec_id") % 20 == 0, F.col("label")).count() == 0
    no_query = spark.createDataFrame([(1, [0.5], 1)], df.schema)
    assert topk_search.search(no_query, F.col("vec_id") % 20 == 0).count() == 0
    assert hard_negatives.mine(no_query, F.col("vec_id") % 20 == 0, F.col("label")).count() == 0


def _lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def _ranked_by_hand(docs, items, k):
    found = [(i, TERM.findall(_lower(t))) for i, t, *_ in docs if t is not None]
    counted = [(i, len(t), {x: t.count(x) for x in set(t)}) for i, t in found if t]
    number, total = len(counted), sum(n for _, n, _ in counted)
    df: dict[str, int] = {}
    for _, _, tf in counted:
        for t in tf:
            df[t] = df.get(t, 0) + 1
    out = []
    for item, text, *_ in items:
        scores = []
        for i, n, tf in counted:
            m = 100 - 25 + 25 * n * number // total
            score = sum(math.floor(1000 * math.log((2 * number + 2) / (2 * df[t] + 1)))
                        * (1000000000 * tf[t] // (1000 * tf[t] + 12 * m))
                        for t in TERM.findall(_lower(text or "")) if t in tf)
            if score > 0:
                scores.append((-score, i is None, i or 0, i))
        out += [(item, rank, x[3], -x[0])
                for rank, x in enumerate(sorted(scores, key=lambda x: x[:3])[:k], 1)]
    return sorted(out, key=repr)


def _texts(seed, count):
    rng = np.random.default_rng(seed)
    words = [f"W{int(x)}" for x in rng.zipf(1.3, 4000) if x < 400] + ["é", "Ñandú", "ſ", "İx", "9"]
    sep = [" ", ", ", "\n", "\x00", "_", "'"]
    return ["".join(w + sep[int(rng.integers(6))] for w in rng.choice(words, int(rng.integers(0, 60))))
            for _ in range(count)]


@pytest.mark.parametrize("seed", [6, 7])
def test_ranking_equals_brute_force(spark, seed):
    texts = _texts(seed, 300)
    docs = [(None if at % 60 == 7 else at // 3 if at % 9 == 0 else at,
             None if at % 43 == 0 else texts[at - 1] if at % 8 == 0 else t, "x", 1)
            for at, t in enumerate(texts)] + [(900, "w1 " * 20000, "x", 1), (901, "", "", 2)]
    items = [(at, t, "c") for at, t in enumerate(_texts(seed + 50, 30))] + [
        (3, texts[5], "c"), (None, texts[6], "c"), (77, None, "c"), (78, "nowhere to be found", "c")]
    got = lexical_search.rank(
        spark.createDataFrame(docs, "doc_id long, text string, terms string, score int"),
        spark.createDataFrame(items, "item_id long, text string, item string"),
        k=5, documents=32, per_block=8).collect()
    assert sorted(map(tuple, got), key=repr) == _ranked_by_hand(docs, items, 5)


def test_ranking_of_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "b")], "item_id long, text string")
    assert lexical_search.rank(docs.limit(0), items).count() == 0
    assert lexical_search.rank(docs, items.limit(0)).count() == 0
    assert [tuple(r)[:3] for r in lexical_search.rank(docs, items).collect()] == [(1, 1, 1)]


def test_accumulators_stop_and_survivors_stay_exact():
    """A rare term decides: later terms create no accumulator, yet every sum is whole."""
    n = 200
    lengths = np.full(n, 50)
    common = np.arange(n, dtype=np.int32)
    rare = np.array([3, 90], dtype=np.int32)
    block = lexical_search.Postings({
        "names": np.arange(n).tobytes(), "named": np.ones(n, bool).tobytes(),
        "lengths": lengths.tobytes(), "terms": [b"common", b"rare"], "dfs": [n, 2],
        "docs": np.concatenate([common, rare]).tobytes(),
        "counts": np.ones(n + 2, np.int32).tobytes()}, n, n * 50)
    share = 1_000_000_000 // (1000 + 12 * 100)
    alive, sums = block.best([(b"rare", 5000, 1), (b"common", 2, 3)], 2, 0)
    assert dict(zip(alive.tolist(), sums.tolist())) == {3: 5006 * share, 90: 5006 * share}
    alive, _ = block.best([(b"rare", 5000, 1), (b"common", 2, 3)], 2, 5007 * share)
    assert not len(alive)
