"""Operators beside brute force on the small tables, and properties of their models."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankloom.llm import (embedding_dedup, lang_id, line_dedup, mixing, ngram_join, packing,
                          quality_rff, quality_rules, secrets, toxicity)
from rankloom.llm.components import connected_components
from rankloom.llm.queries import TOXIC, table, toxic_labels
from rankloom.llm.ranks import md5_order, rank_in_groups
from rankloom.llm.tables import crc_slot

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, SF, "documents").cache()


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.collect()}


def _components(pairs, nodes):
    up = {n: n for n in nodes}

    def root(n):
        while up[n] != n:
            n = up[n]
        return n
    for a, b in pairs:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(250)]
    edges += [(1000 + k, 1001 + k) for k in range(60)] + [(5000, 5001 + k) for k in range(50)]
    nodes = {n for e in edges if e[0] != e[1] for n in e}
    found = connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {(r.node, r.component) for r in found} == set(
        _components([e for e in edges if e[0] != e[1]], nodes).items())
    assert len(found) == len(nodes)


def test_rank_in_groups(spark):
    rows = [(i, "a" if i % 3 else None, i % 7) for i in range(500)]
    df = spark.createDataFrame(rows, "i long, g string, w long")
    got = rank_in_groups(df.withColumn("o", md5_order("i")), ["g"], "o", ["i"], "w", 1).collect()
    for g in ("a", None):
        mine = sorted((r for r in got if r.g == g), key=lambda r: r.o)
        assert [r.group_rank for r in mine] == list(range(len(mine)))
        assert [r.weight_before for r in mine] == [sum(x.w for x in mine[:k])
                                                   for k in range(len(mine))]


# --- joins --------------------------------------------------------------------
def _links_of(texts, size=5, percent=75):
    sets = {}
    for i, t in texts.items():
        words = (t or "").encode().lower().split()
        sets[i] = {tuple(words[k:k + size]) for k in range(max(1, len(words) - size + 1))} \
            if words else set()
    pairs = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b]
             and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    component, degree = _components(pairs, sets), Counter(x for p in pairs for x in p)
    return {(i, len(s), degree[i], component[i]) for i, s in sets.items()}


@pytest.mark.parametrize("block", [2048, 3])
def test_ngram_join_is_exact(docs, texts, block):
    found = ngram_join.links(docs, block=block, range_chars=50_000).collect()
    assert {tuple(r) for r in found} == _links_of(texts)


def test_ngram_join_of_edited_copies(spark, monkeypatch):
    """A dense group around the threshold, cut into blocks, with hot n-grams sent apart."""
    rng = random.Random(3)
    base = [f"w{rng.randrange(5000)}" for _ in range(80)]
    rows = {}
    for i in range(60):
        words = list(base)
        for _ in range(rng.randrange(5)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(10 ** 6)}"
        rows[i] = " ".join(words)
    rows[60] = rows[0].upper()
    monkeypatch.setattr(ngram_join, "HOT", 4)
    df = spark.createDataFrame(list(rows.items()), "doc_id long, text string").repartition(3)
    for block in (7, 2048):
        assert {tuple(r) for r in ngram_join.links(df, block=block).collect()} == _links_of(rows)


@pytest.mark.parametrize("shift", [3, 9])
def test_ngram_join_of_a_chain(spark, shift):
    """Windows that each overlap the next few: one group, whose blocks meet by n-grams."""
    rng = random.Random(5)
    words = [f"w{rng.randrange(10 ** 6)}" for _ in range(60 + shift * 150)]
    rows = {i: " ".join(words[shift * i:shift * i + 60]) for i in range(150)}
    df = spark.createDataFrame(list(rows.items()), "doc_id long, text string").repartition(3)
    assert {tuple(r) for r in ngram_join.links(df, block=8).collect()} == _links_of(rows)


def test_meetings_grow_with_links(spark):
    """A chain's classes meet few blocks; a dense group's blocks meet pairwise."""
    chain = [(i, 1000 + i + k) for i in range(400) for k in range(4)]
    dense = [(10_000 + i, 100_000 + k) for i in range(64) for k in range(64) if (i * k) % 7 != 1]
    keys = spark.createDataFrame(chain + dense, "sig long, gram long")
    sets = keys.groupBy("sig").agg(F.collect_list(F.struct("gram")).alias("grams"))
    groups = keys.select(F.col("sig").alias("node"), F.when(F.col("sig") < 10_000, 0)
                         .otherwise(10_000).cast("long").alias("component")).distinct()
    found = ngram_join.meetings(groups, sets, keys, 8).collect()
    grams = {s: {g for t, g in chain + dense if t == s} for s, _ in chain + dense}
    together = {}
    for r in found:
        together.setdefault((r.component, r.low, r.high), []).append(r)
    pairs = Counter((a.sig, b.sig) for rows in together.values() for a in rows for b in rows
                    if a.sig < b.sig and (a.low == a.high or a.side != b.side))
    assert set(pairs.values()) == {1}
    assert all((a, b) in pairs for a in grams for b in grams if a < b and grams[a] & grams[b])
    chained = sum(r.sig < 10_000 for r in found)
    assert chained <= 400 * 8 < 400 * 50 and len(found) - chained >= 64 * 64 / 16


def test_trie_join_beside_all_pairs():
    rng = np.random.default_rng(8)
    for trial in range(30):
        pool = rng.choice(2 ** 40, 30, replace=False).astype(np.int64)
        often = dict(zip(pool.tolist(), rng.integers(2, 9, len(pool)).tolist()))
        sets, sizes = [], []
        for _ in range(12):
            g = rng.choice(pool, rng.integers(1, 25), replace=False)
            sets.append((g, np.array([often[x] for x in g.tolist()])))
            sizes.append(len(g) + rng.integers(0, 3))
        sizes = np.array(sizes)
        want = set()
        for a in range(12):
            for b in range(a):
                both = len(set(sets[a][0]) & set(sets[b][0]))
                if 100 * both >= 60 * (sizes[a] + sizes[b] - both):
                    want.add((b, a))
        got = {(min(i, int(j)), max(i, int(j))) for i, js in
               ngram_join.trie_join(sets, sizes, 60) for j in js}
        assert got == want, trial


@pytest.mark.parametrize("block", [2048, 4])
def test_embedding_links(spark, block):
    rng = np.random.default_rng(1)
    centers = rng.standard_normal((8, 24))
    rows = []
    for i in range(160):
        v = centers[i % 8] + rng.standard_normal(24) * rng.choice([0.0, 0.15, 0.3, 0.6])
        rows.append((i, [float(x) for x in v.astype(np.float32)], int(i % 8 // 4)))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    x = np.array([r[1] for r in rows], np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    pairs = [(a, b) for a in range(160) for b in range(a + 1, 160)
             if rows[a][2] == rows[b][2] and x[a] @ x[b] >= 0.93]
    assert len(pairs) > 300
    degree, component = Counter(n for p in pairs for n in p), _components(pairs, range(160))
    found = {r.vec_id: r for r in embedding_dedup.links(df, block=block).collect()}
    assert sum(r.n_links for r in found.values()) >= 0.999 * sum(degree.values())
    assert all(found[i].n_links <= degree[i] for i in found)
    assert sum(found[i].component_id != component[i] for i in found) <= 1


# --- texts --------------------------------------------------------------------
def test_base_secrets(docs, texts):
    assign = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*"""
                        r"""["']?([A-Za-z0-9+/_.=-]+)""")
    for r in secrets.scan(docs).collect():
        t = texts[r.doc_id] or ""
        spans = [(m.start(), 0, f"assign:{m.start()}:{m.end()}") for m in assign.finditer(t)
                 if len(m[2]) >= 12]
        spans += [(m.start(), 1, f"access:{m.start()}:{m.end()}")
                  for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
        spans += [(m.start(), 2, f"hex:{m.start()}:{m.end()}")
                  for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
        want = hashlib.sha256(",".join(s for _, _, s in sorted(spans)).encode()).hexdigest()
        assert (r.base_sha256, r.n_assign + r.n_access + r.n_hex) == (want, len(spans))


def test_token_efficiency(spark):
    rng = random.Random(2)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    key = "".join(rng.choice(letters) for _ in range(40))
    clean = ["a_long_identifier_made_of_words", "someCamelCaseIdentifierOfWords",
             "d41d8cd98f00b204e9800998ecf8427e", "123e4567-e89b-12d3-a456-426614174000",
             "internationalization/localization", "aaaaaaaaaaaaaaaaaaaaaaaa"]
    rows = [(0, f"é use {key} here"), *[(i + 1, f"see {c} here") for i, c in enumerate(clean)]]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r for r in secrets.scan(df).collect()}
    assert [(f.kind, f.start, f.end, f.text) for f in found[0].found] == [("random", 6, 46, key)]
    assert all(found[i].n_random == 0 for i in range(1, len(rows)))
    masked = {r.doc_id: r.text for r in secrets.redact(df).collect()}
    assert masked[0] == "é use [secret] here" and masked[1] == rows[1][1]


def test_rule_counts(docs, texts):
    for r in quality_rules.judge(docs).collect():
        t = texts[r.doc_id] or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        seen, dup = set(), 0
        for line in t.split("\n"):
            if re.search(r"[^\x20\x09-\x0D]", line):
                dup += line in seen
                seen.add(line)
        windows = Counter(tuple(words[k:k + 3]) for k in range(len(words) - 2))
        hit = {k + j for k in range(len(words) - 2) if windows[tuple(words[k:k + 3])] > 1
               for j in range(3)}
        want = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(hit))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (len(words) < 50 or 100 * len(hit) > 50 * len(words))
        assert r.kept == (not r.base_failed and not r.failed_rules)


def test_fences_follow_the_group(spark):
    rows = [(i, "en", "a" if i < 200 else "b", " ".join(
        (w + "#" if i >= 200 and k % 2 else w) for k, w in enumerate(
            f"w{i}x{k}" for k in range(60)))) for i in range(400)]
    rows.append((900, "en", "a", " ".join(f"y{k}#" for k in range(60))))
    df = spark.createDataFrame(rows, "doc_id long, lang string, source string, text string")
    kept = {r.doc_id: r.kept for r in quality_rules.judge(df).collect()}
    assert kept.pop(900) is False and all(kept.values())


def test_removed_passages(spark):
    rng = random.Random(4)

    def words(n):
        return [f"v{rng.randrange(10 ** 9)}" for _ in range(n)]
    passage, rows = words(70), {}
    for i in range(12):
        body = words(60)
        rows[i] = " ".join(body[:30] + passage + body[30:]) if i % 3 == 0 else " ".join(body)
    df = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    for r in line_dedup.remove_repeats(df).collect():
        original = rows[r.doc_id]
        if r.doc_id % 3 or r.doc_id == 0:
            assert r.text == original and not r.removed
        else:
            (span,) = r.removed
            assert original[:span.start] + original[span.end:] == r.text
            left = [w for w in passage if w in r.text.split()]
            assert len(left) <= 20 and span.words >= 50
            assert all(w in passage for w in original[span.start:span.end].split())


def test_pieces_and_sequences(docs, texts):
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(packing.vocabulary_path())
    rows = packing.pack(docs).collect()
    sequences, of = defaultdict(list), defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
        of[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
    for i, t in texts.items():
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [0]
        want = [(k, s, len(ids[s:s + 2048]), zlib.crc32(np.array(ids[s:s + 2048], "<u4").tobytes()))
                for k, s in enumerate(range(0, len(ids), 2048))]
        assert sorted(of[i]) == want
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 2048


@pytest.mark.parametrize("text", [
    "Hello, world! it's 42's", "ÉCOLE Straße façade", "tab\there\r\nnl", "<|endoftext|> x<|startoftext|>y",
    "日本語 text", "é combining", "\x1c odd \x85 space", "İstanbul ΑΣ", "a" * 300, "½ ªº µm", ""])
def test_tokenizer_equals_the_library(text):
    from tokenizers import Tokenizer
    whole = Tokenizer.from_file(packing.vocabulary_path())
    mine = packing.tokenizer_of(packing.vocabulary_path())
    want = np.array(whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    assert mine.encode([text, text]) == [want, want]


def test_plan_is_best_fit_decreasing():
    rng = random.Random(6)
    for capacity in (10, 64):
        lengths = [rng.randrange(1, capacity + 1) for _ in range(300)]
        bins: list[int] = []
        for n in sorted(lengths, reverse=True):
            fits = [b for b in bins if b >= n]
            if fits:
                bins.remove(min(fits))
                bins.append(min(fits) - n)
            else:
                bins.append(capacity - n)
        slots = packing.plan_best_fit(Counter(lengths), capacity)
        places = defaultdict(set)
        for length, low, high, first, per, offset in slots:
            for r in range(high - low):
                at = offset + r % per * length
                span = set(range(at, at + length))
                assert not span & places[first + r // per]
                places[first + r // per] |= span
        assert sorted(capacity - len(p) for p in places.values()) == sorted(bins)
        assert all(p == set(range(len(p))) for p in places.values())


# --- mixing -------------------------------------------------------------------
def test_mixing_places_every_document(docs):
    rows = mixing.schedule(docs, block_chars=2000).collect()
    assert len(rows) == docs.count()
    owner: dict[int, tuple] = {}
    for r in rows:
        assert owner.setdefault(r.slot, (r.source, r.block)) == (r.source, r.block)
    by_source = defaultdict(list)
    for slot, (source, block) in sorted(owner.items()):
        by_source[source].append(block)
    assert all(b == sorted(set(b)) for b in by_source.values())


# --- models -------------------------------------------------------------------
def test_kneser_ney_sums_to_one():
    grams, _, _ = lang_id.gram_hashes([b"the cat sat on the mat and the dog sat too"] * 3)
    seen, n = np.unique(grams, return_counts=True)
    levels = lang_id.kneser_ney(seen, n)
    for context in (*np.unique(seen >> np.uint32(6))[:20], np.uint32(12345)):
        every = (np.uint32(context) << np.uint32(6)) | np.arange(64, dtype=np.uint32)
        assert np.exp(lang_id.log_probabilities(levels, every)).sum() == pytest.approx(1.0)


def test_languages_are_found(docs):
    found = lang_id.identify(docs, crc_slot("doc_id", 3) != 1, ["doc_id", "lang"]) \
        .where(crc_slot("doc_id", 3) == 1).collect()
    assert sum(r.lang == r.lang_pred for r in found) >= 0.95 * len(found)
    assert all(0 <= r.score <= 1 for r in found)


def test_held_out_toxicity(spark):
    big = SF.replace("0.001", "0.01")
    labels = toxic_labels(spark, big)
    docs = table(spark, big, "documents")
    chain = toxicity.fit(docs, labels.where(crc_slot("doc_id", 4) != 2), TOXIC)
    assert len(chain.models) == 3 and [len(m) for m in chain.models] == [
        len(chain.models[0]) + k for k in range(3)]
    found = toxicity.predict(docs, chain).join(labels, "doc_id") \
        .where(crc_slot("doc_id", 4) == 2).collect()
    pairs = [(a.p_toxic, b.p_toxic) for a in found if a.toxic for b in found if not b.toxic]
    assert np.mean([a > b for a, b in pairs]) >= 0.85
    assert sum(r.p_toxic >= 0.5 for r in found if not r.toxic) <= 2
    kept = {r.doc_id for r in toxicity.drop_toxic(docs, chain, "toxic").collect()}
    all_p = {r.doc_id: r.p_toxic for r in toxicity.predict(docs, chain).collect()}
    assert kept == {i for i, p in all_p.items() if p < 0.5}


def test_held_out_quality(spark):
    big = SF.replace("0.001", "0.01")
    scored = quality_rff.score(table(spark, big, "documents"), table(spark, big, "labels"),
                               crc_slot("doc_id", 4) != 2)
    found = scored.join(table(spark, big, "labels"), "doc_id") \
        .where(crc_slot("doc_id", 4) == 2).collect()
    pairs = [(a.score, b.score) for a in found if a.quality for b in found if not b.quality]
    assert np.mean([(a > b) + 0.5 * (a == b) for a, b in pairs]) >= 0.95
    assert all(r.predicted == (r.score >= 0.7) for r in found)


def test_isotonic_is_monotone_and_keeps_the_mean():
    rng = np.random.default_rng(0)
    x, n = np.arange(50.0), rng.integers(1, 9, 50).astype(float)
    y = np.clip(x / 50 + rng.normal(0, 0.3, 50), 0, 1)
    knots, levels = quality_rff.isotonic(x, y, n)
    assert (np.diff(levels) > 0).all() and (np.diff(knots) > 0).all()
    assert len(levels) < 50


def test_fourier_features_approximate_the_kernel():
    rng = np.random.default_rng(3)
    x = rng.standard_normal((40, 17))
    z = quality_rff.feature_map(x, 4096)[:, :4096]
    d = ((x[:, None] - x[None]) ** 2).sum(-1)
    assert np.abs(z @ z.T - np.exp(-d / (2 * quality_rff.WIDTH ** 2))).max() < 0.1
