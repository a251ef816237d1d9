"""Every operator on empty tables, nulls, empty and long texts, ties, repeats, extra columns."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from rankloom.llm import (embedding_dedup, lang_id, line_dedup, mixing, ngram_join, packing,
                          quality_rff, quality_rules, secrets, toxicity)
from rankloom.llm.tables import crc_slot

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{i % 977}x{i}" for i in range(30_000))
ROWS = [
    (1, "a plain text of some words, nothing more than that here", "en", "s", 3),
    (1, "a plain text of some words, nothing more than that here", "en", "s", 3),
    (2, None, "en", "s", None), (3, "", None, None, 0), (4, " \n\t ", "en", None, 2),
    (None, "no id but words all the same", None, "s", 1), (5, LONG, "en", "t", len(LONG)),
    (6, LONG, "en", "t", len(LONG)), (7, "!!! ??? 123", "de", "t", 5),
    (8, "ein kurzer deutscher Satz über nichts", "de", "u", 7),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(1, 1, 0), (5, 0, 1), (6, None, None), (8, 1, 0), (None, 1, 0), (99, 0, 1), (7, 0, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def _identify(docs, labels):
    return lang_id.identify(docs, crc_slot("doc_id", 3) != 1, ["doc_id"])


def _toxic(docs, labels):
    flags = labels.select("doc_id", (F.col("toxic") == 1).alias("toxic"))
    return toxicity.predict(docs, toxicity.fit(docs, flags, ["toxic"]))


def _quality(docs, labels):
    return quality_rff.score(docs, labels, crc_slot("doc_id", 4) != 2)


OPERATORS = {
    "language": (_identify, len(ROWS)),
    "toxicity": (_toxic, len(ROWS)),
    "mixing": (lambda d, _: mixing.schedule(d), len(ROWS)),
    "mixed": (lambda d, _: mixing.mixed(d), len(ROWS)),
    "ngrams": (lambda d, _: ngram_join.links(d), len(ROWS) - 1),    # no row without doc_id
    "quality": (_quality, len(ROWS)),
    "lines": (lambda d, _: line_dedup.remove_repeats(d), len(ROWS)),
    "secrets": (lambda d, _: secrets.scan(d), len(ROWS)),
    "redact": (lambda d, _: secrets.redact(d), len(ROWS)),
    "rules": (lambda d, _: quality_rules.judge(d), len(ROWS)),
    "packing": (lambda d, _: packing.pack(d), None),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_rows_stay_whole(name, docs, labels):
    run, number = OPERATORS[name]
    rows = run(docs, labels).collect()
    assert number is None or len(rows) == number


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(name, empty, labels):
    assert OPERATORS[name][0](empty, labels).collect() == []


@pytest.mark.parametrize("name", OPERATORS)
def test_clashing_columns_are_harmless(name, docs, labels):
    run, number = OPERATORS[name]
    extra = docs.withColumns({c: F.lit("x") for c in (
        "score", "removed", "slot", "block", "group_rank", "weight_before", "length", "n",
        "label", "kept", "sig", "row", "units", "best", "fold")})
    rows = run(extra, labels).collect()
    assert number is None or len(rows) == number


def test_language_without_letters(docs, labels):
    found = {(r.doc_id, r.lang_pred, r.score) for r in _identify(docs, labels).collect()}
    assert {(2, "und", 0.0), (3, "und", 0.0), (4, "und", 0.0), (7, "und", 0.0)} <= found
    assert {r[1] for r in found} <= {"und", "en", "de"}


def test_copies_link_and_empty_texts_do_not(docs):
    found = {r.doc_id: (r.n_shingles, r.n_links, r.component_id)
             for r in ngram_join.links(docs).collect()}
    assert found[5] == (29_996, 1, 5) and found[6] == (29_996, 1, 5)
    assert found[2] == (0, 0, 2) and found[3] == (0, 0, 3) and found[4] == (0, 0, 4)
    assert found[1][1:] == (1, 1)


def test_long_copy_is_removed_and_first_stays(docs):
    found = {r.doc_id: r for r in line_dedup.remove_repeats(docs).collect()}
    assert found[5].text == LONG and not found[5].removed
    assert found[6].text == "" and found[6].removed[0].words == 30_000
    assert found[2].text is None and found[1].text == ROWS[0][1]


def test_packing_of_empty_and_long_texts(docs):
    rows = packing.pack(docs).collect()
    assert [(r.piece, r.length) for r in rows if r.doc_id == 2] == [(0, 1)]
    long = sorted((r.piece, r.start, r.length) for r in rows if r.doc_id == 5)
    assert long[0] == (0, 0, 2048) and [s for _, s, _ in long] == \
        [2048 * k for k in range(len(long))]


BAD = [
    (1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.0], 1), (4, [1.0, 0.0], 2),
    (5, [1.0, 0.0], None), (6, None, 1), (7, [0.0, 0.0], 1), (8, [float("nan"), 1.0], 1),
    (9, [1.0, None], 1), (10, [], 1), (11, [1.0, 0.01], 1), (12, [1.0, 0.0, 0.0], 1),
    (None, [0.0, 1.0], 1), (13, [-0.0, 1.0], 1),
]


def test_vectors_without_links(spark):
    rows = spark.createDataFrame(BAD, "vec_id long, embedding array<float>, label int") \
        .withColumn("bucket", F.lit(3))
    found = {r.vec_id: (r.n_links, r.component_id, r.kept)
             for r in embedding_dedup.links(rows).collect()}
    assert [found[i] for i in (1, 2, 3, 11)] == [(3, 1, True), *[(3, 1, False)] * 3]
    assert all(found[i] == (0, i, True) for i in (4, 5, 6, 7, 8, 9, 10, 12))
    assert found[None][0] == 1 and found[13] == (1, 13, True)
    assert embedding_dedup.links(rows.limit(0)).collect() == []


def test_pipeline_stages_keep_rows_without_names(spark, docs, tmp_path):
    flags = "doc_id long, quality int, toxic int"
    spark.createDataFrame([(1, 1, 0), (5, 1, 1)], flags).write.parquet(
        f"{tmp_path}/labels.parquet")
    frame = docs.select(*corpus_pipeline.COLUMNS)
    for _, stage in corpus_pipeline.STAGES[1:4]:
        frame = stage(spark, frame, str(tmp_path))
        assert frame.columns == corpus_pipeline.COLUMNS
    ids = sorted((r.doc_id is None, r.doc_id or 0) for r in frame.select("doc_id").collect())
    assert ids == sorted([(False, i) for i in (1, 1, 2, 3, 4, 5, 7, 8)] + [(True, 0)])
    assert corpus_pipeline.STAGES[4][1](spark, frame.limit(0), str(tmp_path)).collect() == []


def test_lines_keep_columns_of_any_name(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(1, text, "u", [1], 5), (2, text, "v", [2], 6), (3, None, "w", [], 7)]
    docs = spark.createDataFrame(
        rows, "doc_id long, text string, _units string, units array<int>, _row int") \
        .withColumns({"row": F.lit(1), "doc": F.lit("d"), "removed": F.lit("old")})
    out = line_dedup.remove_repeats(docs)
    assert out.columns == ["doc_id", "text", "_units", "units", "_row", "row", "doc", "removed"]
    found = {r.doc_id: (r.text, r._units, r.units, r._row, r.doc, len(r.removed))
             for r in out.collect()}
    assert found == {1: (text, "u", [1], 5, "d", 0), 2: ("", "v", [2], 6, "d", 1),
                     3: (None, "w", [], 7, "d", 0)}


def test_any_number_of_languages(spark, monkeypatch):
    """More languages than are held at a time: the passes find what one pass finds."""
    alphabets = ["abcd", "efgh", "ijkl", "mnop", "qrst", "uvwx"]
    rows = [(i, " ".join(alphabets[i % 6][(i + k) % 4] * 2 + alphabets[i % 6][k % 4]
                         for k in range(12)), f"l{i % 6}") for i in range(120)]
    rows += [(200, None, "l0"), (201, "123", "l1"), (202, "abcd efgh", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")

    def found():
        rows = lang_id.identify(docs, F.col("doc_id") % 4 != 0, ["doc_id"]).collect()
        return {r.doc_id: (r.lang_pred, round(r.score, 9), r.rejected, round(r.entropy, 9))
                for r in rows}
    whole = found()
    assert all(whole[i][0] == f"l{i % 6}" for i in range(120))
    for at_once in (1, 4):
        monkeypatch.setattr(lang_id.score_all, "__defaults__", (at_once,))
        assert found() == whole
