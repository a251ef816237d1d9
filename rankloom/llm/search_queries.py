"""The thin queries of the search operators, with their check SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.llm import hard_negatives, lexical_search, topk_search
from rankloom.llm.queries import table
from rankloom.llm.registry import query

_WHOLE = """
    e AS (
        SELECT vec_id, label,
               [floor({scale} * CAST(x AS DOUBLE)) FOR x IN embedding] AS v
        FROM embeddings
        WHERE embedding IS NOT NULL AND len(
            [x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0)"""


_TERMS = r"""regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"""


@query("op11_lexical_search", f"""
    WITH d AS (SELECT doc_id, {_TERMS} AS terms FROM documents WHERE text IS NOT NULL),
    c AS (SELECT count(*) AS docs, CAST(sum(len(terms)) AS BIGINT) AS total
          FROM d WHERE len(terms) > 0),
    p AS (SELECT doc_id, len(terms) AS n, unnest(terms) AS term FROM d),
    tf AS (SELECT doc_id, n, term, count(*) AS tf FROM p GROUP BY ALL),
    w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(docs) + 2 AS DOUBLE)
                                            / (2 * count(*) + 1))) AS BIGINT) AS w
          FROM tf, c GROUP BY term),
    b AS (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark),
    s AS (
        SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 12 * (
                   100 - 25 + ((25 * n * docs) // total))))) AS BIGINT) AS score
        FROM b JOIN tf USING (term) JOIN w USING (term), c GROUP BY item_id, doc_id)
    SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)
                         AS INTEGER) AS rank, doc_id, score
    FROM s WHERE score > 0 QUALIFY rank <= 20""")
def lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.rank(table(spark, sf_dir, "documents"),
                               table(spark, sf_dir, "benchmark"))


@query("op12_hard_negatives", f"""
    WITH {_WHOLE.format(scale=256)},
    n AS (
        SELECT vec_id, v, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label
        FROM e WHERE label IS NOT NULL),
    s AS (
        SELECT a.vec_id AS anchor_id, o.vec_id, a.label = o.label AS same,
               CAST(list_sum([p[1] * p[2] FOR p IN list_zip(a.v, o.v)]) AS BIGINT)
                   AS score
        FROM n a JOIN n o ON a.vec_id <> o.vec_id WHERE a.vec_id % 100 = 0),
    p AS (
        SELECT anchor_id, vec_id, score FROM s WHERE same
        QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
    w AS (
        SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id,
               p.score AS positive_score, s.score AS negative_score,
               CAST(row_number() OVER (PARTITION BY p.anchor_id, p.vec_id
                                       ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank
        FROM p JOIN s USING (anchor_id)
        WHERE NOT s.same AND s.score * 100 BETWEEN 80 * p.score AND 100 * p.score)
    SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score
    FROM w WHERE rank <= 5""")
def hard_negative_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    vec_id = F.col("vec_id")
    label = F.when(vec_id % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"), vec_id % 100 == 0, label)


@query("op13_topk_search", f"""
    WITH {_WHOLE.format(scale=64)},
    s AS (
        SELECT a.vec_id AS query_id, o.vec_id,
               CAST(list_sum([p[1] * p[2] FOR p IN list_zip(a.v, o.v)]) AS BIGINT)
                   AS score
        FROM e a JOIN e o ON a.vec_id <> o.vec_id WHERE a.vec_id % 20 = 0),
    r AS (
        SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)
                       AS INTEGER) AS rank FROM s)
    SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20""")
def topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
