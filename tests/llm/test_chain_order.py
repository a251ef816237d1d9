"""Every model of the chain takes part in the decision."""

from __future__ import annotations

import numpy as np

from rankloom.llm import queries, toxicity
from rankloom.llm.queries import TOXIC


def test_a_later_category_rejects(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a bad text"), (2, "a good text")],
                                 "doc_id long, text string")
    ((_, _, _, words),) = toxicity._terms([b"bad"])
    models = [np.zeros(6 + k) for k in range(3)]
    for w in models:
        w[5] = -2.0     # the constant, behind one word and four shares
    models[1][0] = 6.0
    chain = toxicity.Chain(TOXIC, np.unique(words[:1]), models)
    assert chain([b"a bad text"])[0, 0] < 0.5 < chain([b"a bad text"])[0, 1]
    monkeypatch.setattr(toxicity, "fit", lambda *a, **k: chain)
    monkeypatch.setattr(queries, "table", lambda s, d, n: docs)
    monkeypatch.setattr(queries, "toxic_labels", lambda *a: None)
    found = {r.doc_id: r.rejected for r in queries.toxicity_chain(spark, "").collect()}
    assert found == {1: True, 2: False}
    assert [r.doc_id for r in toxicity.drop_toxic(docs, chain, *TOXIC).collect()] == [2]
