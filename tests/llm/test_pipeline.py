"""The pipeline beside a brute-force version of its stages."""

from __future__ import annotations

import corpus_pipeline
from rankloom.llm import packing, secrets, toxicity
from rankloom.llm.packing import tokenizer_of, vocabulary_path
from rankloom.llm.queries import TOXIC, table, toxic_labels

SF = "/root/testdata/sf0.001"


def _first_of_groups(texts):
    sets = {}
    for i, t in texts.items():
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i
    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and \
                    100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {i for i in sets if root(i) == i}


def test_run_beside_brute_force(spark):
    docs = table(spark, SF, "documents")
    chain = toxicity.fit(docs, toxic_labels(spark, SF), TOXIC)
    texts = {r.doc_id: r.text for r in docs.collect()}
    toxic = {i for i, t in texts.items() if chain([(t or "").encode()])[0, 0] >= 0.5}
    clean = {i: t for i, t in texts.items() if i not in toxic}
    kept = {i: clean[i] for i in _first_of_groups(clean)}
    assert 0 < len(toxic) < 0.2 * len(texts) and len(kept) < len(clean)

    def masked(t):
        spans = [s[:2] for s in secrets.base_spans(t)] + [
            s[:2] for s in secrets.inefficient_spans(t, secrets.encoding_of(secrets.VOCABULARY))]
        out, done = "", 0
        for a, b in sorted(spans):
            if a >= done:
                out += t[done:a] + "[secret]"
            done = max(done, b)
        return out + t[done:]
    encode = tokenizer_of(vocabulary_path()).encode
    want = {i: len(encode([masked(t or "")])[0]) // 4 + 1 for i, t in kept.items()}
    rows = corpus_pipeline.run(spark, SF).collect()
    got: dict[int, int] = {}
    for r in rows:
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
    assert got == want
    histogram: dict[int, int] = {}
    for r in rows:
        histogram[r.length] = histogram.get(r.length, 0) + 1
    slots = packing.plan_best_fit(histogram)
    assert len({r.sequence_id for r in rows}) == max(
        s[3] + -(-(s[2] - s[1]) // s[4]) for s in slots)


def test_mixing_stage_orders_its_files(spark, tmp_path):
    docs = table(spark, SF, "documents")
    out = corpus_pipeline.STAGES[3][1](spark, docs, SF)
    out.write.parquet(f"{tmp_path}/mixed")
    from rankloom.llm.mixing import schedule
    slot = {r.doc_id: r.slot for r in schedule(docs).collect()}
    read = sorted(p.name for p in (tmp_path / "mixed").glob("part-*"))
    order = [slot[r.doc_id] for name in read
             for r in spark.read.parquet(f"{tmp_path}/mixed/{name}").select("doc_id").collect()]
    assert len(order) == docs.count() and order == sorted(order)
