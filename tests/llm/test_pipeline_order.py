"""The mixing stage decides where run() puts documents."""

from __future__ import annotations

from collections import defaultdict

import corpus_pipeline
from rankloom.llm import mixing, packing

SF = "/root/testdata/sf0.001"


def test_run_follows_the_target_weights(spark, monkeypatch):
    def rows():
        return sorted(tuple(r) for r in corpus_pipeline.run(spark, SF).collect())
    before = rows()
    monkeypatch.setattr(mixing, "tempered", lambda sizes: {
        s: 1.0 + k ** 3 for k, s in enumerate(sorted(sizes))})
    after = rows()
    assert before != after
    assert [r[:5] for r in before] == [r[:5] for r in after]


def test_stretches_come_one_after_the_other(spark):
    docs = spark.createDataFrame([(i, "word " * (i * 37 % 90), 99 - i) for i in range(100)],
                                 "doc_id long, text string, place long")
    got = packing.pack_in_order(docs, "place", capacity=64, stretch=10).collect()
    of, room = defaultdict(set), defaultdict(list)
    for r in got:
        of[(99 - r.doc_id) // 10].add(r.sequence_id)
        room[r.sequence_id].append((r.offset, r.length))
    assert sorted(room) == list(range(len(room)))
    assert all(max(of[k]) < min(of[k + 1]) for k in range(9))
    for parts in room.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 64
