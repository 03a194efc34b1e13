"""What copies and tasks cost the join: no row for each counter of a task, no regions for each copy."""

import numpy as np
from conftest import words

from tillgrain.llm import jaccard


def test_sketch_leaves_tasks_packed_and_counts_all(spark, frame, rng):
    rows = [(i, words(rng, 60, 4000)) for i in range(120)]
    docs = frame(rows).repartition(3)
    passed = jaccard.stored(jaccard.first_pass(docs, 3, doc_key="doc_id", text="text"))
    assert passed.where("n >= 0").count() == 120 and passed.where("n = -1").count() <= 3 * jaccard.SKETCH // jaccard.SKETCH_ROWS
    want = np.zeros(jaccard.SKETCH, np.int64)
    for _, t in rows:
        h = next(jaccard._sets(docs.sparkSession.createDataFrame([(t,)], "t string").toArrow().column(0).combine_chunks(), 3))[1]
        np.add.at(want, (h & np.uint64(jaccard.SKETCH - 1)).astype(int), 1)
    assert (jaccard._order(passed).level == jaccard.Order(want).level).all()


def test_regions_are_made_once_for_all_copies(spark, frame, rng, monkeypatch):
    texts = [words(rng, 50) for _ in range(12)]
    docs = frame([(k, texts[k % 12] if k < 96 else texts[k - 96] + " more") for k in range(98)])
    read, made = [], jaccard._outer_regions
    monkeypatch.setattr(jaccard, "_outer_regions", lambda docs, *rest: (read.append(docs.count()), made(docs, *rest))[1])
    got = {r.doc: r.component for r in jaccard.join(docs).collect()}
    assert read == [14] and got == {k: (k % 12 if k < 96 else k - 96) for k in range(98)}
