import re
from collections import Counter

import numpy as np
from conftest import words

from tillgrain.llm import quality, trees
from tillgrain.llm.queries import op6


def brute(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    counts = Counter(windows)
    covered = {j for i, x in enumerate(windows) if counts[x] > 1 for j in range(i, i + 5)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return [len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered)]


TEXTS = ["a b c d e a b c d e f", "x " * 12, "l1\nl1\n \n \nl1 \nl2\r\nl2\r\n", "#*$ %&| <>é漢🙂", "one two three four five six seven eight nine ten", "a b c d e f a b c d e g a b c d e"]


def test_statistics_by_brute_force(spark, frame, odd, rng):
    rows = [*odd, *((100 + i, t) for i, t in enumerate(TEXTS)), *((200 + i, words(rng, 300, 6)) for i in range(5)), *((300 + i, "\n".join(words(rng, 3, 3) for _ in range(20))) for i in range(5))]
    forest = trees.fit(np.zeros((0, len(quality.FEATURES))), np.zeros(0), quality.MONOTONE)
    got = quality.judge(frame(rows, extra=True), forest).collect()
    want = sorted((str(d), *brute(t)) for d, t, *_ in rows)
    assert sorted((str(r.doc_id), *(r[c] for c in quality.COUNTS)) for r in got) == want
    for r in got:
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert r.kept == (not r.base_failed)  # without labels the trees keep
    assert quality.judge(frame([]), forest).count() == 0


def test_trees_learn_and_stay_monotone():
    rng = np.random.default_rng(1)
    x = rng.random((3000, 4))
    y = ((x[:, 0] > 0.6) ^ (rng.random(3000) < 0.1)).astype(float)
    forest = trees.fit(x, y, np.array([0, -1, 1, 0]))
    assert ((forest.probability(x) > 0.5) == (x[:, 0] > 0.6)).mean() > 0.95
    free = trees.fit(x, (x[:, 1] > 0.5).astype(float), np.array([0, -1, 0, 0]))  # the data want the other way
    probe = np.repeat(rng.random((50, 4)), 20, axis=0)
    probe[:, 1] = np.tile(np.linspace(0, 1, 20), 50)
    for f in (forest, free):
        assert (np.diff(f.margin(probe).reshape(50, 20), axis=1) <= 1e-9).all()


def test_labels_teach_it(spark, folder):
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    got = op6.query(spark, folder).join(labels, "doc_id").where("NOT base_failed").collect()
    right = [r.kept == (r.quality == 1) for r in got]
    assert sum(right) / len(right) > 0.9
    assert op6.query(spark, folder).columns[:9] == ["doc_id", *quality.COUNTS, "base_failed", "score", "kept"]


def test_flat_trees_by_a_plain_walk():
    rng = np.random.default_rng(3)
    x = rng.random((600, 4))
    forest = trees.fit(x, (x[:, 0] + x[:, 2] > 1).astype(float), np.array([0, 0, 0, 0]))
    probe = rng.random((50, 4))

    def walk(tree, row, node=0):
        inner = len(forest.feature[tree])
        if node >= inner:
            return forest.value[tree][node - inner]
        right = row[forest.feature[tree][node]] > forest.threshold[tree][node]
        return walk(tree, row, 2 * node + (2 if right else 1))

    assert np.allclose(forest.margin(probe), [forest.base + sum(walk(t, r) for t in range(len(forest.feature))) for r in probe])
