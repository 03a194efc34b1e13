import random

import numpy as np
import pytest
from conftest import words  # noqa: F401

from tillgrain.llm import jaccard, kernel
from tillgrain.llm.queries import op2


def shingle_set(text, n):
    w = kernel.word_list(text, lower=True)
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def brute(rows, n, num, den):
    sets = [shingle_set(t, n) for _, t in rows]
    comp = list(range(len(rows)))

    def find(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and den * len(a & sets[j]) >= num * len(a | sets[j]):
                comp[find(i)] = find(j)
    names = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            names[find(i)] = min(names.get(find(i), d), d)
    return sorted((str(d), len(sets[i]), str(d if not sets[i] else names.get(find(i)))) for i, (d, _) in enumerate(rows))


def corpus(seed, groups=12, pool=60):
    """Chains of edited copies around the threshold, a large group, shared passages, tiny texts."""
    rng = random.Random(seed)
    passage = " ".join(f"p{i}" for i in range(40))
    texts = []
    for g in range(groups):
        base = [f"g{g}w{rng.randrange(pool)}" for _ in range(rng.choice((8, 30, 80, 200)))]
        for _ in range(rng.randrange(1, 9) if g else 120):
            copy = list(base)
            for _ in range(rng.randrange(0, max(2, len(base) // 14))):
                copy[rng.randrange(len(copy))] = f"e{rng.randrange(10**6)}"
            if rng.random() < 0.3:
                base = copy  # a chain
            texts.append(" ".join(copy) + (" " + passage if rng.random() < 0.3 else ""))
    texts += [passage, passage.upper(), "a", "a b", "a b c", "a b c d", "", None, "  "] + texts[:5]
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("n,num,seed,way", [(3, 90, 1, "plain"), (5, 80, 2, "plain"), (3, 80, 3, "dealt"), (5, 80, 2, "hot")])
def test_components_by_brute_force(spark, frame, monkeypatch, n, num, seed, way):
    if way == "dealt":  # all cells are dealt until they are tiny
        monkeypatch.setattr(jaccard, "LOCAL_NODES", 3)
    if way == "hot":  # names of 4 bits clash, a small sketch tells nothing, all regions count as large
        monkeypatch.setattr(jaccard, "NODE_BITS", 4)
        monkeypatch.setattr(jaccard, "SKETCH", 2)
        monkeypatch.setattr(jaccard, "HOT", 3)
    rows = corpus(seed, groups=5 if way == "dealt" else 12)
    got = jaccard.join(frame(rows), n=n, num=num).collect()
    assert sorted((str(r.doc), r.n_shingles, str(r.component)) for r in got) == brute(rows, n, num, 100)


def passage_corpus(nodes, seed=4):
    """Texts around one passage, each with words of its own; every tenth has a copy with one word changed."""
    rng = random.Random(seed)
    passage = [f"p{i}" for i in range(40)]
    texts = []
    while len(texts) < nodes:
        own = [f"o{rng.randrange(10**9)}" for _ in range(20)]
        texts.append(" ".join(passage + own))
        if rng.random() < 0.1:
            texts.append(" ".join(passage + own[:-1] + ["changed"]))
    return list(enumerate(texts))


def test_rounds_grow_with_the_logarithm_of_a_cell(spark, frame, monkeypatch):
    monkeypatch.setattr(jaccard, "LOCAL_NODES", 40)
    monkeypatch.setattr(jaccard, "SKETCH", 1)  # the passage is unseen: it takes part in every prefix
    rounds = {}
    for nodes in (150, 1500):
        rows = passage_corpus(nodes)
        docs = frame(rows)
        passed = jaccard.stored(jaccard.first_pass(docs, 3, doc_key="doc_id", text="text"))
        links, rounds[nodes] = jaccard.links_of(docs, passed, passed.where("n > 0"), 3, 90, 100, clashes=[])
        labels = jaccard.components(links)
        pairs = sum(1 for _, t in rows if t.endswith("changed"))
        assert labels.count() == 2 * pairs and labels.select("label").distinct().count() == pairs
    assert 1 <= rounds[150] and rounds[1500] <= rounds[150] + 3


def test_odd_rows(spark, frame, odd):
    rows = [r[:2] for r in odd]
    got = jaccard.join(frame(odd, extra=True)).collect()
    assert sorted((str(r.doc), r.n_shingles, str(r.component)) for r in got) == brute(rows, 3, 90, 100)
    assert jaccard.join(frame([])).count() == 0


def test_cells_by_brute_force():
    rng = np.random.default_rng(3)
    sets = []
    for _ in range(40):
        base = np.unique(rng.integers(0, 1 << 40, 60).astype(np.uint64))
        for _ in range(4):
            sets.append(np.unique(np.concatenate([base[rng.random(len(base)) > 0.06], rng.integers(0, 1 << 40, 2).astype(np.uint64)])))
    links = jaccard.join_cell(sets, 90, 100)
    parent = list(range(len(sets)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        parent[find(a)] = find(b)
    for i in range(len(sets)):
        for j in range(i):
            common = len(np.intersect1d(sets[i], sets[j]))
            linked = common * 100 >= (len(sets[i]) + len(sets[j]) - common) * 90
            assert not linked or find(i) == find(j)
    assert all(len(np.intersect1d(sets[a], sets[b])) * 100 >= 90 * len(np.union1d(sets[a], sets[b])) for a, b in links)


def test_one_of_each_keeps_the_smallest_and_all_columns(spark, frame, odd):
    rows = corpus(5)
    df = frame(rows, extra=True)
    kept = jaccard.one_of_each(df, n=3, num=90)
    want = {c for _, n, c in brute(rows, 3, 90, 100)}
    assert kept.columns == df.columns and {str(r.doc_id) for r in kept.collect()} == want
    assert {r.row for r in kept.collect()} == {"x"} and {r.node for r in kept.collect()} == {"x"}
    # rows without words all stay; of alike rows one does
    texts = [r.text for r in jaccard.one_of_each(frame(odd)).collect()]
    assert texts.count("x") == 1 and texts.count(None) == 2 and texts.count("") == 1


def test_contraction_never_exceeds_the_difference():
    rng = np.random.default_rng(1)
    h = np.unique(rng.integers(0, 1 << 60, 900).astype(np.uint64))
    a, b = np.sort(h[:600]), np.sort(h[200:])
    counts = jaccard._counts(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)])).astype(int)
    assert np.abs(counts[0] - counts[1]).sum() <= len(np.setxor1d(a, b))


def test_query_columns(spark, folder):
    assert op2.query(spark, folder).columns == ["doc_id", "n_shingles", "component_id"]
