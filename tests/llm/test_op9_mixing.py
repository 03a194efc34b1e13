from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from conftest import words

from tillgrain.llm import mixing
from tillgrain.llm.queries import op9


def brute_targets(sizes, weights=(3, 1, 2), share=Fraction(3, 2), most=2):
    """Reshare what is above the caps, again and again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    out, capped, rest = {}, set(), share * sum(sizes.values())
    while True:
        left = [s for s in names if s not in capped]
        free = rest - sum(most * sizes[s] for s in capped)
        for s in left:
            out[s] = free * w[s] / sum(w[x] for x in left)
        over = {s for s in left if out[s] > most * sizes[s]}
        if not over:
            return {s: float(most * sizes[s]) if s in capped else float(out[s]) for s in names}
        capped |= over


def test_targets_by_brute_force(rng):
    for _ in range(50):
        sizes = {(f"s{i}" if i else None): rng.randrange(1, 1000) for i in range(rng.randrange(1, 9))}
        got, want = mixing.targets(list(sizes.items())), brute_targets(sizes)
        assert all(got[s] == pytest.approx(want[s]) for s in sizes)
    assert mixing.targets([("a", 0), (None, 0)]) == {"a": 0.0, None: 0.0} and mixing.targets([]) == {}


def test_flight_keeps_both_totals(rng):
    g = np.random.default_rng(2)
    p, size = g.random(500), g.integers(1, 900, 500).astype(float)
    moved = mixing.flight(p, size, g.random(500))
    assert ((moved > 0) & (moved < 1)).sum() <= 2
    assert moved.sum() == pytest.approx(p.sum()) and moved @ size == pytest.approx(p @ size)
    equal = mixing.flight(np.full(9, 0.5), np.full(9, 4.0), g.random(9))
    assert equal.sum() == pytest.approx(4.5)


def test_every_unit_keeps_its_chance():
    g = np.random.default_rng(5)
    p, size = np.array([0.2, 0.5, 0.8, 0.35, 0.65]), np.array([3.0, 1.0, 4.0, 1.5, 5.0])
    mean = np.mean([mixing.flight(p.copy(), size, g.random(5)) for _ in range(4000)], axis=0)
    assert np.abs(mean - p).max() < 0.03


def check(rows, docs, exact):
    sizes, taken, target = Counter(), Counter(), {}
    source = {d: s for d, _, _, s in docs}
    for r in rows:
        s = source[r.doc_id]
        sizes[s] += r["size"]
        taken[s] += r.taken
        target[s] = r.target
        assert 0 <= r.taken <= 2 * r["size"] and (not r["size"] or r.taken % r["size"] == 0)
    want = brute_targets(sizes)
    for s in sizes:
        assert target[s] == pytest.approx(want[s]) and abs(taken[s] - want[s]) <= exact


@pytest.mark.parametrize("block", [5000, 30])
def test_mix(spark, frame, rng, block):
    docs = [(i, words(rng, rng.randrange(0, 60)), "en", "hot" if i % 3 == 0 else rng.choice(["a", "b", None, "c"])) for i in range(900)]
    got = mixing.mix(frame(docs, extra=True), block=block).collect()
    assert len(got) == 900
    check(got, docs, 60)
    again = mixing.mix(frame(docs).repartition(5), block=block).collect()
    assert sorted((r.doc_id, r.taken) for r in got) == sorted((r.doc_id, r.taken) for r in again)


def test_odd_rows(spark, frame, odd):
    df = frame(odd, extra=True)
    got = mixing.mix(df).collect()
    assert len(got) == len(odd) and all(r.taken == 0 for r in got if not r["size"])
    out = mixing.mixed(df)
    assert out.columns == df.columns
    count = defaultdict(int)
    for r in mixing.mix(df).collect():
        count[r.doc_id] += r.copies
    assert Counter(r.doc_id for r in out.collect()) == {k: v for k, v in count.items() if v}
    assert mixing.mix(frame([])).count() == 0 and mixing.mixed(frame([])).count() == 0
    assert mixing.mix(frame([(1, None), (2, " ")])).count() == 2


def test_query(spark, folder):
    docs = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", "lang", "source").collect()]
    got = op9.query(spark, folder)
    assert got.columns == ["doc_id", "size", "source_size", "target", "taken"]
    rows = got.collect()
    assert all(r["size"] == len((t or "").split()) for r, t in zip(sorted(rows, key=lambda r: r.doc_id), [t for _, t, *_ in sorted(docs, key=lambda x: x[0])], strict=True))
    check(rows, docs, max(r["size"] for r in rows))


def test_mixed_keeps_columns_and_tells_null_cells_apart(spark, frame):
    rows = [(1, "web " * 5, "en", None), (1, None, "en", "web " * 5), (None, "a b", "en", "s"), (2, "a b", "en", "s"), (2, "a b", "en", "s")]
    df = frame(rows, extra=True).selectExpr("*", "'y' AS copies", "'y' AS number", "'y' AS whole", "'y' AS id")
    out = mixing.mixed(df).collect()
    assert {(r.row, r.digest, r._digest, r.copies, r.number, r.whole, r.id) for r in out} == {("x", "x", "x", "y", "y", "y", "y")}
    assert df.select(mixing.row_id("doc_id", "text", "source").alias("i")).distinct().count() == 4 and all(r.text is not None for r in out)


def test_wordless_documents_have_copies_by_number(spark, frame, rng):
    docs = [(i, words(rng, 30) if i % 2 else None, "en", "abc"[i % 3]) for i in range(600)] + [(1000 + i, " ", "en", "d") for i in range(5)]
    rows = mixing.mix(frame(docs)).collect()
    check([r for r in rows if r.doc_id < 1000], [d for d in docs if d[0] < 1000], 30)
    source = {d: s for d, _, _, s in docs}
    for s in "abc":
        ratio = next(r.target / r.source_size for r in rows if source[r.doc_id] == s)
        blank = [r.copies for r in rows if source[r.doc_id] == s and not r["size"]]
        assert all(int(ratio) <= c <= int(ratio) + 1 for c in blank)
        copies = [r.copies for r in rows if source[r.doc_id] == s]
        assert abs(sum(copies) - ratio * len(copies)) <= 2
    assert [r.copies for r in rows if source[r.doc_id] == "d"] == [0] * 5 and all(r.taken == 0 for r in rows if not r["size"])
