import re
from collections import Counter, defaultdict

from tillgrain.llm import loglines


def brute(rows, min_docs=3, similar=0.6, depth=3):
    lines = []
    for doc, text in rows:
        for at, line in enumerate((text or "").split("\n") if text is not None else []):
            g = ["<*>" if re.search("[0-9]", w) else w for w in re.findall(r"[^\x20\x09-\x0D]+", line)]
            if g:
                lines.append(((doc, text), at, (len(g), tuple(g[:depth])), tuple(g)))
    leaf_lines = Counter(leaf for _, _, leaf, _ in lines)
    places = defaultdict(Counter)
    for _, _, leaf, g in lines:
        for i, w in enumerate(g):
            places[leaf, i][w] += 1

    def name(leaf, g):
        hits = sum(2 * places[leaf, i][w] > leaf_lines[leaf] for i, w in enumerate(g))
        return ("leaf", leaf) if hits >= similar * len(g) else ("line", leaf, g)

    docs = defaultdict(set)
    for row, _, leaf, g in lines:
        docs[name(leaf, g)].add(row)
    drop = defaultdict(set)
    for row, at, leaf, g in lines:
        if len(docs[name(leaf, g)]) >= (2 if len(g) >= 50 else min_docs):
            drop[row].add(at)
    out = []
    for doc, text in rows:
        parts = text.split("\n") if text is not None else []
        gone = drop.get((doc, text), set())
        out.append((str(doc), len(parts), len(gone), None if text is None else "\n".join(p for i, p in enumerate(parts) if i not in gone)))
    return sorted(out, key=str)


def test_by_brute_force(spark, frame, odd, rng):
    rows = [r[:2] for r in odd]
    for i in range(40):
        own = [f"own{i} line {j} of its kind {rng.random()}" for j in range(2)]
        shared = [f"User u{i} logged in from host{rng.randrange(99)} at 1{i}:00", f"Order {i} was sent to {rng.choice('abc')} today by {rng.choice(['van', 'ship', 'train', 'mule'])} again"] if i % 2 else []
        rows.append((100 + i, "\n".join(rng.sample(own + shared + (["All rights reserved."] if i % 5 == 0 else []), len(own + shared) + (i % 5 == 0)))))
    got = sorted(((str(r.doc_id), r.n_lines, r.n_dropped, r.text) for r in loglines.dedup(frame(rows, extra=True)).collect()), key=str)
    assert got == brute(rows)
    assert sum(r[2] for r in got) > 40
    assert loglines.dedup(frame([])).count() == 0


def family(rng, words, n):
    """Lines of 18 tokens that start alike and have a field without digits."""
    return [" ".join(["We", "ask", "that", *words[:7], "".join(rng.choices("abcdefgh", k=6)), *words[7:]]) for _ in range(n)]


def test_families_of_one_leaf_each_get_a_template(spark, frame, rng):
    for sizes in ((60, 40), (50, 50), (20, 20, 20, 4)):
        lines = [x for f, n in enumerate(sizes) for x in family(rng, [f"{chr(65 + f)}{chr(97 + i)}" for i in range(14)], n)]
        alone = ["We ask that " + " ".join("".join(rng.choices("xyz", k=9)) for _ in range(15)) for _ in range(5)]
        rows = [(i, x + "\n" + "".join(rng.choices("uvw", k=30))) for i, x in enumerate(rng.sample(lines + alone, len(lines + alone)))]
        got = {r.doc_id: r.text for r in loglines.dedup(frame(rows)).collect()}
        for i, text in rows:
            line, other = text.split("\n")
            assert got[i] == (text if line in alone else other)


def test_a_long_line_of_two_documents_recurs(spark, frame, rng):
    def line(n):
        return " ".join("".join(rng.choices("abcdefgh", k=7)) for _ in range(n))

    long, short = line(50), line(49)
    rows = [(1, f"{line(60)}\n{long}"), (2, f"{long}\n{short}"), (3, f"{short}\n{line(50)}")]
    got = {r.doc_id: r.text for r in loglines.dedup(frame(rows)).collect()}
    assert got == {1: rows[0][1].split("\n")[0], 2: short, 3: rows[2][1]}


def test_very_many_lines(spark, frame):
    texts = ["\n".join([f"Entry {i} of the log was written" for i in range(100_000)] + [f"the end of {name}"]) for name in ("one", "two two", "three is here")]
    out = loglines.dedup(frame(list(enumerate(texts)))).collect()
    assert [(r.n_lines, r.n_dropped) for r in out] == [(100_001, 100_000)] * 3 and {r.text for r in out} == {"the end of one", "the end of two two", "the end of three is here"}


def test_recall_of_planted_templates(spark, frame, rng):
    """Boilerplate of several families with fields, some of which share a path, against the generator's truth."""
    families = [["We", "ask", "that", *("".join(rng.choices("klmnop", k=6)) for _ in range(rng.randrange(9, 30)))] for _ in range(25)]
    planted, rows = 0, []
    for i in range(400):
        lines = [" ".join("".join(rng.choices("abcdefghij", k=rng.randrange(3, 9))) for _ in range(rng.randrange(6, 30))) for _ in range(3)]
        marks = []
        for f in rng.sample(range(25), 3):
            words = list(families[f])
            for at in rng.sample(range(4, len(words)), 2):
                words[at] = "".join(rng.choices("uvwxyz", k=5))
            marks.append(" ".join(words))
        planted += 3
        rows.append((i, "\n".join(lines + marks)))
    out = loglines.dedup(frame(rows)).collect()
    dropped = sum(r.n_dropped for r in out)
    own_kept = all(set(rows[r.doc_id][1].split("\n")[:3]) <= set(r.text.split("\n")) for r in out)
    assert dropped >= 0.9 * planted and own_kept


def test_counts_of_tokens_are_not_joined(spark):
    kinds = spark.createDataFrame([(1, 1, "a b c", 4, 3), (1, 1, "a b d", 3, 3), (1, 1, "a e d", 1, 3), (2, 2, "x y", 5, 3)], "leaf long, node long, general string, n long, enough int")
    tried = loglines._fits(kinds, 0.6)
    assert {r.general: r.fits for r in tried.collect()} == {"a b c": True, "a b d": True, "a e d": False, "x y": True}
    # a place's counts are summed, not met with totals of the node
    assert "Join Inner" not in tried._jdf.queryExecution().optimizedPlan().toString()


def test_lines_all_alike_are_not_counted_by_token(spark, frame, monkeypatch):
    """Leaves of one repeated line need no counts; a leaf of different lines does."""
    rows = [(i, "the same line in every text\n" + f"one two three fixed words and {'abc'[i % 3]} end", "en", "s") for i in range(9)]
    counted = []
    monkeypatch.setattr(loglines, "_counts", lambda kinds, own=loglines._counts: counted.append({r.general for r in kinds.collect()}) or own(kinds))
    got = {r.doc_id: r.n_dropped for r in loglines.dedup(frame(rows)).collect()}
    assert got == {i: 2 for i in range(9)}
    assert counted and all(len(c) == 3 and not any(x.startswith("the same") for x in c) for c in counted)
