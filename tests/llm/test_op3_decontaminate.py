from conftest import words

from tillgrain.llm import decontaminate as d
from tillgrain.llm import kernel


def brute(docs, items, n=5, share=0.8):
    out, found = [], set()
    for doc, text in docs:
        spoken = kernel.word_list(text, lower=True)
        for key, item in items:
            w = kernel.word_list(item, lower=True)
            size = min(n, len(w))
            if not w:
                continue
            mine, theirs = ({tuple(x[i : i + size]) for i in range(len(x) - size + 1)} for x in (w, spoken))
            if len(mine & theirs) >= share * len(mine) - 1e-9:
                out.append((str(doc), str(key), len(mine), len(mine & theirs)))
                found.add((doc, text))
    return sorted(out), found


def test_finds_all_that_brute_force_finds(spark, frame, odd, rng):
    items = [(i, words(rng, n, 10**6)) for i, n in enumerate((3, 4, 5, 6, 9, 20, 40, 70, 130, 300))] + [(20, None), (21, ""), (22, "x"), (None, "null key item of seven words here"), (23, words(rng, 30, 10**6)), (23, words(rng, 30, 10**6))]
    docs = [r[:2] for r in odd]
    for _, text in items:
        w = (text or "").split()
        for broken in (0, 1, 2, 4):
            copy = list(w)
            for _ in range(min(broken, len(copy))):
                copy[rng.randrange(len(copy))] = "zz"
            docs.append((1000 + len(docs), words(rng, 2000, 10**6) + " " + " ".join(copy).upper() + "\n" + words(rng, 50, 10**6)))
        docs.append((1000 + len(docs), " ".join(w[: len(w) // 2] + ["and", "then"] + w[len(w) // 2 :])))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = d.contaminated(frame(docs, extra=True), bench).collect()
    want, bad = brute(docs, items)
    assert want and sorted((str(r.doc_id), str(r.item_id), r.item_shingles, r.shared_shingles) for r in got) == want
    blocks = d.contaminated(frame(docs), bench, max_block_shingles=60).collect()
    assert sorted((str(r.doc_id), str(r.item_id), r.item_shingles, r.shared_shingles) for r in blocks) == want
    kept = d.decontaminate(frame(docs, extra=True), bench)
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r[0]) for r in docs if r not in bad)


def test_empty_sides(spark, frame):
    none = spark.createDataFrame([], "item_id long, text string")
    assert d.contaminated(frame([(1, "a b")]), none).count() == 0 and d.decontaminate(frame([(1, "a b")]), none).count() == 1
    assert d.contaminated(frame([]), spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")).count() == 0
