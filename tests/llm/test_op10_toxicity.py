import numpy as np
import pyarrow as pa
from conftest import words

from tillgrain.llm import kernel, toxicity
from tillgrain.llm.queries import op10

BAD = {"en": ["grumf", "blorg"], "de": ["knurz", "schlonz"]}


def corpus(rng, n=2400):
    rows, labels = [], []
    for i in range(n):
        lang, toxic = ("en", "de")[i % 2], int(rng.random() < 0.2)
        w = words(rng, rng.randrange(5, 120), 800).split()
        if toxic:
            for _ in range(rng.randrange(1, 4)):
                w.insert(rng.randrange(len(w)), rng.choice(BAD[lang]).upper() + rng.choice(["", ".", ","]))
        rows.append((i, " ".join(w), lang, "s"))
        labels.append((i, toxic))
    return rows, labels


def test_learns_words_that_make_texts_toxic(spark, frame, odd, rng):
    rows, labels = corpus(rng)
    label = spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id long, toxic int")
    net = toxicity.train(frame(rows), label, where=toxicity.F.col("k") % 3 != 0)
    assert set(net.cuts) == {"en", "de"}
    got = {r.doc_id: r for r in toxicity.score(frame(rows, extra=True), net).collect()}
    held = [i for i in range(len(rows)) if i % 3 == 0]
    right = [(got[i].score >= toxicity.CUT) == bool(labels[i][1]) for i in held]
    assert sum(right) / len(right) > 0.97
    kept = {r.doc_id for r in toxicity.drop_toxic(frame(rows, extra=True), net).collect()}
    assert kept == {i for i, r in got.items() if not r.flagged}
    again = toxicity.train(frame(rows).repartition(6), label, where=toxicity.F.col("k") % 3 != 0)
    assert np.array_equal(again.embed, net.embed)
    out = toxicity.score(frame(odd), net).collect()
    assert len(out) == len(odd) and all(0 <= r.score <= 1 for r in out)
    assert toxicity.score(frame([]), net).count() == 0
    long = "w1 " * 50_000
    a, b = sorted(toxicity.score(frame([(1, long), (2, long + "grumf blorg")]), net).collect(), key=lambda r: r.doc_id)
    assert a.score < toxicity.CUT <= b.score


def test_without_labels_scores_are_constant(spark, frame):
    net = toxicity.train(frame([(1, "a")]), spark.createDataFrame([], "doc_id long, toxic int"))
    assert len({r.score for r in toxicity.score(frame([(1, "a"), (2, None)]), net).collect()}) == 1


def test_convolution_by_a_plain_loop():
    rng = np.random.default_rng(4)
    net = toxicity.Net(np.arange(50))
    texts = ["a b c d e", "", "a", "c a b", "zz b"]
    part = next(kernel.slices(pa.array(texts)))
    buckets, first = toxicity._buckets(part)
    ids = rng.integers(0, 51, len(buckets)).astype(np.int32)
    got = net.logits(ids, first, net.tables())
    for i in range(len(texts)):
        own = net.embed[ids[first[i] : first[i + 1]]]
        e = np.concatenate([own, np.zeros((3, toxicity.DIM))])
        pooled = [max(sum(e[t + k] @ net.filters[w][k][:, f] for k in range(w)) for t in range(max(1, len(own)))) + net.offset[w][f] for w in toxicity.WIDTHS for f in range(toxicity.FILTERS)]
        assert abs(np.maximum(pooled, 0) @ net.out + net.bias[0] - got[i]) < 1e-4


def test_gradients_by_differences():
    rng = np.random.default_rng(6)
    net = toxicity.Net(np.arange(20))
    texts, y, weight = [rng.integers(1, 21, n).astype(np.int32) for n in (1, 4, 9)], np.array([1.0, 0.0, 1.0]), np.ones(3)

    def loss():
        tables = [[t.astype(float) for t in ts] for ts in [[net.embed @ net.filters[w][k] for k in range(w)] for w in toxicity.WIDTHS]]
        first = np.array([0, 1, 5, 14])
        logit = net.logits(np.concatenate(texts), first, tables)
        return np.mean(np.logaddexp(0, logit) - y * logit)

    for parameter, grad in zip(net.parameters()[1:], toxicity._gradients(net, texts, y, weight)[1:], strict=True):
        at = tuple(rng.integers(0, s) for s in parameter.shape)
        old = parameter[at]
        parameter[at] = old + 1e-5
        up = loss()
        parameter[at] = old - 1e-5
        down = loss()
        parameter[at] = old
        assert abs((up - down) / 2e-5 - grad[at]) < 2e-3


def test_query(spark, folder):
    got = op10.query(spark, folder)
    assert got.columns[:4] == ["doc_id", "held_out", "score", "predicted"]
    assert got.where("predicted <> int(score >= 0.3)").count() == 0
    assert got.count() == spark.read.parquet(f"{folder}/documents.parquet").count()


def test_long_texts_and_hot_keys_in_training(spark, frame, rng):
    rows, labels = corpus(rng, 400)
    # only long texts hold this word; one labelled key has very many rows
    rows += [(1000 + i, words(rng, 10_000, 800) + (" lurgh" if i % 2 else ""), "en", "s") for i in range(40)]
    labels += [(1000 + i, i % 2) for i in range(40)]
    hot = frame([(0, "same text again", "en", "s")]).crossJoin(spark.range(100_000)).drop("id")
    label = spark.createDataFrame(labels, "doc_id long, toxic int")
    net = toxicity.train(frame(rows).union(hot), label)
    bucket = int(toxicity._buckets(next(kernel.slices(pa.array(["lurgh"]))))[0][0])
    assert bucket in set(net.known.tolist())
    few = toxicity.train(frame(rows), label, max_words=50_000)
    assert len(few.known) < len(net.known)


def test_wide_filters_learn_word_order(spark, frame, rng):
    """Texts of the same words, toxic by the order of two of them: what single words can't tell."""
    rows, labels = [], []
    for i in range(1200):
        w, toxic = words(rng, 12, 40).split(), i % 2
        at = rng.randrange(len(w))
        w[at:at] = ["red", "fish"] if toxic else ["fish", "red"]
        rows.append((i, " ".join(w), "en", "s"))
        labels.append((i, toxic))
    net = toxicity.train(frame(rows), spark.createDataFrame(labels, "doc_id long, toxic int"), where=toxicity.F.col("k") % 3 != 0)
    got = {r.doc_id: r.score for r in toxicity.score(frame(rows), net).collect()}
    held = [i for i in range(1200) if i % 3 == 0]
    assert sum((got[i] >= toxicity.CUT) == bool(labels[i][1]) for i in held) / len(held) > 0.8


def test_every_labelled_row_is_trained_on(spark, frame, rng, monkeypatch):
    """More labelled rows than a record holds: each is in one, and reruns agree."""
    rows = [(i, f"w{i % 700} w{i % 31} " + ("grumf" if i % 5 == 0 else "fine") + (" lurgh" if i % 1300 == 0 else "") + f" u{i}", "en", "s") for i in range(13_000)]
    label = spark.createDataFrame([(r[0], int(r[0] % 5 == 0)) for r in rows], "doc_id long, toxic int")
    records = []
    monkeypatch.setattr(toxicity, "_packed", lambda *a, own=toxicity._packed: records.append(own(*a)) or records[-1])
    monkeypatch.setattr(toxicity, "EPOCHS", 1)
    monkeypatch.setattr(toxicity, "released", lambda *frames: None)
    net = toxicity.train(frame(rows).repartition(5), label)
    got = [len(np.frombuffer(r.label, np.int32)) for r in records[0].collect()]
    assert len(got) == 2 and sum(got) == 13_000
    bucket = int(toxicity._buckets(next(kernel.slices(pa.array(["lurgh"]))))[0][0])
    assert bucket in set(net.known.tolist())
    scores = {r.doc_id: r.score for r in toxicity.score(frame(rows), net).where("doc_id < 1000").collect()}
    assert sum((scores[i] >= toxicity.CUT) == (i % 5 == 0) for i in scores) > 970
    again = toxicity.train(frame(rows).repartition(3), label)
    assert np.array_equal(again.embed, net.embed)
