import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tillgrain.llm import kernel, language
from tillgrain.llm.queries import op8


def test_held_out_accuracy(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    got = op8.query(spark, folder)
    assert set(got.columns) >= {"doc_id", "held_out", "lang_pred", "score"} and got.count() == docs.count()
    r = got.where("held_out").join(docs, "doc_id").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.min("score"), F.max("score")).first()
    assert r[0] >= 0.95 and 0 <= r[1] <= r[2] <= 1


def test_codewords_tell_languages_apart():
    for k in (2, 3, 4, 7, 9, 20):
        code = language.codewords(k)
        apart = (code.shape[1] - code @ code.T) / 2 + np.diag(np.full(k, np.inf))
        assert apart.min() >= (1 if k < 3 else 2) and (np.abs(code.sum(0)) < k).all()
    assert language.codewords(7).shape == (7, 63) and language.codewords(1).shape == (1, 0)


def test_odd_rows_and_few_languages(spark, frame, odd):
    texts = {"de": "der die das und nicht ist auch ein", "en": "the and of that with this from have", "fr": "le la les des est une dans pour que"}
    train = frame([(i, f"{texts[l]} {texts[l][i % 9 :]}", l) for i, l in enumerate(list(texts) * 30)])
    model = language.train(train)
    got = {(r.doc_id, r.lang_pred) for r in language.identify(frame([(1, "und das ist nicht"), (2, "that is from the"), (3, "les une pour des"), (4, "123 ...")]), model).collect()}
    assert got == {(1, "de"), (2, "en"), (3, "fr"), (4, "und")}
    rows = language.identify(frame(odd, extra=True), model).collect()
    assert len(rows) == len(odd) and {r.lang_pred for r in rows} <= {*texts, "und"}
    assert {r.lang_pred for r in rows if r.doc_id in (0, 1, 2, 3)} == {"und"} and next(r for r in rows if r.doc_id == 7).lang_pred != "und"
    one = language.train(train.where("lang = 'en'"))
    assert {r.lang_pred for r in language.identify(frame([(1, "le"), (2, "?")]), one).collect()} == {"en", "und"}
    none = language.train(frame([]))
    assert [r.lang_pred for r in language.identify(frame([(1, "le")]), none).collect()] == ["und"] and language.identify(frame([]), none).count() == 0


def test_long_and_short_texts_use_all_of_themselves(spark, frame):
    texts = {"de": "der die das und nicht ist auch ein ", "en": "the and of that with this from have "}
    model = language.train(frame([(i, texts[l] * 3 + texts[l][i % 5 :], l) for i, l in enumerate(list(texts) * 30)]))
    got = {r.doc_id: r.lang_pred for r in language.identify(frame([(1, texts["de"] * 10 + texts["en"] * 40_000), (2, texts["en"] * 10 + texts["de"] * 40_000)]), model).collect()}
    assert got == {1: "en", 2: "de"}


def plain_grams(text):
    """Byte n-grams by a plain loop: their buckets and counts."""
    data = bytes(language._FOLD[b] for b in text.encode())
    out = {}
    for n in (1, 2, 3):
        for i in range(len(data) - n + 1):
            code = 0
            for c in data[i : i + n]:
                code = (code * 257 + c + 1) % 2**32
            h = (code + n * 0x51ED27) * 0x9E3779B1 % 2**32
            h ^= h >> 15
            bucket = (h * 0x85EBCA6B % 2**32) >> 19
            out[bucket] = out.get(bucket, 0) + 1
    return out


def test_counts_margins_and_decoding_by_plain_loops():
    rng = np.random.default_rng(8)
    texts = ["Der Hund", "", "x", "çà et là 12 !", "the cat sat on the mat"]
    part = next(kernel.slices(pa.array(texts)))
    counts = language.gram_counts(part)
    for row, text in zip(counts, texts, strict=True):
        assert {int(i): int(row[i]) for i in np.flatnonzero(row)} == plain_grams(text)
    model = language.Model(["a", "b", "c", "d"])
    bits = model.code.shape[1]
    model.weights, model.bias, model.trust = rng.standard_normal((language.BUCKETS, bits)).astype(np.float32), rng.standard_normal(bits), rng.random(bits)
    margins = model.margins(part)
    best, score = model.decode(margins)
    for i, text in enumerate(texts):
        grams = plain_grams(text)
        total = sum(grams.values())
        want = (sum(n * model.weights[b].astype(float) for b, n in grams.items()) / max(1, total) + model.bias) * total / (total + language.FAINT)
        assert np.abs(margins[i] - want).max() < 1e-4
        losses = [sum(model.trust[k] * np.log1p(np.exp(-want[k] * word[k])) for k in range(bits)) for word in model.code]
        assert best[i] == int(np.argmin(losses))
        assert abs(score[i] - np.exp(-min(losses)) / sum(np.exp(-x) for x in losses)) < 1e-4


def test_repeated_rows_count_once_in_the_sample(spark, frame):
    texts = {"de": "der die das und nicht ist auch ein", "en": "the and of that with this from have"}
    rows = [(i, f"{texts[l]} {i}", l) for i, l in enumerate(list(texts) * 40)]
    hot = frame([(999, "zzz zzz", "de")]).crossJoin(spark.range(20_000)).drop("id")
    a, b = (language.train(d, max_train=60) for d in (frame(rows).union(hot), frame(rows).union(hot).repartition(5)))
    assert np.array_equal(a.weights, b.weights)
    assert {r.lang_pred for r in language.identify(frame([(1, "das und ist")]), a).collect()} == {"de"}
