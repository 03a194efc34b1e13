"""Language identification by error-correcting output codes.

Every known language gets a codeword of bits; one binary n-gram classifier (logistic regression on the
shares of hashed 1- to 3-byte n-grams of the whole text, ASCII capitals lowered) predicts each bit. Up to
seven languages take the exhaustive code of 2^(k-1)-1 bits; more take random codewords, the set with the
largest smallest distance out of many draws. Decoding sums each bit's logistic loss against every
codeword, weighted by how reliable that bit was on rows held back from its training, and takes the
codeword with the least loss; the two smallest losses give the score and flag ambiguous texts.

Fitting uses a bounded sample: at most ``max_train`` texts (one for each language, if there are more
languages than that), spread evenly over languages by a hash of key and text; repeated rows count once.
From each only the counts of its hashed n-grams reach the driver. Prediction reads the text alone.

Special cases: a null text, or one without a letter (Unicode category L), is ``und`` with score 0. With one
known language every other text gets it; with none, every text is ``und``. Repeated rows give a row each;
columns other than key, text and language are ignored, whatever their names.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillgrain.llm import kernel
from tillgrain.llm.session import received, sent

MAX_TRAIN = 3_000
BUCKETS = 1 << 13
STEPS = 140
AMBIGUOUS = 0.9
TYPICAL = 2.5  # the usual margin of a bit
FAINT = 60  # a text of so many n-grams counts half
UNDETERMINED = "und"

_U32 = np.uint32
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True


def _grams(part: kernel.Texts) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For n of 1, 2, 3: the bucket of the n-gram that begins at each byte, and whether it lies inside its text. Runs of
    digits, marks and spaces are one separator byte each in value."""
    chars = _FOLD[part.data].astype(_U32)
    size = len(chars)
    text_end = np.repeat(part.bounds[1:], np.diff(part.bounds))
    at = np.arange(size)
    code = np.zeros(size, _U32)
    for n in (1, 2, 3):
        code[: size - n + 1] = code[: size - n + 1] * _U32(257) + chars[n - 1 :] + _U32(1)
        h = (code + _U32(n * 0x51ED27)) * _U32(0x9E3779B1)
        h ^= h >> _U32(15)
        yield (h * _U32(0x85EBCA6B)) >> _U32(32 - 13), at + n <= text_end


_FOLD = np.array([i + 32 if 65 <= i <= 90 else i if 97 <= i <= 122 or i >= 0x80 else 0x20 for i in range(256)], np.uint8)


def gram_counts(part: kernel.Texts) -> np.ndarray:
    """Hashed n-gram counts of each text of a slice, one row each."""
    out = np.zeros((len(part), BUCKETS), np.float32)
    for buckets, inside in _grams(part):
        for i, (a, b) in enumerate(zip(part.bounds[:-1], part.bounds[1:], strict=True)):
            out[i] += np.bincount(buckets[a:b][inside[a:b]], minlength=BUCKETS)
    return out


def codewords(k: int, seed: int = 5) -> np.ndarray:
    """k rows of +1 and -1; every column splits the languages, no two columns split them alike."""
    if k < 2:
        return np.ones((k, 0))
    if k <= 7:
        columns = [(1, *rest) for rest in itertools.product((1, -1), repeat=k - 1) if -1 in rest]
        return np.array(columns, float).T
    rng, bits = np.random.default_rng(seed), int(np.ceil(10 * np.log2(k)))
    best, most = None, -1.0
    for _ in range(200):
        code = rng.choice([-1.0, 1.0], (k, bits))
        apart = (bits - code @ code.T) / 2 + np.diag(np.full(k, np.inf))
        if apart.min() > most and (np.abs(code.sum(0)) < k).all():
            best, most = code, apart.min()
    return best


class Model:
    def __init__(self, names: list[str]):
        self.names, self.code = names, codewords(len(names))
        bits = self.code.shape[1]
        self.weights, self.bias, self.trust = np.zeros((BUCKETS, bits), np.float32), np.zeros(bits), np.ones(bits)

    def losses(self, margins: np.ndarray) -> np.ndarray:
        """Weighted logistic loss of every row against every codeword."""
        return np.stack([(self.trust * np.logaddexp(0, -margins * word)).sum(1) for word in self.code], 1)

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        losses = self.losses(margins)
        p = np.exp(losses.min(1, keepdims=True) - losses)
        p /= p.sum(1, keepdims=True)
        return p.argmax(1), p.max(1)

    def margins(self, part: kernel.Texts) -> np.ndarray:
        bits = self.weights.shape[1]
        total, grams = np.zeros((len(part), bits)), np.zeros(len(part))
        for i0 in range(0, len(part), 64):  # a few texts at a time keep the gathered weights in the cache
            bounds = part.bounds[i0 : i0 + 65]
            some = kernel.Texts(part.data[bounds[0] : bounds[-1]], bounds - bounds[0], 0, part.null[i0 : i0 + 64])
            rows = slice(i0, i0 + len(some))
            filled = np.flatnonzero(np.diff(some.bounds))
            if not len(filled):
                continue
            heads = some.bounds[:-1][filled]
            for buckets, inside in _grams(some):
                values = self.weights[buckets]
                values[~inside] = 0
                total[rows][filled] += np.add.reduceat(values, heads, axis=0)
                grams[rows][filled] += np.add.reduceat(inside.astype(np.float32), heads)
        return (total / np.maximum(grams, 1)[:, None] + self.bias) * (grams / (grams + FAINT))[:, None]


def fit(counts: np.ndarray, y: np.ndarray, names: list[str]) -> Model:
    """``counts`` is overwritten. A fifth of the rows measures each bit's reliability, then joins the rest for the final weights."""
    model = Model(names)
    if len(names) < 2:
        return model
    counts /= np.maximum(counts.sum(1, keepdims=True), 1)
    scale = (1 / (np.sqrt(np.einsum("ij,ij->j", counts, counts) / max(1, len(y))) + 1e-4)).astype(np.float32)
    z = counts
    z *= scale  # common and rare n-grams learn at one pace
    held = np.arange(len(y)) % 5 == 4
    target = model.code[y]
    share = np.bincount(y, minlength=len(names)).astype(float)
    weight = (1 / np.maximum(share, 1))[y]
    if held.any():
        w, b = _descend(z, target, np.where(held, 0, weight), STEPS // 2)
        margin = z[held] @ w + b
        right = ((margin > 0) == (target[held] > 0)).mean(0)
        model.trust = np.log((right + 0.02) / (1 - right + 0.02)).clip(0.05, None)
        model.trust /= model.trust.mean()
    w, b = _descend(z, target, weight, STEPS)
    size = TYPICAL / max(1e-6, float(np.median(np.abs(z @ w + b))))  # separable rows would let margins grow with the steps
    model.weights, model.bias = w * scale[:, None] * np.float32(size), b * size
    return model


def _descend(z: np.ndarray, target: np.ndarray, weight: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Logistic regression of all bits at once: full-batch steps with momentum, scaled by the gradient's size."""
    weight = (weight / weight.sum())[:, None]
    w, b, m1, m2 = np.zeros((z.shape[1], target.shape[1]), np.float32), np.zeros(target.shape[1]), 0.0, 0.0
    for step in range(1, steps + 1):
        slope = -target * weight / (1 + np.exp(np.clip(target * (z @ w + b), -50, 50)))
        grad = z.T @ slope.astype(np.float32) + 1e-5 * w
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.99 * m2 + 0.01 * grad**2
        w -= (0.02 * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        b -= 0.5 * slope.sum(0)
    return w, b


def train(docs: DataFrame, *, where: Column | None = None, max_train: int = MAX_TRAIN, doc_key: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """Fit on documents with a known language, of those that ``where`` admits."""
    known = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    known = (known if where is None else known.where(where)).select(F.col(doc_key).alias("k"), F.col(text).alias("t"), F.col(lang).alias("lang"))
    known = known.withColumn("lot", F.xxhash64("k", "t", F.lit(3)))  # equal rows have one lot
    sizes = {r.lang: r["count"] for r in known.select("lang", "lot").distinct().groupBy("lang").count().collect()}
    if not sizes:
        return Model([])
    quota = max(1, max_train // len(sizes))
    # twice a language's quota by the size of a hash, then exactly the smallest of these
    spark = docs.sparkSession
    rates = spark.createDataFrame([(name, int(min(1.0, 2 * quota / n) * (1 << 30))) for name, n in sizes.items()], "lang string, rate long")
    picked = known.join(F.broadcast(rates), "lang").where(F.pmod(F.shiftrightunsigned("lot", 20), F.lit(1 << 30)) < F.col("rate")).select("lang", "lot", "t")

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in kernel.slices(batch.column(2)):
                counts = gram_counts(part)
                where = [np.flatnonzero(row) for row in counts]
                own = [c.slice(part.first, len(part)) for c in batch.columns[:2]]
                yield pa.RecordBatch.from_arrays([*own, pa.array([w.tolist() for w in where], pa.list_(pa.int32())), pa.array([row[w].tolist() for row, w in zip(counts, where, strict=True)], pa.list_(pa.float32()))], names=["lang", "lot", "at", "n"])

    once = picked.mapInArrow(grams, "lang string, lot long, at array<int>, n array<float>").groupBy("lang", "lot").agg(F.first("at").alias("at"), F.first("n").alias("n"))
    place = F.row_number().over(W.partitionBy("lang").orderBy(F.pmod(F.shiftrightunsigned("lot", 20), F.lit(1 << 30)), "lot"))
    found = once.withColumn("place", place).where(F.col("place") <= quota).toArrow().sort_by([("lot", "ascending"), ("lang", "ascending")])
    names = sorted(sizes)
    where = {name: i for i, name in enumerate(names)}
    y = np.array([where[x] for x in found.column("lang").to_pylist()], int)
    counts = np.zeros((len(y), BUCKETS), np.float32)
    for i, (at, n) in enumerate(zip(found.column("at"), found.column("n"), strict=True)):
        counts[i, at.values.to_numpy()] = n.values.to_numpy()
    return fit(counts, y, names)


def has_letter(part: kernel.Texts) -> np.ndarray:
    ascii_letters = np.zeros(len(part.data) + 1, np.int64)
    np.cumsum(_LETTER[part.data], out=ascii_letters[1:])
    out = ascii_letters[part.bounds[1:]] > ascii_letters[part.bounds[:-1]]
    for i in np.flatnonzero(~out & (np.diff(part.bounds) > 0)):
        out[i] = any(c.isalpha() for c in bytes(part.data[part.bounds[i] : part.bounds[i + 1]]).decode("utf-8", "replace"))
    return out


def identify(docs: DataFrame, model: Model, *, doc_key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, lang_pred, score (0 to 1), ambiguous."""
    packed = sent(docs.sparkSession, model)
    schema = T.StructType([T.StructField(doc_key, docs.schema[doc_key].dataType), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("ambiguous", T.BooleanType())])

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = received(packed)
        names = np.array([*model.names, UNDETERMINED], object)
        for batch in batches:
            best, score = [], []
            for part in kernel.slices(batch.column(1)):
                letters = has_letter(part) & ~part.null
                if model.names:
                    i, p = model.decode(model.margins(part)) if len(model.names) > 1 else (np.zeros(len(part), int), np.ones(len(part)))
                else:
                    i, p = np.zeros(len(part), int), np.zeros(len(part))
                best.append(np.where(letters, i, len(model.names)))
                score.append(np.where(letters, p, 0.0))
            if best:
                p = np.concatenate(score)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names[np.concatenate(best)], pa.string()), pa.array(p), pa.array(p < AMBIGUOUS)], names=schema.names)

    return docs.select(F.col(doc_key).alias("k"), F.col(text).alias("t")).mapInArrow(predict, schema)
