"""Quality rules: exact text statistics, base rules over them, and gradient-boosted trees for the verdict.

All statistics cover whole texts. The trees are trained on the driver from a bounded sample of labelled
documents (``max_train`` rows, chosen by a hash of the key; only statistics are collected) and flattened
into node arrays, which score each Arrow batch at once. The shares of symbols, repeated lines, repeated
word windows and capitals may only lower the score.

Special cases: a null, empty or blank text has no words, fails the base rules and is not kept. Without
labels of both kinds the trees are a constant that keeps what passes the base rules. Repeated rows give a
row each; columns other than key and text are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillgrain.llm import kernel, trees
from tillgrain.llm.decontaminate import _arrow
from tillgrain.llm.sampling import labelled_sample

MAX_TRAIN = 20_000
SYMBOLS = b"#*$%&|<>"
WINDOW = 5
LEAST_WORDS = 10
REPEAT_PERCENT = 20
THRESHOLD = 0.5
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
FEATURES = ["log_words", "word_length", "symbol_share", "dup_line_share", "repeat_share", "capital_share", "digit_share", "mark_share", "line_words", "bar_share", "distinct_share"]
MONOTONE = np.array([0, 0, -1, -1, -1, -1, 0, 0, 0, -1, 0])


def _classes(members: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(members)] = True
    return out


_SYMBOL, _CAPITAL, _DIGIT = _classes(SYMBOLS), _classes(bytes(range(65, 91))), _classes(b"0123456789")
_MARK, _BAR = _classes(b"!?.,;:"), _classes(b"|")
_HEAD = np.array([b < 0x80 or b >= 0xC0 for b in range(256)])


def statistics(part: kernel.Texts) -> tuple[np.ndarray, np.ndarray]:
    """COUNTS (integers) and FEATURES of each text of a slice."""
    words = kernel.Words(part, lower=False)
    n, data, bounds = words.counts(), part.data, part.bounds
    inside = ~kernel._SPACE[data] & _HEAD[data]

    def per_text(flags: np.ndarray) -> np.ndarray:
        return _between(flags, bounds)

    word_chars, symbols = per_text(inside), per_text(_SYMBOL[data])
    dup_lines, lines = _dup_lines(part, words)
    repeated, distinct = _repeats(words)
    counts = np.stack([n, word_chars, symbols, dup_lines, repeated], 1).astype(np.int64)
    some, chars = np.maximum(n, 1), np.maximum(word_chars, 1)
    features = np.stack(
        [np.log1p(n), word_chars / some, symbols / chars, dup_lines / np.maximum(lines, 1), repeated / some, per_text(_CAPITAL[data]) / chars, per_text(_DIGIT[data]) / chars, per_text(_MARK[data]) / chars, np.log1p(n / np.maximum(lines, 1)), per_text(_BAR[data]) / chars, distinct / some], 1
    )
    return counts, features


def _between(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def _dup_lines(part: kernel.Texts, words: kernel.Words) -> tuple[np.ndarray, np.ndarray]:
    """Lines with a word that equal an earlier line of the text; lines with a word."""
    data, bounds = part.data, part.bounds
    breaks = np.flatnonzero(data == 10)
    owner = np.searchsorted(bounds, breaks, "right") - 1
    starts = np.concatenate([bounds[:-1], breaks + 1])
    texts = np.concatenate([np.arange(len(part)), owner])
    order = np.lexsort((starts, texts))
    starts, texts = starts[order], texts[order]
    ends = np.append(starts[1:] - 1, 0)
    last = np.append(texts[1:] != texts[:-1], True)[: len(texts)]
    ends[last] = bounds[texts[last] + 1]
    filled = np.searchsorted(words.starts, ends) > np.searchsorted(words.starts, starts)
    starts, ends, texts = starts[filled], ends[filled], texts[filled]
    powers, inverse = kernel._powers(len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(kernel._byte_values(3)[data] * powers[:-1], out=total[1:])
    hashes = kernel.mix((total[ends] - total[starts]) * inverse[starts])
    order = np.lexsort((hashes, texts))
    again = np.zeros(len(order), bool)
    again[1:] = (hashes[order][1:] == hashes[order][:-1]) & (texts[order][1:] == texts[order][:-1])
    return np.bincount(texts[order][again], minlength=len(part)), np.bincount(texts, minlength=len(part))


def _repeats(words: kernel.Words) -> tuple[np.ndarray, np.ndarray]:
    """Words in a window of WINDOW words that the text has twice or more; distinct words."""
    h, bounds = kernel.shingles(words, WINDOW)
    n, first = words.counts(), words.first
    out, kinds = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
    for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
        own = np.sort(words.hashes[first[i] : first[i + 1]])
        kinds[i] = len(own) and 1 + int((own[1:] != own[:-1]).sum())
        if b - a < 2:
            continue
        ordered = np.sort(h[a:b])
        twice = ordered[1:][ordered[1:] == ordered[:-1]]
        if len(twice):
            at = np.flatnonzero(np.isin(h[a:b], twice))
            cover = np.zeros(int(n[i]) + 1, np.int64)
            np.add.at(cover, at, 1)
            np.add.at(cover, np.minimum(at + WINDOW, n[i]), -1)
            out[i] = int((np.cumsum(cover[:-1]) > 0).sum())
    return out, kinds


def base_failed(counts: np.ndarray) -> np.ndarray:
    return (counts[:, 0] < LEAST_WORDS) | (100 * counts[:, 4] > REPEAT_PERCENT * counts[:, 0])


def train(docs: DataFrame, labels: DataFrame, *, max_train: int = MAX_TRAIN, doc_key: str = "doc_id", text: str = "text", label: str = "quality") -> trees.Forest:
    def features(column: pa.Array) -> list[pa.Array]:
        return [pa.array(np.concatenate([statistics(p)[1] for p in kernel.slices(column)]).tolist(), pa.list_(pa.float64()))]

    sample = labelled_sample(docs, labels, label, features, "x array<double>", max_rows=max_train, doc_key=doc_key, text=text)
    found = sorted((list(r.x), r.label) for r in sample.select("x", "label").collect())
    x, y = np.array([r[0] for r in found]).reshape(-1, len(FEATURES)), np.array([r[1] for r in found], float)
    return trees.fit(x, y, MONOTONE)


def judge(docs: DataFrame, forest: trees.Forest, *, doc_key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Per row: key, COUNTS, base_failed, score (probability of good quality), kept."""
    key = T.StructField(doc_key, docs.schema[doc_key].dataType)
    schema = T.StructType([key, *(T.StructField(c, T.LongType()) for c in COUNTS), T.StructField("base_failed", T.BooleanType()), T.StructField("score", T.DoubleType()), T.StructField("kept", T.BooleanType())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [statistics(p) for p in kernel.slices(batch.column(1))]
            if not parts:
                continue
            counts, x = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            failed, p = base_failed(counts), forest.probability(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(counts[:, j]) for j in range(len(COUNTS))), pa.array(failed), pa.array(p), pa.array(~failed & (p >= threshold))], names=schema.names)

    return docs.select(F.col(doc_key).alias("k"), F.col(text).alias("t")).mapInArrow(score, schema)
