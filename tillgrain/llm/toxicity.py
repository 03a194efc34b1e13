"""Toxicity: a convolutional text classifier trained in numpy.

Words (runs of letters, digits and non-ASCII bytes, ASCII capitals lowered) are hashed into 2^22 buckets;
a bucket that at least ``LEAST_DOCS`` training texts use (more in a large sample) has an embedding, all others share a
fixed zero vector. Filters of widths 1, 2 and 3 run over the whole text, the largest response of each
filter is kept (max pooling), and a logistic layer turns these into a score.

Training takes every labelled row, on the executors. Only bucket numbers leave a task: whole texts of some ``PART_ROWS`` rows, dealt by
their hash, are packed into one record. The words' counts are sums over all records. In an epoch each record goes through its
own steps from the same parameters, and the next epoch starts from the mean of all; with one record this is plain training. Sums are of
whole numbers, so reruns agree in any order. Equal texts count once. A fifth of a record's texts of each label stays out of
training: on all of these the score is shifted so that 0.3 is the best global cut, and a cut for each language with enough rows is
calibrated (logits in steps of 1 / ``FINE``). The language only picks that cut; it never enters a score.

Special cases: a null or empty text gets the score of a text without any known word. Without labels of both
kinds every score is the share of positives. Repeated rows give a row each; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillgrain.llm import kernel
from tillgrain.llm.sampling import chosen_labels
from tillgrain.llm.session import received, released, row_id, sent, stored

#: Texts of one packed record; fewer where they are long.
PART_ROWS, PART_BYTES = 12_000, 1 << 24
#: Labelled texts whose keys are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 1 << 19
#: Parameters are added as whole numbers of 1 / UNIT, in records of CHUNK.
UNIT, CHUNK = float(1 << 36), 1 << 17
FINE = 1024
BUCKETS = 1 << 22
LEAST_DOCS = 3
WIDTHS = (1, 2, 3)
FILTERS = 6
DIM = 8
EPOCHS = 8
CUT = 0.3
LEAST_POSITIVES = 25

_FOLD = np.array([i + 32 if 65 <= i <= 90 else i if 97 <= i <= 122 or 48 <= i <= 57 or i >= 0x80 else 0x20 for i in range(256)], np.uint8)


def _buckets(part: kernel.Texts) -> tuple[np.ndarray, np.ndarray]:
    words = kernel.Words(kernel.Texts(_FOLD[part.data], part.bounds, part.first, part.null), lower=False, seed=7)
    return (words.hashes & np.uint64(BUCKETS - 1)).astype(np.int64), words.first


class Net:
    def __init__(self, known: np.ndarray, seed: int = 17):
        rng = np.random.default_rng(seed)
        self.known = known  # bucket of row i + 1 of the embeddings; row 0 is the zero vector
        self.embed = np.concatenate([np.zeros((1, DIM)), 0.1 * rng.standard_normal((len(known), DIM))])
        self.filters = {w: 0.3 * rng.standard_normal((w, DIM, FILTERS)) for w in WIDTHS}
        self.offset = {w: np.zeros(FILTERS) for w in WIDTHS}
        self.out = 0.3 * rng.standard_normal(FILTERS * len(WIDTHS))
        self.bias = np.zeros(1)
        self.cuts: dict[str, float] = {}

    def parameters(self) -> list[np.ndarray]:
        return [self.embed, *self.filters.values(), *self.offset.values(), self.out, self.bias]

    def tables(self) -> list[list[np.ndarray]]:
        """For each width and place in the filter, every embedding's response: a convolution is then a sum of lookups."""
        return [[(self.embed @ self.filters[w][k]).astype(np.float32) for k in range(w)] for w in WIDTHS]

    def lookup(self) -> np.ndarray:
        rows = np.zeros(BUCKETS, np.int32)
        rows[self.known] = np.arange(1, len(self.known) + 1)
        return rows

    def logits(self, ids: np.ndarray, first: np.ndarray, tables: list[list[np.ndarray]]) -> np.ndarray:
        """ids: embedding rows of the words of a slice; first: where each text's words begin, and the end."""
        size, n, gap = np.diff(first), len(first) - 1, len(WIDTHS) - 1
        # zero rows after each text, so that no filter reaches into the next; an empty text is one zero row
        own = np.maximum(size, 1)
        ends = np.cumsum(own + gap)
        heads = ends - own - gap
        padded = np.zeros(int(ends[-1]) if n else 0, np.int32)
        padded[np.arange(len(ids)) + np.repeat(heads - first[:-1], size)] = ids
        places = np.stack([heads, heads + own], 1).ravel()
        total = np.full(n, float(self.bias[0]))
        for i, (w, table) in enumerate(zip(WIDTHS, tables, strict=True)):
            response = table[0][padded]
            for k in range(1, w):
                response[:-k] += table[k][padded[k:]]
            pooled = np.maximum.reduceat(response, places, axis=0)[::2]
            total += np.maximum(pooled + self.offset[w], 0) @ self.out[i * FILTERS : (i + 1) * FILTERS]
        return total


def _epoch(net: Net, moments: list[tuple[np.ndarray, np.ndarray]], texts: list[np.ndarray], y: np.ndarray, share: float, turn: int, seed: list[int]) -> None:
    """Adam over the texts once, in place. texts: embedding rows of each text's words."""
    weight = np.where(y > 0, 0.5 / share, 0.5 / (1 - share))
    batches = np.array_split(np.random.default_rng(seed).permutation(len(y)), max(1, len(y) // 64))
    for step, batch in enumerate(batches, 1 + turn * len(batches)):
        for p, grad, (m, v) in zip(net.parameters(), _gradients(net, [texts[i] for i in batch], y[batch], weight[batch]), moments, strict=True):
            m *= 0.9
            m += 0.1 * grad
            v *= 0.99
            v += 0.01 * grad**2
            p -= 0.01 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)


def _best_cut(logits: np.ndarray, n: np.ndarray, hits: np.ndarray) -> float:
    """The middle of the gap between distinct scores, of n rows and so many positives each, at which cutting gives the best F1."""
    order = np.argsort(-logits, kind="stable")
    ordered, upto = logits[order], np.cumsum(hits[order])
    best = int(np.argmax(2 * upto / (np.cumsum(n[order]) + hits.sum())))
    below = ordered[best + 1] if best + 1 < len(ordered) else ordered[best] - 1
    return float((ordered[best] + below) / 2)


def _gradients(net: Net, texts: list[np.ndarray], y: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
    """Of the weighted logistic loss, in the order of parameters(). Only a filter's best place in a text passes anything on."""
    gap = len(WIDTHS) - 1
    parts, heads, at = [], [], 0
    for t in texts:
        heads.append(at)
        parts += [t, np.zeros(gap + (len(t) == 0), np.int32)]
        at += len(t) + gap + (len(t) == 0)
    padded = np.concatenate([*parts, np.zeros(gap, np.int32)])
    ends = [*heads[1:], at]
    places, pooled = {}, {}
    for w, table in zip(WIDTHS, net.tables(), strict=True):
        response = table[0][padded]
        for k in range(1, w):
            response[:-k] += table[k][padded[k:]]
        places[w] = np.stack([a + response[a : max(a + 1, b - gap)].argmax(0) for a, b in zip(heads, ends, strict=True)])
        pooled[w] = np.take_along_axis(response, places[w], 0) + net.offset[w]
    active = np.concatenate([np.maximum(pooled[w], 0) for w in WIDTHS], 1)
    logit = active @ net.out + net.bias[0]
    slope = weight * (1 / (1 + np.exp(-logit)) - y) / len(y)
    embed = 2e-5 * net.embed
    filters, offset = [], []
    for i, w in enumerate(WIDTHS):
        back = slope[:, None] * net.out[i * FILTERS : (i + 1) * FILTERS] * (pooled[w] > 0)
        offset.append(back.sum(0))
        grad = 1e-4 * net.filters[w]
        for k in range(w):
            rows = padded[places[w] + k]
            grad[k] += np.einsum("df,dfe->ef", back, net.embed[rows])
            np.add.at(embed, rows.ravel(), (back[:, :, None] * net.filters[w][k].T[None]).reshape(-1, DIM))
        filters.append(grad)
    embed[0] = 0
    return [embed, *filters, *offset, active.T @ slope + 1e-4 * net.out, np.array([slope.sum()])]


def _chosen(docs: DataFrame, labels: DataFrame, where: Column | None, max_train: int | None, max_words: int | None, doc_key: str, text: str, label: str, lang: str | None) -> DataFrame:
    """(k, a, b, label, also, bytes): each labelled text once, by the hashes of the text, with its smallest label; a key that many rows have
    counts with the text of the smallest hashes. Texts don't travel. Stored."""
    if max_train is not None:
        known = chosen_labels(labels, label, max_train, doc_key=doc_key, where=where).select("k", "label")
    else:
        known = labels.select(F.col(doc_key).alias("k"), F.col(label).cast("int").alias("label")).where("k IS NOT NULL AND label IS NOT NULL")
        known = (known if where is None else known.where(where)).groupBy("k").agg(F.min("label").alias("label"))
    t, also = F.col(text), (F.col(lang) if lang else F.lit(None)).cast("string")
    words = F.regexp_count(t, F.lit(r"[^\x20\x09-\x0D]+")) if max_words is not None else F.lit(0)
    narrow = docs.where(t.isNotNull()).select(F.col(doc_key).alias("k"), row_id(t).alias("h"), also.alias("also"), F.octet_length(t).alias("bytes"), words.alias("words"))
    own = narrow.groupBy("k").agg(F.min(F.struct("h", "also", "bytes", "words")).alias("r")).join(known, "k")
    each = own.groupBy("r.h").agg(F.min(F.struct("label", "r.also", "k", "r.bytes", "r.words")).alias("r")).select("h.a", "h.b", "r.*")
    if max_words is not None:
        each = each.withColumn("upto", F.sum("words").over(W.orderBy("a", "b"))).where(F.col("upto") <= max_words).drop("upto")
    return stored(each.drop("words"))


def _packed(docs: DataFrame, chosen: DataFrame, parts: int, few: bool, doc_key: str, text: str, lang: str | None) -> DataFrame:
    """(ids, first, label, held, also): a record a part. ids: three bytes a word, the number of its bucket. Stored."""
    # which of a part's texts stay out: every fifth of each label, in the order of their hashes
    part = F.pmod("a", F.lit(parts)).cast("int")
    turn = F.row_number().over(W.partitionBy("part", "label").orderBy("a", "b"))
    keys = chosen.drop("bytes").withColumn("part", part).withColumn("held", turn % 5 == 0)
    rows = docs.where(F.col(text).isNotNull()).select(F.col(doc_key).alias("k"), row_id(text).alias("h"), F.col(text).alias("t")).select("k", "h.*", "t")
    rows = rows.join(F.broadcast(keys) if few else keys.hint("merge"), ["k", "a", "b"]).select("part", "a", "b", "label", "held", "also", "t")

    def numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()  # repeated rows of a task go here, those of several tasks in the record
        for batch in batches:
            new = []
            for h in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                new.append(h not in seen)
                seen.add(h)
            batch = batch.filter(pa.array(new, pa.bool_()))
            ids = []
            for piece in kernel.slices(batch.column(6)):
                buckets, first = _buckets(piece)
                three = np.ascontiguousarray(buckets.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3])
                ids += [three[a:b].tobytes() for a, b in zip(first[:-1], first[1:], strict=True)]
            if ids:
                yield pa.RecordBatch.from_arrays([*batch.columns[:6], pa.array(ids, pa.binary())], names=[*batch.schema.names[:6], "ids"])

    def pack(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("a", "ascending"), ("b", "ascending")])
        a, b = rows.column("a").to_numpy(), rows.column("b").to_numpy()
        once = np.ones(len(a), bool)
        once[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        rows = rows.filter(pa.array(once))
        ids = rows.column("ids").combine_chunks()
        ids = ids.combine_chunks() if isinstance(ids, pa.ChunkedArray) else ids
        bounds = np.frombuffer(ids.buffers()[1], np.int32)[ids.offset : ids.offset + len(ids) + 1].astype(np.int64)
        first = (bounds - bounds[0]) // 3
        cells = [memoryview(ids.buffers()[2])[bounds[0] : bounds[-1]].tobytes() if bounds[-1] > bounds[0] else b"", first.tobytes(), rows.column("label").to_numpy().astype(np.int32).tobytes(), rows.column("held").to_numpy(zero_copy_only=False).astype(bool).tobytes()]
        also = pa.array([rows.column("also").to_pylist()], pa.list_(pa.string()))
        return pa.table([rows.column("part").slice(0, 1), *(pa.array([c], pa.binary()) for c in cells), also], names=["part", "ids", "first", "label", "held", "also"])

    made = rows.mapInArrow(numbers, "part int, a long, b long, label int, held boolean, also string, ids binary")
    return stored(made.repartition(parts, "part").groupBy("part").applyInArrow(pack, "part int, ids binary, first binary, label binary, held binary, also array<string>"))


def _records(batches: Iterator[pa.RecordBatch], held: bool, lookup: np.ndarray | None = None) -> Iterator[tuple[int, list[np.ndarray], np.ndarray, list[str | None]]]:
    """Part, buckets (by ``lookup``, rows) of each text, labels and languages of a record's texts that stay out of training, or of the others."""
    for batch in batches:
        for i in range(batch.num_rows):
            ids, first, label, out = (np.frombuffer(c[i].as_buffer(), kind) for c, kind in zip(batch.columns[1:5], (np.uint8, np.int64, np.int32, bool), strict=True))
            four = np.zeros((len(ids) // 3, 4), np.uint8)
            four[:, :3] = ids.reshape(-1, 3)
            buckets, take = four.view("<i4").ravel(), np.flatnonzero(out == held)
            if lookup is not None:
                lookup.take(buckets, out=buckets, mode="clip")
            also = batch.column(5)[i].values
            yield batch.column(0)[i].as_py(), [buckets[first[j] : first[j + 1]] for j in take], label[take].astype(float), also.take(pa.array(take)).to_pylist() if held else []


def _known(packed: DataFrame, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The buckets that enough training texts use, and how many of each label do."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((2, BUCKETS), np.int32)
        for _, texts, y, _ in _records(batches, False):
            for t, label in zip(texts, y, strict=True):
                seen[int(label > 0), np.unique(t)] += 1
        used = np.flatnonzero(seen.any(0))
        for at in range(0, len(used), CHUNK // 2):
            own = used[at : at + CHUNK // 2]
            yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), *(pa.array(s[own].astype(np.int64)) for s in seen)], names=["bucket", "clean", "toxic"])

    sums = packed.mapInArrow(run, "bucket int, clean long, toxic long").groupBy("bucket").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    found = sums.where(F.col("clean") + F.col("toxic") >= least).orderBy("bucket").toArrow()
    return found.column("bucket").to_numpy().astype(np.int64), np.stack([found.column(c).to_numpy() for c in ("clean", "toxic")])


def _trained(packed: DataFrame, net: Net, share: float, seed: int) -> None:
    """All epochs. Each record's steps start from the same parameters; their mean goes on."""
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in net.parameters()]
    for turn in range(EPOCHS):
        packet = sent(packed.sparkSession, (net, moments))

        def run(batches: Iterator[pa.RecordBatch], packet=packet, turn=turn) -> Iterator[pa.RecordBatch]:
            total, count = None, 0
            for part, texts, y, _ in _records(batches, False, received(packet)[0].lookup()):
                if len(y):
                    net, moments = received(packet)
                    _epoch(net, moments, texts, y, share, turn, [seed, turn, part])
                    own = np.rint(_flat(net, moments) * UNIT).astype(np.int64)
                    total, count = own if total is None else total + own, count + 1
            for at in range(0, 0 if total is None else len(total), CHUNK):
                yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([count], pa.int64()), pa.array([total[at : at + CHUNK].tobytes()], pa.binary())], names=["at", "n", "v"])

        def add(rows: pa.Table) -> pa.Table:
            total = sum(np.frombuffer(v.as_py(), np.int64) for v in rows.column("v"))
            return pa.table([rows.column("at").slice(0, 1), pa.array([sum(rows.column("n").to_pylist())], pa.int64()), pa.array([total.tobytes()], pa.binary())], names=["at", "n", "v"])

        schema = "at long, n long, v binary"
        got = packed.mapInArrow(run, schema).groupBy("at").applyInArrow(add, schema).toArrow().sort_by("at")
        packet.destroy()
        mean = np.concatenate([np.frombuffer(v.as_py(), np.int64) / n for v, n in zip(got.column("v"), got.column("n").to_pylist(), strict=True)]) / UNIT
        at = 0
        for p, (m, v) in zip(net.parameters(), moments, strict=True):
            for x in (p, m, v):
                x[...] = mean[at : at + x.size].reshape(x.shape)
                at += x.size
            v **= 2


def _flat(net: Net, moments: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Parameters and moments in one row; of the second ones, which are small, the roots."""
    return np.concatenate([x.ravel() for p, (m, v) in zip(net.parameters(), moments, strict=True) for x in (p, m, np.sqrt(v))])


def _calibrated(packed: DataFrame, net: Net) -> None:
    packet = sent(packed.sparkSession, net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = received(packet)
        tables = net.tables()
        for _, texts, y, langs in _records(batches, True, net.lookup()):
            logits = [net.logits(t, np.array([0, len(t)]), tables)[0] for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(np.rint(np.array(logits, float) * FINE).astype(np.int64)), pa.array((y > 0).astype(np.int64))], names=["lang", "at", "y"])

    sums = packed.mapInArrow(run, "lang string, at long, y long").groupBy("lang", "at").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("hits"))
    rows = sums.orderBy("lang", "at").toArrow()
    langs, (at, n, hits) = rows.column("lang").to_pylist(), (rows.column(c).to_numpy() for c in ("at", "n", "hits"))

    def cut(take: np.ndarray) -> float:
        places, of = np.unique(at[take], return_inverse=True)
        return _best_cut(places / FINE, np.bincount(of, n[take]), np.bincount(of, hits[take]))

    if not hits.sum():
        return
    shift = np.log(CUT / (1 - CUT)) - cut(np.ones(len(at), bool))
    net.bias[0] += shift
    names = np.array([x or "" for x in langs], object)
    for name in sorted(set(names) - {""}):
        mine = names == name
        if hits[mine].sum() >= LEAST_POSITIVES:
            net.cuts[name] = float(np.clip(1 / (1 + np.exp(-cut(mine) - shift)), 0.15, 0.7))


def train(docs: DataFrame, labels: DataFrame, *, where: Column | None = None, max_train: int | None = None, max_words: int | None = None, doc_key: str = "doc_id", text: str = "text", label: str = "toxic", lang: str | None = "lang", seed: int = 17) -> Net:
    """Fit on all labelled documents; ``where`` limits the labels by their key, which it knows as column k. ``max_train`` rows and
    ``max_words`` words, if given, bound what is read."""
    chosen = _chosen(docs, labels, where, max_train, max_words, doc_key, text, label, lang)
    n, positives, size = chosen.agg(F.count(F.lit(1)), F.sum(F.when(F.col("label") > 0, 1).otherwise(0)), F.sum("bytes")).first()
    share = float(np.clip(positives / n, 1e-3, 1 - 1e-3)) if n else 0.5
    if n < 20 or positives in (0, n):
        net = Net(np.zeros(0, np.int64), seed)
        net.out[:] = 0
        net.bias[0] = np.log(share / (1 - share))
        return net
    packed = _packed(docs, chosen, max(-(-n // PART_ROWS), -(-size // PART_BYTES)), n <= BROADCAST_ROWS, doc_key, text, lang)
    known, seen = _known(packed, max(LEAST_DOCS, n // 2_000))
    net = Net(known, seed)
    # the first axis of the embeddings starts at each word's smoothed log-odds of standing in a toxic text
    net.embed[1:, 0] = 0.5 * (np.log((seen[1] + 8 * share) / (seen[0] + 8 * (1 - share))) - np.log(share / (1 - share)))
    net.filters[1][0, :, 0] = np.eye(DIM)[0]
    net.out[0], net.bias[0] = 1.0, -1.0
    _trained(packed, net, share, seed)
    _calibrated(packed, net)
    released(packed, chosen)
    return net


def score(docs: DataFrame, net: Net, *, doc_key: str = "doc_id", text: str = "text", lang: str | None = "lang") -> DataFrame:
    """Per row: key, score, flagged (the score reaches the cut of the row's language, CUT where it has none)."""
    packed = sent(docs.sparkSession, net)
    schema = T.StructType([T.StructField(doc_key, docs.schema[doc_key].dataType), T.StructField("score", T.DoubleType()), T.StructField("flagged", T.BooleanType())])

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = received(packed)
        lookup, tables = net.lookup(), net.tables()
        for batch in batches:
            scores = [1 / (1 + np.exp(-np.clip(_part_logits(net, part, lookup, tables), -50, 50))) for part in kernel.slices(batch.column(1))]
            if scores:
                p = np.concatenate(scores)
                cuts = np.array([net.cuts.get(x, CUT) for x in batch.column(2).to_pylist()])
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), pa.array(p >= cuts)], names=schema.names)

    language = F.col(lang) if lang else F.lit(None).cast("string")
    return docs.select(F.col(doc_key).alias("k"), F.col(text).alias("t"), language.alias("l")).mapInArrow(predict, schema)


def _part_logits(net: Net, part: kernel.Texts, lookup: np.ndarray, tables: list[list[np.ndarray]]) -> np.ndarray:
    buckets, first = _buckets(part)
    return net.logits(lookup[buckets], first, tables)


def drop_toxic(docs: DataFrame, net: Net, *, text: str = "text", lang: str = "lang") -> DataFrame:
    """The documents that are not flagged, all columns as they came, in one pass over them. A null text has the score of an
    empty one, a null language the global cut; without a column ``lang`` that cut holds for all."""
    packed = sent(docs.sparkSession, net)
    t, l = docs.columns.index(text), docs.columns.index(lang) if lang in docs.columns else None

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = received(packed)
        lookup, tables = net.lookup(), net.tables()
        for batch in batches:
            logits = [_part_logits(net, part, lookup, tables) for part in kernel.slices(batch.column(t))]
            if logits:
                cuts = np.array([net.cuts.get(x, CUT) for x in batch.column(l).to_pylist()]) if l is not None else CUT
                fine = 1 / (1 + np.exp(-np.clip(np.concatenate(logits), -50, 50))) < cuts
                yield batch.filter(pa.array(fine))

    return docs.mapInArrow(keep, docs.schema)
