"""Benchmark decontamination: which documents hold which test items.

Size-partitioned MinHash containment search. Test items are put in classes by their number of distinct
word shingles (class c: 2^c up to 2^(c+1)). A class gets one sketch length, just long enough that a
document holding the wanted share of any item of the class must hold one of the item's smallest hashes:
an item of q shingles of which ceil(t q) must be found can lose q - ceil(t q) of them, so its
q - ceil(t q) + 1 smallest hashes can't all be lost. Short items therefore have short sketches, and the
search misses nothing however long the document around the item is. Documents are probed against all
sketches in one pass over their whole texts (a document with fewer shingles than a class needs skips
that class); those that meet a sketch are checked by full shingle containment, first on hashes and then
on the words themselves.

Test items are the stated query set. They go to the executors in blocks of at most ``max_block_shingles``
shingles; more items mean more passes over the documents, never a larger broadcast.

Special cases: a null or empty text, or one of spaces only, holds nothing and is no item that could be
found. An item of fewer than ``n`` words is one shingle, its whole sequence, and is looked for at that
length. Repeated document rows give a row each; repeated items (equal item_id) give a row each. Columns
other than the key and text columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillgrain.llm import kernel
from tillgrain.llm.session import received, sent

SHINGLE_WORDS = 5
CONTAINMENT = 0.8
MAX_BLOCK_SHINGLES = 1 << 21


def _needed(q: int, containment: float) -> int:
    return max(1, int(np.ceil(containment * q - 1e-9)))


class ItemIndex:
    """Sketches and full sets of a block of items."""

    def __init__(self, items: list[tuple], n: int, containment: float):
        self.n, self.containment = n, containment
        self.keys, self.words, sets = [], [], []
        for key, text in items:
            words = kernel.word_list(text, lower=True)
            if words:
                self.keys.append(key)
                self.words.append(words)
        self.lengths = [min(n, len(w)) for w in self.words]  # items shorter than a shingle are probed at their own length
        column = pa.array([" ".join(w) for w in self.words], pa.string())
        for part in kernel.slices(column):
            h, bounds = kernel.distinct(*kernel.shingles(kernel.Words(part, True), n))
            sets += [h[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        self.sets = sets
        self.needs = [_needed(len(s), containment) for s in sets]
        entries: dict[int, list[tuple[np.uint64, int]]] = {}
        for i, s in enumerate(sets):
            size_class = int(len(s)).bit_length() - 1
            most = (1 << size_class + 1) - 1
            k = max(len(s) - self.needs[i] + 1, min(len(s), most - _needed(most, containment) + 1))
            for h in np.sort(s)[:k]:
                entries.setdefault(self.lengths[i], []).append((h, i))
        #: By shingle length: sorted sketch hashes, the item of each, a bitmap of their low bits
        self.probes = {}
        for length, found in entries.items():
            hashes = np.array([h for h, _ in found], np.uint64)
            order = np.argsort(hashes, kind="stable")
            bitmap = np.zeros(1 << 20, bool)
            bitmap[hashes & np.uint64((1 << 20) - 1)] = True
            self.probes[length] = (hashes[order], np.array([i for _, i in found])[order], bitmap)
        self.smallest = {n: min((self.needs[i] for i in range(len(sets)) if self.lengths[i] == n), default=1) for n in self.probes}

    def matches(self, column: pa.Array) -> Iterator[tuple[int, int, int]]:
        """(row, item, shared shingles) of every text that holds enough of an item."""
        for part in kernel.slices(column):
            words = kernel.Words(part, True)
            for length, (hashes, items, bitmap) in self.probes.items():
                found, bounds = kernel.shingles(words, length)
                hit = np.flatnonzero(bitmap[found & np.uint64((1 << 20) - 1)])
                at = np.searchsorted(hashes, found[hit])
                hit = hit[hashes[np.minimum(at, len(hashes) - 1)] == found[hit]]
                if not len(hit):
                    continue
                rows = np.searchsorted(bounds, hit, "right") - 1
                for row in np.unique(rows).tolist():
                    whole = np.unique(found[bounds[row] : bounds[row + 1]])
                    if len(whole) < self.smallest[length]:
                        continue
                    mine = found[hit[rows == row]]
                    lo, hi = np.searchsorted(hashes, mine), np.searchsorted(hashes, mine, "right")
                    candidates = sorted({int(i) for a, b in zip(lo, hi, strict=True) for i in items[a:b]})
                    spoken = None
                    for i in candidates:
                        if np.isin(self.sets[i], whole, assume_unique=True).sum() < self.needs[i]:
                            continue
                        if spoken is None:
                            text = bytes(part.data[part.bounds[row] : part.bounds[row + 1]]).decode("utf-8", "surrogatepass")
                            spoken = _sequences(kernel.word_list(text, lower=True), length)
                        shared = len(_sequences(self.words[i], length) & spoken)
                        if shared >= self.needs[i]:
                            yield part.first + row, i, shared


def _sequences(words: list[str], n: int) -> set[tuple[str, ...]]:
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))}


def _blocks(docs: DataFrame, items: DataFrame, item_key: str, text: str, n: int, containment: float, max_block_shingles: int) -> Iterator:
    """Broadcast indexes of the items, each of a bounded size."""
    items = items.select(F.col(item_key).alias("item"), F.col(text).alias("words"))
    # an item has no more shingles than half its bytes, and one: a proven bound for what a block holds
    total = items.agg(F.coalesce(F.sum(F.octet_length("words") / 2 + 1), F.lit(0)).alias("n")).first()["n"]
    count = max(1, int(-(-total // max_block_shingles)))
    for block in range(count):
        chosen = items if count == 1 else items.where(F.pmod(F.xxhash64("item", "words"), F.lit(count)) == block)
        index = ItemIndex([tuple(r) for r in chosen.collect()], n, containment)
        if index.keys:
            yield sent(docs.sparkSession, index)


def contaminated(
    docs: DataFrame, items: DataFrame, *, doc_key: str = "doc_id", item_key: str = "item_id", text: str = "text", n: int = SHINGLE_WORDS, containment: float = CONTAINMENT, max_block_shingles: int = MAX_BLOCK_SHINGLES
) -> DataFrame:
    """Pairs of a document and a test item it holds: doc key, item key, item_shingles, shared_shingles, containment."""
    blocks = list(_blocks(docs, items, item_key, text, n, containment, max_block_shingles))
    fields = [T.StructField(doc_key, docs.schema[doc_key].dataType), T.StructField(item_key, items.schema[item_key].dataType)]
    schema = T.StructType([*fields, T.StructField("item_shingles", T.LongType()), T.StructField("shared_shingles", T.LongType()), T.StructField("containment", T.DoubleType())])
    arrow = pa.schema([("d", _arrow(fields[0].dataType)), ("i", _arrow(fields[1].dataType)), ("n", pa.int64()), ("s", pa.int64()), ("c", pa.float64())])
    arrow = pa.schema([pa.field(f.name, a.type) for f, a in zip(schema.fields, arrow, strict=True)])
    narrow = docs.select(F.col(doc_key).alias("d"), F.col(text).alias("t"))
    out = None
    for block in blocks:

        def probe(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            index = received(block)
            for batch in batches:
                found = list(index.matches(batch.column(1)))
                if found:
                    rows = [r for r, _, _ in found]
                    sizes = [len(index.sets[i]) for _, i, _ in found]
                    shared = [s for _, _, s in found]
                    columns = [batch.column(0).take(pa.array(rows)), pa.array([index.keys[i] for _, i, _ in found], arrow.field(1).type), pa.array(sizes, pa.int64()), pa.array(shared, pa.int64()), pa.array([s / q for s, q in zip(shared, sizes, strict=True)], pa.float64())]
                    yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

        part = narrow.mapInArrow(probe, schema)
        out = part if out is None else out.unionAll(part)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)


def _arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def decontaminate(
    docs: DataFrame, items: DataFrame, *, item_key: str = "item_id", text: str = "text", n: int = SHINGLE_WORDS, containment: float = CONTAINMENT, max_block_shingles: int = MAX_BLOCK_SHINGLES
) -> DataFrame:
    """The documents that hold no test item, all columns as they came; nothing is shuffled."""
    at = docs.columns.index(text)
    for block in _blocks(docs, items, item_key, text, n, containment, max_block_shingles):
        docs = docs.mapInArrow(_without(block, at), docs.schema)
    return docs


def _without(block, at: int):
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = received(block)
        for batch in batches:
            fine = np.ones(batch.num_rows, bool)
            fine[[row for row, _, _ in index.matches(batch.column(at))]] = False
            yield batch.filter(pa.array(fine))

    return keep
