"""How well item similarity and popularity find a product hidden from a basket, without a row for each basket and candidate.

Orders are gathered once, a row each. Known items have numbers, the most ordered first, and fall into ranges by their number. A task
gets the orders with an item of its range and all test baskets, both as packed bytes; it counts the pairs of its range, adds up each
basket's candidates of the range in memory and tells only how many outrank the hidden item. That item's own score, which all ranges
need, comes from a pass before.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from datetime import date

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillgrain.functions.ordering import numbered
from tillgrain.session import batches_of, released, stored

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Pairs of a range, lines that a task packs at once, baskets of a block, candidates that are added up at once.
PAIRS, LINES, BLOCK, AT_ONCE = 1 << 23, 1 << 18, 1 << 14, 1 << 21


def gathered(mart_basket: DataFrame, test_from: date, most: int, by: tuple[str, ...] = ("invoice",)) -> DataFrame:
    """invoice, train, test: the different codes before a day and from it on, of the baskets that ``recommender.baskets`` keeps."""
    x = F.collect_set(F.struct("invoice_date", "customer_id", "stock_code")).alias("x")
    sized = mart_basket.where("invoice IS NOT NULL").groupBy(*by).agg(x).where(F.size("x").between(2, most))

    def codes(when) -> F.Column:
        return F.array_distinct(F.transform(F.filter("x", lambda r: when(r["invoice_date"])), lambda r: r["stock_code"]))

    day = F.lit(test_from)
    return sized.select("invoice", codes(lambda d: d < day).alias("train"), codes(lambda d: d >= day).alias("test"))


def item_places(orders: DataFrame, min_orders: int) -> DataFrame:
    """stock_code, item_orders, place (from 0, the most ordered first), better (how many items have more orders)."""
    counts = orders.select(F.explode("train").alias("stock_code")).groupBy("stock_code").agg(F.count(F.lit(1)).alias("item_orders")).where(F.col("item_orders") >= min_orders)
    placed = numbered(counts, [F.desc("item_orders"), "stock_code"], "place").withColumn("place", F.col("place") - 1)
    return placed.join(placed.groupBy("item_orders").agg(F.min("place").alias("better")), "item_orders")


def _places(lists: pa.Array, codes: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the known codes of lists: list, place, and where they are among all."""
    of = np.repeat(np.arange(len(lists)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy())
    place = pc.fill_null(pc.index_in(lists.flatten(), value_set=codes, skip_nulls=True), -1).to_numpy()
    known = np.flatnonzero(place >= 0)
    return of[known], place[known], known


def _each(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each, one after another."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)


def _train_cells(orders: DataFrame, items, ranges: int) -> DataFrame:
    """(g, sizes, items): the orders with an item of range g."""

    def packed(sizes: np.ndarray, place: np.ndarray) -> Iterator[pa.RecordBatch]:
        starts = np.cumsum(sizes) - sizes
        of = np.repeat(np.arange(len(sizes)), sizes)
        cell = np.unique((place % ranges).astype(np.int64) * len(sizes) + of)
        g, of = cell // len(sizes), cell % len(sizes)
        for k in np.unique(g):
            own = of[g == k]
            yield pa.RecordBatch.from_arrays([pa.array([int(k)], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in (sizes[own].astype(np.int32), place[_each(starts[own], sizes[own])].astype(np.int32)))], names=["g", "sizes", "items"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, held, n = items.value[0], [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                of, place, _ = _places(batch.column(0).slice(at, BLOCK), codes)
                sizes = np.bincount(of, minlength=1)
                place, sizes = place[sizes[of] >= 2], sizes[sizes >= 2]
                held.append((sizes, place))
                n += len(place)
                if n >= LINES:
                    yield from packed(*map(np.concatenate, zip(*held, strict=True)))
                    held, n = [], 0
        if n:
            yield from packed(*map(np.concatenate, zip(*held, strict=True)))

    return orders.select("train").mapInArrow(run, "g int, sizes binary, items binary")


def _blocks(orders: DataFrame, items) -> DataFrame:
    """(invoice, popular, sizes, items): test baskets with two known items or more, a row a block. The hidden item, the first by MD5 of
    invoice and code, stands first; ``popular``: how many items that aren't shown have more orders than it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, count, better = items.value
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                of, place, known = _places(part.column(1), codes)
                digest = part.column(2).flatten().take(pa.array(known))
                order = pc.sort_indices(pa.table({"of": of, "digest": digest, "code": part.column(1).flatten().take(pa.array(known))}), sort_keys=[("of", "ascending"), ("digest", "ascending"), ("code", "ascending")]).to_numpy()
                of, place = of[order], place[order]
                n = np.bincount(of, minlength=part.num_rows)
                place, kept = place[n[of] >= 2], np.flatnonzero(n >= 2)
                if not len(kept):
                    continue
                sizes = n[kept]
                hidden = place[np.cumsum(sizes) - sizes]
                above = np.add.reduceat((count[place] > np.repeat(count[hidden], sizes)).astype(np.int64), np.cumsum(sizes) - sizes)
                lists = [pa.ListArray.from_arrays(pa.array([0, len(kept)], pa.int32()), x) for x in (part.column(0).take(pa.array(kept)), pa.array(better[hidden] - above))]
                yield pa.RecordBatch.from_arrays([*lists, *(pa.array([x.astype(np.int32).tobytes()], pa.binary()) for x in (sizes, place))], names=["invoice", "popular", "sizes", "items"])

    digest = F.transform("test", lambda c: F.md5(F.concat_ws("|", "invoice", c)))
    return orders.where(F.size("test") >= 2).select("invoice", "test", digest.alias("digest")).mapInArrow(run, "invoice array<string>, popular array<long>, sizes binary, items binary")


class Near:
    """The pairs of a range: for each item, the items of the range that orders hold beside it, and their similarity."""

    def __init__(self, g: int, ranges: int, count: np.ndarray):
        self.g, self.ranges, self.count, self.width = g, ranges, count, (len(count) - g + ranges - 1) // ranges
        self.pairs, self.times, self.more, self.n = np.zeros(0, np.int64), np.zeros(0, np.int32), [], 0

    def add(self, sizes: np.ndarray, items: np.ndarray) -> None:
        of = np.repeat(np.arange(len(sizes)), sizes)
        mine = np.flatnonzero(items % self.ranges == self.g)
        n = sizes[of[mine]]
        own, other = np.repeat(items[mine], n), items[_each((np.cumsum(sizes) - sizes)[of[mine]], n)]
        two = own != other
        self.more.append(other[two].astype(np.int64) * self.width + own[two] // self.ranges)
        self.n += len(self.more[-1])
        if self.n >= 2 * PAIRS:
            self._merge()

    def _merge(self) -> None:
        """One number and how often it occurs for each pair. Most ranges come here once, so the numbers are put in order in place."""
        new = np.concatenate([np.zeros(0, np.int64), *self.more])
        self.more, self.n = [], 0
        new.sort()
        at = np.flatnonzero(np.concatenate([[True], new[1:] != new[:-1]])) if len(new) else np.zeros(0, np.int64)
        times, new = np.diff(at, append=len(new)).astype(np.int32), new[at]
        if len(self.pairs):
            new, times = np.concatenate([self.pairs, new]), np.concatenate([self.times, times])
            order = np.argsort(new, kind="stable")
            new, times = new[order], times[order]
            at = np.flatnonzero(np.concatenate([[True], new[1:] != new[:-1]]))
            new, times = new[at], np.add.reduceat(times, at)
        self.pairs, self.times = new, times

    def close(self) -> None:
        self._merge()
        self.own, self.similarity = np.zeros(len(self.pairs), np.int32), np.zeros(len(self.pairs))
        for at in range(0, len(self.pairs), AT_ONCE):
            part = slice(at, at + AT_ONCE)
            other, own = np.divmod(self.pairs[part], self.width)
            self.own[part] = own
            self.similarity[part] = self.times[part] / np.sqrt((self.count[other] * self.count[own * self.ranges + self.g]).astype(float))
        self.starts = np.searchsorted(self.pairs, np.arange(len(self.count) + 1) * self.width)
        del self.pairs, self.times

    def candidates(self, sizes: np.ndarray, items: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """Baskets from and to; basket and item as one number, and similarity, of what their shown items ask for."""
        first = np.cumsum(sizes) - sizes
        n = self.starts[items + 1] - self.starts[items]
        n[first] = 0
        upto = np.cumsum(np.add.reduceat(n, first))
        a = 0
        while a < len(sizes):
            b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + AT_ONCE, "right")))
            lines = slice(first[a], first[b] if b < len(sizes) else len(items))
            at = _each(self.starts[items[lines]], n[lines])
            yield a, b, np.repeat(np.repeat(np.arange(b - a), sizes[a:b]), n[lines]) * np.int64(self.width) + self.own[at], self.similarity[at]
            a = b

    def own_scores(self, sizes: np.ndarray, items: np.ndarray) -> np.ndarray:
        """Of the hidden items of the range; 0 for others."""
        out, mine = np.zeros(len(sizes)), np.flatnonzero(items[np.cumsum(sizes) - sizes] % self.ranges == self.g)
        if len(mine):
            start, n = (np.cumsum(sizes) - sizes)[mine], sizes[mine]
            own = items[start]
            for a, b, key, similarity in self.candidates(n, items[_each(start, n)]):
                hit = key % self.width == np.repeat(own[a:b] // self.ranges, np.bincount(key // self.width, minlength=b - a))
                out[mine[a:b]] = np.bincount((key // self.width)[hit], similarity[hit], b - a)
        return out

    def above(self, sizes: np.ndarray, items: np.ndarray, own: np.ndarray) -> np.ndarray:
        """How many items of the range, beside the basket's own, score more than the hidden one; scores have 9 digits."""
        out, first = np.zeros(len(sizes), np.int64), np.cumsum(sizes) - sizes
        for a, b, key, similarity in self.candidates(sizes, items):
            lines = slice(first[a], first[b] if b < len(sizes) else len(items))
            of, inside = np.repeat(np.arange(b - a), sizes[a:b]), items[lines] % self.ranges == self.g
            taken = np.sort(of[inside] * np.int64(self.width) + items[lines][inside] // self.ranges)
            known = own[a:b][key // max(1, self.width)] > 0
            # a hidden item without a score is outranked by whatever has one
            found = [np.unique(key[~known])]
            if known.any():
                k, s = key[known], similarity[known]
                order = np.argsort(k, kind="stable")
                k, s = k[order], s[order]
                start = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
                k, s = k[start], np.round(np.add.reduceat(s, start), 9)
                found.append(k[s > own[a:b][k // self.width]])
            for k in found:
                free = k[~np.isin(k, taken)] if len(taken) else k
                out[a:b] += np.bincount(free // max(1, self.width), minlength=b - a)
        return out


def _told(orders: DataFrame, blocks: DataFrame, items, ranges: int) -> DataFrame:
    """(block, told): of each block's baskets, the hidden items' scores, or, where ``blocks`` have them (own), how many items outrank
    them."""
    scored = "own" in blocks.columns
    own = F.col("own") if scored else F.lit(None).cast("binary")
    train = _train_cells(orders, items, ranges).select("g", F.lit(None).cast("long").alias("block"), "sizes", "items", F.lit(None).cast("binary").alias("own"))
    test = blocks.select(F.explode(F.sequence(F.lit(0), F.lit(ranges - 1))).alias("g"), "block", "sizes", "items", own.alias("own"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near, done = None, False
        for batch in batches:
            for i in range(batch.num_rows):
                g, block = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                sizes, places = (np.frombuffer(batch.column(c)[i].as_buffer(), np.int32).astype(np.int64) for c in (2, 3))
                if near is None or near.g != g:
                    near, done = Near(g, ranges, items.value[1]), False
                if block is None:
                    near.add(sizes, places)
                    continue
                if not done:
                    near.close()
                    done = True
                told = near.above(sizes, places, np.frombuffer(batch.column(4)[i].as_buffer(), np.float64)) if scored else near.own_scores(sizes, places)
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([told.tobytes()], pa.binary())], names=["block", "told"])

    def added(rows: pa.Table) -> pa.Table:
        kind = np.int64 if scored else np.float64
        total = sum(np.frombuffer(x.as_py(), kind) for x in rows.column("told"))
        return pa.table({"block": pa.array([rows.column("block")[0].as_py()], pa.int64()), "told": pa.array([(total if scored else np.round(total, 9)).tobytes()], pa.binary())})

    dealt = train.unionByName(test).repartition(4 * ranges, "g").sortWithinPartitions("g", F.col("block").asc_nulls_first())
    with batches_of(orders.sparkSession, "8m"):
        parts = stored(dealt.mapInArrow(run, "block long, told binary"))
        out = stored(parts.groupBy("block").applyInArrow(added, "block long, told binary"))
    released(parts)
    return out


def ranks(orders: DataFrame, min_orders: int) -> DataFrame:
    """For each test basket of ``gathered`` orders (stored), how many items outrank the hidden one: by similarity to the rest of the
    basket, and by popularity. The items (their codes and two numbers each) are sent to all tasks."""
    spark = orders.sparkSession
    listed = item_places(orders, min_orders).orderBy("place").select("stock_code", "item_orders", "better").toArrow().combine_chunks()
    codes = listed.column("stock_code").combine_chunks()
    items = spark.sparkContext.broadcast((codes, listed.column("item_orders").to_numpy(), listed.column("better").to_numpy()))
    pairs = orders.agg(F.sum(F.size("train") * (F.size("train") - 1)).alias("n")).first()["n"] or 0
    ranges = max(1, min(len(codes), -(-pairs // PAIRS)))
    blocks = stored(_blocks(orders, items).withColumn("block", F.monotonically_increasing_id()))
    own = _told(orders, blocks, items, ranges)
    above = _told(orders, stored(blocks.join(own.withColumnRenamed("told", "own"), "block")), items, ranges)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                n = pa.array(np.frombuffer(batch.column(2)[i].as_buffer(), np.int64))
                yield pa.RecordBatch.from_arrays([batch.column(0)[i].values, n, batch.column(1)[i].values], names=["invoice", "by_similarity", "by_popularity"])

    return blocks.join(above, "block").select("invoice", "popular", "told").mapInArrow(run, "invoice string, by_similarity long, by_popularity long")
