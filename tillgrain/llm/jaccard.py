"""Exact n-gram Jaccard join in the metric space of shingle sets.

Two texts link when the Jaccard similarity of their word shingle sets is at least t (den * common >= num * all,
in integers); the Jaccard distance 1 - similarity is a metric, and everything below rests on that.

Texts with equal sets collapse into one *node* first, so copies cost nothing later. Then

1. *Outer regions.* The outermost pivots are single shingles. The region of a pivot takes in the nodes that
   have it among the first n - ceil(t n) + 1 shingles of their set in one global order; linked nodes share at
   least ceil(t n) shingles, so they meet in some region: this is the window beyond which replication adds
   nothing. (Distances of whole texts to a few pivot texts are all close to 1 in text, and their
   triangle windows would replicate nearly every text to every region; the README has the figures.) The global
   order puts shingles that many texts have last, by a sketch of counts over all documents. Any order
   gives the same links; this one keeps regions small.
2. *Pivots.* A region, by set size, falls apart wherever the next size is out of reach of the last one. Of each
   part the smallest set is the pivot, and the pair (node, pivot) is compared exactly, once for all regions that
   ask. Before texts are read, a contraction decides: the counts of a set's shingles in ``BUCKETS`` hash
   buckets are no farther apart (L1) than the sets (symmetric difference), so pairs too far apart there are
   too far apart. Nodes within eps = 1 - t of their pivot link to it: a group of copies becomes a star around
   its pivot, never a clique.
3. *Recursion.* What a pivot didn't take in may still link. Its cell keeps the nodes farther than eps from it and,
   by the triangle inequality, of those within eps only the ones no nearer than the nearest outsider's
   distance less eps. A larger cell is dealt to the Voronoi regions of ``PIVOTS`` of its outsiders, a node to all
   whose pivot is at most 2 eps farther than its nearest one: linked nodes meet in the region of either's nearest
   pivot. Where these windows would replicate more than they part (all nodes about as far from each other, as
   texts around one passage are), the cell's nodes are dealt to pivots that are shingles again, now in an order by
   exact counts within the cell: what the cell's nodes share comes last and deals nobody. Either way the pivots are
   settled and leave, and parts are dealt again until they have at most ``LOCAL_NODES`` nodes and ``LOCAL``
   shingles. These are joined in one task (after the contraction has dismissed all that have no partner there), by Voronoi
   cells with windows of 2 eps in memory.
4. *Components.* Links are joined by spreading the smallest label, with pointer jumping.

Shingles are 64-bit hashes. Nodes are named by 64 bits of their set, told apart by 64 more. Special cases: a null,
empty or blank text has no shingles and links with nothing. Repeated rows are one node, and each row is in the result.
Null keys don't name a component unless all its keys are null. An empty table gives no rows. Other columns pass
by, whatever their names.
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
from tillgrain.llm.session import received, released, row_id, sent, stored

#: Counters of the sketch of shingle counts
SKETCH = 1 << 20
#: Counters that leave a task in one row, of 128 KB at most
SKETCH_ROWS = 1 << 14
#: A region of more nodes has its pivots found in two steps
HOT = 1 << 17
#: Shingles that a cell joined in one task may have, and its nodes
LOCAL, LOCAL_NODES = 1 << 21, 1 << 12
PIVOTS = 6
ROWS_A_TASK = 2_000
BUCKETS = 128
#: Keys of 24 bytes that may be broadcast; more are joined by shuffle
BROADCAST_ROWS = 1 << 19
#: Bits of a set's hash that name its node
NODE_BITS = 64


def prefix_size(n, num: int, den: int):
    """n - ceil(n num / den) + 1, for numbers or arrays."""
    return n + (-n * num // den) + 1


def _sets(column: pa.Array, n: int) -> Iterator[tuple[kernel.Texts, np.ndarray, np.ndarray]]:
    for part in kernel.slices(column):
        yield part, *kernel.distinct(*kernel.shingles(kernel.Words(part, lower=True), n))


def _sums(terms: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.zeros(len(terms) + 1, np.uint64)
    np.cumsum(kernel.mix(terms), out=total[1:])
    return kernel.mix(total[bounds[1:]] - total[bounds[:-1]] + np.diff(bounds).astype(np.uint64))


def _keys(hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64 bits of each set that name its node, and 64 more."""
    node = _sums(hashes + np.uint64(0x2545F4914F6CDD1D), bounds) >> np.uint64(64 - NODE_BITS)
    return node.view(np.int64), _sums(hashes ^ np.uint64(0x6A09E667F3BCC909), bounds).view(np.int64)


def _named(hashes: np.ndarray, bounds: np.ndarray, clashes: list[int]) -> np.ndarray:
    """The nodes of sets; ``clashes`` are names that two different sets have, which the other bits set apart."""
    node, more = _keys(hashes, bounds)
    return np.where(np.isin(node, clashes), node ^ more, node) if clashes else node


def _counts(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """How many of each set's shingles fall in each bucket, 255 at most (which brings counts no farther apart)."""
    sets = len(bounds) - 1
    bucket = (kernel.mix(hashes ^ np.uint64(0x5851F42D4C957F2D)) & np.uint64(BUCKETS - 1)).astype(np.int64)
    at = bucket + np.repeat(np.arange(sets) * BUCKETS, np.diff(bounds))
    return np.minimum(np.bincount(at, minlength=sets * BUCKETS), 255).astype(np.uint8).reshape(sets, BUCKETS)


def first_pass(docs: DataFrame, n: int, *, doc_key: str, text: str) -> DataFrame:
    """Per row: doc (its key), row (128 bits of key and text), n (set size), node and more (bits of the set), counts (its
    contraction). Beside these, rows with n of -1: what the sketch's counters from ``node`` on count, packed in ``counts`` with ``more`` bytes
    each."""
    rows = docs.select(F.col(doc_key).alias("doc"), row_id(doc_key, text).alias("row"), F.col(text).alias("t"))
    schema = T.StructType([*rows.schema.fields[:2], *(T.StructField(c, T.LongType()) for c in ("n", "node", "more")), T.StructField("counts", T.BinaryType())])
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in schema])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch, kinds = np.zeros(SKETCH, np.int64), None
        for batch in batches:
            found = []
            for _, h, b in _sets(batch.column(2), n):
                sketch += np.bincount((h & np.uint64(SKETCH - 1)).astype(np.int64), minlength=SKETCH)
                found.append((np.diff(b), *_keys(h, b), _counts(h, b)))
            if found:
                kinds = [batch.column(0).type, batch.column(1).type]
                size, node, more, counts = (np.concatenate(x) for x in zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(size), pa.array(node), pa.array(more), pa.array([c.tobytes() for c in counts], pa.binary())], names=schema.names)
        # packed: a row for each counter would be up to SKETCH rows a task
        for part in range(0, SKETCH if kinds else 0, SKETCH_ROWS):
            own = sketch[part : part + SKETCH_ROWS]
            if own.any():
                packed = own.astype(np.min_scalar_type(own.max()))
                yield pa.RecordBatch.from_arrays([*(pa.nulls(1, k) for k in kinds), *(pa.array([x]) for x in (-1, part, packed.itemsize)), pa.array([packed.tobytes()], pa.binary())], names=schema.names)

    return rows.mapInArrow(run, schema)


class Order:
    """The global order: by how often documents have a shingle, as far as the sketch tells, then by hash."""

    def __init__(self, sketch: np.ndarray):
        self.level = np.minimum(np.log2(1.0 + sketch) * 1024, 65535).astype(np.uint16)
        self.hot = sketch > HOT

    def prefixes(self, hashes: np.ndarray, bounds: np.ndarray, num: int, den: int) -> np.ndarray:
        """Places of the (ascending) hashes that are in their set's prefix."""
        size = np.diff(bounds)
        want = np.where(size > 0, prefix_size(size, num, den), 0)
        owner = np.repeat(np.arange(len(size)), size)
        order = np.argsort((owner << 16) | self.level[hashes & np.uint64(SKETCH - 1)], kind="stable")
        place = np.arange(len(hashes)) - np.repeat(bounds[:-1], size)
        return order[place < np.repeat(want, size)]


def _order(passed: DataFrame) -> Order:
    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, size, packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = np.frombuffer(packed, f"u{size}").astype(np.int64)
                total[part] = total[part] + own if part in total else own
        for part, own in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([own.tobytes()], pa.binary())], names=["part", "c"])

    found = passed.where("n = -1").select("node", "more", "counts").repartition(16, "node").mapInArrow(added, "part long, c binary").toArrow()
    sketch = np.zeros(SKETCH, np.int64)
    for part, c in zip(found.column("part").to_pylist(), found.column("c").to_pylist(), strict=True):
        sketch[part : part + SKETCH_ROWS] = np.frombuffer(c, np.int64)
    return Order(sketch)


def _outer_regions(docs: DataFrame, n: int, num: int, den: int, packed, clashes: list[int], text: str) -> DataFrame:
    """(g, n, node, hot): the nodes of each outer region, with their sizes. Only a region that is hot may have more than HOT nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rule = received(packed)
        for batch in batches:
            for _, h, b in _sets(batch.column(0), n):
                keep = rule.prefixes(h, b, num, den)
                size = np.diff(b)
                node, wide = np.repeat(_named(h, b, clashes), size), np.repeat(size, size)
                hot = rule.hot[h[keep] & np.uint64(SKETCH - 1)]
                yield pa.RecordBatch.from_arrays([pa.array(h[keep].view(np.int64)), pa.array(wide[keep].astype(np.int32)), pa.array(node[keep]), pa.array(hot)], names=["g", "n", "node", "hot"])

    return docs.select(F.col(text).alias("t")).where("t IS NOT NULL").mapInArrow(run, "g long, n int, node long, hot boolean")


def _begins(region: W, num: int, den: int) -> Column:
    """Whether a row's size is out of reach of the one before."""
    return F.coalesce(F.lag("n").over(region) * den < F.col("n") * num, F.lit(True))


def _pivoted(outer: DataFrame, num: int, den: int) -> DataFrame:
    """(x, nx, p, np): each node with the pivots of its regions' parts, once. By ascending size, a part ends where the next size
    is out of reach of the last; its first node is the pivot. Nodes are in one order within a region of bounded size."""
    region = W.partitionBy("g").orderBy("n", "node")
    marked = outer.withColumn("head", F.when(_begins(region, num, den), F.struct("node", "n")))
    parts = marked.withColumn("head", F.last("head", ignorenulls=True).over(region.rowsBetween(W.unboundedPreceding, 0)))
    return parts.select(F.col("node").alias("x"), F.col("n").alias("nx"), F.col("head.node").alias("p"), F.col("head.n").alias("np")).where("x <> p")


def _pivoted_hot(outer: DataFrame, num: int, den: int) -> DataFrame:
    """The same for regions of any size: sizes are counted first, and only a region's distinct sizes are put in order."""
    sizes = outer.groupBy("g", "n").agg(F.min("node").alias("node"))
    region = W.partitionBy("g").orderBy("n")
    marked = sizes.withColumn("head", F.when(_begins(region, num, den), F.struct("node", "n")))
    heads = stored(marked.select("g", "n", F.last("head", ignorenulls=True).over(region.rowsBetween(W.unboundedPreceding, 0)).alias("head")))
    return outer.join(heads, ["g", "n"]).select(F.col("node").alias("x"), F.col("n").alias("nx"), F.col("head.node").alias("p"), F.col("head.n").alias("np")).where("x <> p")


def _contracted(pairs: DataFrame, counts: DataFrame, num: int, den: int) -> DataFrame:
    """Adds low, a lower bound of the pair's distance, from sizes and contractions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = batch.num_rows and [np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, BUCKETS).astype(np.int16) for i in (4, 5)]
            if both:
                total = batch.column(1).to_numpy() + batch.column(3).to_numpy()
                apart = np.abs(both[0] - both[1]).sum(1)
                yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(4)), pa.array(2 * apart / (total + apart))], names=["x", "nx", "p", "np", "low"])

    reach = F.least("nx", "np") * den >= F.greatest("nx", "np") * num
    near = pairs.where(reach).join(counts.select(F.col("node").alias("x"), F.col("counts").alias("cx")), "x").join(counts.select(F.col("node").alias("p"), F.col("counts").alias("cp")), "p")
    near = near.select("x", "nx", "p", "np", "cx", "cp").mapInArrow(run, "x long, nx int, p long, np int, low double")
    far = pairs.where(~reach).select("x", "nx", "p", "np", (1 - F.least("nx", "np") / F.greatest("nx", "np")).alias("low"))
    return near.unionByName(far)


def _compare(pairs: DataFrame, texts: DataFrame, n: int) -> DataFrame:
    """(x, p, common, nx, np) of node pairs, by their texts. Pairs are dealt by either node, so a pivot that many nodes ask for is
    split by the join's skew handling."""
    a = texts.select(F.col("node").alias("x"), F.col("t").alias("tx"))
    b = texts.select(F.col("node").alias("p"), F.col("t").alias("tp"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: dict[int, np.ndarray] = {}
        for batch in batches:
            names, out = batch.column(1).to_pylist(), []
            i = 0
            for part, h, bounds in _sets(batch.column(2), n):
                for j in range(len(part)):
                    p = names[i]
                    if p not in last:
                        last = {p: next(_sets(batch.column(3).slice(i, 1), n))[1]}
                    own, pivot = h[bounds[j] : bounds[j + 1]], last[p]
                    at = np.searchsorted(pivot, own)
                    out.append((int((pivot[np.minimum(at, len(pivot) - 1)] == own).sum()) if len(pivot) else 0, len(own), len(pivot)))
                    i += 1
            if out:
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, pa.int64()) for c in zip(*out, strict=True))], names=["x", "p", "common", "nx", "np"])

    return pairs.join(a, "x").join(b, "p").select("x", "p", "tx", "tp").mapInArrow(run, "x long, p long, common long, nx long, np long")


def _distance() -> Column:
    return 1 - F.col("common") / (F.col("nx") + F.col("np") - F.col("common"))


def _linked(num: int, den: int) -> Column:
    return F.col("common") * den >= (F.col("nx") + F.col("np") - F.col("common")) * num


# --- a cell in one task ---


class _Cell:
    """Distances among the sets of a cell, through one sorted list of all their shingles."""

    def __init__(self, sets: list[np.ndarray]):
        self.sets = sets
        self.size = np.array([len(s) for s in sets])
        every = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(len(sets)), self.size)
        order = np.argsort(every, kind="stable")
        self.every, self.owner = every[order], owner[order]

    def common(self, q: int) -> np.ndarray:
        lo = np.searchsorted(self.every, self.sets[q], "left")
        hi = np.searchsorted(self.every, self.sets[q], "right")
        n = hi - lo
        at = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(n) else np.zeros(0, int)
        return np.bincount(self.owner[at], minlength=len(self.sets))


def join_cell(sets: list[np.ndarray], num: int, den: int, same: list[int] | None = None) -> list[tuple[int, int]]:
    """Links that connect all linked sets of a cell: a spanning set of them, not every pair. ``same`` are known to be connected."""
    cell, eps = _Cell(sets), 1 - num / den
    parent = list(range(len(sets)))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    links: list[tuple[int, int]] = []
    for a, b in zip((same or [])[:-1], (same or [])[1:], strict=True):
        parent[find(a)] = find(b)

    def link(q: int, members: np.ndarray, common: np.ndarray) -> None:
        union = cell.size[q] + cell.size[members] - common
        for y in members[(common * den >= union * num) & (members != q)].tolist():
            if (a := find(q)) != (b := find(y)):
                parent[a] = b
                links.append((q, y))

    stack = [(np.arange(len(sets)), 0)]
    while stack:
        members, depth = stack.pop()
        if len(members) < 2 or len({find(i) for i in members.tolist()}) == 1:
            continue
        if len(members) <= 24 or depth > 12:
            for q in members.tolist():
                link(q, members, cell.common(q)[members])
            continue
        # pivots far from each other; each links what is within eps of it
        pivots, distance, q = [], [], int(members[0])
        for _ in range(4):
            common = cell.common(q)[members]
            link(q, members, common)
            pivots.append(q)
            distance.append(1 - common / (cell.size[q] + cell.size[members] - common))
            q = int(members[np.argmax(np.min(distance, axis=0))])
        d = np.stack(distance)
        near = d.min(0)
        rest = ~np.isin(members, pivots)
        cells = [members[rest & (row <= near + 2 * eps)] for row in d]
        if max(map(len, cells)) > 0.9 * len(members):  # all are as far from each pivot: compare directly
            for q in members[rest].tolist():
                link(q, members, cell.common(q)[members])
        else:
            stack += [(c, depth + 1) for c in cells]
    return links


def _whole_cells(rows: DataFrame, tasks: int) -> DataFrame:
    """Rows of a cell in one task, one after another. The caller names the number of tasks: cells are small in bytes and take
    time, so partitions must not be merged by size."""
    return rows.repartition(max(1, min(10_000, tasks)), "cell").sortWithinPartitions("cell")


def _runs(cells: np.ndarray) -> Iterator[tuple[int, int]]:
    cuts = np.concatenate([[0], np.flatnonzero(cells[1:] != cells[:-1]) + 1, [len(cells)]]) if len(cells) else np.zeros(1, int)
    yield from zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)


def _join_cells(cells: DataFrame, n: int, num: int, den: int, tasks: int) -> DataFrame:
    """``cells``: cell, node, near (known to be linked to the cell's pivot), t. Links (x, p)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[int | None, dict[int, tuple[np.ndarray, bool]]] = (None, {})

        def joined(members: dict[int, tuple[np.ndarray, bool]]) -> list[tuple[int, int]]:
            names = sorted(members)
            if len(names) < 2:
                return []
            links = join_cell([members[i][0] for i in names], num, den, [k for k, i in enumerate(names) if members[i][1]])
            return [(names[a], names[b]) for a, b in links]

        def batch_of(links: list[tuple[int, int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in links], pa.int64()), pa.array([y for _, y in links], pa.int64())], names=["x", "p"])

        for batch in batches:
            cell, node, near = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            sets = [h[x:y] for _, h, bounds in _sets(batch.column(3), n) for x, y in zip(bounds[:-1], bounds[1:], strict=True)]
            links: list[tuple[int, int]] = []
            for a, b in _runs(cell):
                if held[0] != cell[a]:
                    links += joined(held[1])
                    held = (cell[a], {})
                held[1].update({int(node[i]): (sets[i].copy(), bool(near[i])) for i in range(a, b)})
            if links:
                yield batch_of(links)
        if links := joined(held[1]):
            yield batch_of(links)

    return _whole_cells(cells.select("cell", "node", "near", "t"), tasks).mapInArrow(run, "x long, p long")


# --- the join ---


def _texts(docs: DataFrame, nodes: DataFrame, asked: DataFrame, doc_key: str, text: str) -> DataFrame:
    """(node, t): a text of each asked node."""
    first = stored(nodes.join(asked, "node", "left_semi").select("node", "row"))
    few = first.count() <= BROADCAST_ROWS
    found = docs.select(row_id(doc_key, text).alias("row"), F.col(text).alias("t")).join(F.broadcast(first) if few else first, "row")
    return stored(found.select("node", "t"))


def _judged(pairs: DataFrame, counts: DataFrame, read, n: int, num: int, den: int) -> DataFrame:
    """(x, nx, p, np, d, near): the exact distance of pairs that could link, a lower bound above eps of all others."""
    bounds = stored(_contracted(pairs, counts, num, den))
    limit = 1 - num / den + 1e-9
    maybe = bounds.where(F.col("low") <= limit)
    exact = _compare(maybe.select("x", "p"), read(maybe), n).withColumn("d", _distance()).withColumn("near", _linked(num, den))
    exact = exact.select("x", F.col("nx").cast("int"), "p", F.col("np").cast("int"), "d", "near")
    return stored(exact.unionByName(bounds.where(F.col("low") > limit).select("x", "nx", "p", "np", F.col("low").alias("d"), F.lit(False).alias("near"))))


def _with_partner(cells: DataFrame, num: int, den: int, tasks: int) -> DataFrame:
    """``cells``: cell, node, near, size, counts. Those that the contraction leaves a possible partner in their cell, of which one
    at least is an outsider."""

    def kept(size: np.ndarray, near: np.ndarray, counts: np.ndarray) -> np.ndarray:
        keep = np.zeros(len(size), bool)
        if near.all():
            return keep
        until = np.searchsorted(size * num, size * den, "right")  # sizes within reach, in ascending order
        for i in np.flatnonzero(until > np.arange(len(size)) + 1).tolist():
            j = np.arange(i + 1, until[i])
            if near[i]:
                j = j[~near[j]]
            if len(j):
                apart = np.abs(counts[j] - counts[i]).sum(1)
                j = j[apart * (den + num) <= (size[j] + size[i]) * (den - num)]
                keep[j] = True
                keep[i] |= len(j) > 0
        return keep

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # the rows, so far, of the last cell seen

        def flush() -> list[tuple]:
            if len(held) < 2:
                return []
            size = np.array([r[3] for r in held], np.int64)
            keep = kept(size, np.array([r[2] for r in held]), np.frombuffer(b"".join(r[4] for r in held), np.uint8).reshape(-1, BUCKETS).astype(np.int16))
            return [held[i][:3] for i in np.flatnonzero(keep)]

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.bool_())], names=["cell", "node", "near"])

        for batch in batches:
            rows, out = list(zip(*(c.to_pylist() for c in batch.columns), strict=True)), []
            for a, b in _runs(batch.column(0).to_numpy()):
                if held and held[0][0] != rows[a][0]:
                    out += flush()
                    held = []
                held += rows[a:b]
            if out:
                yield batch_of(out)
        if out := flush():
            yield batch_of(out)

    dealt = cells.select("cell", "node", "near", "size", "counts").repartition(max(1, min(10_000, tasks)), "cell").sortWithinPartitions("cell", "size")
    return dealt.mapInArrow(run, "cell long, node long, near boolean")


def _one_of_each_set(docs: DataFrame, nodes: DataFrame, rows: int, doc_key: str, text: str) -> DataFrame:
    """(t): a text of each of the ``nodes`` (stored), where most of the rows are copies and the rows to read are few enough to be
    broadcast; else all texts."""
    few = nodes.count()
    if few > BROADCAST_ROWS or 2 * few > rows:
        return docs.select(F.col(text).alias("t"))
    return docs.select(row_id(doc_key, text).alias("row"), F.col(text).alias("t")).join(F.broadcast(nodes.select("row")), "row", "left_semi").select("t")


def _all_pairs(docs: DataFrame, passed: DataFrame, n: int, num: int, den: int, clashes: list[int], text: str) -> DataFrame:
    """What ``_pivoted`` gives for all outer regions."""
    order = _order(passed)
    outer = _outer_regions(docs, n, num, den, sent(docs.sparkSession, order), clashes, text)
    if not order.hot.any():
        return stored(_pivoted(outer, num, den).distinct())
    outer = stored(outer)
    pairs = stored(_pivoted(outer.where("NOT hot"), num, den).unionByName(_pivoted_hot(outer.where("hot"), num, den)).distinct())
    released(outer)
    return pairs


def _near_window(cells: DataFrame, eps: float) -> DataFrame:
    """``cells`` (cell, node, near, size, d: distance to the pivot that the near ones link with) without the near nodes that no
    outsider can link with, and without cells that have no outsider."""
    sides = cells.groupBy("cell").agg(F.min(F.when(~F.col("near"), F.col("d"))).alias("nearest")).where("nearest IS NOT NULL")
    return cells.join(sides, "cell").where(f"NOT near OR d >= nearest - {eps} - 1e-9").select("cell", "node", "near", "size")


def _voronoi(cells: DataFrame, far: DataFrame, eps: float) -> DataFrame:
    """(cell, home, node, near, size, d): nodes (pivots left out) in the regions of all pivots that are at most 2 eps farther than
    their nearest one; home is the cell they come from. ``far``: cell, node, p, d, linked."""
    nearest = far.groupBy("cell", "node").agg(F.min("d").alias("nearest"))
    at = far.join(nearest, ["cell", "node"]).where(f"d <= nearest + {2 * eps} + 1e-9")
    at = at.join(cells.select("cell", "node", "size", F.col("near").alias("was")), ["cell", "node"])
    regions = stored(at.select(F.xxhash64("cell", "p").alias("cell"), F.col("cell").alias("home"), "node", F.col("linked").alias("near"), "size", "d", "was"))
    # nodes that were known to be linked with each other have nothing to look for among themselves
    return regions.join(regions.groupBy("cell").agg(F.min("was").alias("all")).where("NOT all").select("cell"), "cell").drop("was")


def _by_shingles(cells: DataFrame, texts: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """(cell, node, near, size): the cells' nodes dealt to regions of single shingles, in an order by counts within the cell.

    Of two linked nodes the smaller has a common shingle among its first n - ceil(2 t n / (1 + t)) + 1, and the larger has
    it among its first n - ceil(t n) + 1; so a region is needed only where some node has its shingle that early. Shingles
    that one node alone has come first and lead nowhere."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            i = 0
            for part, h, bounds in _sets(batch.column(4), n):
                size = np.diff(bounds)
                at = pa.array(np.repeat(np.arange(i, i + len(part)), size))
                yield pa.RecordBatch.from_arrays([*(c.take(at) for c in batch.columns[:4]), pa.array(h.view(np.int64))], names=["cell", "node", "near", "size", "g"])
                i += len(part)

    spread = stored(cells.join(texts, "node").select("cell", "node", "near", "size", "t").mapInArrow(run, "cell long, node long, near boolean, size int, g long"))
    shared = stored(spread.groupBy("cell", "g").agg(F.count(F.lit(1)).alias("c")).where("c > 1"))
    own = W.partitionBy("cell", "node")
    met = spread.join(shared, ["cell", "g"]).withColumn("place", F.col("size") - F.count(F.lit(1)).over(own) + F.row_number().over(own.orderBy("c", "g")))
    early = met.where(F.col("place") <= F.col("size") - F.ceil(F.col("size") * num / den) + 1)
    early = stored(early.withColumn("first", F.col("place") <= F.col("size") - F.ceil(F.col("size") * (2 * num) / (den + num)) + 1))
    some = early.groupBy("cell", "g").agg(F.max("first").alias("first"), F.min("near").alias("all_near"), F.count(F.lit(1)).alias("nodes")).where("first AND NOT all_near AND nodes > 1").select("cell", "g")
    out = stored(early.join(some, ["cell", "g"]).select(F.xxhash64("cell", "g").alias("cell"), "node", "near", "size"))
    released(spread, shared, early)
    return out


def _dealt(cells: DataFrame, read, n: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """Deal large cells (cell, node, near, size) to smaller ones: links (x, p) with the pivots, and the new cells."""
    eps = 1 - num / den
    lot = F.pmod(F.xxhash64("node", "cell"), F.lit(PIVOTS))
    pivots = cells.where("NOT near").groupBy("cell", lot.alias("lot")).agg(F.min(F.struct(F.xxhash64("node", "cell", F.lit(1)), "node", "size")).alias("v"))
    pivots = stored(pivots.select("cell", F.col("v.node").alias("p"), F.col("v.size").alias("np")))
    texts = read(cells.select("node"))
    pairs = cells.join(pivots, "cell").where("node <> p")
    exact = _compare(pairs.select(F.col("node").alias("x"), "p").distinct(), texts, n).withColumn("d", _distance()).withColumn("linked", _linked(num, den))
    exact = stored(exact.select("x", "p", "d", "linked"))
    rest = cells.join(pivots.select("cell", F.col("p").alias("node")), ["cell", "node"], "left_anti")
    far = stored(rest.join(pivots, "cell").select("cell", "node", "p").join(exact.withColumnRenamed("x", "node"), ["node", "p"]))
    regions = stored(_voronoi(rest, far, eps))
    # a cell parts by regions if comparing within them is at most half of comparing within the cell
    before = rest.groupBy(F.col("cell").alias("home")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    after = regions.groupBy("home", "cell").agg(F.count(F.lit(1)).cast("double").alias("n")).groupBy("home").agg(F.sum(F.col("n") * F.col("n")).alias("work"))
    parted = stored(before.join(after, "home").select(F.col("home").alias("cell"), (F.col("work") <= F.col("n") * F.col("n") / 2).alias("parted")))
    by_region = _near_window(regions.join(parted.where("parted").select(F.col("cell").alias("home")), "home"), eps)
    # the others keep one group known to be linked: around the pivot with most links in the cell, or the one they had
    best = far.groupBy("cell", "p").agg(F.count(F.when(F.col("linked"), 1)).alias("links")).groupBy("cell").agg(F.max(F.struct("links", "p")).alias("best"))
    had = rest.groupBy("cell").agg(F.count(F.when(F.col("near"), 1)).alias("had"))
    best = best.join(had, "cell").join(parted.where("NOT parted").select("cell"), "cell").where("best.links > had").select("cell", F.col("best.p").alias("p"))
    stars = _near_window(far.join(best, ["cell", "p"]).join(rest.select("cell", "node", "size"), ["cell", "node"]).select("cell", "node", F.col("linked").alias("near"), "size", "d"), eps)
    old = rest.join(parted.where("NOT parted").select("cell"), "cell").join(best.select("cell"), "cell", "left_anti").select("cell", "node", "near", "size")
    by_shingle = _by_shingles(stored(stars.unionByName(old)), texts, n, num, den)
    return exact.where("linked").select("x", "p"), by_region.unionByName(by_shingle)


def links_of(docs: DataFrame, passed: DataFrame, nodes: DataFrame, n: int, num: int, den: int, *, clashes: list[int], doc_key: str = "doc_id", text: str = "text") -> tuple[list[DataFrame], int]:
    """Links (x, p) between nodes, as stored frames: enough to connect all linked nodes; and how often cells were dealt."""
    eps, rounds = 1 - num / den, 0
    rows = nodes.count()
    # one row for each set, merged before anything is dealt by node: copies of one text may be many
    nodes = stored(nodes.groupBy("node").agg(F.min("row").alias("row"), F.first("counts").alias("counts")), 10 * rows)
    pairs = _all_pairs(_one_of_each_set(docs, nodes, rows, doc_key, text), passed, n, num, den, clashes, "t")
    asked = pairs.select(F.col("x").alias("node")).union(pairs.select(F.col("p").alias("node"))).distinct()
    counts = stored(nodes.join(asked, "node", "left_semi").select("node", "counts"))

    def read(wanted: DataFrame) -> DataFrame:
        return _texts(docs, nodes, wanted.distinct(), doc_key, text)

    def read_pairs(maybe: DataFrame) -> DataFrame:
        return read(maybe.select(F.col("x").alias("node")).union(maybe.select(F.col("p").alias("node"))))

    judged = _judged(pairs, counts, read_pairs, n, num, den)
    links = [judged.where("near").select("x", "p")]

    # cells: what lies outside each pivot's reach, and the pivot's own nodes that could link with it
    cells = _near_window(judged.select(F.col("p").alias("cell"), F.col("x").alias("node"), "near", F.col("nx").alias("size"), "d"), eps)
    while True:
        cells = stored(cells)
        weight = stored(cells.groupBy("cell").agg(F.count(F.lit(1)).alias("nodes"), F.sum("size").alias("shingles"), F.count(F.when(~F.col("near"), 1)).alias("out")).where("nodes > 1 AND out > 0"), rows)
        small = (F.col("shingles") <= LOCAL) & (F.col("nodes") <= LOCAL_NODES)
        kinds = weight.agg(F.count(F.when(small, 1)).alias("few"), F.count(F.when(~small, 1)).alias("many"), F.coalesce(F.sum(F.when(small, F.col("nodes"))), F.lit(0)).alias("rows")).first()
        if kinds.few:
            mine = cells.join(weight.where(small).select("cell"), "cell").select("cell", "node", "near", "size").join(counts, "node")
            mine = stored(_with_partner(mine, num, den, kinds.rows // ROWS_A_TASK))
            texts = read(mine.select("node"))
            links.append(stored(_join_cells(mine.join(texts, "node"), n, num, den, mine.count() // ROWS_A_TASK)))
            released(mine, texts)
        if not kinds.many:
            return links, rounds
        met, cells = _dealt(stored(cells.join(weight.where(~small).select("cell"), "cell")), read, n, num, den)
        links.append(met)
        rounds += 1


def components(links: list[DataFrame]) -> DataFrame:
    """(node, label) of all nodes that have a link: the smallest node of the component."""
    edges = links[0]
    for more in links[1:]:
        edges = edges.unionByName(more)
    rows = edges.count()
    edges = stored(edges.unionByName(edges.select(F.col("p").alias("x"), F.col("x").alias("p"))).distinct(), rows)
    labels = stored(edges.groupBy(F.col("x").alias("node")).agg(F.least(F.min("p"), F.col("x")).alias("label")), rows)
    last = labels
    while True:
        told = edges.join(labels.withColumnRenamed("node", "p"), "p").select(F.col("x").alias("node"), "label")
        best = labels.withColumnRenamed("label", "old").join(told.groupBy("node").agg(F.min("label").alias("told")), "node").withColumn("best", F.least("old", "told"))
        hop = labels.select(F.col("node").alias("best"), F.col("label").alias("further"))
        new = stored(best.join(hop, "best", "left").select("node", "old", F.least("best", F.coalesce("further", "best")).alias("label")), rows)
        released(last)
        changed = new.where("label <> old").limit(1).count()
        last, labels = new, new.select("node", "label")
        if not changed:
            released(edges)
            return labels


def join(docs: DataFrame, *, n: int = 3, num: int = 90, den: int = 100, doc_key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc, row (bits of key and text), n_shingles, component (smallest key reachable by links)."""
    passed = stored(first_pass(docs, n, doc_key=doc_key, text=text))
    nodes = passed.where("n >= 0").select("doc", "row", "n", "node", "more", "counts")
    # names that two different sets share: about rows^2 / 2^65, so none, or a few among 10^10 rows
    clashes = [r.node for r in nodes.groupBy("node").agg(F.min("more").alias("a"), F.max("more").alias("b")).where("a <> b").select("node").collect()]
    if clashes:
        nodes = nodes.withColumn("node", F.when(F.col("node").isin(clashes), F.col("node").bitwiseXOR(F.col("more"))).otherwise(F.col("node")))
    worded = nodes.where("n > 0")
    links, _ = links_of(docs, passed, worded, n, num, den, clashes=clashes, doc_key=doc_key, text=text)
    labels = components(links)
    names = worded.groupBy("node").agg(F.min("doc").alias("least")).join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = names.groupBy("label").agg(F.min("least").alias("component"))
    by_node = names.select("node", "label").join(least, "label").select("node", "component")
    out = nodes.join(by_node, "node", "left")
    return out.select("doc", "row", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc")).alias("component"))


def one_of_each(docs: DataFrame, *, n: int = 5, num: int = 80, den: int = 100, doc_key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that give their component its name, each once, and all without words; all columns as they came."""
    found = join(docs, n=n, num=num, den=den, doc_key=doc_key, text=text)
    kept = found.where("n_shingles = 0 OR doc <=> component").select("row", (F.col("n_shingles") > 0).alias("worded")).distinct()
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("whole")
    same = docs.select(whole, row_id(doc_key, text).alias("row")).join(kept, "row")
    number = F.row_number().over(W.partitionBy("row").orderBy("row"))
    return same.withColumn("number", number).where("number = 1 OR NOT worded").select("whole.*")
