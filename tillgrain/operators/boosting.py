"""Boosted regression trees of several models at once, over rows that never leave their tasks.

Values become bins once, kept in blocks of rows, feature by feature; then every pass over the blocks serves all models: it sums
residuals by node, feature and bin, of the smaller child of each split only (the other is the parent less it). Residuals come
from all trees so far, once a tree, and stay in the executors' memory as far as they fit; they are never written, and blocks
that don't fit compute theirs anew in each pass. Models whose trees split alike share the work of finding rows. Gradients are
whole numbers of a fixed scale, so sums are the same in any order. The boosting is that of Spark's GBTRegressor with squared loss: the first tree counts
in full, later ones by the step; the best gain in variance splits; a leaf keeps a least number of rows. Every row of
the training weeks counts. Cuts are quantiles of all rows before a day, with -1 (missing) and 0 in bins of their own.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillgrain.session import stored  # noqa: F401

cloudpickle.register_pickle_by_value(sys.modules[__name__])

DEPTH, BINS, LEAST = 5, 32, 30
NODES = 2 ** (DEPTH + 1) - 1
CHUNK, SHIFT, TOP = 1 << 16, 36, 1 << 18
POINTS = 1000
#: The residual of a row that a model may not learn from.
UNUSED = np.iinfo(np.int32).min


@dataclass
class Model:
    """Learns targets[target] of the rows whose day is before ``before``."""

    target: int
    before: int
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)


def cuts(rows: DataFrame, x: list[str]) -> list[np.ndarray]:
    share = [i / (BINS - 2) for i in range(1, BINS - 2)]
    found = rows.agg(*[F.percentile_approx(F.when(F.col(c) > 0, F.col(c)), share, 1000).alias(c) for c in x]).first()
    return [np.unique([-1.0, 0.0, *(found[c] or [])]) for c in x]


def summary(values: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """At most ``POINTS`` of the values, each with the weight of those around it."""
    if len(values) <= POINTS:
        return values, weights
    order = np.argsort(values, kind="stable")
    upto = np.cumsum(weights[order])
    ends = np.searchsorted(upto, upto[-1] * (np.arange(POINTS) + 0.5) / POINTS)
    return values[order][np.minimum(ends, len(values) - 1)], np.full(POINTS, upto[-1] / POINTS)


def quantiles(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """A feature's cuts, from summaries of its positive values."""
    order = np.argsort(values, kind="stable")
    upto = np.cumsum(weights[order])
    at = np.searchsorted(upto, upto[-1] * np.arange(1, BINS - 2) / (BINS - 2) - 1e-9) if len(values) else []
    return np.unique([-1.0, 0.0, *values[order][np.minimum(at, len(values) - 1)]]) if len(values) else np.array([-1.0, 0.0])


def bins_of(values: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """(feature, row): the bin of each value; ``values`` likewise, NaN where missing. An even number of features."""
    out = np.zeros((len(edges) + len(edges) % 2, values.shape[1]), np.uint8)
    for f, e in enumerate(edges):
        out[f] = np.searchsorted(e, np.where(np.isnan(values[f]), -1.0, values[f]))
    return out


def _filled(x: list[str]) -> Column:
    return F.array(*[F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(-1.0)), F.lit(-1.0)) for c in x])


def _values(column: pa.Array, features: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), features).T


def block(days: np.ndarray, bins: np.ndarray, targets: list[np.ndarray]) -> pa.RecordBatch:
    """One record: rows by day, each column as bytes, bins feature by feature."""
    order = np.argsort(days, kind="stable") if (np.diff(days) < 0).any() else slice(None)
    parts = [days[order].astype(np.int32), bins[:, order], *(y[order].astype(np.float64) for y in targets)]
    tops = [float(np.nanmax(np.abs(y), initial=0.0)) for y in targets]
    return pa.RecordBatch.from_arrays(
        [*(pa.array([np.ascontiguousarray(x).tobytes()], pa.binary()) for x in parts), *(pa.array([t]) for t in tops)],
        names=["day", "bins", *(f"y{i}" for i in range(len(targets))), *(f"top{i}" for i in range(len(targets)))],
    )


def block_schema(targets: int) -> str:
    return ", ".join([*(f"{c} binary" for c in ("day", "bins", *(f"y{i}" for i in range(targets)))), *(f"top{i} double" for i in range(targets))])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, list[np.ndarray]]]:
    for b in batches:
        for i in range(b.num_rows):
            day, bins, *ys = (np.frombuffer(c[i].as_buffer(), kind) for c, kind in zip(b.columns, (np.int32, np.uint8, *[np.float64] * (b.num_columns - 2)), strict=True))
            yield day, bins.reshape(-1, len(day)), ys


def _leaves(bins: np.ndarray, tree: tuple, depth: int) -> np.ndarray:
    """The place of each row among the nodes of a depth. A node that isn't split sends all to the left. Whole columns are compared:
    a few operations on bytes for each split."""
    at = np.zeros(bins.shape[1], np.uint8)
    level: list[tuple[int, np.ndarray | None]] = [(0, None)]
    for d in range(depth):
        below, turned = [], None
        for node, own in level:
            if tree[1][node] == 255:
                below.append((2 * node + 1, own))
                continue
            right = bins[tree[0][node]] > tree[1][node]
            if own is not None:
                right &= own
            turned = right.copy() if turned is None else np.logical_or(turned, right, out=turned)
            if d + 1 < depth:
                below += [(2 * node + 1, ~right if own is None else own ^ right), (2 * node + 2, right)]
        at += at
        if turned is not None:
            at += turned.view(np.uint8)
        level = below
    return at


def grown(bins: np.ndarray, trees: list[tuple], step: float, seen: dict[tuple, np.ndarray] | None = None) -> np.ndarray:
    """The sum of trees, the first in full. ``seen`` keeps the leaves of these bins by the splits that lead to them."""
    out = np.zeros(bins.shape[1])
    seen = {} if seen is None else seen
    for turn, t in enumerate(trees):
        splits = t[0].tobytes(), t[1].tobytes()
        if splits not in seen:
            seen[splits] = _leaves(bins, t, DEPTH)
        out += (t[2][NODES // 2 :] * (step if turn else 1.0))[seen[splits].astype(np.intp)]
    return out


def binned(rows: DataFrame, x: list[str], day: Column, targets: list[str], edges: list[np.ndarray]) -> DataFrame:
    """(day, bins, y..., top...): blocks of rows; ``top`` is the largest size of a target."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, CHUNK):
                part = b.slice(at, CHUNK)
                yield block(part.column(0).to_numpy(), bins_of(_values(part.column(1), len(edges)), edges), [c.to_numpy() for c in part.columns[2:]])

    given = rows.select(day.cast("int").alias("day"), _filled(x).alias("x"), *[F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))).alias(f"y{i}") for i, c in enumerate(targets)])
    return given.mapInArrow(run, block_schema(len(targets)))


def _residuals(frame: DataFrame, models: list[Model], scales: list[float], step: float) -> DataFrame:
    """(day, bins, g): whole numbers, (model, row), of what the models' trees leave."""
    sent = frame.sparkSession.sparkContext.broadcast([(m.target, m.before, scale, m.trees) for m, scale in zip(models, scales, strict=True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for day, bins, ys in _blocks(batches):
            g, seen = np.full((len(sent.value), len(day)), UNUSED, np.int32), {}
            for own, (target, before, scale, trees) in zip(g, sent.value, strict=True):
                left = 2 * (ys[target] - grown(bins, trees, step, seen)) if trees else ys[target]
                use = (day < before) & ~np.isnan(left)
                own[use] = np.rint(left[use] * scale)
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (day, np.ascontiguousarray(bins), g)], names=["day", "bins", "g"])

    return frame.select(*[c for c in frame.columns if not c.startswith("top")]).mapInArrow(run, "day binary, bins binary, g binary")


def _histograms(held: DataFrame, plans: list[tuple], depth: int, features: int) -> dict[int, np.ndarray]:
    """By model, (slot, feature, bin, (rows, residuals)). ``plans``: a tree and the slot of each node."""
    pairs = (features + 1) // 2
    sent = held.sparkSession.sparkContext.broadcast(plans)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plans = sent.value
        slots_of = [int(p[1].max()) + 1 for p in plans]
        total = [np.zeros((n, 2 * pairs, BINS, 2), np.int64) for n in slots_of]
        open_ = [np.zeros((pairs, n * BINS * BINS)) for n in slots_of]
        rows_in = [0] * len(plans)
        alike: dict[tuple, list[int]] = {}
        for m, (tree, slots) in enumerate(plans):
            if slots_of[m]:
                alike.setdefault((tree[0].tobytes(), tree[1].tobytes(), slots.tobytes()), []).append(m)

        def flush(m: int) -> None:
            sums = open_[m].astype(np.int64).reshape(pairs, slots_of[m], BINS, BINS)
            count = (sums + (1 << (SHIFT - 1))) >> SHIFT
            for part, cells in enumerate((count, sums - (count << SHIFT))):
                total[m][:, 0::2, :, part] += cells.sum(3).transpose(1, 0, 2)
                total[m][:, 1::2, :, part] += cells.sum(2).transpose(1, 0, 2)
            open_[m][:], rows_in[m] = 0, 0

        for batch in batches:
            for i in range(batch.num_rows):
                day, bins, g = (np.frombuffer(c[i].as_buffer(), kind) for c, kind in zip(batch.columns, (np.int32, np.uint8, np.int32), strict=True))
                bins, g = bins.reshape(-1, len(day)), g.reshape(len(plans), len(day))
                both = [bins[2 * k].astype(np.uint16) * np.uint16(BINS) + bins[2 * k + 1] for k in range(pairs)]
                for own in alike.values():
                    tree, slots = plans[own[0]]
                    if depth:
                        slot = slots[(1 << depth) - 1 : (2 << depth) - 1][_leaves(bins, tree, depth).astype(np.intp)]
                        rows = np.flatnonzero(slot >= 0)
                        base = slot[rows].astype(np.int64) * (BINS * BINS)
                    else:
                        rows = None
                    learnt = []
                    for m in own:
                        x = g[m] if rows is None else g[m].take(rows, mode="clip")
                        use = x != UNUSED
                        # rows are in the order of days, so that most often a slice will do
                        n = int(use.sum())
                        which = slice(0, n) if use[:n].all() else np.flatnonzero(use)
                        if rows_in[m] + n >= 2 * CHUNK:
                            flush(m)
                        rows_in[m] += n
                        if n:
                            learnt.append((m, which, x[which] + float(1 << SHIFT)))
                    for k in range(pairs if learnt else 0):
                        cell = both[k].astype(np.int64) if rows is None else both[k].take(rows, mode="clip") + base
                        for m, which, x in learnt:
                            open_[m][k] += np.bincount(cell[which], weights=x, minlength=open_[m].shape[1])
        for m in range(len(plans)):
            flush(m)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(plans)), pa.int32()), pa.array([t.tobytes() for t in total], pa.binary())], names=["m", "h"])

    def add(rows: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(h.as_py(), np.int64) for h in rows.column("h"))
        return pa.table({"m": pa.array([rows.column("m")[0].as_py()], pa.int32()), "h": pa.array([total.tobytes()], pa.binary())})

    added = held.mapInArrow(run, "m int, h binary").groupBy("m").applyInArrow(add, "m int, h binary").toArrow()
    sent.destroy()
    return {m: np.frombuffer(h, np.int64).reshape(-1, 2 * pairs, BINS, 2) for m, h in zip(added.column("m").to_pylist(), added.column("h").to_pylist(), strict=True)}


def _split(h: np.ndarray, features: int) -> tuple[int, int] | None:
    """The feature and last left bin of the best gain, the first of equals."""
    left = h[:features].cumsum(1)
    n, s = (h[0, :, i].sum().astype(float) for i in (0, 1))
    ln, ls = left[:, :-1, 0].astype(float), left[:, :-1, 1].astype(float)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = ls**2 / ln + (s - ls) ** 2 / (n - ln) - s**2 / n
    gain = np.where((ln >= LEAST) & (n - ln >= LEAST), gain, -1)
    best = int(gain.argmax())
    return divmod(best, BINS - 1) if gain.flat[best] > 1e-9 * max(1.0, abs(s)) else None


def fit(frame: DataFrame, models: list[Model], features: int, iterations: int, step: float) -> None:
    """Adds trees to the models. ``frame`` as ``binned`` makes it, stored."""
    tops = frame.agg(*[F.max(c).alias(c) for c in frame.columns if c.startswith("top")]).first()
    reach = [0.0] * len(models)
    for turn in range(iterations):
        weight = step if turn else 1.0
        trees = [(np.zeros(NODES, np.int16), np.full(NODES, 255, np.uint8), np.zeros(NODES)) for _ in models]
        scales = [TOP / max(1e-9, (2 * ((tops[m.target] or 0.0) + r)) if turn else (tops[m.target] or 0.0)) for m, r in zip(models, reach, strict=True)]
        sums: list[dict[int, np.ndarray]] = [{} for _ in models]
        small: list[dict[int, int | None]] = [{0: None} for _ in models]  # a node to count: its parent
        held = _residuals(frame, models, scales, step).persist(StorageLevel.MEMORY_ONLY)
        for depth in range(DEPTH):
            plans = []
            for tree, own in zip(trees, small, strict=True):
                slots = np.full(NODES, -1, np.int16)
                slots[list(own)] = range(len(own))
                plans.append((tree, slots))
            counted = _histograms(held, plans, depth, features)
            for i, tree in enumerate(trees):
                level = {}
                for slot, (node, parent) in enumerate(small[i].items()):
                    level[node] = counted[i][slot] if i in counted else np.zeros((features + features % 2, BINS, 2), np.int64)
                    if parent is not None:
                        level[4 * parent + 3 - node] = sums[i][parent] - level[node]
                sums[i], small[i] = level, {}
                for node in sorted(level):
                    h = level[node]
                    found = _split(h, features)
                    if found is None:
                        leaf = node
                        while 2 * leaf + 1 < NODES:
                            leaf = 2 * leaf + 1
                        tree[2][leaf] = h[0, :, 1].sum() / max(1, h[0, :, 0].sum()) / scales[i]
                        continue
                    f, at = found
                    tree[0][node], tree[1][node] = f, at
                    left, right = h[f, : at + 1].sum(0), h[f, at + 1 :].sum(0)
                    if depth == DEPTH - 1:
                        tree[2][2 * node + 1], tree[2][2 * node + 2] = left[1] / left[0] / scales[i], right[1] / right[0] / scales[i]
                    else:
                        small[i][2 * node + (1 if left[0] <= right[0] else 2)] = node
            if not any(small):
                break
        held.unpersist()
        for i, (m, tree) in enumerate(zip(models, trees, strict=True)):
            m.trees.append(tree)
            reach[i] += weight * float(np.abs(tree[2]).max())


def predicted(rows: DataFrame, x: list[str], edges: list[np.ndarray], of: Column, models: list[list[Model]], names: list[str], step: float) -> DataFrame:
    """Adds a forecast for each of ``names``, 0 at least; ``of`` is the number of the row's list of models."""
    sent = rows.sparkSession.sparkContext.broadcast([[m.trees for m in each] for each in models])
    kept = [(c, t) for c, t in rows.dtypes if c not in x]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            which, bins = b.column(len(kept)).to_numpy(), bins_of(_values(b.column(len(kept) + 1), len(edges)), edges)
            out = np.zeros((len(names), b.num_rows))
            for k in np.unique(which):
                at = np.flatnonzero(which == k)
                own = bins[:, at]
                for i, trees in enumerate(sent.value[k]):
                    out[i, at] = grown(own, trees, step)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(kept)], *map(pa.array, np.maximum(out, 0))], names=[*(c for c, _ in kept), *names])

    return rows.select(*(c for c, _ in kept), of.cast("int").alias("_of"), _filled(x).alias("_x")).mapInArrow(run, ", ".join([*(f"{c} {t}" for c, t in kept), *(f"{n} double" for n in names)]))
