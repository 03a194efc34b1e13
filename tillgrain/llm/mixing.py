"""Mixing sources to target weights by cube-method balanced sampling.

A source's target is its share of the wanted total, held to ``most`` times what the source has; excess is
shared again by weight. Each document of a source is taken floor(r) times for r = target / size, and once
more with probability r - floor(r). Which documents get the extra copy is drawn by the cube method: the
vector of probabilities moves, a few coordinates at a time, along directions in which the expected tokens
and the number of documents of the source stay exactly as they are, until all but two of a block's
coordinates are 0 or 1. Blocks are made by a hash within a source, hold about ``BLOCK`` documents, and what
is left of them (two documents each) meets in further rounds; the last two of a source are rounded to
the sum closest to the target, and one exchange of two documents may follow. Larger documents move first.

All draws come from hashes, so reruns agree. A source may hold any share of the rows: its blocks are as
many as its rows need. The driver sees one row per source.

Special cases: a null or blank text has size 0, so it takes no words (taken 0), but has copies as any other document
of its source: the draw balances them with the others by number. A source without any word has target 0 and
no copies. Null is a source of its own, the last one. Rows with one key are separate units; equal ones may be
swapped. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tillgrain.llm.session import row_id, stored

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2.0
BLOCK = 5_000
MAX_SOURCES = 1 << 20


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: list[tuple[str | None, int]], weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> dict[str | None, float]:
    """Target of each source. Weights repeat over the sources in code point order, null last."""
    ordered = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))
    weight = {s: weights[i % len(weights)] for i, (s, _) in enumerate(ordered)}
    size = dict(ordered)
    rest, out, open_ = share * sum(size.values()), {}, {s for s, n in ordered if n > 0}
    out = dict.fromkeys(size, 0.0)
    while open_:
        unit = rest / math.fsum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * unit > most * size[s]}
        if not full:
            out |= {s: weight[s] * unit for s in open_}
            break
        out |= {s: most * size[s] for s in full}
        rest -= math.fsum(out[s] for s in full)
        open_ -= full
    return out


def flight(p: np.ndarray, size: np.ndarray, prefer: np.ndarray) -> np.ndarray:
    """Move probabilities until two at most are fractional, keeping sum(p) and sum(p * size).

    Three fractional units at a time: the direction orthogonal to both constraints is a cross product; a
    step goes to one of its two ends, with the chances that keep every expectation (``prefer`` are
    uniform numbers, one for each unit, which decide).
    """
    p = p.tolist()
    size = size.tolist()
    prefer = prefer.tolist()
    held: list[int] = []
    for i in range(len(p)):
        if not 0.0 < p[i] < 1.0:
            continue
        held.append(i)
        if len(held) < 3:
            continue
        a, b, c = held
        u = (size[b] - size[c], size[c] - size[a], size[a] - size[b])
        if u == (0, 0, 0):
            u = (1, -1, 0)
        up = min(((1 - p[k]) / x if x > 0 else -p[k] / x) for k, x in zip(held, u, strict=True) if x)
        down = min((p[k] / x if x > 0 else (p[k] - 1) / x) for k, x in zip(held, u, strict=True) if x)
        step = up if prefer[i] * (up + down) < down else -down
        for k, x in zip(held, u, strict=True):
            v = p[k] + step * x
            p[k] = 0.0 if v < 1e-9 else 1.0 if v > 1 - 1e-9 else v
        held = [k for k in held if 0.0 < p[k] < 1.0]
    return np.array(p)


def land(p: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Round the last fractional units so that the tokens come closest to what was expected, then the documents; then, if it
    brings the tokens closer, exchange one taken unit for one that is not."""
    left = np.flatnonzero((p > 0) & (p < 1))
    if not len(left):
        return p
    wanted = float(p @ size)
    choices = np.array(np.meshgrid(*[[0.0, 1.0]] * len(left))).reshape(len(left), -1).T
    off = np.abs(choices @ size[left] - p[left] @ size[left]), np.abs(choices.sum(1) - p[left].sum())
    p[left] = choices[np.lexsort((off[1], off[0]))[0]]
    more = wanted - float(p @ size)
    out, inn = np.flatnonzero(p == 1), np.flatnonzero(p == 0)
    if len(out) and len(inn):
        inn = inn[np.argsort(size[inn], kind="stable")]
        at = np.searchsorted(size[inn], size[out] + more)
        best = min(((abs(more + size[o] - size[inn[j]]), int(o), int(inn[j])) for o, k in zip(out, at, strict=True) for j in (k - 1, k) if 0 <= j < len(inn)))
        if best[0] < abs(more):
            p[best[1]], p[best[2]] = 0.0, 1.0
    return p


def balanced(units: DataFrame, *, block: int = BLOCK) -> DataFrame:
    """``units``: source (int), key and more (longs), copy columns as they are, size (long), p (double). Returns them with p of 0 or 1.

    Each round deals a source's open units over blocks and flies them; rounds end when every source fits
    one block, where the landing follows.
    """
    done, open_, turn = [], units.where("p > 0 AND p < 1"), 0
    done.append(units.where("NOT (p > 0 AND p < 1)"))
    schema = units.schema
    while True:
        most = open_.groupBy("source").count().agg(F.max("count").alias("n")).first()["n"] or 0
        if not most:
            break
        counts = open_.groupBy("source").agg(F.count(F.lit(1)).alias("rows"))
        last = most <= block

        dealt = open_.join(F.broadcast(counts), "source").withColumn("block", F.pmod(F.xxhash64("key", F.lit(turn)), F.ceil(F.col("rows") / block)))
        flown = stored(dealt.groupBy("source", "block").applyInPandas(_flyer(last, turn, schema.names), schema))
        done.append(flown.where("NOT (p > 0 AND p < 1)"))
        if last:
            break
        open_, turn = flown.where("p > 0 AND p < 1"), turn + 1
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def _flyer(last: bool, turn: int, names: list[str]):
    def fly(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["size", "key", "more"], ascending=[False, True, True], kind="stable")
        draws = np.random.default_rng([turn, len(rows), int(rows["size"].sum())]).random(len(rows))
        p, size = rows["p"].to_numpy(), rows["size"].to_numpy(float)
        moved = flight(p, size, draws)
        return rows.assign(p=land(moved, size) if last else moved)[names]

    return fly


def mix(docs: DataFrame, *, doc_key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, block: int = BLOCK) -> DataFrame:
    """Per row: doc key, size, source_size, target (its source's), taken (words the mix takes), copies, and id (128 bits of key,
    text and source, to find the row again)."""
    spark = docs.sparkSession
    narrow = stored(docs.select(F.col(doc_key).alias("k"), F.col(source).alias("s"), word_count(F.col(text)).alias("size"), row_id(doc_key, text, source).alias("id")))
    totals = narrow.groupBy("s").agg(F.sum("size").alias("n"), F.count(F.lit(1)).alias("rows"))
    found = totals.limit(MAX_SOURCES + 1).collect()
    if len(found) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    wanted = targets([(r.s, int(r.n)) for r in found], weights, share, most)
    plan = [(r.s, i, int(r.n), wanted[r.s], wanted[r.s] / r.n if r.n else 0.0) for i, r in enumerate(sorted(found, key=lambda r: (r.s is None, r.s or "")))]
    plan = F.broadcast(spark.createDataFrame(plan, "s2 string, source int, source_size long, target double, ratio double"))
    units = narrow.join(plan, narrow.s.eqNullSafe(plan.s2)).select(
        "source", F.col("id.a").alias("key"), F.col("id.b").alias("more"), "k", "size", "source_size", "target", F.floor("ratio").cast("long").alias("whole"), (F.col("ratio") - F.floor("ratio")).alias("p")
    )
    drawn = balanced(units, block=block)
    copies = F.col("whole") + F.col("p").cast("long")
    return drawn.select(F.col("k").alias(doc_key), "size", "source_size", "target", (copies * F.col("size")).alias("taken"), copies.alias("copies"), F.struct(F.col("key").alias("a"), F.col("more").alias("b")).alias("id"))


def mixed(docs: DataFrame, *, doc_key: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """The mix itself: every document as many times as the mix takes it, all columns as they came, whatever their names.

    Rows are found again by their bits. Only the copies of rows alike in key, text and source add up in one of them. Nulls in
    any column pass through; sources without any word have no copies; an empty table gives no rows.
    """
    decided = mix(docs, doc_key=doc_key, text=text, source=source, **options).where("copies > 0").groupBy("id").agg(F.sum("copies").cast("int").alias("copies"))
    # of rows alike in key, text and source the first carries the copies of all
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("whole")
    same = docs.select(whole, row_id(doc_key, text, source).alias("id")).join(decided.hint("merge"), "id")
    first = same.withColumn("number", F.row_number().over(W.partitionBy("id").orderBy("id"))).where("number = 1")
    return first.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("whole.*")
