"""Sharding by sampled splitters: range-partition records into shards of nearly equal bytes.

The order is by (text hash, key), so copies of a text lie together. The plan for a table is made in a few
small aggregations, none of which needs a group in one task:

1. Groups of equal texts that hold more than 1/``FINE`` of a shard (at most shards * FINE of them exist) are
   *heavy*. A heavy group becomes pieces by a hash of the key; one that no shard can hold is spread piece
   by piece (an overfull range is subdivided), any other keeps to one shard. The largest go first, each to
   the shard with the most room. Rows that share key and text and are more than a piece are stored with a
   number each, which enters the hash.
2. Of the other, light groups, a sample of keys is drawn with chances in proportion to size; its quantiles
   are the splitters of ``shards * 16`` ranges, or of one for each ``RANGE_BYTES``. Rows are counted by range.
3. Ranges fill the shards' remaining room in order. A range that straddles a boundary is subdivided where
   the running bytes inside it reach the boundary, between two groups.

So shards differ by less than a light group, and equal texts share a shard unless their group is larger
than a shard. Slots count up from 0 within a shard, in range order. Everything is DataFrame and SQL
operations; the driver holds the plan, whose size depends on the number of shards alone.

Special cases: a null text has no bytes (size 8) and counts as the empty text's group; null keys sort
first. Repeated rows each get a slot. An empty table gives no rows. Extra columns pass through ``assign``
untouched unless they are named like its outputs, which then win.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tillgrain.llm.session import stored

FINE = 64
SPLITS = 16
SAMPLE = 16_384
#: Ranges follow the bytes, up to a number that a plan can hold
RANGE_BYTES, MOST_RANGES = 1 << 28, 1 << 14


def size_of(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long")


def group_of(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


@dataclass
class Plan:
    shards: int
    #: group hash -> number of pieces
    pieces: dict[int, int] = field(default_factory=dict)
    #: (group hash, piece) -> (shard, first slot)
    placed: dict[tuple[int, int], tuple[int, int]] = field(default_factory=dict)
    splitters: list[int] = field(default_factory=list)
    #: of each range: bytes before it
    before: list[int] = field(default_factory=list)
    #: of each shard: the light bytes up to its end
    until: list[int] = field(default_factory=list)
    #: of each (range, shard): the first slot
    first: dict[tuple[int, int], int] = field(default_factory=dict)


def _range_of(splitters: list[int], value: Column) -> Column:
    """How many splitters are at most value: in two steps, a coarse list and the slice of the fine one below it."""
    if not splitters:
        return F.lit(0)
    step = max(1, int(len(splitters) ** 0.5))
    coarse, fine = F.lit(splitters[::step]), F.lit(splitters)
    block = F.size(F.filter(coarse, lambda s: s <= value))
    inner = F.size(F.filter(F.slice(fine, F.greatest(block - 1, F.lit(0)) * step + 1, F.lit(step)), lambda s: s <= value))
    return F.when(block == 0, F.lit(0)).otherwise((block - 1) * step + inner)


def _with_piece(keyed: DataFrame, plan: Plan) -> DataFrame:
    """Adds piece: null for light groups. Heavy groups are at most shards * FINE, and so is what is broadcast."""
    if not plan.pieces:
        return keyed.withColumn("piece", F.lit(None).cast("int"))
    heavy = F.broadcast(keyed.sparkSession.createDataFrame(list(plan.pieces.items()), "g long, pieces long"))
    return keyed.join(heavy, "g", "left").withColumn("piece", F.pmod(F.xxhash64(*_names(keyed), F.lit(29)), F.col("pieces")).cast("int")).drop("pieces")


def _names(keyed: DataFrame) -> list[str]:
    return ["k", "tie"] if "tie" in keyed.columns else ["k"]


def measure(keyed: DataFrame, shards: int) -> tuple[int, dict[int, int]]:
    """All bytes, and those of each heavy group."""
    total = keyed.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("b")).first()["b"]
    heavy = keyed.groupBy("g").agg(F.sum("size").alias("b")).where(F.col("b") > total / shards / FINE)
    return total, {r.g: r.b for r in heavy.collect()}


def repeated(keyed: DataFrame, shards: int, measured: tuple[int, dict[int, int]]) -> list[tuple[int, int]]:
    """(group hash, key hash) of the rows of one key and text that are more than a piece: shards * FINE at most."""
    total, heavy = measured
    if not heavy:
        return []
    groups = F.broadcast(keyed.sparkSession.createDataFrame([(g,) for g in heavy], "g long"))
    same = keyed.join(groups, "g").groupBy("g", F.xxhash64("k").alias("c")).agg(F.sum("size").alias("b")).where(F.col("b") > total / shards / FINE)
    return sorted((r.g, r.c) for r in same.collect())


def told_apart(keyed: DataFrame, often: list[tuple[int, int]]) -> DataFrame:
    """Adds tie, a number that tells the rows of ``repeated`` apart; these are stored first, so that each keeps its number."""
    none = F.lit(0).cast("long").alias("tie")
    if not often:
        return keyed.select("*", none)
    marks = F.broadcast(keyed.sparkSession.createDataFrame([(*x, True) for x in often], "g long, c long, often boolean"))
    marked = keyed.withColumn("c", F.xxhash64("k")).join(marks, ["g", "c"], "left")
    same = stored(marked.where("often").select(*keyed.columns, F.monotonically_increasing_id().alias("tie")))
    return marked.where("often IS NULL").select(*keyed.columns, none).unionByName(same)


def make_plan(keyed: DataFrame, shards: int, measured: tuple[int, dict[int, int]] | None = None) -> Plan:
    """``keyed``: k (any type), g (group hash), size, and tie where ``told_apart`` added it."""
    plan = Plan(shards)
    total, heavy = measured or measure(keyed, shards)
    if not total:
        return plan
    share = total / shards
    plan.pieces = {g: max(1, int(-(-b * FINE // share))) for g, b in heavy.items()}
    room = [share] * shards
    if heavy:
        sizes = _with_piece(keyed, plan).where("piece IS NOT NULL").groupBy("g", "piece").agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("n"))
        by_group: dict[int, list[tuple[int, int, int]]] = {}
        for r in sorted(sizes.collect(), key=lambda r: (r.g, r.piece)):
            by_group.setdefault(r.g, []).append((r.piece, r.b, r.n))
        slots = [0] * shards
        for g in sorted(by_group, key=lambda g: (-heavy[g], g)):
            whole = max(range(shards), key=lambda s: (room[s], -s)) if heavy[g] <= share else None
            for piece, b, n in by_group[g]:
                shard = whole if whole is not None else max(range(shards), key=lambda s: (room[s], -s))
                plan.placed[g, piece] = shard, slots[shard]
                slots[shard] += n
                room[shard] -= b
    else:
        slots = [0] * shards
    light = _with_piece(keyed, plan).where("piece IS NULL")
    left = total - sum(heavy.values())
    if left:
        # a row is drawn with a chance in proportion to its size: SAMPLE of them in all, give or take a few hundred
        ranges = max(shards * SPLITS, min(MOST_RANGES, left // RANGE_BYTES))
        chance = F.least(F.lit(1.0), F.col("size") * (max(SAMPLE, 64 * ranges) / left))
        drawn = sorted(r.g for r in light.where((F.pmod(F.xxhash64("g", "k", F.lit(31)), F.lit(1 << 30)) / (1 << 30)) < chance).select("g").collect())
        plan.splitters = sorted({drawn[i * len(drawn) // ranges] for i in range(1, ranges)} if drawn else set())
        counts = light.withColumn("r", _range_of(plan.splitters, F.col("g"))).groupBy("r").agg(F.sum("size").alias("b"))
        by_range = {r.r: r.b for r in counts.collect()}
        at = 0
        for r in range(len(plan.splitters) + 1):
            plan.before.append(at)
            at += by_range.get(r, 0)
        # pieces that overfilled a shard leave less for the others: share the light bytes over the room there is
        free = [max(0.0, x) for x in room]
        scale, at = left / sum(free), 0.0
        for x in free:
            at += x * scale
            plan.until.append(int(round(at)))
        plan.until[-1] = left
        placed = _placed(light, plan)
        rows = {(r.r, r.shard): r.n for r in placed.groupBy("r", "shard").agg(F.count(F.lit(1)).alias("n")).collect()}
        for (r, shard), n in sorted(rows.items(), key=lambda x: (x[0][1], x[0][0])):
            plan.first[r, shard] = slots[shard]
            slots[shard] += n
    return plan


def _placed(light: DataFrame, plan: Plan) -> DataFrame:
    """Light rows with their range r and shard. The running sum takes in all rows of a group, so a group keeps together."""
    ranged = light.withColumn("r", _range_of(plan.splitters, F.col("g")))
    ends = F.sum("size").over(W.partitionBy("r").orderBy("g").rangeBetween(W.unboundedPreceding, W.currentRow))
    bounds = [x for x in plan.until[:-1]]
    at = F.element_at(F.lit(plan.before), F.col("r") + 1) + F.col("ends")
    shard = F.size(F.filter(F.lit(bounds), lambda b: b < F.col("at"))) if bounds else F.lit(0)
    return ranged.withColumn("ends", ends).withColumn("at", at).withColumn("shard", shard).drop("ends", "at")


def place(keyed: DataFrame, plan: Plan) -> DataFrame:
    """Adds shard (int) and slot (long) to rows with k, g, size; other columns ride along."""
    marked = _with_piece(keyed, plan)
    light = _placed(marked.where("piece IS NULL"), plan)
    within = F.row_number().over(W.partitionBy("r", "shard").orderBy("g", "k"))
    starts = [plan.first.get((r, s), 0) for r in range(len(plan.splitters) + 1) for s in range(plan.shards)]
    first = F.element_at(F.lit(starts), (F.col("r") * plan.shards + F.col("shard") + 1).cast("int"))
    out = light.withColumn("slot", within - 1 + first).drop("r", "piece")
    if not plan.placed:
        return out
    homes = F.broadcast(keyed.sparkSession.createDataFrame([(g, piece, shard, slot) for (g, piece), (shard, slot) in plan.placed.items()], "g long, piece int, shard int, start long"))
    in_piece = F.row_number().over(W.partitionBy("g", "piece").orderBy(*_names(keyed)))
    heavy = marked.where("piece IS NOT NULL").withColumn("within", in_piece).join(homes, ["g", "piece"]).withColumn("slot", F.col("within") - 1 + F.col("start")).drop("piece", "within", "start")
    return out.unionByName(heavy)


def assign(docs: DataFrame, shards: int, *, doc_key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with shard and slot. The plan reads key, size and hash of each row, stored once; the rows move once."""
    outputs = {"shard", "slot"}
    keep = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in outputs]
    wide = docs.select(F.struct(*keep).alias("row"), F.col(doc_key).alias("k"), group_of(F.col(text)).alias("g"), size_of(F.col(text)).alias("size"))
    narrow = stored(wide.select("k", "g", "size"))
    measured = measure(narrow, shards)
    often = repeated(narrow, shards, measured)
    told = told_apart(wide, often)
    narrow = stored(told.select("k", "g", "size", "tie")) if often else told_apart(narrow, often)
    plan = make_plan(narrow, shards, measured)
    return place(told, plan).select("row.*", F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"))


def write_shards(docs: DataFrame, shards: int, path: str, **options) -> None:
    """One folder of Parquet files for each shard."""
    assign(docs, shards, **options).write.partitionBy("shard").parquet(path)
