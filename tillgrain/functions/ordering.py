"""Numbering rows in a total order without bringing them all to one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tillgrain.session import stored

#: Rows of one range are numbered by their place in it; this many bits of the generated id are the place.
_BITS = 33


def _in_ranges(df: DataFrame, order: list[Column | str]) -> tuple[DataFrame, Column]:
    """The rows sorted by ranges, stored, with a generated _id; and the range of a row."""
    ranged = stored(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()))
    return ranged, F.shiftright("_id", _BITS).cast("int")


def _before(totals: dict[int, float | int | None]) -> Column:
    """By range, the total of all ranges before it. There are as many ranges as partitions."""
    starts, at = [], 0
    for p in range(max(totals) + 1):
        starts.append(at)
        at += totals.get(p) or 0
    return F.lit(starts)


def numbered(df: DataFrame, order: list[Column | str], name: str) -> DataFrame:
    """Adds 1, 2, 3, ... in the given order. Rows are sorted by ranges, ranges are counted, and each range starts after those
    before it. The order must be total, else equal rows may swap numbers."""
    ranged, part = _in_ranges(df, order)
    sizes = dict(tuple(r) for r in ranged.groupBy(part.alias("p")).count().collect())
    if not sizes:
        return ranged.withColumn(name, F.lit(0).cast("long")).drop("_id")
    start = F.element_at(_before(sizes), part + 1)
    return ranged.withColumn(name, (start + F.col("_id").bitwiseAND((1 << _BITS) - 1) + 1).cast("long")).drop("_id")


def accumulated(df: DataFrame, order: list[Column | str], sums: dict[str, str]) -> DataFrame:
    """Adds running sums of whole-number columns (new name: column) in the given order, each row's own value included."""
    ranged, part = _in_ranges(df, order)
    totals = {r.p: r for r in ranged.groupBy(part.alias("p")).agg(*(F.sum(c).alias(name) for name, c in sums.items())).collect()}
    within = W.partitionBy("_part").orderBy("_id").rowsBetween(W.unboundedPreceding, 0)
    out = ranged.withColumn("_part", part)
    for name, c in sums.items():
        before = F.element_at(_before({p: r[name] for p, r in totals.items()}), F.col("_part") + 1) if totals else F.lit(0)
        out = out.withColumn(name, (F.sum(c).over(within) + before).cast("long"))
    return out.drop("_id", "_part")


def tile(number: Column, rows: int, tiles: int) -> Column:
    """The tile of a row by its number (from 1): sizes differ by one at most, the larger tiles come first."""
    size, more = divmod(rows, tiles)
    edge = more * (size + 1)
    later = more + F.floor((number - edge - 1) / max(size, 1)) + 1
    return F.when(number <= edge, F.floor((number - 1) / (size + 1)) + 1).otherwise(later).cast("long")
