"""Exact ranking and forecast metrics as aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillgrain.functions.columns import ratio
from tillgrain.functions.ordering import accumulated, numbered


def ranking(df: DataFrame, score: Column, label: str, key: str, probability: bool = False) -> DataFrame:
    """One row: roc_auc (ties count half), average_precision, top_decile_rate, top_decile_lift, and brier for probabilities.

    Rows are first counted by score, so that the running sums go over distinct scores. No step sees all rows in one task.
    """
    rows = df.select(score.alias("s"), F.col(label).cast("long").alias("y"), F.col(key).alias("k"))
    groups = rows.groupBy("s").agg(F.sum("y").alias("pos"), F.count(F.lit(1)).alias("n"))
    steps = accumulated(groups, [F.desc("s")], {"tp": "pos", "seen": "n"})
    totals = rows.agg(F.sum("y").alias("all_pos"), F.count(F.lit(1)).alias("all_n"), F.sum((F.col("y") - F.col("s")) * (F.col("y") - F.col("s"))).alias("off"))
    neg = F.col("n") - F.col("pos")
    # a negative is outranked by the positives before it, and by half of those with its score
    curve = steps.agg(F.sum(neg * (2 * F.col("tp") - F.col("pos"))).alias("pairs"), F.sum(ratio(F.col("tp"), F.col("seen")) * F.col("pos")).alias("precision"))
    best = numbered(rows, [F.desc("s"), "k"], "place").crossJoin(F.broadcast(totals.select("all_n"))).where(F.col("place") <= F.greatest(F.lit(1), F.expr("all_n div 10"))).agg(ratio(F.sum("y"), F.count(F.lit(1))).alias("top"))
    one = curve.crossJoin(totals).crossJoin(best)
    out = [
        ratio(F.col("pairs"), 2 * F.col("all_pos") * (F.col("all_n") - F.col("all_pos"))).alias("roc_auc"),
        ratio(F.col("precision"), F.col("all_pos")).alias("average_precision"),
        F.col("top").alias("top_decile_rate"),
        ratio(F.col("top"), ratio(F.col("all_pos"), F.col("all_n"))).alias("top_decile_lift"),
    ]
    return one.select(*out, *([ratio(F.col("off"), F.col("all_n")).alias("brier")] if probability else []))


def wape(actual: Column, forecast: Column) -> Column:
    """Total absolute error over total demand; rows without either don't count."""
    both = actual.isNotNull() & forecast.isNotNull()
    return ratio(F.sum(F.when(both, F.abs(forecast - actual))), F.sum(F.when(both, actual)))


def bias(actual: Column, forecast: Column) -> Column:
    both = actual.isNotNull() & forecast.isNotNull()
    return ratio(F.sum(F.when(both, forecast - actual)), F.sum(F.when(both, actual)))


def grouped_auc(df: DataFrame, groups: list[str], score: str, label: str) -> DataFrame:
    """roc_auc of each group, for many groups at once: the scores of all groups are put in one order, group by group."""
    steps = df.groupBy(*groups, F.col(score).alias("s")).agg(F.sum(F.col(label).cast("long")).alias("pos"), F.count(F.lit(1)).alias("n"))
    run = accumulated(steps, [*groups, F.desc("s")], {"tp": "pos"})
    # the running sum goes on from group to group; what a group begins with is the same for all its rows
    neg = F.col("n") - F.col("pos")
    sums = run.groupBy(*groups).agg(F.sum(neg * (2 * F.col("tp") - F.col("pos"))).alias("pairs"), F.sum("pos").alias("p"), F.sum(neg).alias("q"), F.min(F.col("tp") - F.col("pos")).alias("begun"))
    return sums.select(*groups, ratio(F.col("pairs") - 2 * F.col("begun") * F.col("q"), 2 * F.col("p") * F.col("q")).alias("roc_auc"))
