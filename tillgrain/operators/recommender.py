"""What is bought together: item-to-item cosine similarity over order baskets."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tillgrain.functions.columns import ratio
from tillgrain.operators import holdout
from tillgrain.session import stored

MIN_ITEM_ORDERS = 20
MAX_BASKET = 100
TOP_K = (5, 10)
NEIGHBOURS = 20


def baskets(mart_basket: DataFrame, most: int = MAX_BASKET) -> DataFrame:
    """Orders of two or more products; larger ones than ``most`` are restocks that link everything to everything. The bound also
    holds the pairs of an order to most^2."""
    sized = mart_basket.select("invoice", "invoice_date", "stock_code", F.count(F.lit(1)).over(W.partitionBy("invoice")).alias("basket_size"))
    return sized.where((F.col("basket_size") >= 2) & (F.col("basket_size") <= most))


def item_counts(frame: DataFrame, min_orders: int = MIN_ITEM_ORDERS) -> DataFrame:
    """Lines are dealt by order already, so that only counts are shuffled."""
    return frame.select("invoice", "stock_code").distinct().groupBy("stock_code").agg(F.count("invoice").alias("item_orders")).where(F.col("item_orders") >= min_orders)


def linked(frame: DataFrame, items: DataFrame) -> DataFrame:
    """invoice, stock_code, item_orders of the orders with two of the items or more: all pairs come from these."""
    kept = frame.select("invoice", "stock_code").distinct().join(F.broadcast(items), "stock_code")
    return kept.withColumn("known", F.count(F.lit(1)).over(W.partitionBy("invoice"))).where("known >= 2").drop("known")


def similarity_of(lines: DataFrame, some: DataFrame) -> DataFrame:
    """``similarity`` for the few products of ``some`` alone, from ``linked`` lines: only orders that hold one of them are paired."""
    own = lines.join(F.broadcast(some.select("stock_code", F.lit(True).alias("wanted"))), "stock_code", "left")
    near = own.withColumn("any", F.max("wanted").over(W.partitionBy("invoice"))).where("any").groupBy("invoice").agg(F.collect_list(F.struct("stock_code", "item_orders", "wanted")).alias("x"))
    pairs = near.select("x", F.explode("x").alias("a")).where("a.wanted").select("a", F.explode("x").alias("b")).where("a.stock_code != b.stock_code")
    together = pairs.groupBy(F.col("a.stock_code").alias("stock_code"), F.col("b.stock_code").alias("neighbour")).agg(F.count(F.lit(1)).alias("orders_together"), F.first("a.item_orders").alias("a"), F.first("b.item_orders").alias("b"))
    return together.select("stock_code", "neighbour", "orders_together", (F.col("orders_together") / F.sqrt(F.col("a") * F.col("b"))).alias("similarity"))


def similarity(frame: DataFrame, min_orders: int = MIN_ITEM_ORDERS) -> DataFrame:
    """Both directions of each pair: stock_code, neighbour, orders_together, similarity."""
    items = item_counts(frame, min_orders)
    kept = frame.select("invoice", "stock_code").distinct().join(items, "stock_code")
    other = kept.select("invoice", F.col("stock_code").alias("neighbour"), F.col("item_orders").alias("neighbour_orders"))
    # each pair is counted once, then told to both
    pairs = kept.join(other, "invoice").where("stock_code < neighbour")
    together = pairs.groupBy("stock_code", "neighbour").agg(F.count(F.lit(1)).alias("orders_together"), F.first("item_orders").alias("a"), F.first("neighbour_orders").alias("b"))
    both = F.explode(F.array(F.struct(F.col("stock_code").alias("x"), F.col("neighbour").alias("y")), F.struct(F.col("neighbour").alias("x"), F.col("stock_code").alias("y"))))
    told = together.select(both.alias("pair"), "orders_together", (F.col("orders_together") / F.sqrt(F.col("a") * F.col("b"))).alias("similarity"))
    return told.select(F.col("pair.x").alias("stock_code"), F.col("pair.y").alias("neighbour"), "orders_together", "similarity")


def neighbours(pairs: DataFrame, top: int = NEIGHBOURS) -> DataFrame:
    """Each product's closest, ties by code."""
    rank = F.row_number().over(W.partitionBy("stock_code").orderBy(F.desc("similarity"), "neighbour")).cast("long")
    ranked = pairs.withColumn("rank", rank).where(F.col("rank") <= top)
    return ranked.select("stock_code", "neighbour", "rank", F.round("similarity", 4).alias("similarity"), "orders_together").where("similarity > 0")


def recommend(pairs: DataFrame, basket: list[str], k: int = 10) -> DataFrame:
    """Products by summed similarity to the basket, without the basket's own."""
    scores = pairs.where(F.col("stock_code").isin(basket) & ~F.col("neighbour").isin(basket)).groupBy(F.col("neighbour").alias("stock_code")).agg(F.sum("similarity").alias("score"))
    return scores.where("score > 0").orderBy(F.desc("score"), "stock_code").limit(k)


def hit_rates(ranked: DataFrame, ks: tuple[int, ...] = TOP_K) -> DataFrame:
    """By model, from one pass over the ranks."""
    def of(c: str) -> Column:
        n = F.count(F.lit(1))
        hits = [ratio(F.count(F.when(F.col(c) < k, 1)), n).alias(f"hit_rate_at_{k}") for k in ks]
        return F.struct(n.alias("test_baskets"), *hits, F.avg(1 / (F.col(c) + 1)).alias("mean_reciprocal_rank"))

    both = ranked.agg(of("by_similarity").alias("a"), of("by_popularity").alias("b"))
    rows = F.array(F.struct(F.col("a").alias("v"), F.lit("item similarity").alias("model")), F.struct(F.col("b").alias("v"), F.lit("best sellers").alias("model")))
    return both.select(F.explode(rows).alias("r")).select("r.v.*", "r.model")


def evaluate(mart_basket: DataFrame, test_from: date, min_orders: int = MIN_ITEM_ORDERS) -> DataFrame:
    return hit_rates(holdout.ranks(stored(holdout.gathered(mart_basket, test_from, MAX_BASKET)), min_orders))
