"""Marts over the fact table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tillgrain.functions.columns import money, month_of, months_between, week_of
from tillgrain.functions.ordering import numbered, tile
from tillgrain.operators.star import is_return, is_sale


def _sold(c: str) -> Column:
    return F.when(is_sale(), F.col(c))


def _returned(c: str) -> Column:
    return F.when(is_return(), F.col(c))


def _returned_value() -> Column:
    return F.coalesce(-money(_returned("amount")), F.lit(0.0))


def monthly(fact: DataFrame) -> DataFrame:
    return fact.groupBy(month_of(F.col("invoice_date")).alias("month")).agg(
        money(_sold("amount")).alias("revenue"),
        F.countDistinct(_sold("invoice")).alias("orders"),
        F.countDistinct(_sold("customer_id")).alias("customers"),
        F.sum(_sold("quantity")).alias("units"),
        _returned_value().alias("returned_value"),
    )


def country(fact: DataFrame) -> DataFrame:
    return fact.groupBy("country").agg(
        money(_sold("amount")).alias("revenue"), F.countDistinct(_sold("invoice")).alias("orders"), F.countDistinct("customer_id").alias("customers"), _returned_value().alias("returned_value")
    )


def product(fact: DataFrame, dim_product: DataFrame) -> DataFrame:
    sums = fact.groupBy("stock_code").agg(
        money(_sold("amount")).alias("revenue"),
        F.sum(_sold("quantity")).alias("units_sold"),
        F.countDistinct(_sold("invoice")).alias("orders"),
        F.coalesce(-F.sum(_returned("quantity")), F.lit(0)).alias("units_returned"),
        _returned_value().alias("returned_value"),
        F.median(_sold("unit_price")).alias("median_price"),
        F.coalesce(F.sum(F.when(F.col("is_reversed"), F.col("quantity"))), F.lit(0)).alias("units_reversed"),
        F.count(_sold("line_id")).alias("sale_lines"),
        F.count(_returned("line_id")).alias("return_lines"),
    )
    named = dim_product.select("stock_code", "description")
    return sums.join(named, "stock_code").select("stock_code", "description", *[c for c in sums.columns if c != "stock_code"])


def customer_rfm(fact: DataFrame) -> DataFrame:
    """Quintile scores of recency, frequency and net spend; ties by customer."""
    end = fact.agg(F.date_add(F.max("invoice_date"), 1).alias("end"))
    base = (
        fact.where("customer_id IS NOT NULL")
        .groupBy("customer_id")
        .agg(F.max(_sold("invoice_date")).alias("last"), F.countDistinct(_sold("invoice")).alias("frequency"), money(F.col("amount")).alias("monetary"), F.count(F.when(is_sale(), 1)).alias("sales"))
        .where("sales > 0")
        .crossJoin(F.broadcast(end))
        .select("customer_id", F.datediff("end", "last").cast("long").alias("recency_days"), "frequency", "monetary")
    )

    scored, fifths = base, []
    for score, measure in (("r", "recency_days"), ("f", "frequency"), ("m", "monetary")):
        scored = numbered(scored, [measure, "customer_id"], score)
    rows = scored.count()
    for score in ("r", "f", "m"):
        fifth = tile(F.col(score), rows, 5)
        fifths.append((6 - fifth if score == "r" else fifth).alias(score))
    scored = scored.select("customer_id", "recency_days", "frequency", "monetary", *fifths)
    r, value = F.col("r"), F.col("f") + F.col("m")
    segment = (
        F.when((r >= 4) & (value >= 8), "Champions")
        .when((r == 3) & (value >= 8), "Loyal")
        .when((r >= 4) & (value <= 3), "New")
        .when(r >= 3, "Promising")
        .when(value >= 6, "At risk")
        .otherwise("Lost")
    )
    return scored.withColumn("segment", segment)


def cohort(fact: DataFrame) -> DataFrame:
    active = fact.where(is_sale() & F.col("customer_id").isNotNull()).select("customer_id", month_of(F.col("invoice_date")).alias("month")).distinct()
    joined = active.withColumn("cohort", F.min("month").over(W.partitionBy("customer_id")))
    return joined.groupBy("cohort", months_between(F.col("cohort"), F.col("month")).alias("month_offset")).agg(F.count(F.lit(1)).alias("customers"))


def product_weekly(fact: DataFrame) -> DataFrame:
    """Demand: reversed sales don't count."""
    kept = fact.where(is_sale() & ~F.col("is_reversed"))
    return kept.groupBy(week_of(F.col("invoice_date")).alias("week_start"), "stock_code").agg(F.sum("quantity").alias("units"), money(F.col("amount")).alias("revenue"), F.countDistinct("invoice").alias("orders"))


def demand(fact: DataFrame) -> DataFrame:
    """``product_weekly`` without revenue."""
    kept = fact.where(is_sale() & ~F.col("is_reversed"))
    return kept.groupBy(week_of(F.col("invoice_date")).alias("week_start"), "stock_code").agg(F.sum("quantity").alias("units"), F.countDistinct("invoice").alias("orders"))


def basket(fact: DataFrame) -> DataFrame:
    """Dealt by order once: what is asked of whole orders after needs no other shuffle."""
    return fact.where(is_sale()).select("invoice", "invoice_date", "customer_id", "stock_code").repartition("invoice").distinct()
