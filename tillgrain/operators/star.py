"""Dimensions and the fact table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tillgrain.functions.columns import month_of, week_of

def is_sale() -> Column:
    return F.col("line_type") == "sale"


def is_return() -> Column:
    return F.col("line_type") == "return"


def traded(stg: DataFrame) -> DataFrame:
    return stg.where(F.col("line_type").isin("sale", "return"))


def _first_by(df: DataFrame, key: str, *order: Column) -> DataFrame:
    return df.withColumn("pick", F.row_number().over(W.partitionBy(key).orderBy(*order))).where("pick = 1")


def dim_product(stg: DataFrame) -> DataFrame:
    """A product's name is its commonest on sale lines, then on all lines, then the first by alphabet."""
    lines = traded(stg)
    names = lines.where("description IS NOT NULL").groupBy("stock_code", "description").agg(F.count(F.when(is_sale(), 1)).alias("sold"), F.count(F.lit(1)).alias("seen"))
    named = _first_by(names, "stock_code", F.desc("sold"), F.desc("seen"), F.asc_nulls_last("description")).select("stock_code", "description")
    facts = lines.groupBy("stock_code").agg(
        F.countDistinct(F.when(is_sale(), F.col("description"))).alias("description_variants"),
        F.min(F.when(is_sale(), F.col("invoice_date"))).alias("first_sold"),
        F.max(F.when(is_sale(), F.col("invoice_date"))).alias("last_sold"),
    )
    return facts.join(named, "stock_code", "left").select("stock_code", "description", "description_variants", "first_sold", "last_sold")


def dim_customer(stg: DataFrame) -> DataFrame:
    """A customer's country is the commonest on their lines, then the first by alphabet."""
    lines = traded(stg).where("customer_id IS NOT NULL")
    seen = lines.groupBy("customer_id", "country").agg(F.count(F.lit(1)).alias("seen"))
    country = _first_by(seen, "customer_id", F.desc("seen"), F.asc_nulls_last("country")).select("customer_id", "country")
    days = lines.groupBy("customer_id").agg(F.min(F.when(is_sale(), F.col("invoice_date"))).alias("first_order_date"), F.max(F.when(is_sale(), F.col("invoice_date"))).alias("last_order_date"))
    return days.join(country, "customer_id").select("customer_id", "country", "first_order_date", "last_order_date")


def dim_date(stg: DataFrame) -> DataFrame:
    """Every day from the first to the last invoice."""
    days = stg.agg(F.min("invoice_date").alias("lo"), F.max("invoice_date").alias("hi")).where("lo IS NOT NULL").select(F.explode(F.sequence("lo", "hi", F.expr("INTERVAL 1 DAY"))).alias("date"))
    d = F.col("date")
    return days.select(d, F.year(d).cast("long").alias("year"), F.month(d).cast("long").alias("month"), month_of(d).alias("month_start"), week_of(d).alias("week_start"), (F.weekday(d) + 1).cast("long").alias("weekday"))


def fact_sales(stg: DataFrame) -> DataFrame:
    """Sale and return lines. A sale is reversed if the k-th return of the same customer, product and quantity follows the k-th
    such sale; guests and lines without a code never match."""
    lines = traded(stg)
    columns = ["line_id", "invoice", "invoice_ts", "invoice_date", "stock_code", "customer_id", "country", "quantity", "unit_price", "amount", "line_type"]
    known = lines.where("customer_id IS NOT NULL AND stock_code IS NOT NULL").withColumn("units", F.abs("quantity"))
    # one pass over the pair's lines: of the k-th sale and the k-th return, which time is later
    turn = W.partitionBy("customer_id", "stock_code", "units", "line_type").orderBy("invoice_ts", "line_id")
    pair = W.partitionBy("customer_id", "stock_code", "units", "k")
    # dealt once for both windows
    paired = known.repartition("customer_id", "stock_code", "units").withColumn("k", F.row_number().over(turn)).withColumn("returned", F.max(F.when(is_return(), F.col("invoice_ts"))).over(pair))
    reversed_ = is_sale() & F.coalesce(F.col("returned") >= F.col("invoice_ts"), F.lit(False))
    guests = lines.where("customer_id IS NULL OR stock_code IS NULL").select(*columns, F.lit(False).alias("is_reversed"))
    return paired.select(*columns, reversed_.alias("is_reversed")).unionByName(guests)
