"""Descriptive analytics over marts and facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tillgrain.functions.columns import money, ratio
from tillgrain.functions.ordering import accumulated
from tillgrain.operators.star import is_return, is_sale

SEGMENTS = ["Champions", "Loyal", "Promising", "New", "At risk", "Lost"]
MAX_OFFSET = 12


def overview_totals(fact: DataFrame) -> DataFrame:
    sold = F.when(is_sale(), F.col("amount"))
    totals = fact.agg(
        money(sold).alias("gross_sales"),
        (-money(F.when(is_return(), F.col("amount")))).alias("returned_value"),
        money(F.col("amount")).alias("net_sales"),
        F.countDistinct(F.when(is_sale(), F.col("invoice"))).alias("orders"),
        F.countDistinct("customer_id").alias("customers"),
        F.countDistinct(F.when(is_sale(), F.col("stock_code"))).alias("products"),
        F.sum(F.when(is_sale(), F.col("quantity"))).alias("units"),
        F.countDistinct("country").alias("countries"),
        ratio(money(F.when(F.col("country") != "United Kingdom", sold)), money(sold)).alias("export_share"),
    )
    return totals.withColumn("average_order_value", ratio(F.col("gross_sales"), F.col("orders")))


def country_share(mart_country: DataFrame, top: int = 10) -> DataFrame:
    total = mart_country.agg(money(F.col("revenue")).alias("total"))
    shared = mart_country.crossJoin(F.broadcast(total)).select("country", "revenue", "orders", "customers", ratio(F.col("revenue"), F.col("total")).alias("share"))
    return shared.orderBy(F.desc_nulls_last("revenue"), "country").limit(top)


def top_products(mart_product: DataFrame, top: int = 10) -> DataFrame:
    """Best sellers by revenue, without those of which half or more was reversed."""
    kept = mart_product.where("units_reversed < 0.5 * units_sold")
    return kept.orderBy(F.desc_nulls_last("revenue"), "stock_code").limit(top).select("stock_code", "description", "revenue", "units_sold", "orders")


def weekdays(fact: DataFrame, dim_date: DataFrame) -> DataFrame:
    sales = fact.where(is_sale()).join(dim_date.select(F.col("date").alias("invoice_date"), "weekday"), "invoice_date")
    return sales.groupBy("weekday").agg(money(F.col("amount")).alias("revenue"), F.countDistinct("invoice").alias("orders"))


def return_summary(fact: DataFrame) -> DataFrame:
    def of(kind: Column, c: str) -> Column:
        return F.when(kind, F.col(c))

    lines = F.count(of(is_return(), "line_id"))
    return fact.agg(
        ratio(-money(of(is_return(), "amount")), money(of(is_sale(), "amount"))).alias("value_rate"),
        ratio(-F.sum(of(is_return(), "quantity")), F.sum(of(is_sale(), "quantity"))).alias("unit_rate"),
        lines.alias("return_lines"),
        F.countDistinct(of(is_return(), "invoice")).alias("return_orders"),
        ratio(lines, F.count(of(is_sale(), "line_id"))).alias("line_rate"),
        F.count(F.when(F.col("is_reversed"), 1)).alias("reversed_lines"),
        ratio(F.count(F.when(F.col("is_reversed"), 1)), lines).alias("full_reversal_share"),
    )


def return_monthly(mart_monthly: DataFrame) -> DataFrame:
    return mart_monthly.select("month", "returned_value", ratio(F.col("returned_value"), F.col("revenue")).alias("value_rate"))


def return_by_product(mart_product: DataFrame, least_lines: int = 300, top: int = 12) -> DataFrame:
    """By lines rather than units, which a few cancelled bulk orders would swamp."""
    rated = mart_product.where(F.col("sale_lines") >= least_lines).select("stock_code", "description", "sale_lines", "return_lines", ratio(F.col("return_lines"), F.col("sale_lines")).alias("line_rate"), "returned_value")
    return rated.orderBy(F.desc_nulls_last("line_rate"), "stock_code").limit(top)


def return_by_country(mart_country: DataFrame, least_orders: int = 80) -> DataFrame:
    return mart_country.where(F.col("orders") >= least_orders).select("country", "orders", "revenue", "returned_value", ratio(F.col("returned_value"), F.col("revenue")).alias("value_rate"))


def days_to_return(fact: DataFrame) -> DataFrame:
    """For reversed sales: days until the first return of the same customer, product and quantity, in classes."""
    sales = fact.where("is_reversed").select("line_id", "customer_id", "stock_code", F.col("quantity").alias("units"), "invoice_ts", "invoice_date")
    back = fact.where(is_return()).select("customer_id", "stock_code", (-F.col("quantity")).alias("units"), F.col("invoice_ts").alias("at"), F.col("invoice_date").alias("day"))
    pairs = sales.join(back, ["customer_id", "stock_code", "units"]).where("at >= invoice_ts").groupBy("line_id", "invoice_date").agg(F.min("day").alias("day"))
    days = F.datediff("day", "invoice_date")
    bucket = F.when(days == 0, "Same day").when(days <= 7, "1-7 days").when(days <= 30, "8-30 days").when(days <= 90, "31-90 days").otherwise("Over 90 days")
    return pairs.groupBy(bucket.alias("bucket")).agg(F.min(days).cast("long").alias("first_day"), F.count(F.lit(1)).alias("lines"))


def segments(rfm: DataFrame) -> DataFrame:
    """In a fixed order (position), with shares of customers and revenue."""
    n = F.col("customers")
    sums = rfm.groupBy("segment").agg(F.count(F.lit(1)).alias("customers"), money(F.col("monetary")).alias("revenue"), F.sum("recency_days").alias("days"), F.sum("frequency").alias("all_orders"))
    everyone = W.partitionBy()  # six rows
    total = F.sum(F.col("revenue").cast("decimal(28,2)")).over(everyone).cast("double")
    order = F.array(*map(F.lit, SEGMENTS))
    return sums.select(
        "segment",
        F.array_position(order, F.col("segment")).cast("long").alias("position"),
        "customers",
        "revenue",
        ratio(F.col("days"), n).alias("recency_days"),
        ratio(F.col("all_orders"), n).alias("orders"),
        ratio(F.col("revenue"), n).alias("value"),
        ratio(n, F.sum(n).over(everyone)).alias("customer_share"),
        ratio(F.col("revenue"), total).alias("revenue_share"),
    )


def retention(cohort: DataFrame) -> DataFrame:
    size = F.max(F.when(F.col("month_offset") == 0, F.col("customers"))).over(W.partitionBy("cohort"))
    return cohort.withColumn("size", size).select("cohort", "month_offset", "customers", "size", ratio(F.col("customers"), F.col("size")).alias("retention"))


def retention_matrix(cohort: DataFrame, most: int = MAX_OFFSET) -> DataFrame:
    wide = retention(cohort).where(F.col("month_offset") <= most).groupBy("cohort", "size").pivot("month_offset", list(range(most + 1))).agg(F.first("retention"))
    return wide.select("cohort", "size", *[F.col(str(i)).alias(f"m{i}") for i in range(most + 1)])


def later_retention(cohort: DataFrame, offset: int) -> DataFrame:
    """Mean retention at an offset over cohorts after the first, which also holds everyone who was active before the data begin."""
    first = cohort.agg(F.min("cohort").alias("first"))
    later = retention(cohort).where(F.col("month_offset") == offset).crossJoin(F.broadcast(first)).where("cohort > first")
    return later.agg(F.avg("retention").alias("retention"), F.count(F.lit(1)).alias("cohorts"))


def top_share(rfm: DataFrame, share: float = 0.2) -> DataFrame:
    """Share of the customers whose percent rank by spend is below ``share``; equal spends have one rank."""
    spends = rfm.groupBy("monetary").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("monetary").cast("decimal(18,2)")).alias("cash"))
    ranked = accumulated(spends, [F.desc("monetary")], {"seen": "n"})
    rows = F.broadcast(rfm.agg(F.count(F.lit(1)).alias("rows")))
    rank = F.coalesce(ratio(F.col("seen") - F.col("n"), F.col("rows") - 1), F.lit(0.0))
    return ranked.crossJoin(rows).agg(ratio(F.sum(F.when(rank < share, F.col("cash"))).cast("double"), F.sum("cash").cast("double")).alias("top_share"))


def customer_summary(rfm: DataFrame) -> DataFrame:
    return rfm.agg(
        F.count(F.lit(1)).alias("customers"),
        ratio(F.count(F.when(F.col("frequency") >= 2, 1)), F.count(F.lit(1))).alias("repeat_rate"),
        F.median("monetary").alias("median_value"),
        F.median(F.col("frequency").cast("double")).alias("median_orders"),
    )


def top_markets(mart_country: DataFrame, top: int = 8) -> DataFrame:
    """The largest markets outside the United Kingdom."""
    return mart_country.where("country <> 'United Kingdom'").orderBy(F.desc_nulls_last("revenue"), "country").limit(top).select("country", "revenue")
