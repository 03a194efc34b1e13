"""Checks that every build must pass, and a profile of what cleaning did."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillgrain.functions.columns import money
from tillgrain.operators.star import is_return, is_sale

OVERLAP = ("2010-12-01", "2010-12-09")


def _count(df: DataFrame, name: str, failed: Column | None = None) -> DataFrame:
    return (df if failed is None else df.where(failed)).agg(F.count(F.lit(1)).alias("failures")).select(F.lit(name).alias("check_name"), "failures")


def _close(name: str, left: DataFrame, right: DataFrame) -> DataFrame:
    """1 if two one-row sums differ by more than a penny."""
    pair = left.select(F.coalesce(F.col("v"), F.lit(0.0)).alias("a")).crossJoin(right.select(F.coalesce(F.col("v"), F.lit(0.0)).alias("b")))
    return pair.select(F.lit(name).alias("check_name"), (F.abs(F.col("a") - F.col("b")) > 0.01).cast("long").alias("failures"))


def checks(raw: DataFrame, stg: DataFrame, fact: DataFrame, dim_product: DataFrame, dim_customer: DataFrame, dim_date: DataFrame, monthly: DataFrame, product: DataFrame, overlap: tuple[str, str] = OVERLAP) -> DataFrame:
    """check_name and failures of twelve checks; each must be 0. ``overlap``: the days that two sheets publish."""
    facts = fact.agg(
        *(
            F.count(F.when(failed, 1)).alias(name)
            for name, failed in {
                "fact_sales has no missing keys": F.col("invoice").isNull() | F.col("stock_code").isNull() | F.col("invoice_date").isNull(),
                "sale lines have positive quantity and amount": is_sale() & ((F.col("quantity") <= 0) | (F.col("amount") <= 0)),
                "return lines have negative quantity and amount": is_return() & ((F.col("quantity") >= 0) | (F.col("amount") >= 0)),
                "only sale lines are marked as reversed": F.col("is_reversed") & ~is_sale(),
            }.items()
        )
    )
    one_pass = facts.unpivot([], facts.columns, "check_name", "failures")  # four checks, one scan
    sold = fact.where(is_sale()).agg(money(F.col("amount")).alias("v"))
    days = F.col("invoice_date").between(*(F.lit(d).cast("date") for d in overlap))
    raw_days = F.to_date("invoice_ts").between(*(F.lit(d).cast("date") for d in overlap))
    lines, staged = fact.agg(F.count(F.lit(1)).alias("a")), stg.where(F.col("line_type").isin("sale", "return")).agg(F.count(F.lit(1)).alias("b"))
    parts = [
        one_pass,
        _count(fact.join(dim_product, "stock_code", "left_anti"), "every fact product exists in dim_product"),
        _count(fact.where("customer_id IS NOT NULL").join(dim_customer, "customer_id", "left_anti"), "every fact customer exists in dim_customer"),
        dim_product.agg((F.count(F.lit(1)) - F.countDistinct("stock_code")).alias("failures")).select(F.lit("dim_product has one row per stock code").alias("check_name"), "failures"),
        _close("monthly revenue reconciles with the fact table", monthly.agg(money(F.col("revenue")).alias("v")), sold),
        _close("product revenue reconciles with the fact table", product.agg(money(F.col("revenue")).alias("v")), sold),
        _count(fact.join(dim_date.select(F.col("date").alias("invoice_date")), "invoice_date", "left_anti"), "no invoice date falls outside dim_date"),
        _close("the overlapping week is counted exactly once", stg.where(days).agg(money(F.col("amount")).alias("v")), raw.where("sheet = 2").where(raw_days).agg(money(F.col("quantity") * F.col("price")).alias("v"))),
        lines.crossJoin(staged).select(F.lit("fact_sales has one row per staged sale or return line").alias("check_name"), F.abs(F.col("a") - F.col("b")).alias("failures")),
    ]
    return reduce(DataFrame.unionByName, parts)


def must_pass(result: DataFrame) -> None:
    failed = {r.check_name: r.failures for r in result.where("failures > 0").collect()}
    if failed:
        raise ValueError(f"quality checks failed: {failed}")


def repeated_lines(fact: DataFrame) -> DataFrame:
    """How many lines repeat an identical one; they are kept."""
    groups = fact.groupBy("invoice", "stock_code", "quantity", "unit_price", "invoice_ts", "customer_id").agg(F.count(F.lit(1)).alias("n"))
    return groups.where("n > 1").agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("repeated"))


def profile(raw: DataFrame, stg: DataFrame, fact: DataFrame) -> DataFrame:
    """One row of counts: each table is read once."""
    a = raw.agg(F.count(F.lit(1)).alias("raw_rows"))
    b = stg.agg(F.count(F.lit(1)).alias("staged_rows"), *(F.count(F.when(F.col("line_type") == t, 1)).alias(f"{t}_rows") for t in ("adjustment", "non_product", "return", "sale")))
    sold, guest = F.when(is_sale(), F.col("amount")), F.col("customer_id").isNull()
    c = fact.agg(
        F.count(F.lit(1)).alias("fact_rows"),
        F.count(F.when(guest, 1)).alias("lines_without_customer"),
        (money(F.when(guest, sold)) / money(sold)).alias("revenue_share_without_customer"),
        F.count(F.when(F.col("is_reversed"), 1)).alias("reversed_sale_lines"),
        F.coalesce(F.sum(F.when(F.col("is_reversed"), F.col("quantity"))), F.lit(0)).alias("reversed_units"),
        F.min("invoice_date").alias("first_date"),
        F.max("invoice_date").alias("last_date"),
    )
    return a.crossJoin(b).crossJoin(c).crossJoin(repeated_lines(fact)).withColumn("overlap_rows_removed", F.col("raw_rows") - F.col("staged_rows"))
