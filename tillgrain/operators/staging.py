"""Staged invoice lines: typed, one copy of what two sheets publish, classified."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillgrain.functions.ordering import numbered

PRODUCT_CODE = r"\A[0-9]{5}[A-Z]{0,2}\z"


def typed(raw: DataFrame) -> DataFrame:
    return raw.select(
        "sheet",
        "row_no",
        F.trim("invoice").alias("invoice"),
        F.upper(F.trim("stock_code")).alias("stock_code"),
        F.nullif(F.trim("description"), F.lit("")).alias("description"),
        F.col("quantity").cast("int").alias("quantity"),
        F.col("invoice_ts").cast("timestamp_ntz").alias("invoice_ts"),
        F.col("price").cast("double").alias("unit_price"),
        F.col("customer_id").cast("int").alias("customer_id"),
        F.trim("country").alias("country"),
    )


def without_overlap(lines: DataFrame) -> DataFrame:
    """Lines of sheet 1 from the start of sheet 2 on go. A line without a time stays; without a sheet 2 all stay."""
    start = lines.where("sheet = 2").agg(F.min("invoice_ts").alias("start"))  # one row
    repeated = (F.col("sheet") == 1) & (F.col("invoice_ts") >= F.col("start"))
    return lines.crossJoin(F.broadcast(start)).where(~F.coalesce(repeated, F.lit(False))).drop("start")


def line_type() -> Column:
    """First match wins. Null codes and prices count as no match, so such lines are adjustments."""
    cancelled, units, price = F.col("invoice").startswith("C"), F.col("quantity"), F.col("unit_price")
    return (
        F.when(~F.col("stock_code").rlike(PRODUCT_CODE), "non_product")
        .when(cancelled & (units < 0) & (price > 0), "return")
        .when(~cancelled & (units > 0) & (price > 0), "sale")
        .otherwise("adjustment")
    )


def classified(lines: DataFrame) -> DataFrame:
    return lines.withColumns({"invoice_date": F.to_date("invoice_ts"), "amount": F.col("quantity") * F.col("unit_price"), "line_type": line_type()})


def stage(raw: DataFrame) -> DataFrame:
    """line_id numbers what is left by sheet and row."""
    lines = numbered(classified(without_overlap(typed(raw))), ["sheet", "row_no"], "line_id")
    return lines.select("line_id", *[c for c in lines.columns if c not in ("sheet", "row_no", "line_id")])
