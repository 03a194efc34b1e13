"""Raw invoice lines: the published schema, and an adapter that makes such lines of an order database."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillgrain.functions.columns import pence
from tillgrain.functions.ordering import numbered
from tillgrain.session import table

RAW = T.StructType(
    [
        T.StructField("sheet", T.IntegerType()),
        T.StructField("row_no", T.LongType()),
        T.StructField("invoice", T.StringType()),
        T.StructField("stock_code", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("quantity", T.IntegerType()),
        T.StructField("invoice_ts", T.TimestampNTZType()),
        T.StructField("price", T.DoubleType()),
        T.StructField("customer_id", T.IntegerType()),
        T.StructField("country", T.StringType()),
    ]
)

#: Keys of so many parts at most (8 bytes each) are sent to all tasks; of more, lines are dealt by part.
BROADCAST_PARTS = 1 << 21
FIRST_OF_SHEET_2, END_OF_SHEET_1 = "1998-05-01", "1998-05-10"


def _shifted(ts: Column, hours: Column, days: Column) -> Column:
    return F.timestamp_seconds(F.unix_timestamp(ts.cast("timestamp")) + hours * 3600 + days * 86400).cast("timestamp_ntz")


def lines_of_orders(spark: SparkSession, folder: str, described: bool = True) -> DataFrame:
    """Invoice lines with a sheet, without numbers: one sale line for each order line, one return line for each returned one of
    every fourth part. Nine days are published in both sheets. Lines are dealt by ``order``. Not ``described``: without descriptions."""
    o, p, c, n = (table(spark, folder, t) for t in ("orders", "part", "customer", "nation"))
    # orders find their country before they meet lines, so that lines are dealt by order and by part only
    placed = (
        o.select("o_orderkey", "o_custkey", "o_orderdate")
        .join(c.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
        .join(F.broadcast(n.select("n_nationkey", "n_name")), F.col("c_nationkey") == F.col("n_nationkey"))
        .select("o_orderkey", "o_custkey", "o_orderdate", "n_name")
    )
    parts = p.select("p_partkey", "p_name") if described else p.select("p_partkey")
    if not described and p.count() <= BROADCAST_PARTS:
        parts = F.broadcast(parts)
    lines = table(spark, folder, "lineitem").join(parts, F.col("l_partkey") == F.col("p_partkey")).join(placed, F.col("l_orderkey") == F.col("o_orderkey"))
    part, supplier, customer, units = F.col("l_partkey"), F.col("l_suppkey"), F.col("o_custkey"), F.col("l_quantity").cast("int")
    price = pence(F.col("l_extendedprice") / F.col("l_quantity"))
    suffix = F.when(part % 3 == 0, "").when(part % 3 == 1, "a ").otherwise("BL")
    name = F.col("p_name")
    description = F.when(supplier % 11 == 0, F.lit(None)).when(supplier % 13 == 0, "  ").when(supplier % 7 == 0, F.upper(name)).otherwise(F.concat(F.lit(" "), name))
    shared = [
        F.when(part % 97 == 0, "POST").otherwise(F.concat(F.lpad(part.cast("string"), 5, "0"), suffix)).alias("stock_code"),
        (description if described else F.lit(None).cast("string")).alias("description"),
        F.when(customer % 5 != 0, customer.cast("int")).alias("customer_id"),
        F.when((F.col("n_name") == "NATION_0") | (customer % 2 == 0), "United Kingdom").when(supplier % 17 == 0, "NATION_1").otherwise(F.col("n_name")).alias("country"),
        F.col("l_linenumber").alias("line"),
        F.col("l_orderkey").alias("order"),
    ]
    hours = 8 + F.col("l_linenumber")
    sale = F.struct(
        (500000 + F.col("l_orderkey")).cast("string").alias("invoice"),
        units.alias("quantity"),
        _shifted(F.col("o_orderdate"), hours, F.lit(0)).alias("invoice_ts"),
        F.when((part % 101 == 0) & (F.col("l_linestatus") == "O"), 0.0).otherwise(price).alias("price"),
    )
    back = F.struct(
        F.concat(F.lit("C"), (700000 + F.col("l_orderkey")).cast("string")).alias("invoice"),
        F.when(F.col("l_linestatus") == "F", -units).otherwise(-F.greatest(F.lit(1), units - 3)).alias("quantity"),
        _shifted(F.col("o_orderdate"), hours, part % 120).alias("invoice_ts"),
        price.alias("price"),
    )
    both = F.when((F.col("l_returnflag") == "R") & (part % 4 == 0), F.array(sale, back)).otherwise(F.array(sale))
    rows = lines.select(*shared, F.explode(both).alias("x")).select("x.*", "stock_code", "description", "customer_id", "country", "line", "order")
    early, late = F.col("invoice_ts") < F.lit(END_OF_SHEET_1).cast("timestamp_ntz"), F.col("invoice_ts") >= F.lit(FIRST_OF_SHEET_2).cast("timestamp_ntz")
    sheets = F.array_compact(F.array(F.when(early, 1), F.when(late, 2)))
    return rows.withColumn("sheet", F.explode(sheets))


def raw_lines(spark: SparkSession, folder: str) -> DataFrame:
    """The adapter's lines with their number inside the sheet."""
    return with_row_numbers(lines_of_orders(spark, folder).drop("order"), ["invoice_ts", "invoice", "stock_code", "quantity", "line", "price", F.col("customer_id").asc_nulls_last()])


def with_row_numbers(lines: DataFrame, order: list[Column | str]) -> DataFrame:
    counted = numbered(lines, ["sheet", *order], "_number")
    before = F.broadcast(counted.groupBy("sheet").agg((F.min("_number") - 1).alias("_before")))  # a row for each sheet
    return counted.join(before, "sheet").withColumn("row_no", F.col("_number") - F.col("_before")).select(*RAW.fieldNames())


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RAW).parquet(path)


def write_raw(lines: DataFrame, path: str) -> None:
    """Sorted by sheet and row, zstd-compressed."""
    lines.orderBy("sheet", "row_no").write.mode("overwrite").option("compression", "zstd").parquet(path)


def from_sheets(sheets: list[DataFrame], names: dict[str, str]) -> DataFrame:
    """Lines of a workbook's sheets, given as frames in published order with a ``position`` column: columns renamed, sheets and
    rows numbered from 1."""
    out = None
    for i, sheet in enumerate(sheets, 1):
        lines = numbered(sheet, ["position"], "row_no").drop("position").withColumn("sheet", F.lit(i))
        out = lines if out is None else out.unionByName(lines)
    return out.withColumnsRenamed(names)
