"""Bronze as a stream of files, and weekly demand by event time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tillgrain.sources.invoices import RAW


def source(spark: SparkSession, folder: str, files_at_once: int = 100) -> DataFrame:
    """Raw lines of files as they arrive in a folder."""
    return spark.readStream.schema(RAW).option("maxFilesPerTrigger", files_at_once).parquet(folder)


def load(lines: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append all files that have arrived since the last call, each once."""
    loaded = lines.withColumn("_loaded_at", F.current_timestamp()).withColumn("batch", F.col("sheet"))
    return loaded.writeStream.format("parquet").partitionBy("batch").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)


def weekly_units(lines: DataFrame, late: str = "14 days") -> DataFrame:
    """Units by week and product. Windows count from a Thursday, the epoch; four days on, they begin on Mondays."""
    timed = lines.withColumn("ts", F.col("invoice_ts").cast("timestamp")).withWatermark("ts", late)
    week = F.window("ts", "7 days", "7 days", "4 days")
    sums = timed.groupBy(week.alias("week"), F.upper(F.trim("stock_code")).alias("stock_code")).agg(F.sum("quantity").alias("units"))
    return sums.select(F.to_date("week.start").alias("week_start"), "stock_code", "units")
