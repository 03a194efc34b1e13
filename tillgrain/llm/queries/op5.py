"""All documents in 24 shards of nearly equal bytes."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillgrain.llm import sharding
from tillgrain.llm.session import stored, table

NAME = "op5_sharding"
ORACLE_SQL = None  # boundaries follow a sample by Spark's hash; tests check the law, the groups and the slots
SHARDS = 24


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    keyed = stored(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("k"), sharding.group_of(text).alias("g"), sharding.size_of(text).alias("size"), F.crc32(F.coalesce(text, F.lit(""))).alias("crc")))
    measured = sharding.measure(keyed, SHARDS)
    told = sharding.told_apart(keyed, sharding.repeated(keyed, SHARDS, measured))
    placed = sharding.place(told, sharding.make_plan(told.select("k", "g", "size", "tie"), SHARDS, measured))
    return placed.select(
        F.col("k").alias("doc_id"), "size", F.col("crc").cast("long").alias("text_crc32"), F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
