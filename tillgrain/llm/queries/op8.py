"""The predicted language of every document; rows with crc32(doc_id) mod 3 = 1 are held out."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillgrain.llm import language
from tillgrain.llm.session import table

NAME = "op8_language_id"
ORACLE_SQL = None  # a trained model's output; tests measure held-out accuracy


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    model = language.train(docs, where=~held_out)
    return language.identify(docs, model).withColumn("held_out", F.coalesce(held_out, F.lit(False)))
