"""The toxicity score of every document; rows with crc32(doc_id) mod 4 = 2 are held out."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillgrain.llm import toxicity
from tillgrain.llm.session import table

NAME = "op10_toxicity"
ORACLE_SQL = None  # a trained model's output; tests measure held-out accuracy


def _held_out(key: str):
    return F.crc32(F.col(key).cast("string")) % 4 == 2


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    net = toxicity.train(docs, table(spark, sf_dir, "labels"), where=~_held_out("k"))
    return toxicity.score(docs, net).select(
        "doc_id", F.coalesce(_held_out("doc_id"), F.lit(False)).alias("held_out"), "score", (F.col("score") >= toxicity.CUT).cast("int").alias("predicted"), "flagged"
    )
