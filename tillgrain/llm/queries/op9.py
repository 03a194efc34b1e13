"""How many words of every document the mix of all sources takes."""

from pyspark.sql import DataFrame, SparkSession

from tillgrain.llm.mixing import mix
from tillgrain.llm.session import table

NAME = "op9_mix"
ORACLE_SQL = None  # the draw isn't SQL; tests check its laws against brute force


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
