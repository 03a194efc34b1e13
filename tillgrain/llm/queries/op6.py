"""Text statistics, base rules and the trees' verdict for every document."""

from pyspark.sql import DataFrame, SparkSession

from tillgrain.llm import quality
from tillgrain.llm.session import table

NAME = "op6_quality_rules"
ORACLE_SQL = None  # the verdict is a trained model's


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.judge(docs, quality.train(docs, table(spark, sf_dir, "labels")))
