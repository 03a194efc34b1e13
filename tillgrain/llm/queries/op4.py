"""Every page as a WARC record, written and read back."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillgrain.llm.session import table
from tillgrain.llm.warc import archive

NAME = "op4_warc"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive(table(spark, sf_dir, "pages")).select(F.col("k").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


#: five hexadecimal digits are four characters of base32
_QUAD = "list_transform(range(0, 8), lambda i: CAST('0x' || substr(h, i * 5 + 1, 5) AS BIGINT))"
_BASE32 = f"array_to_string(list_transform({_QUAD}, lambda v: " + " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((v >> {s}) & 31 AS INTEGER) + 1, 1)" for s in (15, 10, 5, 0)) + "), '')"
ORACLE_SQL = f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS h FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY h, n) AS best FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, {_BASE32} AS payload_digest,
    CASE WHEN best IS NULL OR page_id = best THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN best IS NULL OR page_id = best THEN NULL ELSE best END AS refers_to FROM m"""
