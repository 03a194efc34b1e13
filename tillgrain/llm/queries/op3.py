"""Which benchmark items stand in which documents."""

from pyspark.sql import DataFrame, SparkSession

from tillgrain.llm.decontaminate import contaminated
from tillgrain.llm.session import table

NAME = "op3_benchmark_decontamination"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_SHINGLES = """list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END)"""
_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"
ORACLE_SQL = f"""
WITH iw AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
s AS (SELECT item_id, len(w) AS nw, {_SHINGLES} AS s FROM iw WHERE len(w) > 0),
items AS (SELECT item_id, least(nw, 5) AS n, len(s) AS q, unnest(s) AS g FROM s),
dw AS (SELECT doc_id, {_WORDS} AS w FROM documents),
lengths AS (SELECT DISTINCT n FROM items),
d AS (SELECT doc_id, n, unnest(list_distinct(list_transform(range(1, greatest(len(w) - n + 2, 1)), lambda i: array_to_string(w[i:i + n - 1], ' ')))) AS g FROM dw, lengths)
SELECT doc_id, item_id, CAST(max(q) AS BIGINT) AS item_shingles, CAST(count(*) AS BIGINT) AS shared_shingles, count(*) / max(q) AS containment
FROM items JOIN d USING (n, g) GROUP BY doc_id, item_id HAVING count(*) >= max(q) * 0.8 - 1e-9"""
