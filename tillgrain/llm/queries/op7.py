"""Every document without the lines of templates that recur across documents."""

from pyspark.sql import DataFrame, SparkSession

from tillgrain.llm import loglines
from tillgrain.llm.session import table

NAME = "op7_line_dedup"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return loglines.dedup(table(spark, sf_dir, "documents"))


_LEAD = " || ' ' || ".join(f"coalesce(g[{i + 1}], '')" for i in range(loglines.DEPTH))
ORACLE_SQL = rf"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(range(1, len(ls) + 1)) AS pos, unnest(ls) AS line FROM d),
t AS (SELECT doc_id, pos, list_transform(regexp_extract_all(line, '[^\x20\x09-\x0D]+'), lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '{loglines.FIELD}' ELSE x END) AS g FROM l),
p AS (SELECT *, len(g) || ' ' || {_LEAD} AS leaf, array_to_string(g, ' ') AS general FROM t WHERE len(g) > 0),
totals AS (SELECT leaf, count(*) AS total FROM p GROUP BY leaf),
c AS (SELECT leaf, place, token, count(*) AS n FROM (SELECT leaf, unnest(range(1, len(g) + 1)) AS place, unnest(g) AS token FROM p) GROUP BY ALL),
f AS (SELECT c.* FROM c JOIN totals USING (leaf) WHERE 2 * n > total),
k AS (SELECT DISTINCT leaf, general, len(g) AS size, g FROM p),
x AS (SELECT leaf, general, unnest(range(1, size + 1)) AS place, unnest(g) AS token FROM k),
h AS (SELECT leaf, general, count(*) AS hits FROM x JOIN f USING (leaf, place, token) GROUP BY ALL),
n AS (SELECT k.leaf, k.general, CASE WHEN coalesce(hits, 0) >= {loglines.SIMILAR} * size THEN 'T ' || k.leaf ELSE 'L ' || k.leaf || ' / ' || k.general END AS name FROM k LEFT JOIN h USING (leaf, general)),
q AS (SELECT p.doc_id, p.pos, n.name, CASE WHEN len(p.g) >= {loglines.LONG} THEN {loglines.LONG_MIN_DOCS} ELSE {loglines.MIN_DOCS} END AS enough FROM p JOIN n USING (leaf, general)),
r AS (SELECT name FROM q GROUP BY name HAVING count(DISTINCT doc_id) >= any_value(enough)),
o AS (SELECT doc_id, list(DISTINCT pos) AS dropped FROM q JOIN r USING (name) GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(len(ls), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(dropped), 0) AS BIGINT) AS n_dropped,
    CASE WHEN dropped IS NULL THEN text ELSE array_to_string(list_transform(list_filter(range(1, len(ls) + 1), lambda i: NOT list_contains(dropped, i)), lambda i: ls[i]), chr(10)) END AS text
FROM d LEFT JOIN o USING (doc_id)"""
