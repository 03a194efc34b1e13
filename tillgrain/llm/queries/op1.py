"""Secrets in every document."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillgrain.llm import secrets
from tillgrain.llm.session import table

NAME = "op1_secret_scan"


def _of(order: int):
    return lambda span: span["order"] == order


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = secrets.scan(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["order"] < len(secrets.BASE))
    counts = [F.size(F.filter("spans", _of(i))).cast("long").alias(f"n_{rule.kind}") for i, rule in enumerate(secrets.BASE)]
    return hits.select("doc_id", *counts, F.sha2(secrets.line(base), 256).alias("base_sha256"), secrets.line(F.col("spans")).alias("spans"))


def _spans(rule: secrets.Rule, order: int) -> str:
    """The rule's spans as a DuckDB list, from the alternation of matches m and the text p between them."""
    re = rule.regex.replace("'", "''")
    keep = f"len(regexp_extract_all(t, '{re}', {rule.group})[i]) >= {rule.least}"
    start = f"(list_sum(list_transform(string_split_regex(t, '{re}')[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(regexp_extract_all(t, '{re}')[1:i - 1], lambda x: length(x))), 0))"
    return f"""CASE WHEN regexp_matches(t, '{re}') THEN list_transform(list_filter(range(1, len(regexp_extract_all(t, '{re}')) + 1), lambda i: {keep}),
        lambda i: {{'s': CAST({start} AS BIGINT), 'o': {order}, 'e': CAST({start} + length(regexp_extract_all(t, '{re}')[i]) AS BIGINT), 'k': '{rule.kind}'}}) ELSE [] END"""


_ALL = ", ".join(f"{_spans(r, i)} AS s{i}" for i, r in enumerate(secrets.BASE + secrets.MORE))
_JOIN = "list_concat(" * (len(secrets.BASE + secrets.MORE) - 1) + "s0, " + "), ".join(f"s{i}" for i in range(1, len(secrets.BASE + secrets.MORE))) + ")"
_LINE = "array_to_string(list_transform({0}, lambda x: x.k || ':' || x.s || ':' || x.e), ',')"
ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), a AS (SELECT doc_id, {_ALL} FROM d),
b AS (SELECT doc_id, s0, s1, s2, list_sort({_JOIN}) AS spans, list_sort(list_concat(list_concat(s0, s1), s2)) AS base FROM a)
SELECT doc_id, CAST(len(s0) AS BIGINT) AS n_assign, CAST(len(s1) AS BIGINT) AS n_access, CAST(len(s2) AS BIGINT) AS n_hex,
    sha256({_LINE.format('base')}) AS base_sha256, {_LINE.format('spans')} AS spans FROM b"""
