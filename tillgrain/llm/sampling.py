"""Bounded samples of labelled rows for fitting.

Texts never travel: each task turns the sampled texts of its own partition into features, and only these are
shuffled. Which rows are taken hangs on hashes of key and text alone, so reruns agree.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillgrain.llm.session import stored


def chosen_labels(labels: DataFrame, label: str, max_rows: int, *, doc_key: str = "doc_id", where: Column | None = None) -> DataFrame:
    """(k, label) of the ``max_rows`` keys with the smallest hashes. Conflicting labels of a key: the smallest holds."""
    known = labels.select(F.col(doc_key).alias("k"), F.col(label).cast("int").alias("label")).where("k IS NOT NULL AND label IS NOT NULL")
    if where is not None:
        known = known.where(where)
    keys = stored(known.groupBy("k").agg(F.min("label").alias("label")).withColumn("lot", F.xxhash64("k", F.lit(11))))
    count = keys.count()
    # twice the wanted share by the hash's size, then exactly the smallest: what one task sorts is bounded too
    share = int(min(1.0, 2 * max_rows / max(1, count)) * (1 << 30))
    return keys.where(F.pmod(F.shiftrightunsigned("lot", 20), F.lit(1 << 30)) < share).orderBy(F.pmod(F.shiftrightunsigned("lot", 20), F.lit(1 << 30)), "lot", "k").limit(max_rows)


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, features: Callable[[pa.Array], list[pa.Array]], fields: str, *, max_rows: int, doc_key: str = "doc_id", text: str = "text", also: Column | None = None, where: Column | None = None
) -> DataFrame:
    """(lot, label, also, *fields) of at most ``max_rows`` labelled documents, one for each key, stored.

    ``features`` turns a column of texts into one array for each of ``fields`` (a DDL list). Null keys, texts and labels
    are left out. A key that many rows have counts once, with the text that has the smallest hash. The labels' side
    is broadcast: it has at most max_rows rows of a key and two numbers.
    """
    chosen = chosen_labels(labels, label, max_rows, doc_key=doc_key, where=where)
    rows = docs.select(F.col(doc_key).alias("k"), F.col(text).alias("t"), (F.lit(None) if also is None else also).cast("string").alias("also")).where("t IS NOT NULL")
    rows = rows.join(F.broadcast(chosen), "k").select("lot", F.xxhash64("t").alias("pick"), "label", "also", "t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([*batch.columns[:4], *features(batch.column(4))], names=names)

    schema = T._parse_datatype_string(f"lot long, pick long, label int, also string, {fields}")
    names = schema.names
    made = rows.mapInArrow(run, schema)
    return stored(made.groupBy("lot").agg(F.min_by(F.struct("label", "also", *names[4:]), "pick").alias("row")).select("lot", "row.*"))
