"""A corpus from raw documents: toxic documents and near copies go, benchmark passages go, sources are mixed to their
target weights, and what is left is dealt into shards. The mix counts words, but documents without a word (null or blank
texts too) have copies by their source's ratio as others do; only those of sources without any word go there.

Each stage gets all that the one before kept, reread from Parquet, and returns the columns of documents; the last
adds shard and slot.

Odd rows have a defined result in every stage. Extra columns pass through all of them unchanged, whatever their names
(shard and slot are replaced by the last), an empty table gives no rows, and nulls may stand in any column:

- toxicity: a null text has the score of an empty one; without labels nothing is toxic unless toxic labels prevail.
  Repeated rows have one score and stay or go together. Ties with the cut go.
- n-gram Jaccard join: documents without a word link with nothing and all stay. Of rows alike in key and text one stays.
  Where several texts of a group share its smallest doc_id, one row of each such text stays; null keys stay only in
  groups that have no other.
- benchmark decontamination: null, empty and blank texts hold nothing and stay; repeated rows stay or go together; a
  document that holds exactly the wanted share of an item goes.
- mixing: a null source is a source; rows alike in key, text and source share one draw of copies each, all of which
  the first of them carries; of rows equal in size, hashes decide.
- sharding: a null text has 8 bytes and the place of an empty one; null keys come first; each repeated row has a slot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tillgrain.llm import decontaminate, jaccard, mixing, sharding, toxicity
from tillgrain.llm.session import stored, table

SHARDS = 24


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents at or above their language's cut go. The classifier learns from the labels of documents at hand."""
    return toxicity.drop_toxic(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of similarity 0.8 or more on 5-word shingles connect, the one with the smallest doc_id stays."""
    return jaccard.one_of_each(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold 0.8 or more of a benchmark item's 5-word shingles go."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as many times as the mix takes it: not at all, once or twice."""
    return mixing.mixed(docs)


def deal_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with shard and slot."""
    return sharding.assign(docs, SHARDS)


STAGES = [("toxicity", drop_toxic), ("ngram_jaccard_join", one_of_each_group), ("benchmark_decontamination", drop_benchmark), ("mixing", mix_sources), ("sharding", deal_shards)]

#: Trained scores, seeded draws and hashes aren't SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
