"""A corpus pipeline of five operators: each stage takes (spark, docs, sf_dir), works on all rows that its predecessor
kept, and returns a DataFrame that is written as Parquet and read again as the next stage's docs."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import decontam, jaccard_join, mixing, sharding, toxicity
from quern.llm.shared import shared_folder, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the toxicity network doesn't reject; it learns from labelled rows of these documents that aren't
    held out. Null and empty texts have the lowest score and stay; rows that repeat are judged alike; without labels of both kinds
    nothing goes. Only COLUMNS are kept, from here on; an empty table stays empty."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").filter(~toxicity.held_out()))
    return toxicity.score_documents(docs.select(*COLUMNS), model).filter("predicted = 0").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group that n-gram Jaccard links connect: the one with the least doc_id. Documents
    without words (null, empty or blank texts) are in no group and stay; rows that repeat leave one; a null doc_id counts as the greatest. An empty
    table stays empty."""
    return jaccard_join.one_of_each(docs.select(*COLUMNS), n=5, threshold=75)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes benchmark passages: the words of each merged span go, with what stands between them; other text stays as it is.
    A document of which no word is left goes; null and empty texts, and rows without a passage, stay as they are. n_chars follows the text. With an
    empty benchmark or table nothing changes."""
    return decontam.remove_contamination(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"), length=10)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats and drops documents so that sources meet their target weights; copies become rows. A null source is a source like any other.
    Rows without words weigh nothing and are kept as often as the threshold of their source says, as all its rows are; where the whole source has none, they go. Rows
    that repeat an id are taken or left together. An empty table stays empty."""
    mixed = mixing.mixed_documents(docs.select(*COLUMNS))
    return mixed.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*COLUMNS)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds the shard of each row, its size and its slot there. Rows without a doc_id share a shard, copies of one row too. An empty table stays
    empty."""
    return sharding.shard_documents(docs.select(*COLUMNS), shards=40).select(*COLUMNS, "size", "shard", "slot")


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("benchmark_decontamination", remove_benchmark),
    ("mixing", mix_sources),
    ("sharding", shard),
]

#: The stages train a network and join texts by components; SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the cluster's shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        out = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
    return docs
