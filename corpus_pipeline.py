"""A corpus from raw documents to shards: toxicity, near-duplicates, benchmark passages, source mix, sharding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
one's docs. All but the last return the columns of documents, whatever further columns there are and whatever their names.
Rows with null ids or texts go through: such texts are empty. Rows that share a doc_id share their fate in the
near-duplicate and benchmark stages. Texts of any length are read whole; an empty table gives an empty one at every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framespark.llm import decontaminate, mixing, near_dedup, sharding, toxicity
from framespark.llm.common import free_name, materialize, new_path, table


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows of docs whose doc_id, null too, isn't in gone (doc_id)."""
    key = free_name("gone", docs)
    gone = gone.select(F.col("doc_id").alias(key)).distinct()
    return docs.join(gone, docs["doc_id"].eqNullSafe(F.col(key)), "left_anti")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the factorization machine doesn't call toxic. It is fitted to a bounded sample of the labelled rows of docs."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), fold=~toxicity.held_out())
    return toxicity.score_toxicity(docs, model, keep=True)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies (five-word shingles, similarity 0.8 or more): that with the smallest doc_id."""
    return _without(docs, near_dedup.near_duplicates(docs).where("not kept"))


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without a passage of the benchmark."""
    return _without(docs, decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark")).where("contaminated"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes its first word (never, once or twice), in the order of the mix's schedule."""
    return mixing.mix(docs, keep=True)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of each row, for eight shards of near equal bytes."""
    return sharding.reshard_documents(docs, new_path(spark, "shards"))


STAGES = [("toxicity", drop_toxic), ("near_dedup", drop_near_copies), ("decontamination", drop_benchmark), ("mixing", mix_sources), ("sharding", shard)]
#: SQL can't express the stages; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage_{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
