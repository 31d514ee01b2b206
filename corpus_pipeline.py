"""The corpus pipeline: five stages over documents, each written as Parquet and read again by the next.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
documents. The toxicity model is fitted on the labelled rows of the stage's own input. Mixing takes one
epoch, so that no document comes twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from matchloom.llm import decontamination, mixing, ngram_join, sharding, toxicity
from matchloom.llm.common import materialize, read_table

#: Tokens that the mix takes, in percent of those that are left when it starts.
MIX_PERCENT = 80

#: The fitted model and the seeded order of the mix have no SQL form; tests hold the stages against plain Python.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the severity model does not reject. Null and empty texts stay; repeated rows stand or fall together."""
    return toxicity.drop_toxic(docs, toxicity.train(docs, read_table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class, the one with the smallest id; rows with a null id or without words stay."""
    return ngram_join.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage. Null and empty texts stay."""
    return decontamination.drop_leaks(docs, read_table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One epoch of documents at the target weights. Null texts have no tokens and come with the prefix they lie in."""
    return mixing.mix_documents(docs, budget_percent=MIX_PERCENT)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with shard, slot, home_shard and hops, every row one place; an empty table gives no rows, here as in all stages."""
    return sharding.assign_shards(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix),
    ("sharding", shard),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
