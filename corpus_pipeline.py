"""A corpus-cleaning pipeline of five stages over `documents`; each stage is written as Parquet and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobloom.llm.common import Scratch, table
from jobloom.llm.decontaminate import clean
from jobloom.llm.mixing import mix
from jobloom.llm.neardup import dedup
from jobloom.llm.sharding import shard
from jobloom.llm.toxicity import score, train

#: Documents that score this much or more are rejected as toxic.
TOXIC_FROM = 0.3


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects toxic documents; the model learns from the labelled rows among `docs`. Null and empty texts are not toxic."""
    return docs.where(score(docs, train(spark, sf_dir, docs)) < TOXIC_FROM)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each group of near-duplicates; rows without an id or without words stay, see `dedup`."""
    return dedup(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark passage, also with some tokens substituted; an empty benchmark drops nothing."""
    return clean(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the rows of the mix: sources (null is one) at tempered weights up to the horizon of the schedule."""
    rows = docs.select("doc_id", "source", F.struct(*docs.columns).alias("_all"))
    return mix(rows).where("in_mix").select(*[F.col(f"_all.`{c}`") for c in docs.columns])


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts the mix in 16 shards of near-equal bytes; adds shard and slot (columns of these names are replaced)."""
    return shard(docs, 16)


STAGES = [("toxicity", toxicity), ("near-duplicates", near_duplicates), ("decontamination", decontamination), ("mixing", mixing), ("sharding", sharding)]

#: No SQL: the learned grammar and the sketches have no SQL form; tests/llm compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`. Every stage takes repeated rows, null columns, empty tables and further columns as its operator says."""
    scratch = Scratch(spark, "pipeline")
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir), name.replace("-", "_"))
        if before is not None:  # the next stage is written: nothing reads it any more
            scratch.drop(before)
        before = docs
    return docs
