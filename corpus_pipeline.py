"""The corpus pipeline: language ID, near-dedup, decontamination, mixing, sharding.

Each stage gets the documents its predecessor kept and returns a DataFrame, which is written as
Parquet and read again as the next stage's documents. All stages but the last return the columns
of ``documents``; the last adds the shard and the slot.

Nulls, empty and very long texts, repeated rows, empty tables and extra columns are handled as
the operators' docstrings state; extra columns travel through every stage.
"""

from __future__ import annotations

import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import tallygrid
from tallygrid.llm import decontaminate, language, mixing, resemblance, sharding
from tallygrid.llm._common import shared_dir, table
from tallygrid.llm.queries import held_out

cloudpickle.register_pickle_by_value(tallygrid)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents in one of the learned languages."""
    model = language.fit(docs.where(~held_out(F.col("doc_id"))))
    return language.keep_identified(docs, model)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of texts that share 0.8 of their runs of five words, that
    with the least id."""
    return resemblance.drop_near_duplicates(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of a benchmark item."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats and leaves out documents so that sources meet their target weights."""
    return mixing.mix(docs)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts every document into one of 24 shards and numbers it there."""
    return sharding.shard(docs).select("row.*", F.col("shard").alias("out_shard"), F.col("slot").alias("out_slot"))


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminated),
    ("mix", mixed),
    ("shard", sharded),
]

#: The language stage is a trained model, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    root = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{root}/{k}-{name}")
            docs = spark.read.parquet(f"{root}/{k}-{name}")
    return docs
