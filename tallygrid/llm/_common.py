"""Helpers shared by the training-data operators."""

from __future__ import annotations

import sys
import tempfile
import uuid
from collections.abc import Callable, Hashable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words by ASCII white space, and the separators between them.
SPACE_WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def space_words(text: Column) -> Column:
    """Number of words by ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(SPACE_WORD)), F.lit(0)).cast("long")


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case and nothing else changed."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(
        F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    )


def once(make: Callable, *key: Hashable):
    """What ``make`` gives for a key, made once in a worker. Functions travel by value, so a cache of
    their own would be empty in each task; the interpreter's modules stay."""
    held, name = vars(sys).setdefault("_tallygrid_once", {}), (make.__module__, make.__qualname__, key)
    if name not in held:
        held[name] = make(*key)
    return held[name]


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Where it is unset a local session gets a temporary folder; a cluster is refused, since
    its machines would not see each other's files.
    """
    context = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if path is None:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="spark-checkpoint-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """The frame computed once and read back from the shared folder, with no lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


#: With this setting Spark removes a query's shuffle files as soon as the query has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: Rows of a batch between Spark and Python; whole texts make batches of the usual size large.
BATCH_ROWS, TEXT_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", "1000"


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Settings of the session for the queries that this block runs."""
    before = {name: spark.conf.get(name, None) for name in values}
    for name, value in values.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def stored(df: DataFrame, batch_rows: str = TEXT_ROWS) -> DataFrame:
    """The frame computed once, as a compressed Parquet table in the shared folder; later reads
    prune columns. The shuffle files behind it are removed once it is written."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    with settings(spark, {CLEANUP: "true", BATCH_ROWS: batch_rows}):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, key: str) -> DataFrame:
    """The frame computed once, as a table in buckets of ``key``, which joins on it read without a
    shuffle."""
    spark = df.sparkSession
    n, name = int(spark.conf.get("spark.sql.shuffle.partitions")), f"table_{uuid.uuid4().hex}"
    writer = df.repartition(n, key).write.format("parquet").option("compression", "zstd").option("path", f"{shared_dir(spark)}/{name}")
    with settings(spark, {CLEANUP: "true"}):
        writer.bucketBy(n, key).sortBy(key).saveAsTable(name)
    return spark.table(name)
