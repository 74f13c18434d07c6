"""Feature extraction per subject: resumable checkpoints and a fail-closed merge."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallygrid.functions.text import derive_subject, has_extension
from tallygrid.operators.checkpoints import keep_last, outcome_counts, pending, source_columns
from tallygrid.sources.readers import exists
from tallygrid.sources.writers import write_merged, write_subjects


def plan(manifest: DataFrame, file_col: str, extensions: Sequence[str], group_col: str | None = None, subjects: Sequence[str] | None = None) -> DataFrame:
    """Manifest rows of the wanted file types and subjects, with their ``subject``."""
    rows = manifest.where(has_extension(F.col(file_col), extensions))
    rows = rows.withColumn("subject", derive_subject(F.col(file_col), F.col(group_col) if group_col else None))
    return rows.where(F.col("subject").isin(list(subjects))) if subjects is not None else rows


def extract(planned: DataFrame, features: Callable[[DataFrame], DataFrame], folder: str) -> DataFrame:
    """Extract what is not done yet and write it by subject; counts per subject.

    ``features`` adds columns to rows, ``ok`` among them. A subject is done once its partition
    exists, so a run that was stopped goes on where it ended.
    """
    spark = planned.sparkSession
    done = spark.read.parquet(folder).select("subject") if exists(spark, folder) else spark.createDataFrame([], "subject string")
    left = pending(planned, done, "subject")
    if not left.isEmpty():
        write_subjects(features(left), folder)
    names = planned.select("subject").distinct()
    return outcome_counts(spark.read.parquet(folder).join(names, "subject", "left_semi"))


def merge(spark, folder: str, keys: Sequence[str], file_col: str, out: str) -> DataFrame:
    """The last row of every key over all subjects, written as one table."""
    rows = spark.read.parquet(folder)
    wanted = source_columns(keys, file_col)
    missing = [k for k in wanted if k not in rows.columns]
    if missing:
        raise ValueError(f"no key columns: {', '.join(missing)}")
    marked = rows.withColumn("_file", F.col("_metadata.file_name"))
    write_merged(keep_last(marked, wanted, [F.col("subject"), F.col("_file"), F.xxhash64(*rows.columns)]).drop("_file"), out)
    return spark.read.parquet(out)
