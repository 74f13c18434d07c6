"""Batches of requests (W7, W8, C9, E29, E30, X4, X6, X14, J5, J7, U7, K6, K8); batches by size
(W6) are in :mod:`tallygrid.operators.greedy_batches`."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallygrid.functions.text import build_key, labelled_block, mime_type, slashes, split_key
from tallygrid.operators.ranks import running_total
from tallygrid.sources.file_table import FileTable

GB = 1 << 30
#: Storage of a key, fixed values: so much of it may be used by media.
KEY_BYTES = 18 * GB


def bytes_per_subject(files: DataFrame, subject: str = "subject", size: str = "length") -> DataFrame:
    """Media bytes per subject."""
    return files.groupBy(subject).agg(F.sum(size).cast("long").alias("bytes"), F.count(F.lit(1)).alias("files"))


def quota_prefix(subjects: DataFrame, limit: int = KEY_BYTES, subject: str = "subject") -> DataFrame:
    """The smallest subjects that fit the quota together (W7), ties by subject: adds
    ``running_bytes``. The running total is made by ranges of size and subject, so neither many
    sizes nor many subjects of one size meet in a task."""
    total = running_total(subjects, ["bytes", subject], "bytes", "running_bytes")
    return total.withColumn("running_bytes", F.col("running_bytes").cast("long")).where(F.col("running_bytes") <= limit)


def level(loads: np.ndarray, size: int, ranks: np.ndarray) -> np.ndarray:
    """For each of ``ranks`` the load, before it, of the bin that takes that item, by bisection."""
    low, high = np.full(len(ranks), loads.min()), loads.min() + size * (ranks + 1)
    while (open_ := low < high).any():
        middle = (low + high) // 2
        reached = np.maximum(0, (middle[:, None] - loads) // size + 1).sum(axis=1) > ranks
        high, low = np.where(open_ & reached, middle, high), np.where(open_ & ~reached, middle + 1, low)
    return low


def placed_in_turn(loads: Sequence[int], size: int, ranks: np.ndarray) -> np.ndarray:
    """The bins of items of one size, numbered by ``ranks`` from 0, each put into the least loaded
    bin, ties to the first: the item of rank i takes the i-th least of all sums (load + a multiple of
    the size), in order of the sum and the bin."""
    loads = np.asarray(loads, np.int64)
    if size == 0:
        return np.full(len(ranks), int(loads.argmin()))
    sums = level(loads, size, ranks)
    # Of the bins with the sum, those before it in order took the ranks before.
    before = np.maximum(0, -((loads - sums[:, None]) // size)).sum(axis=1)
    at = (sums[:, None] >= loads) & ((sums[:, None] - loads) % size == 0)
    return np.array([np.flatnonzero(own)[r] for own, r in zip(at, ranks - before, strict=True)], np.int64)


def spread_over_keys(subjects: DataFrame, keys: int, subject: str = "subject") -> DataFrame:
    """Subjects on API keys, largest first onto the least loaded (C9), ties by subject and by key:
    ``key_id``. Null bytes count as 0.

    Only the loads depend on what was placed before, and they change by sizes, not by subjects: a
    stream over the different sizes, from the largest, finds the ``keys`` loads before each, and
    the subjects of a size take their places from these in parallel.
    """
    held = F.coalesce("bytes", F.lit(0)).cast("long")
    sizes = subjects.groupBy(held.alias("_b")).agg(F.count(F.lit(1)).alias("n"))

    def fill(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        loads = np.zeros(keys, np.int64)
        for part in parts:
            before = []
            for size, n in zip(part["_b"].tolist(), part["n"].tolist(), strict=True):
                before.append(loads.tolist())
                if size:  # all bins fill up to the load that the last item meets
                    last = level(loads, size, np.array([n - 1]))[0]
                    taken = np.maximum(0, -((loads - last) // size))
                    taken[np.flatnonzero((last >= loads) & ((last - loads) % size == 0))[:n - int(taken.sum())]] += 1
                    loads = loads + size * taken
            yield pd.DataFrame({"_b": part["_b"], "_loads": before})

    # One row a size in one task, of which it holds one at a time.
    loads = sizes.repartition(1).sortWithinPartitions(F.desc("_b")).mapInPandas(fill, "_b long, _loads array<long>")
    rank = F.row_number().over(Window.partitionBy("_b").orderBy(subject)) - 1

    @F.pandas_udf("long")
    def place(loads: pd.Series, size: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([placed_in_turn(x, int(b), np.array([i]))[0] for x, b, i in zip(loads, size, n, strict=True)], dtype="int64")

    numbered = subjects.withColumn("_b", held).withColumn("_n", rank).join(loads, "_b")
    return numbered.select(*subjects.columns, place("_loads", "_b", "_n").alias("key_id"))


def next_number(names: DataFrame, prefix: str, name: str = "name") -> DataFrame:
    """``next``: one above the highest number behind a prefix."""
    n = F.nullif(F.regexp_extract(name, rf"^{prefix}(\d+)", 1), F.lit("")).cast("int")
    return names.agg((F.coalesce(F.max(n), F.lit(0)) + 1).alias("next"))


def requests(rows: DataFrame, uris: DataFrame, file_col: str, prompt: str, labels: Sequence[tuple[str, str]] = (), subject: str = "subject", temperature: float = 0.0) -> DataFrame:
    """``key`` and ``line`` (JSON) of a batch request per row with an uploaded file
    (X4, J5, F8-F10, K6). ``uris`` has ``subject``, ``path``, ``uri``."""
    known = uris.select(F.col("subject").alias("_s"), slashes(F.col("path")).alias("_p"), F.col("uri").alias("_uri"))
    joined = rows.join(known, (F.col(subject) == F.col("_s")) & (slashes(F.col(file_col)) == F.col("_p")))
    file_part = F.struct(F.struct(F.col("_uri").alias("file_uri"), mime_type(F.col("_p")).alias("mime_type")).alias("file_data"), F.lit(None).cast("string").alias("text"))
    text_part = F.struct(F.lit(None).cast("struct<file_uri string, mime_type string>").alias("file_data"), labelled_block([(label, F.col(c)) for label, c in labels]).alias("text"))
    body = F.struct(
        F.array(F.struct(F.lit("user").alias("role"), F.array(file_part, text_part).alias("parts"))).alias("contents"),
        F.struct(F.array(F.struct(F.lit(prompt).alias("text"))).alias("parts")).alias("system_instruction"),
        F.struct(F.lit(temperature).alias("temperature"), F.lit("application/json").alias("response_mime_type")).alias("generation_config"),
    )
    key = build_key(F.col("_s"), F.col("_p"))
    return joined.select(key.alias("key"), F.to_json(F.struct(key.alias("key"), body.alias("request"))).alias("line"))


def subject_count(rows: DataFrame, subject: str = "subject") -> DataFrame:
    """How many different subjects there are (E30); a null is none."""
    return rows.agg(F.count_distinct(subject).alias("subjects"))


def subjects_of(keys: DataFrame, key: str = "key") -> DataFrame:
    """Different subjects of request keys, in order."""
    return keys.select(split_key(F.col(key))[0].alias("subject")).distinct().orderBy("subject")


def split_rows(rows: DataFrame, key: str = "key") -> DataFrame:
    """Rows with the ``subject`` and the ``path`` of their request keys (C10), to be written by
    subject."""
    subject, path = split_key(F.col(key))
    return rows.withColumn("subject", subject).withColumn("path", path)


def failed_sources(source: DataFrame, failed: DataFrame, file_col: str) -> DataFrame:
    """Source rows of failed ones, by normalised path."""
    return source.join(failed.select(slashes(F.col(file_col)).alias("_p")).distinct(), slashes(F.col(file_col)) == F.col("_p"), "left_semi")


def upsert_jobs(log: DataFrame, entries: DataFrame, now: str) -> DataFrame:
    """The job log with new or changed entries (X6, D3): entries win, unknown columns stay, and
    ``created_at`` is that of the first entry."""
    fresh = entries.withColumn("updated_at", F.lit(now))
    names = [*log.columns, *[c for c in fresh.columns if c not in log.columns]]
    both = log.alias("o").join(fresh.alias("n"), "job_name", "full_outer")

    def value(c: str) -> Column:
        old = F.col(f"o.{c}") if c in log.columns else F.lit(None)
        new = F.col(f"n.{c}") if c in fresh.columns else F.lit(None)
        if c == "created_at":
            return F.coalesce(old, new, F.lit(now))
        return F.coalesce(new, old)

    return both.select(*[F.col("job_name") if c == "job_name" else value(c).alias(c) for c in names])


def merge_jobs(table: FileTable, entries: DataFrame, now: str) -> dict[str, int]:
    """:func:`upsert_jobs` on a log kept as a table of files (X6): files with a changed job are
    rewritten, new jobs are added. Columns that the log does not have are left out."""
    name = F.col("job_name")

    def changed(rows: DataFrame, changes: DataFrame) -> DataFrame:
        return upsert_jobs(rows, changes.join(rows.select("job_name"), "job_name", "left_semi"), now)

    def added(changes: DataFrame) -> DataFrame:
        log = table.read()
        new = upsert_jobs(log.limit(0), changes, now)
        return new.select(*log.columns)

    return table.merge(entries, name, name, changed, added)


def strategy(subjects: DataFrame, urgent: bool = False) -> DataFrame:
    """``batch`` or ``live`` (X14): batch above 5 GB or 10 subjects unless it is urgent."""
    many = (F.sum("bytes") > 5 * GB) | (F.count(F.lit(1)) > 10)
    return subjects.agg(F.when(many & F.lit(not urgent), "batch").otherwise("live").alias("strategy"))


def retry_strategy(failures: DataFrame) -> DataFrame:
    """``batch`` above 500 failures, else ``live``."""
    return failures.agg(F.when(F.count(F.lit(1)) > 500, "batch").otherwise("live").alias("strategy"))
