"""Average ranks of many columns, and running totals, without a window over all rows.

A column's values become a histogram, and the histogram, not the data, is put in order: dealt by
ranges of (column, value), with running sums inside a range and, from the sums of the ranges before
it, an offset. Two columns that both have missing values are ranked on the rows in which both are
known, so a value's row in the histogram counts, for each other column, the rows in which that one
is known too, and has a rank for each.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallygrid.shared import stored


def running_total(rows: DataFrame, by: Sequence[str], weight: str, name: str) -> DataFrame:
    """``rows`` with ``name``, the sum of ``weight`` up to each row in the order of ``by``: by ranges,
    with a sum of what lies before each, so no task sees all rows."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = stored(rows.repartitionByRange(parts, *by).withColumn("_part", F.spark_partition_id()))
    sums = ranged.groupBy("_part").agg(F.sum(weight).alias("_sum"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    offsets = F.broadcast(sums.select("_part", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before")))
    within = Window.partitionBy("_part").orderBy(*by).rowsBetween(Window.unboundedPreceding, 0)
    return ranged.join(offsets, "_part").withColumn(name, F.col("_before") + F.sum(weight).over(within)).drop("_part", "_before")


def rank_table(df: DataFrame, columns: Sequence[str], beside: Sequence[Sequence[str]]) -> DataFrame:
    """``column`` (its place in ``columns``), ``value`` and ``ranks``: the average rank of each value,
    one for each set of columns of ``beside``, among the rows in which all of the set are known."""
    counts = [f"n{i}" for i in range(len(beside))]
    flags = [F.lit(1) if not s else F.when(F.coalesce(*[F.when(F.col(f"`{c}`").isNull(), 1) for c in s]).isNull(), 1).otherwise(0) for s in beside]
    values = F.explode(F.array(*[F.struct(F.lit(i).alias("column"), F.col(f"`{c}`").cast("double").alias("value")) for i, c in enumerate(columns)]))
    each = df.select(*[f.alias(n) for n, f in zip(counts, flags, strict=True)], values.alias("v")).where("v.value IS NOT NULL")
    histogram = each.groupBy("v.column", "v.value").agg(*[F.sum(n).alias(n) for n in counts])

    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = stored(histogram.repartitionByRange(parts, "column", "value").withColumn("part", F.spark_partition_id()))
    # A row for each range and for each column that begins in one: their number does not grow with the data.
    sums = ranged.groupBy("column", "part").agg(*[F.sum(n).alias(n) for n in counts])
    before = Window.partitionBy("column").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = F.broadcast(sums.select("column", "part", *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"o{i}") for i, n in enumerate(counts)]))
    within = Window.partitionBy("column", "part").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    ranks = [F.col(f"o{i}") + F.sum(n).over(within) - (F.col(n) - 1) / 2 for i, n in enumerate(counts)]
    return ranged.join(offsets, ["column", "part"]).select("column", "value", F.array(*ranks).alias("ranks"))


def with_ranks(df: DataFrame, columns: Sequence[str], beside: Sequence[Sequence[str]]) -> DataFrame:
    """The ``columns`` of ``df`` and for the i-th ``r{i}``, the ranks of its value by :func:`rank_table`."""
    table = stored(rank_table(df, columns, beside))
    out = df.select(*[F.col(f"`{c}`") for c in columns])
    for i, c in enumerate(columns):  # Spark broadcasts what is small: an ordinal column has few values
        of = table.where(F.col("column") == i).select(F.col("value").alias("_v"), F.col("ranks").alias(f"r{i}"))
        out = out.join(of, F.col(f"`{c}`").cast("double") == F.col("_v"), "left").drop("_v")
    return out
