"""Exact quantiles per key, linear interpolation between order statistics.

``percentile`` keeps every distinct value of a group in one buffer. For large groups the order
statistics come from counts instead: each group's range falls into ``CELLS`` cells, even steps of a
scale that is linear near zero and logarithmic beyond, so long tails spread over many cells. A first
pass counts cells, and running totals over them tell the cell of each wanted rank; a second pass
counts the values within those cells, and running totals over them give the values. Everything is a
row per key and cell or value: nothing reaches the driver, and equal values are one row however many
rows tie.

Rows never move to their group. What they are matched with is broadcast, a row for each group beyond
``direct_rows`` (so at most one for that many rows) or for each cell that holds a wanted rank of one,
and they are counted where they are read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallygrid.shared import stored

#: Values of a group that one buffer may hold.
DIRECT_ROWS = 2_000_000
CELLS = 1 << 16


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float], direct_rows: int = DIRECT_ROWS, largest: int | None = None,
) -> DataFrame:
    """``keys`` and ``q``, an array with the quantile of each of ``probs``; nulls are left out.

    ``largest`` is the number of rows of the largest group, counted if it is not given.
    """
    rows = df.select(*keys, F.col(value).cast("double").alias("_v")).where("_v IS NOT NULL")
    if largest is None:
        counted = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")) if keys else rows.agg(F.count(F.lit(1)).alias("n"))
        largest = counted.agg(F.max("n")).first()[0] or 0
    at = F.array(*[F.lit(float(p)) for p in probs])
    if largest <= direct_rows:
        return rows.groupBy(*keys).agg(F.percentile("_v", at).alias("q"))
    # Keys as one struct, which is never null, so that groups with null keys join too.
    rows = rows.select(F.struct(*keys, F.lit(0).alias("_one")).alias("_k"), "_v")
    bounds = rows.groupBy("_k").agg(F.count(F.lit(1)).alias("_n"), F.avg(F.abs("_v")).alias("_scale"), F.min("_v").alias("_a"), F.max("_v").alias("_b"))
    large = stored(bounds.where(F.col("_n") > direct_rows))
    small = rows.join(F.broadcast(large.select("_k")), "_k", "left_anti").groupBy("_k").agg(F.percentile("_v", at).alias("q"))
    found = _from_counts(rows, large, probs).unionByName(small)
    return found.select(*[F.col(f"_k.`{k}`") for k in keys], "q")


def _from_counts(rows: DataFrame, bounds: DataFrame, probs: Sequence[float]) -> DataFrame:
    """Order statistics of the groups of ``bounds`` from counts of cells, then of the values in the
    cells that matter."""

    def bent(c: str) -> Column:
        return F.asinh(F.coalesce(F.try_divide(F.col(c) * 100, F.col("_scale")), F.lit(0.0)))

    step = F.coalesce(F.try_divide(bent("_v") - bent("_a"), bent("_b") - bent("_a")), F.lit(0.0))
    celled = rows.join(F.broadcast(bounds.select("_k", "_scale", "_a", "_b")), "_k").select("_k", "_v", F.floor(F.least(step, F.lit(1.0)) * CELLS).alias("_cell"))
    cells = celled.groupBy("_k", "_cell").agg(F.count(F.lit(1)).alias("_m"))
    upto = Window.partitionBy("_k").orderBy("_cell").rowsBetween(Window.unboundedPreceding, 0)
    cells = cells.withColumn("_upto", F.sum("_m").over(upto)).withColumn("_below", F.col("_upto") - F.col("_m"))

    place = (F.col("_n") - 1) * F.col("_w.p")
    at = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(p)).alias("p")) for i, p in enumerate(probs)])
    wanted = bounds.select("_k", "_n", F.explode(at).alias("_w")).select("_k", F.col("_w.i").alias("_i"), (place - F.floor(place)).alias("_part"), F.explode(F.array(
        F.struct(F.lit(0).alias("side"), F.floor(place).alias("k")), F.struct(F.lit(1).alias("side"), F.ceil(place).alias("k")))).alias("_s"))

    def holding(counted: DataFrame, on: list[str]) -> DataFrame:
        return wanted_in.join(counted, on).where((F.col("_s.k") >= F.col("_below")) & (F.col("_s.k") < F.col("_upto")))

    wanted_in = wanted
    held = holding(cells, ["_k"]).select("_k", "_i", "_part", "_s", "_cell", "_below")
    few = held.select("_k", "_cell", F.col("_below").alias("_start")).distinct()
    values = celled.join(F.broadcast(few), ["_k", "_cell"]).groupBy("_k", "_cell", "_start", "_v").agg(F.count(F.lit(1)).alias("_m"))
    within = Window.partitionBy("_k", "_cell").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    values = values.withColumn("_upto", F.col("_start") + F.sum("_m").over(within)).withColumn("_below", F.col("_upto") - F.col("_m"))
    wanted_in = held.drop("_below")
    ranked = holding(values, ["_k", "_cell"])
    both = ranked.groupBy("_k", "_i", "_part").agg(F.min(F.when(F.col("_s.side") == 0, F.col("_v"))).alias("x0"), F.min(F.when(F.col("_s.side") == 1, F.col("_v"))).alias("x1"))
    one = F.struct("_i", (F.col("x0") + (F.col("x1") - F.col("x0")) * F.col("_part")).alias("x"))
    return both.groupBy("_k").agg(F.transform(F.array_sort(F.collect_list(one)), lambda s: s["x"]).alias("q"))
