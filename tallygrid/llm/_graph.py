"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallygrid.llm._common import cut


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step. Minima combine before the shuffle and are written, a row per node: a hub's edges
    meet one row in a join of their own, which Spark splits."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = both if large else both.where("b < a")
    least = cut(near.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")))
    linked = (both.where("b > a") if large else near).join(least, "a")
    moved = linked.select(F.col("b").alias("a"), F.col("m").alias("b"))
    if not large:
        moved = moved.unionByName(least.select("a", F.col("m").alias("b")))
    return moved.where("a <> b").distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``node`` and ``label`` (the least node of its component) for every node of ``edges``
    (columns ``a`` and ``b``) that is not itself the least of its component."""
    now = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    state = None
    for _ in range(most_rounds):
        seen = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if seen == state:
            return now.select(F.col("a").alias("node"), F.col("b").alias("label"))
        state = seen
        now = cut(_star(_star(now, large=True), large=False))
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
