"""Mixing sources to target weights by systematic sampling.

Every source gets a target number of words: its weight's share of all words, never more than
``cap`` times what it has, with the excess shared again by weight among the sources below
their cap (water filling). Within a source every document expects ``target / source_size``
copies. The expected copies are prefix-summed over the source's documents, one random offset
is added, and a document is emitted once for every integer boundary its interval crosses.

Documents stand in ascending order of their sizes, which makes the sample stratified by size: the
sums over neighbouring strata differ by no more than their sizes do, so a source misses its target
by little more than its largest document holds. Expected copies are the same for all documents of
a source and the offset is drawn once, from a hash of the seed and the source's name, whatever the
outcome: every document's chance is what its expected copies say.

The prefix sum never gathers a source in one task: a document's place is the number of
documents of sizes that come earlier (from a histogram over sizes), plus those of equal size in
earlier hash buckets (from a histogram over buckets), plus its row number within its bucket.
Only histograms meet in one task: their rows are distinct sizes, not documents.

Edge cases: a null text has size 0; null sources form one source, ordered last; null ids are
allowed and order by an empty key; repeated rows are separate documents; a source with no
words has target 0 and its documents take 0 words; an empty table gives an empty result.
Extra columns, whatever their names, travel inside one struct and cannot clash.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallygrid.llm._common import space_words

#: Hex digits of the hash bucket that splits documents of one source and size: 16**3 buckets.
BUCKET_DIGITS = 3


def water_fill(sources: DataFrame, weights: Sequence[float], cap: float) -> DataFrame:
    """Add ``target`` to one row per source (columns ``source``, ``source_size``).

    Weights repeat over the sources in code point order, null last.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.array(*[F.lit(float(w)) for w in weights])
    limited = (
        sources.withColumn("w", F.get(weight, ((F.row_number().over(order) - 1) % len(weights)).cast("int")))
        .withColumn("limit", F.lit(float(cap)) * F.col("source_size"))
        .withColumn("level", F.col("limit") / F.col("w"))
    )
    rise = Window.orderBy("level", F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    before = F.coalesce(F.sum("limit").over(rise.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    onward = F.sum("w").over(rise.rowsBetween(0, Window.unboundedFollowing))
    total = F.sum("source_size").over(everything).cast("double")
    capped = limited.withColumn("capped", F.col("limit") * onward < (total - before) * F.col("w"))
    rest = F.sum("source_size").over(everything) - F.sum(F.when(F.col("capped"), F.col("limit")).otherwise(0.0)).over(everything)
    shares = F.sum(F.when(F.col("capped"), 0.0).otherwise(F.col("w"))).over(everything)
    return capped.select(
        "source", "source_size",
        F.when(F.col("capped"), F.col("limit")).otherwise(F.col("w") * F.try_divide(rest, shares)).alias("target"),
    )


def systematic_copies(
    docs: DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    size: Column | None = None,
    weights: Sequence[float] = (5, 2, 1),
    cap: float = 3.0,
    seed: str = "",
) -> DataFrame:
    """One row per document: ``row`` (struct of all its columns), ``source``, ``size``,
    ``source_size``, ``target`` and ``copies``, the times the mix takes it."""
    size = space_words(F.col("text")) if size is None else size
    key = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))
    # Sources are compared as structs, which are never null, so that one exchange of the rows
    # serves both the window and the join.
    own = [F.struct(F.col(source_col).cast("string").alias("name")).alias("s"), size.cast("long").alias("size"), F.substring(key, 1, BUCKET_DIGITS).alias("bucket")]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), key.alias("key"), *own)

    # The histograms read only the columns that they need.
    cells = docs.select(*own).groupBy("s", "size", "bucket").agg(F.count(F.lit(1)).alias("n"))
    by_size = cells.groupBy("s", "size").agg(F.sum("n").alias("n"))
    sources = by_size.groupBy("s").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"))
    targets = water_fill(sources.select(F.col("s.name").alias("source"), "source_size"), weights, cap)
    targets = targets.select(F.struct(F.col("source").alias("name")).alias("s"), "source_size", "target")
    name = F.concat(F.lit(seed), F.coalesce(F.concat(F.lit("="), F.col("s.name")), F.lit("")))
    offset = F.conv(F.substring(F.md5(name.cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    sooner = Window.partitionBy("s").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    by_size = by_size.select("s", "size", F.coalesce(F.sum("n").over(sooner), F.lit(0)).alias("sooner")).join(targets.withColumn("u", offset), "s")
    earlier = Window.partitionBy("s", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("s", "size", "bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("earlier")).join(by_size, ["s", "size"])

    # Rows with equal keys are copies of one document; the order of equal rows does not show.
    within = Window.partitionBy("s", "size", "bucket").orderBy("key")
    joined = rows.withColumn("place", F.row_number().over(within)).join(cells, ["s", "size", "bucket"]).select(
        "row", F.col("s.name").alias("source"), "size", "source_size", "target", "u", (F.col("sooner") + F.col("earlier") + F.col("place")).alias("rank"))
    crossed = _crossings(F.col("rank") - 1, F.col("rank"), F.col("u"))
    return joined.select("row", "source", "size", "source_size", "target", crossed.alias("copies"))


def _crossings(low: Column, high: Column, offset: Column) -> Column:
    """Integer boundaries between the prefix sums of two places."""
    rate = F.coalesce(F.try_divide(F.col("target"), F.col("source_size")), F.lit(0.0))
    return (F.floor(rate * high + offset) - F.floor(rate * low + offset)).cast("long")


def mix(docs: DataFrame, **kwargs) -> DataFrame:
    """The mixed documents themselves: each row of ``docs`` as often as the mix takes it."""
    taken = systematic_copies(docs, **kwargs).where("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).select("row.*")
