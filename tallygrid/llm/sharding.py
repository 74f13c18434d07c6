"""Sharding by vector bin packing.

Shards are balanced in bytes, tokens and rows together. Items are placed largest first, each
in the shard where the dot product of its vector with the shard's residual capacity is
highest.

Documents with equal texts form a group. A group that weighs more than ``single_share`` of a shard
in any dimension is placed by its own vector; at most ``3 * shards / single_share`` groups can be
that heavy, so the driver sees some ten thousand rows of sums, whatever the input, and no
document. The groups below that weight, whose number grows with the input, hash into ``cells``
cells, which are placed like groups. A group heavier than ``whole_share`` of a shard fits nowhere
in balance: it is cut by a hash of the document ids into pieces of at most half that weight. Rows of
such a group that share an id, or have none, are dealt to its pieces in turn: how many each piece
gets follows from their number, so any numbering of them will do. The tables broadcast have the
same bounds.

Within a shard the slot is the number of documents in earlier (cell, bucket) pairs plus the row
number within the pair; a cell has ``buckets`` pairs, and a single group one more for each
``1 / buckets`` of the weight at which groups are cut.

Edge cases: a null text counts no bytes and no tokens; null and equal ids are dealt in turn where
their group is cut, and placed like any other row elsewhere; equal texts stay in one shard unless their group is heavier than
``whole_share`` of it; an empty table gives an empty result. Extra columns travel inside one
struct and cannot clash.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallygrid.llm._common import cut, space_words

DIMENSIONS = ("bytes", "tokens", "rows")


def pack(items: np.ndarray, bins: int) -> np.ndarray:
    """The bin of each item (a row of non-negative weights), by highest dot product.

    Weights are taken relative to a bin's fair share of each dimension; ties go to the lower
    item and the lower bin.
    """
    fair = items.sum(axis=0) / bins
    vectors = np.divide(items, fair, out=np.zeros_like(items, dtype=float), where=fair > 0)
    residual = np.ones((bins, items.shape[1]))
    placed = np.zeros(len(items), dtype=np.int64)
    for i in np.argsort(-vectors.max(axis=1), kind="stable"):
        best = int(np.argmax(residual @ vectors[i]))
        placed[i] = best
        residual[best] -= vectors[i]
    return placed


def shard(
    docs: DataFrame,
    shards: int = 24,
    id_col: str = "doc_id",
    text_col: str = "text",
    row_bytes: int = 8,
    cells: int = 4096,
    buckets: int = 16,
    whole_share: float = 0.5,
    single_share: float = 1 / 256,
    tokens: Column | None = None,
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """``row`` (struct of ``columns``, by default of all), ``size`` (bytes of the text plus ``row_bytes``),
    ``shard`` (0 to ``shards`` - 1) and ``slot`` (gapless from 0 within the shard)."""
    spark = docs.sparkSession
    text = F.col(text_col)
    size = (F.coalesce(F.octet_length(text), F.lit(0)) + row_bytes).cast("long")
    group = F.xxhash64(text)
    spread = F.xxhash64(F.col(id_col), F.lit("piece"))
    facts = cut(docs.select(
        group.alias("g"), spread.alias("h"), size.alias("bytes"),
        (space_words(text) if tokens is None else tokens).alias("tokens"), F.lit(1).cast("long").alias("rows"),
    ))
    sums = [F.sum(c).alias(c) for c in DIMENSIONS]
    total = facts.agg(*sums).first()
    limits = {c: max(1.0, whole_share * (total[c] or 0) / shards) for c in DIMENSIONS}
    excess = F.greatest(*[F.col(c) / F.lit(limits[c]) for c in DIMENSIONS])
    heavy = facts.groupBy("g").agg(*sums).withColumn("excess", excess).where(F.col("excess") > single_share / whole_share)
    # At most 3 * shards / single_share rows, since each has that share of some dimension.
    n_pieces = F.when((F.col("excess") > 1) & (F.col("rows") > 1), F.ceil(2 * F.col("excess"))).otherwise(1)
    n_buckets = 1 + F.floor(F.least(F.col("excess"), F.lit(1.0)) * buckets)
    first, single = cells, []
    for r in heavy.select("g", n_pieces.cast("long").alias("pieces"), n_buckets.cast("long").alias("buckets")).orderBy("g").collect():
        single.append((r["g"], r["pieces"], first, r["buckets"]))
        first += r["pieces"]
    split = F.broadcast(spark.createDataFrame(single, "g long, pieces long, first long, buckets long"))

    def celled(df: DataFrame) -> DataFrame:
        cell = F.coalesce(F.col("first") + F.pmod(F.col("h"), F.col("pieces")), F.pmod(F.col("g"), F.lit(cells)))
        return df.join(split, "g", "left").withColumn("cell", cell).withColumn(
            "bucket", F.pmod(F.xxhash64("h", F.lit("slot")), F.coalesce("buckets", F.lit(buckets)))
        )

    # Rows of a group that is cut which the hash of their ids does not tell apart: text and so size are the same.
    cut_up = facts.join(split.where("pieces > 1"), "g")
    alike = cut_up.groupBy("g", "h", "first", "pieces", "buckets").agg(F.count(F.lit(1)).alias("n"), F.first("bytes").alias("bytes"), F.first("tokens").alias("tokens")).where("n > 1")
    alike = cut(alike.withColumn("turns", F.col("pieces") * F.col("buckets")))
    some_alike = not alike.isEmpty()

    def dealt(df: DataFrame, turn: Column) -> DataFrame:
        place = F.pmod(F.col("h") + turn, F.col("turns"))
        return df.withColumn("cell", F.col("first") + F.pmod(place, F.col("pieces"))).withColumn("bucket", F.floor(place / F.col("pieces")))

    # One row per (cell, bucket): its number is bounded by the parameters.
    counted = celled(facts.join(alike, ["g", "h"], "left_anti") if some_alike else facts).select("cell", "bucket", *DIMENSIONS)
    if some_alike:
        in_turn = alike.withColumn("turn", F.explode(F.sequence(F.lit(0).cast("long"), F.least("n", "turns") - 1)))
        in_turn = dealt(in_turn, F.col("turn")).withColumn("rows", F.floor(F.col("n") / F.col("turns")) + F.when(F.col("turn") < F.col("n") % F.col("turns"), 1).otherwise(0))
        counted = counted.unionByName(in_turn.select("cell", "bucket", (F.col("bytes") * F.col("rows")).alias("bytes"), (F.col("tokens") * F.col("rows")).alias("tokens"), "rows"))
    held = counted.groupBy("cell", "bucket").agg(*sums).toPandas().sort_values(["cell", "bucket"])
    items = held.groupby("cell")[list(DIMENSIONS)].sum()
    place = dict(zip(items.index, pack(items.to_numpy(dtype=float), shards), strict=True)) if len(items) else {}
    held["shard"] = held["cell"].map(place)
    held["ahead"] = held.groupby("shard")["rows"].cumsum() - held["rows"] if len(held) else []
    plan = F.broadcast(spark.createDataFrame(
        [(int(c), int(b), int(s), int(a)) for c, b, s, a in held[["cell", "bucket", "shard", "ahead"]].itertuples(index=False)],
        "cell long, bucket long, shard int, ahead long",
    ))
    plain = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in columns or docs.columns]).alias("row"),
        group.alias("g"), spread.alias("h"), size.alias("size"), F.col(id_col).alias("id"),
    )
    rows = celled(plain.join(alike, ["g", "h"], "left_anti") if some_alike else plain)
    if some_alike:
        turn = F.row_number().over(Window.partitionBy("g", "h").orderBy("id")) - 1
        again = dealt(plain.join(alike.select("g", "h", "first", "pieces", "turns"), ["g", "h"]).withColumn("turn", turn), F.col("turn"))
        kept = ["row", "g", "size", "id", "cell", "bucket"]
        rows = rows.select(*kept).unionByName(again.select(*kept))
    within = Window.partitionBy("cell", "bucket").orderBy("id", "g")
    return (
        rows.withColumn("n", F.row_number().over(within))
        .join(plan, ["cell", "bucket"])
        .select("row", "size", "shard", (F.col("ahead") + F.col("n") - 1).cast("long").alias("slot"))
    )
