"""The most frequent items, exactly, without counting all items.

1. A sketch of one row: items are counted by a hash into ``buckets`` buckets. Tasks send a number per
   bucket, however many items there are, and no item is more frequent than its bucket.
2. The fullest buckets propose: of their items, and no others, exact counts are made. The n-th
   greatest of them is a floor.
3. If every other bucket holds less than the floor, no item in it can be among the top n. If not,
   the items of all buckets that reach the floor are counted; an item that is frequent enough is in
   one of these, so this second count needs no proof.

Only numbers about buckets reach the driver: the proposing ones and the fullest of the others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallygrid.shared import stored

#: Buckets of the sketch, and buckets that propose for each item asked for.
BUCKETS, PROPOSING = 1 << 18, 8


def top_items(rows: DataFrame, items: Column, n: int, buckets: int = BUCKETS, proposing: int = PROPOSING) -> DataFrame:
    """``item`` and ``count`` of the ``n`` most frequent elements of an array column, ties by item;
    null elements are no items."""
    # The arrays are made once and read by each count.
    held = stored(rows.select(items.alias("items")))
    each = held.select(F.explode("items").alias("item")).where("item IS NOT NULL")
    bucket = F.pmod(F.xxhash64("item"), F.lit(buckets)).cast("int")
    sketch = stored(each.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("most")))
    # A row for each of a bounded number of buckets.
    fullest = sketch.orderBy(F.desc("most"), "bucket").limit(n * proposing + 1).collect()
    proposed, rest = [r["bucket"] for r in fullest[:n * proposing]], fullest[n * proposing:]

    def counted(some: DataFrame) -> DataFrame:
        return some.groupBy("item").agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), "item").limit(n)

    top = stored(counted(each.where(bucket.isin(proposed))))
    found = top.agg(F.count(F.lit(1)).alias("n"), F.min("count").alias("floor")).first()
    floor = found["floor"] if found["n"] == n else 0
    if rest and rest[0]["most"] >= floor:
        reach = sketch.where(F.col("most") >= floor).select("bucket")  # no more rows than the sketch has buckets
        top = counted(each.withColumn("bucket", bucket).join(F.broadcast(reach), "bucket", "left_semi"))
    return top.orderBy(F.desc("count"), "item")
