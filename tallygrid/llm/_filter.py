"""Filters of bounded size that tell which rows cannot have one of many keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallygrid.llm._common import stored

#: Bits of a filter: so many per key, at most so many in all (16 MiB).
BITS_PER_KEY, MOST_BITS = 32, 1 << 27
#: Bits of a bitmap, a fixed value of Spark's bitmap functions.
BITMAP = 1 << 15


class BitmapFilter:
    """Bitmaps over hashes of the different values of a column.

    What a filter rules out needs no join. With more keys than it has room for it rules out less,
    and whatever uses it moves more rows to the same result.
    """

    def __init__(self, keys: DataFrame, column: str):
        self.column = column
        n = max(keys.count(), 1)
        self.bits = min(MOST_BITS, max(BITMAP, 1 << (BITS_PER_KEY * n - 1).bit_length()))
        bit = self._bit()
        made = F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("_bitmap")
        self.bitmaps = stored(keys.groupBy(F.bitmap_bucket_number(bit).alias("_bucket")).agg(made))

    def _bit(self) -> Column:
        return F.pmod(F.xxhash64(self.column), F.lit(self.bits)) + 1  # Spark's buckets count from 1

    def probe(self, rows: DataFrame) -> DataFrame:
        """``rows`` with ``maybe``: false only if the key is not in the filter."""
        bit = self._bit()
        probed = rows.withColumn("_bucket", F.bitmap_bucket_number(bit)).withColumn("_place", F.bitmap_bit_position(bit))
        # At most MOST_BITS / BITMAP rows of 4 KiB.
        probed = probed.join(F.broadcast(self.bitmaps), "_bucket", "left")
        byte = F.conv(F.hex(F.substring("_bitmap", (F.col("_place") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        maybe = F.coalesce(F.expr("getbit(_byte, cast(_place % 8 as int))") == 1, F.lit(False))
        return probed.withColumn("_byte", byte).withColumn("maybe", maybe).select(*rows.columns, "maybe")
