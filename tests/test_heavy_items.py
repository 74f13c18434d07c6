"""Top items of a plain count, whatever the sketch holds."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tallygrid.operators import heavy_items


def plain(rows, n):
    return sorted(Counter(x for items in rows for x in items or () if x is not None).items(), key=lambda p: (-p[1], p[0]))[:n]


@pytest.mark.parametrize("buckets, proposing", [(1 << 18, 8), (64, 1), (4, 1), (1, 1)])
@pytest.mark.parametrize("flat", [False, True])
def test_plain_count(spark, buckets, proposing, flat):
    rng = random.Random(buckets)
    rows = [[f"w{rng.randint(0, 300) if flat else int(rng.paretovariate(0.6)) % 1000}" for _ in range(rng.randint(0, 30))] for _ in range(200)] + [None, [], [None, "w1"]]
    df = spark.createDataFrame([(r, "clash") for r in rows], "words array<string>, item string").repartition(3)
    for n in (1, 7, 5000):
        found = heavy_items.top_items(df, F.col("words"), n, buckets, proposing)
        assert [tuple(r) for r in found.collect()] == plain(rows, n)


def test_ties_that_only_the_second_count_sees(spark):
    """All items are as frequent, so the proposed ones prove nothing."""
    df = spark.createDataFrame([([f"{i:03}" for i in range(500)],)] * 3, "words array<string>")
    assert [tuple(r) for r in heavy_items.top_items(df, F.col("words"), 4, 32, 1).collect()] == [(f"{i:03}", 3) for i in range(4)]


def test_shuffle_is_bounded_by_the_sketch(spark):
    """Exact counts are made of the proposed buckets' items only."""
    rows = spark.range(20_000).select(F.array(F.concat(F.lit("rare"), F.col("id").cast("string")), F.lit("often")).alias("w"))
    found = heavy_items.top_items(rows, F.col("w"), 1, buckets=1024)
    assert [tuple(r) for r in found.collect()] == [("often", 20_000)]
    assert heavy_items.top_items(rows.where("false"), F.col("w"), 3).count() == 0
