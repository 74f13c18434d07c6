"""Batches of a plain loop, for keys that spread over any number of ranges."""

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallygrid.operators import greedy_batches


def loop(rows, most):
    out, state = {}, defaultdict(lambda: [0, 0])
    for key, i, n in sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1])):
        at = state[key]
        n = n or 0
        if at[1] and at[1] + n > most:
            at[0], at[1] = at[0] + 1, 0
        at[1] += n
        out[key, i] = at[0]
    return out


@pytest.mark.parametrize("most", [3, 40, 5000])
@pytest.mark.parametrize("shape", ["even", "zeros", "huge"])
def test_hot_key(spark, most, shape):
    rng = random.Random(f"{most}{shape}")
    size = {"even": lambda: rng.randint(0, 9), "zeros": lambda: rng.choice([0, 0, 0, 0, None, 3]), "huge": lambda: rng.choice([0, 1, 2, 50, 7000])}[shape]
    rows = [("hot", i, size()) for i in range(700)] + [(rng.choice(["a", "b", "z", None]), 1000 + i, size()) for i in range(60)]
    rows += [("quiet", i, 0) for i in range(200)]
    items = spark.createDataFrame(rows, "key string, i int, n long").withColumn("batches", F.lit("x"))
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        found = greedy_batches.split_by_size(items, "key", "n", most, ["i"], hot=30).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert {(r["key"], r["i"]): r["batch"] for r in found} == loop(rows, most) and len(found) == len(rows)


def test_one_key_fills_every_task(spark):
    items = spark.range(4000).select(F.lit("k").alias("key"), "id", F.lit(1).alias("n"))
    found = greedy_batches.split_by_size(items, "key", "n", 100, ["id"], hot=1000)
    assert found.groupBy("batch").count().where("count <> 100").count() == 0
    ranges = found.inputFiles()
    assert len(ranges) >= 4  # each range was written by a task of its own
    assert greedy_batches.split_by_size(items.where("false"), "key", "n", 100, ["id"]).count() == 0


def test_chains():
    rng = np.random.default_rng(2)
    for _ in range(200):
        sizes = rng.choice([0, 1, 2, 5, 30], rng.integers(1, 30))
        following, (last, count) = greedy_batches.next_starts(sizes, 9), greedy_batches.chains(greedy_batches.next_starts(sizes, 9))
        for i in range(len(sizes)):
            total, j = 0, i
            while j < len(sizes) and not (total and total + sizes[j] > 9):
                total, j = total + sizes[j], j + 1
            assert following[i] == j
            at, n = i, 1
            while following[at] < len(sizes):
                at, n = following[at], n + 1
            assert (last[i], count[i]) == (at, n)
