"""Results of brute force over all pairs."""

import math

import numpy as np
import pytest

from tallygrid.llm import top_k

SCHEMA = "vec_id long, embedding array<double>, score long, v string, `group` int, number string"


def brute(queries, rows, k, scale=256.0):
    def whole(v):
        if v is None or any(x is None or not math.isfinite(x) for x in v):
            return None
        return [max(-(2**63), min(2**63 - 1, math.floor(x * scale))) for x in v]

    ready, out = [(i, w) for i, v in rows if (w := whole(v)) is not None], []
    for i, v in queries:
        q = whole(v)
        if q is None:
            continue
        scored = [(max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(q, w, strict=False)))), j) for j, w in ready if j is None or j != i]
        scored.sort(key=lambda x: (-x[0], x[1] is None, x[1] or 0))
        out += [(i, r + 1, j, s) for r, (s, j) in enumerate(scored[:k])]
    return sorted(map(str, out))


def vectors(seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, 12))
    rows = [(int(i), (rng.lognormal(0, 1.2) * (centres[i % 6] + 0.1 * rng.normal(size=12))).tolist()) for i in range(300)]
    rows += [(1000 + i, rows[50][1]) for i in range(90)]  # a hot vector
    rows += [(2000 + i, [0.0] * 12) for i in range(8)]
    rows += [(50, rows[7][1]), (None, rows[0][1]), (None, rows[50][1]), (3000, None), (3001, [1.0, None]), (3002, [float("nan")] * 12), (3003, [float("inf"), 1.0])]
    return rows + [(3050, []), (3051, [1.0, 2.0]), (3100, (np.array(rows[3][1]) * 40).tolist()), (-50, rows[9][1])]


@pytest.mark.parametrize("coordinate_from", [0.0, 0.7, 2.0])
@pytest.mark.parametrize("bucket", [16, 2048])
def test_brute_force(spark, coordinate_from, bucket):
    rows = vectors(3)
    df = spark.createDataFrame([(*r, 1, "v", 2, "n") for r in rows], SCHEMA).repartition(3)
    queries = df.where("vec_id % 50 = 0")
    found = top_k.top_k(queries, df, k=5, bucket=bucket, block=7, coordinate_from=coordinate_from, focus=3)
    got = sorted(str((r["query_id"], r["rank"], r["vec_id"], r["score"])) for r in found.collect())
    assert got == brute([r for r in rows if r[0] is not None and r[0] % 50 == 0], rows, 5)


def test_large_numbers(spark):
    rows = [(i, [s * 1e7 * (i + 1), 3e12 - i, float(i)]) for i, s in zip(range(12), [1, -1] * 6, strict=True)] + [(50, [1e300, 1.0, -1e300])]
    df = spark.createDataFrame([(*r, 1, "v", 2, "n") for r in rows], SCHEMA)
    found = top_k.top_k(df, df, k=4)
    assert sorted(str((r["query_id"], r["rank"], r["vec_id"], r["score"])) for r in found.collect()) == brute(rows, rows, 4)


def test_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0], 1, "v", 2, "n"), (50, [2.0], 1, "v", 2, "n")], SCHEMA)
    assert [tuple(r) for r in top_k.top_k(df, df).orderBy("query_id").collect()] == [(0, 1, 50, 131072), (50, 1, 0, 131072)]
    assert top_k.top_k(df.where("vec_id = 0"), df.where("vec_id = 0")).count() == 0
    assert top_k.top_k(df.where("false"), df.where("false")).count() == 0


def test_pruning_leaves_out():
    """Far and short buckets are left out or cut; what is left is verified."""
    rng = np.random.default_rng(1)
    near = rng.normal(size=8)
    x = np.array(sorted((rng.normal(size=(400, 8)) * 20).round().tolist() + [(near * 90).round().tolist()] * 6, key=lambda v: -np.linalg.norm(v)), np.int64)
    bucket = top_k.Vectors(len(x), 8, "int64", list(range(len(x))), x.tobytes())
    q = (near * 100).round().astype(np.int64)
    block = top_k.Vectors(1, 8, "int64", [None], q.tobytes())
    best = top_k.Best(block, [None], 5)
    assert best.meet(bucket, 0.7, 4) == {"left_out": 0, "coordinates": 0, "lengths": 1}
    assert best.meet(bucket, 0.7, 4) == {"left_out": 0, "coordinates": 1, "lengths": 0}
    short = top_k.Vectors(20, 8, "int64", list(range(20)), (x[:20] // 50).tobytes())
    assert best.meet(short, 0.7, 4)["left_out"] == 1
    unit = q / np.linalg.norm(q)
    kept = top_k.by_coordinates(unit, 0.9, bucket, 4)
    cosines = bucket.unit @ unit
    assert set(np.flatnonzero(cosines >= 0.9)) <= set(kept.tolist()) and len(kept) < 100
