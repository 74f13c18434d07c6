"""Targets by water filling and systematic copies against brute force."""

import hashlib
import re
from collections import defaultdict
from math import floor

import pytest
from pyspark.sql import functions as F

from tallygrid.llm import mixing


def slow_targets(sizes, weights, cap):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    fixed, total = {}, sum(sizes.values())
    while True:
        free = [s for s in order if s not in fixed]
        rest, share = total - sum(fixed.values()), sum(w[s] for s in free)
        now = {s: rest * w[s] / share for s in free}
        over = [s for s in free if now[s] > cap * sizes[s]]
        if not over:
            return fixed | now
        fixed |= {s: cap * sizes[s] for s in over}


@pytest.mark.parametrize("weights", [(5, 2, 1), (1,), (100, 1)])
def test_targets(spark, docs, weights):
    sizes = defaultdict(int)
    for r in docs.collect():
        sizes[r["source"]] += len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))
    found = mixing.systematic_copies(docs, weights=weights).collect()
    want = slow_targets(sizes, weights, 3)
    for r in found:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
    assert sum({r["source"]: r["target"] for r in found}.values()) == pytest.approx(sum(sizes.values()))


def test_copies(docs):
    found = mixing.systematic_copies(docs).collect()
    assert len(found) == docs.count()
    by_source = defaultdict(list)
    for r in found:
        by_source[r["source"]].append(r)
    for source, rows in by_source.items():
        name = "" if source is None else "=" + source
        u = int(hashlib.md5(name.encode()).hexdigest()[:8], 16) / 2**32
        rate = rows[0]["target"] / rows[0]["source_size"] if rows[0]["source_size"] else 0
        ids = lambda r: "" if r["row"]["doc_id"] is None else str(r["row"]["doc_id"])
        rows.sort(key=lambda r: (r["size"], hashlib.md5(ids(r).encode()).hexdigest()))
        want = [floor(rate * k + u) - floor(rate * (k - 1) + u) for k in range(1, len(rows) + 1)]
        taken = sum(r["size"] * r["copies"] for r in rows)
        # Rows with equal size and id stand in any order.
        groups = sorted((r["size"], ids(r), r["copies"]) for r in rows)
        assert groups == sorted((r["size"], ids(r), c) for r, c in zip(rows, want, strict=True))
        # In the order of sizes a source misses its target by little more than its largest document.
        assert abs(taken - rows[0]["target"]) <= 2 * max(r["size"] for r in rows) and max(r["copies"] for r in rows) <= 3
    assert sorted(map(str, found)) == sorted(map(str, mixing.systematic_copies(docs.repartition(3)).collect()))


def test_mixed_rows(docs, none):
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    assert mixed.count() == sum(r["copies"] for r in mixing.systematic_copies(docs).collect())
    assert mixing.mix(none).count() == 0
    zero = docs.withColumn("text", F.lit(None).cast("string"))
    assert {(r["target"], r["size"] * r["copies"]) for r in mixing.systematic_copies(zero).collect()} == {(0.0, 0)}
