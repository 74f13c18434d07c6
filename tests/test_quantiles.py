"""Quantiles of groups whose rows tie."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallygrid.operators.quantiles import exact_quantiles


def test_ties_are_counted_not_gathered(spark):
    rng = np.random.default_rng(1)
    probs = [0.0, 0.25, 0.5, 0.9, 1.0]
    rows = [("a", float(v)) for v in rng.integers(0, 4, 900)] + [("b", float(v)) for v in rng.normal(size=300)]
    out = exact_quantiles(spark.createDataFrame(rows, "g string, v double").repartition(3), ["g"], "v", probs, direct_rows=40)
    assert "collect_list(_v" not in out._jdf.queryExecution().toString()
    for r in out.collect():
        assert r["q"] == pytest.approx(list(np.quantile([v for g, v in rows if g == r["g"]], probs)))


def test_shapes_and_null_keys(spark):
    rng = np.random.default_rng(2)
    probs = [0.0, 0.01, 0.5, 0.75, 1.0]
    groups = {"tail": np.exp(rng.normal(0, 6, 500)), "near": 1e9 + rng.normal(size=500), "sign": rng.normal(size=501) * 1e-9, "one": np.array([3.5]), "tied": np.full(400, 2.0), None: rng.integers(-5, 5, 99).astype(float)}
    rows = [(k, float(v)) for k, vs in groups.items() for v in vs] + [("tail", None)]
    out = exact_quantiles(spark.createDataFrame(rows, "g string, v double").repartition(5), ["g"], "v", probs, direct_rows=10).collect()
    assert len(out) == len(groups)
    for r in out:
        assert r["q"] == pytest.approx(list(np.quantile(groups[r["g"]], probs)), rel=1e-12)


def test_many_equal_values(spark):
    rows = spark.range(3_000_000).select((F.col("id") % 3).cast("double").alias("v"))
    assert exact_quantiles(rows, [], "v", [0.1, 0.5, 0.9], direct_rows=1000).first()["q"] == [0.0, 1.0, 2.0]


def shuffled(plan):
    """Rows that each exchange of a plan has written."""
    metric = plan.metrics().get("shuffleRecordsWritten")
    found = [metric.get().value()] if metric.isDefined() else []
    children = plan.children()
    return found + [n for i in range(children.size()) for n in shuffled(children.apply(i))]


def test_rows_are_counted_where_they_are_read(spark):
    """Tied rows of two large groups and the rows of small ones: no exchange sees the rows of a group."""
    rows = spark.range(0, 20_000, 1, 4).select(F.when(F.col("id") < 60, F.concat(F.lit("s"), (F.col("id") % 3).cast("string"))).when(F.col("id") % 2 == 0, "a").alias("g"), (F.col("id") * 7 % 40).cast("double").alias("v"))
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        out = exact_quantiles(rows, ["g"], "v", [0.25, 0.5, 0.75], direct_rows=100)
        found = {r["g"]: r["q"] for r in out.collect()}
        assert 0 < max(shuffled(out._jdf.queryExecution().executedPlan())) < 2_000
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    values = {}
    for r in rows.collect():
        values.setdefault(r["g"], []).append(r["v"])
    assert set(found) == set(values) == {None, "a", "s0", "s1", "s2"}
    for g, vs in values.items():
        assert found[g] == pytest.approx(list(np.quantile(vs, [0.25, 0.5, 0.75])))
