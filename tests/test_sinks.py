"""Writes that appear whole, and counts made while writing."""

import os

import pytest
from pyspark.sql import functions as F

from tallygrid.operators import checkpoints
from tallygrid.sources import atomic_lines, writers


def lines(spark, path):
    return sorted(r["value"] for r in writers.read_lines_whole(spark, path).collect())


def test_lines_appear_whole(spark, tmp_path):
    path = str(tmp_path / "lines")
    rows = spark.range(50).select(F.format_string('{"k": %d, "é": "x"}', "id").alias("line")).repartition(4)
    writers.write_lines_whole(rows, path)
    want = sorted(r["line"] for r in rows.collect())
    assert lines(spark, path) == want and sum(f["rows"] for f in atomic_lines.manifest(path)) == 50
    writers.write_lines_whole(rows.limit(3), path, append=True)
    assert len(lines(spark, path)) == 53
    writers.write_lines_whole(rows.limit(3), path)
    assert len(lines(spark, path)) == 3
    assert atomic_lines.sweep(path) > 0 and len(lines(spark, path)) == 3 and atomic_lines.sweep(path) == 0


def test_a_failed_task_leaves_nothing_visible(spark, tmp_path):
    path = str(tmp_path / "lines")
    good = spark.range(8).select(F.col("id").cast("string").alias("line"))
    bad = spark.range(40).repartition(4).select(F.when(F.col("id") == 39, F.raise_error(F.lit("lost"))).otherwise(F.col("id").cast("string")).alias("line"))
    with pytest.raises(Exception, match="lost"):
        writers.write_lines_whole(bad, path)
    assert atomic_lines.manifest(path) == [] and lines(spark, path) == []
    writers.write_lines_whole(good, path)
    for append in (True, False):
        with pytest.raises(Exception, match="lost"):
            writers.write_lines_whole(bad, path, append=append)
        assert lines(spark, path) == [str(i) for i in range(8)]  # the version before is whole
    with pytest.raises(Exception, match="line break"):
        writers.write_lines_whole(spark.createDataFrame([("a\nb",)], "line string"), path)
    writers.write_lines_whole(good.where("false"), path)
    assert lines(spark, path) == []
    live = {f["name"] for f in atomic_lines.manifest(path)}
    atomic_lines.sweep(path)
    assert set(os.listdir(f"{path}/data")) == live


def test_counts_while_writing(spark, tmp_path):
    rows = spark.range(300).select(
        F.when(F.col("id") % 7 > 0, F.concat(F.lit("s"), (F.col("id") % 3).cast("string"))).alias("subject"), F.when(F.col("id") % 5 > 0, F.col("id") % 2 == 0).alias("ok"),
        F.when(F.col("id") % 4 == 0, " ").when(F.col("id") % 4 == 1, "x").alias("a"), F.col("id").alias("b")).repartition(4)
    path = str(tmp_path / "c")
    seen = writers.observed_write(rows, path, ["a", "b"], ["s1", "s2", "none", None])
    back = spark.read.parquet(path)
    counts = {r["subject"]: {"ok": r["ok"], "failed": r["failed"], "total": r["total"]} for r in checkpoints.outcome_counts(back.where("subject IS NOT NULL")).where("subject IS NOT NULL").collect()}
    assert seen["subjects"]["s1"] == counts["s1"] and seen["subjects"]["s2"] == counts["s2"] and seen["subjects"]["none"]["total"] == 0
    assert seen["subjects"][None]["total"] == back.where("subject IS NULL").count()
    assert seen["total"]["total"] == 300 == back.count() and seen["total"]["ok"] == back.where("ok").count()
    assert seen["fields"] == {r["field"]: {"n_filled": r["n_filled"], "pct": r["pct"]} for r in checkpoints.field_coverage(back, ["a", "b"]).collect()}
    none = writers.observed_write(rows.where("false"), str(tmp_path / "n"), ["a"])
    assert none["total"] == {"ok": 0, "failed": 0, "total": 0} and none["fields"]["a"] == {"n_filled": 0, "pct": None}
