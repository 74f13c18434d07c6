"""Reports and resumable extraction."""

import pytest
from pyspark.sql import functions as F

from tallygrid.plans import extraction
from tallygrid.plans.profiler import Profiler
from tallygrid.plans.report import summary, write_report
from tallygrid.sources.xlsx import read_sheet


def test_report(spark, sf_dir, tmp_path):
    profiler = Profiler(spark.read.parquet(f"{sf_dir}/nation.parquet"))
    book = str(tmp_path / "report.xlsx")
    written = write_report(profiler, str(tmp_path), book)
    assert "01_dataset_profile" in written and spark.read.option("header", True).csv(str(tmp_path / "01_dataset_profile.csv")).count() == 3
    assert read_sheet(spark, book, "Summary").count() == summary(profiler).count() + 1 > 1  # and the note


def test_extraction_goes_on(spark, tmp_path):
    folder, calls = str(tmp_path / "c"), []
    manifest = spark.createDataFrame([("1", "a/x.JPG"), ("2", "a\\y.png"), ("3", "b/z.jpg"), ("4", "b/notes.txt"), ("5", None)], "id string, file string")
    planned = extraction.plan(manifest, "file", [".jpg", ".png"])

    def features(rows):
        calls.append(sorted(r["id"] for r in rows.collect()))
        return rows.withColumn("size", F.length("file")).withColumn("ok", F.col("id") != "3")

    extraction.extract(planned.where("subject = 'a'"), features, folder)
    counts = {r["subject"]: (r["ok"], r["failed"]) for r in extraction.extract(planned, features, folder).collect()}
    assert calls == [["1", "2"], ["3"]] and counts == {"a": (2, 0), "b": (0, 1), None: (2, 1)}
    merged = extraction.merge(spark, folder, ["id"], "file", str(tmp_path / "m"))
    assert merged.count() == 3 and "_file" not in merged.columns
    with pytest.raises(ValueError):
        extraction.merge(spark, folder, ["nope"], "file", str(tmp_path / "n"))
    assert extraction.plan(manifest, "file", [".jpg"], subjects=["b"]).count() == 1
