"""Merges that rewrite only the files with a changed row, versions, conflicts and clean-up."""

import pytest
from pyspark.sql import functions as F

from tallygrid.operators import batches, checkpoints
from tallygrid.sources.file_table import Conflict, FileTable


@pytest.fixture
def table(spark, tmp_path):
    made = FileTable(spark, str(tmp_path / "t"))
    rows = spark.range(100).select(F.format_string("m\\%03d.jpg", "id").alias("file"), F.lit("old").alias("field"), (F.col("id") % 5 != 0).alias("model_ok"), F.lit(None).cast("int").alias("retry_count"))
    made.append(rows.repartitionByRange(10, "file"))
    return made


def retry(spark, *rows):
    return spark.createDataFrame(list(rows), "file string, field string, model_ok boolean")


def test_one_row_rewrites_one_file(spark, table):
    before, files = {r["file"]: r for r in table.read().collect()}, set(table.manifest()["files"])
    assert len(files) == 10
    done = checkpoints.merge_retries(table, retry(spark, ("m/015.jpg", "new", True)), "file", ["field"])
    assert done == {"version": 2, "rewritten": 1, "kept": 9, "written": 1}
    assert len(files & set(table.manifest()["files"])) == 9
    after = {r["file"]: r for r in table.read().collect()}
    assert {f for f in after if after[f] != before[f]} == {"m\\015.jpg"} and len(after) == 100
    assert tuple(after["m\\015.jpg"])[1:] == ("new", True, 1)
    assert {r["file"]: r for r in table.read(1).collect()} == before  # the version before is still there


def test_as_the_whole_table_merge(spark, table):
    again = retry(spark, ("m/000.jpg", "new", True), ("m\\050.jpg", "bad", False), ("m/099.jpg", "last", True), ("m/none.jpg", "x", True))
    want = checkpoints.apply_retries(table.read(1), again, "file", ["field"]).collect()
    assert checkpoints.merge_retries(table, again, "file", ["field"])["rewritten"] == 3
    assert sorted(map(tuple, table.read().collect())) == sorted(map(tuple, want))
    assert checkpoints.merge_retries(table, again.where("false"), "file", ["field"]) == {"version": 2, "rewritten": 0, "kept": 10, "written": 0}


def test_conflict_and_lost_write(spark, table):
    other = FileTable(spark, table.path)

    def change(rows, changes):
        checkpoints.merge_retries(other, retry(spark, ("m/001.jpg", "first", True)), "file", ["field"])
        return rows.withColumn("field", F.lit("second"))

    with pytest.raises(Conflict):
        table.merge(retry(spark, ("m/001.jpg", "x", True)), F.replace("file", F.lit("\\"), F.lit("/")), F.col("file"), change)
    assert {r["field"] for r in table.read().where("field <> 'old'").collect()} == {"first"}
    with pytest.raises(RuntimeError):  # a change that fails leaves the table as it was
        table.merge(retry(spark, ("m/001.jpg", "x", True)), F.replace("file", F.lit("\\"), F.lit("/")), F.col("file"), lambda rows, changes: (_ for _ in ()).throw(RuntimeError()))
    assert table.version() == 2 and table.read().count() == 100
    assert table.forget() > 0 and table.read().count() == 100 and table.forget() == 0


def test_jobs(spark, tmp_path):
    log = FileTable(spark, str(tmp_path / "log"))
    rows = spark.createDataFrame([(f"j{i}", "RUNNING", "t0", "t0", "kept") for i in range(40)], "job_name string, state string, created_at string, updated_at string, extra string")
    log.append(rows.repartitionByRange(8, "job_name"))
    new = spark.createDataFrame([("j1", "DONE"), ("j99", "NEW")], "job_name string, state string")
    want = sorted(map(str, batches.upsert_jobs(rows, new, "t1").select(*rows.columns).collect()))
    assert batches.merge_jobs(log, new, "t1") == {"version": 2, "rewritten": 1, "kept": 7, "written": 2}
    assert sorted(map(str, log.read().collect())) == want


def test_empty(spark, tmp_path):
    none = FileTable(spark, str(tmp_path / "none"))
    with pytest.raises(ValueError):
        none.read()
    none.append(spark.range(0))
    assert none.read().count() == 0 and none.version() == 1
