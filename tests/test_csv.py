"""CSV tables: written side by side in bounded files, read back whole."""

from pyspark.sql import functions as F

from tallygrid.sources import readers, writers

WANT = [(str(10 ** 18 + i), None if i % 5 == 0 else f'a, "{i}"\nb', i / 2) for i in range(200)]


def made(spark):
    rows = spark.range(0, 200, 1, 4).select((F.lit(10 ** 18) + F.col("id")).cast("string").alias("key"), F.when(F.col("id") % 5 > 0, F.concat(F.lit('a, "'), "id", F.lit('"\nb'))).alias("t"), (F.col("id") / 2).alias("v"))
    return rows.unionByName(rows.where("false")).unionByName(rows.where("false"))


def back(spark, path):
    return sorted(tuple(r) for r in readers.read_table(spark, str(path), ["key"]).collect())


def files(path):
    return sorted(path.glob("part-*.csv"))


def test_partitions_are_written_side_by_side(spark, tmp_path):
    path = tmp_path / "t.csv"
    assert writers.save_csv(made(spark), str(path))
    assert len([f for f in files(path) if f.read_text().count("\n") > 1]) == 4 and back(spark, path) == WANT
    assert writers.save_csv(made(spark).where("false"), str(tmp_path / "no.csv")) is False and not (tmp_path / "no.csv").exists()


def test_files_are_bounded_and_may_be_one(spark, tmp_path):
    assert writers.save_csv(made(spark), str(tmp_path / "many.csv"), rows=20)
    assert len(files(tmp_path / "many.csv")) >= 10 and all(f.read_text().startswith("key,t,v") for f in files(tmp_path / "many.csv")) and back(spark, tmp_path / "many.csv") == WANT
    assert writers.save_csv(made(spark), str(tmp_path / "one.csv"), parts=1)
    assert len(files(tmp_path / "one.csv")) == 1 and back(spark, tmp_path / "one.csv") == WANT
