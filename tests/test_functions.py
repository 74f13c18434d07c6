"""Scalar expressions, sources, sinks, model calls and streaming forms."""

import json

import pytest
from pyspark.sql import functions as F

from tallygrid.functions import jsons, measures, text
from tallygrid.operators import model_calls
from tallygrid.sources import readers, writers
from tallygrid.sources.xlsx import read_sheet, register, sheet_rows, workbook
from tallygrid.sources.file_table import FileTable
from tallygrid.streaming import forms


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_paths_and_keys(spark):
    f, g = F.lit("a\\b c\\x.jpg"), F.lit("top/sub: 1/")
    assert one(spark, text.derive_subject(f), text.derive_subject(f, g), text.derive_subject(F.lit("x.jpg")), text.derive_subject(f, F.lit(" ")), text.derive_subject(f, F.lit(None).cast("string"))) == ("b c", "sub_ 1", "default", "default", "unknown")
    assert one(spark, *text.split_key(F.lit("s::p\\q::r"))) == ("s", "p/q::r")
    assert one(spark, *text.split_key(F.lit("assets/player_9/a.jpg"))) == ("player_9", "assets/player_9/a.jpg")
    assert one(spark, text.has_extension(F.lit("A.JPG"), [".jpg"]), text.has_extension(F.lit(None).cast("string"), [".jpg"]), text.slide_index(F.lit("07-slide-a.PNG")), text.slide_index(F.lit("x.png"))) == (True, False, 7, None)
    assert text.unique_names(["a" * 40, "a" * 40, "b"]) == ["a" * 31, "a" * 29 + "_2", "b"]
    assert one(spark, text.safe_name(F.lit("a b/é")), text.undecorated(F.lit("['x']")), text.listed(F.array(F.lit("a"), F.lit("b")))) == ("a_b_é", "x", "a; b")
    assert one(spark, text.bigrams(F.array(F.lit("a"))), text.word_count(F.lit(" a  b ")), text.tokens(F.lit(None).cast("string"))) == ([], 2, [])
    assert "the" in text.default_stopwords(spark)


def test_json(spark):
    said = 'Sure {oops} {"a": {"b": [1, 2]}, "c": ["x"], "d": null} bye'
    assert one(spark, jsons.response_fields(F.lit(said)))[0] == {"a.b": "1; 2", "c": "x"}
    assert one(spark, jsons.response_fields(F.lit("none")))[0] is None
    df = spark.createDataFrame([({"b": "1"},), ({"a": "2", "c": "3"},)], "m map<string,string>")
    assert jsons.observed_keys(df, "m") == ["a", "b", "c"] and jsons.ordered_fields(["c"], ["a", "b", "c"]) == ["c", "a", "b"]
    assert [r[0] for r in df.select(jsons.field(F.col("m"), "a", "-")).collect()] == ["-", "2"]
    response = spark.createDataFrame([(([(([("x",), ("y",)],),)],),), (([],),)], "response struct<candidates array<struct<content struct<parts array<struct<text string>>>>>>")
    assert [r[0] for r in response.select(jsons.response_text(F.col("response"))).collect()] == ["xy", None]


def test_measures(spark):
    lit = F.lit
    assert one(spark, measures.intensity_db(lit(0.0)), measures.dbfs(lit(0.0)), measures.dbfs(lit(1.0)), measures.rgb_hex(lit(255), lit(0), lit(16))) == (0.0, -120.0, 0.0, "#FF0010")
    assert one(spark, measures.hex_luminance(lit("#zz")), measures.should_invert(lit("#101010"), lit(False)), measures.signal_status(lit(-90.0))) == (128.0, True, "silent_or_near_silent")
    assert one(spark, measures.scene_frames(lit(0), lit(10), "even", 3), measures.scene_frames(lit(4), lit(4), "boundaries"), measures.scene_frames(lit(0), lit(9))) == ([0, 5, 10], [4], [4])
    hues = spark.createDataFrame([(350.0,), (10.0,)], "h double").select(measures.hue_mean(F.col("h")), measures.hue_deviation(F.col("h"))).first()
    assert min(hues[0], 360 - hues[0]) == pytest.approx(0, abs=1e-6) and hues[1] == pytest.approx(10, abs=0.1)
    box = one(spark, measures.overlay_box(lit(1000), lit(500), lit(0.5), lit("bottom-right")))[0]
    assert (box["w"], box["h"]) == (60, 30) and box["x"] == 1000 - 60 - 14


def test_tables(spark, tmp_path):
    df = spark.createDataFrame([("1234567890123456789", 1.5, "a,\"b\""), ("9", None, "x\ny")], "id string, v double, t string")
    assert writers.save_csv(df, str(tmp_path / "t.csv")) and not writers.save_csv(df.where("false"), str(tmp_path / "no.csv"))
    back = readers.read_table(spark, str(tmp_path / "t.csv"), ["id"])
    assert {r["id"] for r in back.collect()} == {"1234567890123456789", "9"} and back.schema["v"].dataType.simpleString() == "double"
    writers.write_merged(df, str(tmp_path / "m.parquet"))
    assert readers.read_table(spark, str(tmp_path / "m.parquet"), ["v"]).schema["v"].dataType.simpleString() == "string"
    with pytest.raises(ValueError):
        readers.read_table(spark, "x.docx")
    assert readers.read_log(spark, str(tmp_path / "none.csv"), ["a"]).count() == 0
    (tmp_path / "l.jsonl").write_text('{"k": 1}\n\nbroken\n{"k": 2}\n')
    assert sorted(r["k"] for r in readers.read_lines(spark, str(tmp_path / "l.jsonl"), "k int").where("k IS NOT NULL").collect()) == [1, 2]
    (tmp_path / "ids.txt").write_text("a\n\n b \n")
    assert sorted(r[0] for r in readers.read_ids(spark, str(tmp_path / "ids.txt")).collect()) == ["a", "b"]
    assert readers.read_text(spark, str(tmp_path / "ids.txt")) == "a\n\n b \n"
    writers.write_lines(spark.createDataFrame([('{"a":1}',)], "line string"), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).first()["a"] == 1


def test_subject_partitions_are_replaced_alone(spark, tmp_path):
    path = str(tmp_path / "c")
    writers.write_subjects(spark.createDataFrame([("a", 1), ("b", 2)], "subject string, v int"), path)
    writers.write_subjects(spark.createDataFrame([("b", 3)], "subject string, v int"), path)
    assert {(r["subject"], r["v"]) for r in spark.read.parquet(path).collect()} == {("a", 1), ("b", 3)}
    assert "checkpoint" in readers.read_checkpoints(spark, path).columns


def test_workbook(spark, tmp_path):
    path = str(tmp_path / "b.xlsx")
    df = spark.createDataFrame([("é & <b>", 1.5, None), ("z", 2.0, "q")], "a string, b double, c string")
    writers.save_workbook({"First": df, "Empty": df.where("false"), "Second": df.select("a")}, path, note="Note")
    assert [tuple(r) for r in read_sheet(spark, path).limit(2).collect()] == [("é & <b>", "1.5", None), ("z", "2.0", "q")]
    register(spark)
    assert spark.read.format("tallygrid_xlsx").option("sheet", "Second").load(path).columns == ["a"]
    with pytest.raises(ValueError):
        list(sheet_rows(workbook({"x": (["a"], [[1]])}), "nope"))


def test_config():
    c = readers.PipelineConfig.of({"input": "i", "fields": "a,b"}, {"PIPELINE_BASE_DIR": "d", "PIPELINE_OUTPUT_DIR": "o"})
    assert c.base_dir == "d" and c.fields == ("a", "b")
    with pytest.raises(ValueError, match="output_dir"):
        readers.PipelineConfig.of({"input": "i", "base_dir": "b"}, {})


class Busy(Exception):
    code = 503


def client():
    class Client:  # local, so that it travels by value
        def analyze(self, x):
            if x == "bad":
                raise ValueError("no")
            return "" if x == "empty" else f'{{"said": "{x}"}}'

        def upload(self, path):
            return f"uri:{path}"

        def state(self, name):
            return "DONE"

    return Client()


def test_model_calls(spark):
    tries = []

    def flaky():
        tries.append(1)
        if len(tries) < 3:
            raise Busy
        return "x"

    assert model_calls.with_retry(flaky, 3, lambda s: None) == (True, "x", "", 3)
    rows = spark.createDataFrame([("hi",), ("bad",), ("empty",)], "path string")
    done = {r["path"]: r for r in model_calls.analyze(rows, client(), ["path"], pause=lambda s: None).collect()}
    assert done["hi"]["ok"] and done["hi"]["fields"] == {"said": "hi"} and done["bad"]["error"].startswith("ValueError") and done["empty"]["error"] == "blocked"
    assert {r["uri"] for r in model_calls.upload(rows, client()).collect()} == {"uri:hi", "uri:bad", "uri:empty"}
    log = spark.createDataFrame([("j",)], "job_name string")
    assert model_calls.poll(log, client(), 1, 5, ["DONE"], lambda s: None) == {"j": "DONE"}
    uris = spark.createDataFrame([("a", "2024-01-01T00:00:00"), ("b", "2024-01-03T00:00:00")], "path string, at string")
    assert [r["path"] for r in model_calls.expired(uris, "at", "2024-01-03T12:00:00").collect()] == ["a"]


def test_submit_and_download(spark):
    class Client:
        def submit(self, name, path):
            if name == "bad":
                raise ValueError(path)
            return f"jobs/{name}"

        def lines(self, job):
            if job == "jobs/gone":
                raise OSError("gone")
            for i in range(5):
                answer = {"candidates": [{"content": {"parts": [{"text": '{"a": {"b": '}, {"text": f"{i}}}}}"}]}}]}
                yield json.dumps({"key": f"s::p{i}", "response": answer if i else {}})
            yield "no json"

    jobs = model_calls.submit(spark.createDataFrame([("one", "x.jsonl"), ("bad", "y.jsonl"), ("gone", "z.jsonl")], "display_name string, jsonl_path string"), Client())
    log = [(r["job_name"], r["state"], r["error"]) for r in jobs.orderBy("display_name").collect()]
    assert log == [(None, "JOB_STATE_FAILED", "ValueError: y.jsonl"), ("jobs/gone", "JOB_STATE_PENDING", ""), ("jobs/one", "JOB_STATE_PENDING", "")]
    ended = jobs.withColumn("state", F.lit("JOB_STATE_SUCCEEDED")).where("job_name IS NOT NULL")
    rows = model_calls.download(ended, Client(), rows=2).collect()
    assert {(r["job_name"], r["key"], r["text"]) for r in rows if r["fields"]} == {("jobs/one", f"s::p{i}", f'{{"a": {{"b": {i}}}}}') for i in range(1, 5)}
    assert sorted(r["fields"]["a.b"] for r in rows if r["fields"]) == ["1", "2", "3", "4"]
    assert [r["error"] for r in rows if r["job_name"] == "jobs/gone"] == ["OSError: gone"] and len(rows) == 7


def test_streams(spark, tmp_path):
    source = str(tmp_path / "in")
    rows = spark.createDataFrame([(1, "2024-01-01 10:00:00", 2.0), (2, "2024-01-01 11:00:00", 4.0), (1, "2024-01-02 01:00:00", 6.0)], "k int, ts string, v double").withColumn("ts", F.to_timestamp("ts"))
    rows.write.parquet(source)
    schema = spark.read.parquet(source).schema
    stream = lambda: forms.read_new_files(spark, source, schema)
    forms.ingest_available(stream(), str(tmp_path / "out"), str(tmp_path / "c1")).awaitTermination()
    forms.ingest_available(stream(), str(tmp_path / "out"), str(tmp_path / "c1")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3
    batch = forms.windowed_trend(rows, "ts", "v").collect()
    assert {r["v_mean"] for r in batch} == {3.0, 6.0}
    q = forms.windowed_trend(stream(), "ts", "v").writeStream.format("memory").queryName("trend").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r["count"], r["v_mean"]) for r in spark.table("trend").collect()} == {(2, 3.0), (1, 6.0)}
    table = FileTable(spark, str(tmp_path / "last"))
    for _ in range(2):  # the second run finds nothing new
        forms.upsert_last(stream(), ["k"], "ts", table, str(tmp_path / "c2")).awaitTermination()
    assert {(r["k"], r["v"]) for r in table.read().collect()} == {(1, 6.0), (2, 4.0)} and table.version() == 1
    spark.createDataFrame([(2, "2023-01-01 00:00:00", 9.0), (3, "2024-01-05 00:00:00", 1.0), (1, "2024-02-01 00:00:00", 8.0)], "k int, ts string, v double").withColumn("ts", F.to_timestamp("ts")).write.mode("append").parquet(source)
    forms.upsert_last(stream(), ["k"], "ts", table, str(tmp_path / "c2")).awaitTermination()
    assert {(r["k"], r["v"]) for r in table.read().collect()} == {(1, 8.0), (2, 4.0), (3, 1.0)} and table.version() == 2
    assert forms.distinct_events(stream(), ["k"], "ts").isStreaming
