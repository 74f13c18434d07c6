"""Checkpoint algebra and batches on hand-made tables."""

import pytest
from pyspark.sql import functions as F

from tallygrid.operators import batches, checkpoints, greedy_batches


def test_merge(spark):
    a = spark.createDataFrame([("1", "x.jpg", "old"), ("2", "y.jpg", "only")], "id string, file string, v string")
    b = spark.createDataFrame([("1", "x.jpg", "new"), ("1", "x.jpg", "newest")], "id string, file string, v string")
    merged, removed = checkpoints.merge_checkpoints({"a": a, "b": b, "_draft": a}, ["id", "file"])
    assert {r["id"]: r["v"] for r in merged.collect()} == {"1": "newest", "2": "only"} and removed.first()[0] == 2
    again, none = checkpoints.merge_checkpoints({"all": merged}, ["id", "file"])
    assert again.count() == 2 and none.first()[0] == 0


def test_merge_reports_everything(spark):
    a = spark.createDataFrame([("1", "x")], "id string, v string")
    with pytest.raises(checkpoints.MergeError) as e:
        checkpoints.merge_checkpoints({"a": a, "b": a.select("v", "id"), "c": a.withColumn("w", F.lit(1)), "d": a.select("id", F.col("v").alias("id"))}, ["id", "file"])
    assert len(e.value.problems) >= 5
    with pytest.raises(checkpoints.MergeError):
        checkpoints.merge_checkpoints({}, ["id"])


def test_retries(spark):
    rows = spark.createDataFrame([("a\\1.jpg", "", False, None), ("a/2.jpg", "", False, 2), ("a/3.jpg", "", False, 3), ("a/4.jpg", "fine", True, None)], "file string, label string, model_ok boolean, retry_count int")
    assert checkpoints.retryable(rows).count() == 2 and checkpoints.exhausted(rows).count() == 1
    again = spark.createDataFrame([("a/1.jpg", "got", True), ("a/2.jpg", "bad", False)], "file string, label string, model_ok boolean")
    done = {r["file"]: (r["label"], r["model_ok"], r["retry_count"]) for r in checkpoints.apply_retries(rows, again, "file", ["label"]).collect()}
    assert done == {"a\\1.jpg": ("got", True, 1), "a/2.jpg": ("", False, 3), "a/3.jpg": ("", False, 3), "a/4.jpg": ("fine", True, None)}
    summary = {r["subject"]: r for r in checkpoints.retry_summary(rows.withColumn("subject", F.lit("a"))).collect()}
    assert summary["a"]["retryable"] == 2 and summary[None]["error_pct"] == 75.0


def test_review_and_coverage(spark):
    rows = spark.createDataFrame([("s", "1", "x", True), ("s", "2", " ", True), ("t", "3", None, False)], "subject string, file string, label string, model_ok boolean")
    found = {r["subject"]: r for r in checkpoints.review(rows, ["label"]).collect()}
    assert found["s"]["issues"] == ["blank label in good rows"] and "no good rows" in found["t"]["issues"]
    assert checkpoints.blocked(checkpoints.review(rows, ["label"])) and not checkpoints.blocked(checkpoints.review(rows, ["label"]), fix=True)
    steps = {r["subject"]: r["step"] for r in checkpoints.coverage(rows, rows.where("file <> '2'"), "subject", "file").collect()}
    assert steps == {"s": "warn", "t": "write"}
    assert checkpoints.field_coverage(rows, ["label"]).first()["n_filled"] == 1
    totals = {r["subject"]: (r["ok"], r["failed"]) for r in checkpoints.outcome_counts(rows, ok="model_ok").collect()}
    assert totals == {"s": (2, 0), "t": (0, 1), None: (2, 1)}


def test_columns():
    assert checkpoints.source_columns(["id", "file"], "file", ["g", "id"]) == ["id", "file", "g"]
    assert checkpoints.column_order_issues(["b", "a"], ["a", "b"]) == ["columns out of order"]
    assert checkpoints.column_order_issues(["a", "a"], ["a", "c"]) == ["missing column: c", "duplicate column: a"]


def test_joins(spark):
    source = spark.createDataFrame([("s", "d\\1.jpg"), ("s", "d/2.jpg")], "subject string, file string")
    results = spark.createDataFrame([("d/1.jpg", {"tone": "warm"})], "path string, fields map<string,string>")
    rows = checkpoints.reordered(checkpoints.join_results(source, results, "file", ["tone"]), ["file"], ["tone"])
    assert rows.columns == ["file", "tone", "subject", "model_ok"]
    assert {r["file"]: (r["tone"], r["model_ok"]) for r in rows.collect()} == {"d\\1.jpg": ("warm", True), "d/2.jpg": ("", False)}
    assert checkpoints.requested(source, source.limit(1), "file").count() == 1 and checkpoints.pending(source, source.limit(1), "file").count() == 1
    log = spark.createDataFrame([("r1", "JOB_STATE_FAILED"), ("r2", None), ("x", "RUNNING")], "job_name string, state string")
    assert [r["job_name"] for r in checkpoints.live_jobs(log, prefix="r").collect()] == ["r2"]
    uris = source.select("subject", F.col("file").alias("path"))
    assert checkpoints.remaining_uris(uris, uris.limit(1)).count() == 1
    assert checkpoints.merge_lenient([source, log]).columns == ["subject", "file", "job_name", "state"]
    issues = checkpoints.row_issues({"no subject": ~checkpoints.not_blank(F.col("subject")), "flat": ~F.contains("file", F.lit("/"))})
    assert sorted(map(tuple, (r[0] for r in source.select(issues).collect()))) == [(), ("flat",)]


def test_batches(spark):
    items = spark.createDataFrame([("k", i, n) for i, n in enumerate((60, 30, 20, 90, 200, 1))] + [("m", 0, 10)], "key string, i int, n long")
    done = {(r["key"], r["i"]): r["batch"] for r in greedy_batches.split_by_size(items, "key", "n", 100, ["i"]).collect()}
    assert [done["k", i] for i in range(6)] == [0, 0, 1, 2, 3, 4] and done["m", 0] == 0
    sizes = spark.createDataFrame([("a", 5), ("b", 5), ("c", 7), ("d", 1)], "subject string, bytes long")
    odd = spark.createDataFrame([(None, i, 60) for i in range(3)] + [("a", 1, None), ("a", 2, 70), ("a", 3, 70)], "key string, i int, n int")
    assert sorted(r["batch"] for r in greedy_batches.split_by_size(odd, "key", "n", 100, ["i"]).where("key IS NULL").collect()) == [0, 1, 2]
    assert [r["batch"] for r in greedy_batches.split_by_size(odd, "key", "n", 100, ["i"]).where("key = 'a'").orderBy("i").collect()] == [0, 0, 1]
    assert {r["subject"]: r["running_bytes"] for r in batches.quota_prefix(sizes, 11).collect()} == {"d": 1, "a": 6, "b": 11}
    keys = {r["subject"]: r["key_id"] for r in batches.spread_over_keys(sizes, 2).collect()}
    assert keys == {"c": 0, "a": 1, "b": 1, "d": 0}
    names = spark.createDataFrame([("b_3.jsonl",), ("b_12.jsonl",), ("c_99",)], "name string")
    assert batches.next_number(names, "b_").first()[0] == 13
    assert batches.strategy(sizes).first()[0] == "live" and batches.retry_strategy(spark.range(501)).first()[0] == "batch"


def test_requests_and_log(spark):
    rows = spark.createDataFrame([("s", "a\\v.MP4", " "), ("s", "none.jpg", "x")], "subject string, file string, title string")
    uris = spark.createDataFrame([("s", "a/v.MP4", "uri:1")], "subject string, path string, uri string")
    lines = batches.requests(rows, uris, "file", "Look.", [("Title", "title")]).collect()
    assert len(lines) == 1 and lines[0]["key"] == "s::a/v.MP4" and '"mime_type":"video/mp4"' in lines[0]["line"] and "Title: Unknown" in lines[0]["line"]
    keys = spark.createDataFrame([("s::a/b",), ("x/assets/player_k/c.jpg",)], "key string")
    assert [r[0] for r in batches.subjects_of(keys).collect()] == ["player_k", "s"]
    log = spark.createDataFrame([("j1", "RUNNING", "t0", "kept")], "job_name string, state string, created_at string, extra string")
    new = batches.upsert_jobs(log, spark.createDataFrame([("j1", "DONE"), ("j2", "NEW")], "job_name string, state string"), "t1")
    assert {r["job_name"]: (r["state"], r["created_at"], r["extra"], r["updated_at"]) for r in new.collect()} == {"j1": ("DONE", "t0", "kept", "t1"), "j2": ("NEW", "t1", None, "t1")}
    assert batches.failed_sources(rows, rows.limit(1), "file").count() == 1


def test_quota_prefix_of_many(spark):
    """Running totals over ranges are those of the whole list, with many subjects of one size."""
    sizes = sorted(((i * 37) % 11 if i % 2 else 5, f"s{i:04}") for i in range(600))
    frame = spark.createDataFrame([(s, b) for b, s in sizes], "subject string, bytes long").repartition(3)
    want, total = {}, 0
    for b, s in sizes:
        total += b
        if total <= 1500:
            want[s] = total
    assert {r["subject"]: r["running_bytes"] for r in batches.quota_prefix(frame, 1500).collect()} == want


def test_spread_over_keys(spark):
    """The placing is that of a heap, one by one, whether sizes differ or repeat."""
    for sizes in ([(f"s{i:03}", (i * 7919) % 1000 + 1) for i in range(300)] + [("none", None)], [(f"s{i:03}", (i * 7) % 5) for i in range(211)], [("a", 0), ("b", 0)]):
        frame = spark.createDataFrame(sizes, "subject string, bytes long").repartition(3)
        load, want = [0] * 4, {}
        for name, n in sorted(sizes, key=lambda s: (-(s[1] or 0), s[0])):
            want[name] = load.index(min(load))
            load[want[name]] += n or 0
        assert {r["subject"]: r["key_id"] for r in batches.spread_over_keys(frame, 4).collect()} == want
    assert batches.spread_over_keys(frame.where("false"), 4).count() == 0
