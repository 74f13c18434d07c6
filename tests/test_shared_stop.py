"""A quota met by one task stops all, and tasks share a rate."""

import os
import time

import pytest
from pyspark.sql import functions as F

from tallygrid.operators import model_calls
from tallygrid.operators.shared_stop import Pace, SharedStop


def client(log, full_at):
    class Client:
        """Notes each call in a file; the quota is full once ``full_at`` files were noted."""

        def upload(self, path):
            with open(f"{log}/{time.time_ns()}-{path}", "w"):
                pass
            if len(os.listdir(log)) >= full_at:
                raise RuntimeError("429 quota file_storage_bytes exceeded")
            time.sleep(0.01)
            return f"uri:{path}"

    return Client()


def test_no_task_calls_after_the_quota(spark, tmp_path):
    log = tmp_path / "calls"
    log.mkdir()
    stop = SharedStop(str(tmp_path / "stop"))
    files = spark.range(400).select(F.col("id").cast("string").alias("path")).repartition(4)
    rows = model_calls.upload(files, client(str(log), 40), stop=stop, pause=lambda s: None).collect()
    assert len(rows) == 400 and "file_storage_bytes" in stop.reason()
    # Calls that had begun when the quota answered may end: one for each of the four tasks.
    assert 40 <= len(os.listdir(log)) <= 44
    assert sum(r["ok"] for r in rows) >= 36 and {r["error"] for r in rows if not r["ok"]} >= {model_calls.STOPPED}
    before = len(os.listdir(log))
    again = model_calls.upload(files, client(str(log), 10_000), stop=stop, pause=lambda s: None)
    assert {r["error"] for r in again.collect()} == {model_calls.STOPPED} and len(os.listdir(log)) == before
    stop.clear()
    assert all(r["ok"] for r in again.limit(5).collect()) and stop.reason() is None
    stop.clear()


def test_pace():
    now, waits = [0.0], []

    def pause(s):
        waits.append(s)
        now[0] += s

    pace = Pace(2.0, 4, clock=lambda: now[0], pause=pause)  # two a second over four tasks: one in two seconds here
    for _ in range(3):
        pace.wait()
    now[0] += 5
    pace.wait()
    assert waits == [2.0, 2.0] and Pace(None, 4).every == 0


def test_rate_deals_rows_to_tasks(spark):
    class Client:
        def analyze(self, x):
            return '{"said": "%s"}' % x

    rows = spark.createDataFrame([("a",), ("b",)], "x string")
    done = model_calls.analyze(rows, Client(), ["x"], per_second=1000.0, tasks=3)
    assert {r["fields"]["said"] for r in done.collect()} == {"a", "b"}


@pytest.mark.parametrize("reason", ["full", "é"])
def test_flag(tmp_path, reason):
    stop = SharedStop(f"file://{tmp_path}/s")
    assert stop.reason() is None
    stop.set(reason)
    stop.set(reason)
    assert stop.reason() == reason and os.listdir(tmp_path) == ["s"]
