"""Calls of an external model with an injected client.

A client is any picklable object with the method that a function names; none is included.
Calls run inside Spark tasks, one client per task; failures become rows, never exceptions.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallygrid.functions.jsons import response_fields, response_text
from tallygrid.operators.shared_stop import Pace, SharedStop

#: Answers that are worth another try.
AGAIN = frozenset({429, 500, 502, 503, 504})
OUTCOME = "ok boolean, text string, error string, tries int"
#: What an error says when the storage of uploads is full, a fixed value; no further call can succeed.
QUOTA = "file_storage_bytes"
#: The error of rows that were not tried after a stop.
STOPPED = "stopped"


def with_retry(call: Callable[[], str], tries: int = 3, pause: Callable[[float], None] = time.sleep) -> tuple[bool, str | None, str, int]:
    """``ok``, text, error and the tries of a call; waits 2, 4, ... seconds between tries.

    An error is worth another try if it has a ``code`` of :data:`AGAIN`.
    """
    for attempt in range(1, tries + 1):
        try:
            return True, call(), "", attempt
        except Exception as e:  # the row records it
            if getattr(e, "code", None) not in AGAIN or attempt == tries:
                return False, None, f"{type(e).__name__}: {e}", attempt
            pause(2.0 ** attempt)
    raise AssertionError


def calls(call: Callable[..., str], tries: int, pause: Callable[[float], None], stop: SharedStop | None, per_second: float | None, tasks: int) -> Callable[..., tuple[bool, str | None, str, int]]:
    """A task's calls, at its share of the rate: each looks for the stop first, and one whose error
    names the quota sets it. Rows after a stop have no tries and the error ``stopped``."""
    pace = Pace(per_second, tasks, pause=pause)

    def one(*values) -> tuple[bool, str | None, str, int]:
        if stop is not None and stop.reason() is not None:
            return False, None, STOPPED, 0
        pace.wait()
        found = with_retry(lambda: call(*values), tries, pause)
        if stop is not None and QUOTA in found[2]:
            stop.set(found[2])
        return found

    return one


def _tasks(rows: DataFrame, per_second: float | None, tasks: int) -> DataFrame:
    """Rows dealt to so many tasks if a rate is to be shared."""
    return rows.repartition(tasks) if per_second else rows


def analyze(
    rows: DataFrame, client: object, columns: Sequence[str], tries: int = 3, pause: Callable[[float], None] = time.sleep,
    stop: SharedStop | None = None, per_second: float | None = None, tasks: int = 16,
) -> DataFrame:
    """``rows`` with the outcome of ``client.analyze(values of columns)`` and its fields as a map
    (X1, X7). An empty answer counts as blocked. With ``per_second`` the rows go to ``tasks`` tasks,
    which share that rate; ``stop`` is looked for before each call."""

    def stream(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = calls(client.analyze, tries, pause, stop, per_second, tasks)
        for part in parts:
            found = [call(*v) for v in part[list(columns)].itertuples(index=False, name=None)]
            ok, text, error, n = zip(*found, strict=True) if found else ((), (), (), ())
            blocked = [o and not t for o, t in zip(ok, text, strict=True)]
            yield part.assign(ok=[o and not b for o, b in zip(ok, blocked, strict=True)], text=list(text), error=["blocked" if b else e for b, e in zip(blocked, error, strict=True)], tries=list(n))

    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields], OUTCOME])
    done = _tasks(rows, per_second, tasks).mapInPandas(stream, schema)
    return done.withColumn("fields", response_fields("text")).withColumn("ok", F.col("ok") & F.col("fields").isNotNull())


def upload(
    files: DataFrame, client: object, tries: int = 3, pause: Callable[[float], None] = time.sleep,
    stop: SharedStop | None = None, per_second: float | None = None, tasks: int = 16,
) -> DataFrame:
    """``files`` (subject, path) with ``uri`` by ``client.upload(path)`` (X11), with a stop and a rate
    as in :func:`analyze`. What was not uploaded is uploaded by the next run, once the stop is cleared."""

    def stream(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = calls(client.upload, tries, pause, stop, per_second, tasks)
        for part in parts:
            found = [call(p) for p in part["path"]]
            yield part.assign(ok=[x[0] for x in found], uri=[x[1] for x in found], error=[x[2] for x in found])

    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema.fields], "ok boolean, uri string, error string"])
    return _tasks(files, per_second, tasks).mapInPandas(stream, schema)


def expired(uris: DataFrame, uploaded_at: str, now: str, hours: int = 48) -> DataFrame:
    """Uploads that are too old to be read (X10); upload them again."""
    return uris.where(F.to_timestamp(F.lit(now)) - F.to_timestamp(uploaded_at) >= F.make_dt_interval(hours=F.lit(hours)))


def submit(batches: DataFrame, client: object, tries: int = 3, pause: Callable[[float], None] = time.sleep) -> DataFrame:
    """``batches`` (``display_name``, ``jsonl_path``) with ``job_name`` by ``client.submit(display_name,
    jsonl_path)``, ``state`` and ``error`` (X5); rows of the job log. A batch is submitted once: the
    result is to be written before it is read again."""

    def stream(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            found = [with_retry(lambda b=b: client.submit(*b), tries, pause) for b in part[["display_name", "jsonl_path"]].itertuples(index=False, name=None)]
            yield part.assign(job_name=[x[1] for x in found], state=["JOB_STATE_PENDING" if x[0] else "JOB_STATE_FAILED" for x in found], error=[x[2] for x in found])

    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in batches.schema.fields], "job_name string, state string, error string"])
    return batches.mapInPandas(stream, schema)


def download(log: DataFrame, client: object, done: str = "JOB_STATE_SUCCEEDED", rows: int = 1000) -> DataFrame:
    """``job_name``, ``key``, ``text`` and ``fields`` of the response lines of jobs that succeeded, by
    ``client.lines(job_name)`` (X5, N4). Lines are streamed; one that is no JSON has null fields, and
    a job that cannot be read has one row with its error as ``error``."""

    def stream(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for job in part["job_name"]:
                held, error = [], None
                try:
                    for line in client.lines(job):
                        held.append(line)
                        if len(held) >= rows:
                            yield pd.DataFrame({"job_name": job, "line": held, "error": None})
                            held = []
                except Exception as e:  # the row records it
                    error = f"{type(e).__name__}: {e}"
                if held or error:
                    yield pd.DataFrame({"job_name": job, "line": [*held, *([None] if error else [])], "error": [*[None] * len(held), *([error] if error else [])]})

    ended = log.where(F.col("state") == done).select("job_name").distinct()
    lines = ended.mapInPandas(stream, "job_name string, line string, error string")
    # A line that is no JSON is null.
    kind = "key string, response struct<candidates array<struct<content struct<parts array<struct<text string>>>>>>"
    read = lines.withColumn("r", F.from_json("line", kind)).withColumn("text", F.nullif(response_text(F.col("r.response")), F.lit("")))
    return read.select("job_name", "r.key", "text", response_fields("text").alias("fields"), "error")


def poll(log: DataFrame, client: object, every: float, most: float, done: Sequence[str], pause: Callable[[float], None] = time.sleep) -> dict[str, str]:
    """State of every job once all have ended or the time is over (X5). Jobs are a few rows."""
    names, waited = [r[0] for r in log.select("job_name").distinct().collect()], 0.0
    while True:
        states = {n: client.state(n) for n in names}
        if all(s in done for s in states.values()) or waited >= most:
            return states
        pause(every)
        waited += every
