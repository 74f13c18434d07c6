"""A data source of text lines whose writes appear whole or not at all (K5, K6).

``df.write.format("atomic_lines").mode(...).save(path)`` writes a string column, and
``spark.read.format("atomic_lines").load(path)`` reads it. Each task streams its rows into a file of
its own below ``data`` and tells the driver that file's name and counts; the driver's commit names
all files in ``manifest/<n>.json``, which is written beside its place and moved there. Readers follow
the last manifest only, so a job that fails leaves nothing visible, a task that runs twice is counted
once, and a reader never sees half of an overwrite.

Paths are those of pyarrow's file systems. Files of failed tasks and of overwritten versions are
deleted by :func:`sweep`.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StringType, StructType

NAME = "atomic_lines"


def _base(path: str) -> tuple[fs.FileSystem, str]:
    system, base = fs.FileSystem.from_uri(path)
    return system, base.rstrip("/")


def versions(path: str) -> list[int]:
    """Committed versions, in order."""
    system, base = _base(path)
    names = [i.base_name for i in system.get_file_info(fs.FileSelector(f"{base}/manifest", allow_not_found=True))]
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))


def manifest(path: str) -> list[dict]:
    """``name``, ``rows`` and ``bytes`` of each live file."""
    known = versions(path)
    if not known:
        return []
    system, base = _base(path)
    with system.open_input_stream(f"{base}/manifest/{known[-1]:09}.json") as f:
        return json.loads(f.read())["files"]


def sweep(path: str) -> int:
    """Delete the files that no reader can see, and all manifests but the last; how many files went.
    No write may run meanwhile."""
    system, base = _base(path)
    live, gone = {f["name"] for f in manifest(path)}, 0
    for info in system.get_file_info(fs.FileSelector(f"{base}/data", allow_not_found=True)):
        if info.base_name not in live:
            system.delete_file(info.path)
            gone += 1
    for version in versions(path)[:-1]:
        system.delete_file(f"{base}/manifest/{version:09}.json")
    return gone


@dataclass
class Written(WriterCommitMessage):
    name: str
    rows: int
    bytes: int


class LinesWriter(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path, overwrite

    def write(self, iterator: Iterator) -> Written:
        system, base = _base(self.path)
        system.create_dir(f"{base}/data", recursive=True)
        name, rows, size = f"{uuid.uuid4().hex}.jsonl", 0, 0
        with system.open_output_stream(f"{base}/data/{name}") as f:
            for row in iterator:
                if row[0] is None:
                    continue
                if "\n" in row[0]:
                    raise ValueError("a line holds a line break")
                line = row[0].encode() + b"\n"
                f.write(line)
                rows, size = rows + 1, size + len(line)
        return Written(name, rows, size)

    def commit(self, messages: list[Written | None]) -> None:
        system, base = _base(self.path)
        files = [] if self.overwrite else manifest(self.path)
        files += [vars(m) for m in messages if m is not None and m.rows]
        last = max(versions(self.path), default=0)
        system.create_dir(f"{base}/manifest", recursive=True)
        part = f"{base}/manifest/.{uuid.uuid4().hex}"
        with system.open_output_stream(part) as f:
            f.write(json.dumps({"files": files}).encode())
        system.move(part, f"{base}/manifest/{last + 1:09}.json")

    def abort(self, messages: list[Written | None]) -> None:
        system, base = _base(self.path)
        for m in messages:
            if m is not None:
                system.delete_file(f"{base}/data/{m.name}")


@dataclass
class Part(InputPartition):
    name: str


class LinesReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[Part]:
        return [Part(f["name"]) for f in manifest(self.path)]

    def read(self, partition: Part) -> Iterator[tuple[str]]:
        if getattr(partition, "name", None) is None:  # a table without files has one empty partition
            return
        system, base = _base(self.path)
        rest = b""
        with system.open_input_stream(f"{base}/data/{partition.name}") as f:
            while block := f.read(1 << 20):
                *lines, rest = (rest + block).split(b"\n")
                for line in lines:
                    yield (line.decode(),)


class AtomicLines(DataSource):
    """Register with ``spark.dataSource.register(AtomicLines)``."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "value string"

    def writer(self, schema: StructType, overwrite: bool) -> LinesWriter:
        if len(schema.fields) != 1 or not isinstance(schema.fields[0].dataType, StringType):
            raise ValueError("lines are one column of strings")
        return LinesWriter(self.options["path"], overwrite)

    def reader(self, schema: StructType) -> LinesReader:
        return LinesReader(self.options["path"])
