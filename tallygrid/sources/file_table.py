"""A table of Parquet files that is changed file by file.

Its folder holds ``data/<write>/…`` with files that are never changed and ``manifest/<version>.json``
with the live ones. A merge finds the files that hold a changed key, rewrites those and no others, and
makes a new manifest; creating that file, which fails if it is there, is the commit. A write that
dies before it leaves files that no manifest names, and two writers cannot both make a version.

Only names of files reach the driver, where Spark itself lists them.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallygrid.shared import stored

FILE = "_file"


class Conflict(RuntimeError):
    """Another write has made this version."""


class FileTable:
    """A table at ``path``, which any of Spark's file systems may hold."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._fs = self._hadoop.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, *parts: str):
        return self._hadoop.Path("/".join([self.path, *parts]))

    def version(self) -> int:
        """The last version; 0 before the first write."""
        folder = self._at("manifest")
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
        return max((int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith((".", "_"))), default=0)

    def manifest(self, version: int | None = None) -> dict:
        """``files``, ``schema`` and ``note`` of a version."""
        version = self.version() if version is None else version
        if not version:
            return {"files": [], "schema": None, "note": None}
        stream = self._fs.open(self._at("manifest", f"{version:012}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, by default of the last."""
        held = self.manifest(version)
        if held["schema"] is None:
            raise ValueError(f"nothing was written to {self.path}")
        return self._files(held["files"], held["schema"])

    def _files(self, files: Sequence[str], schema: str) -> DataFrame:
        kind = T.StructType.fromJson(json.loads(schema))
        if not files:
            return self.spark.createDataFrame([], kind)
        return self.spark.read.schema(kind).parquet(*[f"{self.path}/{f}" for f in files])

    def _write(self, rows: DataFrame) -> list[str]:
        """Files of ``rows``, not yet in any manifest."""
        name = f"data/{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/{name}")
        return sorted(f"{name}/{s.getPath().getName()}" for s in self._fs.listStatus(self._at(name)) if s.getPath().getName().startswith("part-") and s.getLen())

    def _commit(self, version: int, files: list[str], schema: str, note: str | None) -> None:
        path = self._at("manifest", f"{version:012}.json")
        try:
            stream = self._fs.create(path, False)
        except Exception as e:
            raise Conflict(f"version {version} of {self.path} is there") from e
        try:
            stream.write(bytearray(json.dumps({"files": files, "schema": schema, "note": note}).encode()))
        finally:
            stream.close()

    def append(self, rows: DataFrame, note: str | None = None) -> int:
        """Add rows; the new version. The first write settles the columns."""
        version = self.version()
        held = self.manifest(version)
        schema = held["schema"] or rows.schema.json()
        names = [f["name"] for f in json.loads(schema)["fields"]]
        self._commit(version + 1, held["files"] + self._write(rows.select(*[F.col(f"`{c}`") for c in names])), schema, note)
        return version + 1

    def merge(
        self, changes: DataFrame, key: Column, change_key: Column, change: Callable[[DataFrame, DataFrame], DataFrame],
        insert: Callable[[DataFrame], DataFrame] | None = None, note: str | None = None,
    ) -> dict[str, int]:
        """Rewrite the files that hold a ``key`` among the changes' ``change_key``.

        ``change`` gets the rows of those files and the changes and gives the files' new rows;
        ``insert``, if given, gets the changes whose key no row has and gives rows to add. The new
        ``version``, and how many files were ``rewritten``, ``kept`` and ``written``.
        """
        version = self.version()
        held = self.manifest(version)
        now = self.read(version)
        known = changes.withColumn("_key", change_key)
        keys = now.select(key.alias("_key"), F.col("_metadata.file_path").alias(FILE))
        hits = stored(keys.join(known.select("_key").distinct(), "_key", "left_semi").distinct())
        by_name = {f.rsplit("/", 2)[-2] + "/" + f.rsplit("/", 1)[-1]: f for f in held["files"]}
        touched = sorted({by_name["/".join(r[FILE].rsplit("/", 2)[-2:])] for r in hits.select(FILE).distinct().collect()})
        written, names = [], [F.col(f"`{c}`") for c in now.columns]
        new = []
        if touched:
            new.append(change(self._files(touched, held["schema"]), changes).select(*names).repartition(len(touched)))
        if insert is not None:
            fresh = stored(insert(known.join(hits.select("_key").distinct(), "_key", "left_anti").drop("_key")).select(*names))
            if not fresh.isEmpty():
                new.append(fresh)
        if new:
            written = self._write(reduce(DataFrame.unionByName, new))
        kept = [f for f in held["files"] if f not in set(touched)]
        if touched or written:
            version += 1
            self._commit(version, kept + written, held["schema"], note)
        return {"version": version, "rewritten": len(touched), "kept": len(kept), "written": len(written)}

    def forget(self, keep: int = 1) -> int:
        """Delete manifests before the last ``keep`` versions and files that no manifest left
        names; the number of files deleted. No write may run meanwhile."""
        last = self.version()
        live = {f for v in range(max(1, last - keep + 1), last + 1) for f in self.manifest(v)["files"]}
        gone = 0
        for v in range(1, last - keep + 1):
            self._fs.delete(self._at("manifest", f"{v:012}.json"), False)
        folder = self._at("data")
        for d in self._fs.listStatus(folder) if self._fs.exists(folder) else []:
            own = [s.getPath().getName() for s in self._fs.listStatus(d.getPath())]
            if not any(f"data/{d.getPath().getName()}/{n}" in live for n in own):
                self._fs.delete(d.getPath(), True)
                gone += sum(n.startswith("part-") for n in own)
                continue
            for n in own:
                if n.startswith("part-") and f"data/{d.getPath().getName()}/{n}" not in live:
                    self._fs.delete(self._at("data", d.getPath().getName(), n), False)
                    gone += 1
        return gone
